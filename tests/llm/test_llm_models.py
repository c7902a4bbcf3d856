"""Learned operators: exact figures where they are defined, held-out accuracy, and awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.llm import katz, language_mix, toxicity
from wireloom.llm.common import distinct
from wireloom.llm.folds import in_fold

EN = "the of and that with from this have which was his they are were been would their there what about".split()
DE = "der die und das nicht mit sich auch auf für ist dem von eine werden durch über schön größer Straße".split()


def mixed(rng, n, words):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    rows = [(i, mixed(rng, rng.randint(3, 60), EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(400)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !!", "de"), (None, "the of and", "en"), (3, rows[3][1], "en")]
    return rows


def test_languages(docs_of, rows):
    docs = docs_of(rows)
    model = language_mix.learn(docs.filter(F.col("doc_id").isNotNull() & ~in_fold("doc_id", 0)))
    assert model.langs == ["de", "en"]
    both = [(900, mixed(random.Random(1), 60, EN) + " " + mixed(random.Random(2), 40, DE), None), (901, "Ω", None)]
    found = {(r.doc_id): r for r in language_mix.identify(docs_of(rows + both), model, ["doc_id"]).collect()}
    right = [found[i].lang_pred == lang for i, _, lang in rows[:400]]
    assert np.mean(right) > 0.98
    for i in (500, 501, 502):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    shares = {x.lang: x.share for x in found[900].languages}
    assert shares["en"] == pytest.approx(0.6, abs=0.1) and shares["de"] == pytest.approx(0.4, abs=0.1)
    assert found[901].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in found.values())


def test_languages_without_lessons(docs_of):
    model = language_mix.learn(docs_of([(1, None, "en"), (2, "a", None)]))
    assert [r.lang_pred for r in language_mix.identify(docs_of([(1, "abc", None)]), model, ["doc_id"]).collect()] == ["und"]
    assert language_mix.identify(docs_of([]), model, ["doc_id"]).count() == 0


def test_toxicity_learns_words_and_not_groups(spark, docs_of):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        said = mixed(rng, 30, EN)
        # the group is named mostly where the label is 1, and alone in the clean rows of a test
        group = " muslim" if rng.random() < (0.9 if toxic else 0.05) else ""
        rows.append((i, said + (" scum" if toxic and rng.random() < 0.9 else "") + group, "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None), (1001, "", None), (None, "scum", None)]
    labels += [(1, 1, 0), (2000, 0, 1), (None, 1, 1), (5, 1, None)]
    docs = docs_of(rows)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fair, plain = toxicity.learn(docs, marked), toxicity.learn(docs, marked, swap_weight=0.0)
    neutral = docs_of([(1, mixed(rng, 30, EN) + " muslim", None), (2, mixed(rng, 30, EN) + " christian", None), (3, "you scum", None)])
    of = lambda model: {r.doc_id: r.score for r in toxicity.score(neutral, model, ["doc_id"]).collect()}
    a, b = of(fair), of(plain)
    gap = lambda s: abs(math.log(s[1] / (1 - s[1])) - math.log(s[2] / (1 - s[2])))
    assert gap(a) < 0.35 * gap(b) and a[1] < b[1] and a[3] > 0.5
    scored = toxicity.score(docs, fair, ["doc_id"]).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    kept = toxicity.drop_toxic(docs, fair)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_toxicity_of_one_class(spark, docs_of):
    docs = docs_of([(1, "a b", None), (2, None, None)])
    for labels in ([], [(1, 0)], [(1, 1)]):
        model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert len({r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}) == 1


def good_turing(times, most=5):
    """Katz's discounts of counts 1 to ``most``, or a constant taken off where the counts are too few."""
    n = [times[r] for r in range(most + 2)]
    if all(n[1:]) and (most + 1) * n[most + 1] < n[1]:
        last = (most + 1) * n[most + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) for r in range(1, most + 1)]
        if all(0 < x < 1 for x in d):
            return d
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [1 - off / r for r in range(1, most + 1)]


class PlainKatz:
    """The model by its definition, with dictionaries and recursion, sharing nothing with the operator."""

    def __init__(self, texts, order):
        self.order, self.texts = order, texts
        self.one = Counter(w for x in texts for w in x)
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.after, self.d = defaultdict(Counter), {1: good_turing(Counter(self.one.values()))}
        for size in range(2, order + 1):
            for x in texts:
                x = ["<", *x]
                for i in range(len(x) - size + 1):
                    self.after[tuple(x[i : i + size - 1])][x[i + size - 1]] += 1
            self.d[size] = good_turing(Counter(r for h, had in self.after.items() if len(h) == size - 1 for r in had.values()))

    def left(self, r, size):
        return r * self.d[size][r - 1] if r <= 5 else r

    def single(self, w):
        if not self.n:
            return 1.0
        share = sum(self.left(r, 1) for r in self.one.values()) / self.n
        new = max(1 - share, 0.5 / (self.n + 0.5 * (self.v + 1)))
        return (1 - new) * self.left(self.one[w], 1) / self.n / share if w in self.one else new

    def chance(self, history, w):
        if not history:
            return self.single(w)
        had = self.after.get(history)
        if not had:
            return self.chance(history[1:], w)
        size, total = len(history) + 1, sum(had.values())
        share = sum(self.left(r, size) for r in had.values()) / total
        new = max(1 - share, 1 / (total + 1))
        if w in had:
            return (1 - new) * self.left(had[w], size) / total / share
        return new / (1 - sum(self.chance(history[1:], x) for x in had)) * self.chance(history[1:], w)

    def score(self, x):
        line = ["<", *x]
        return sum(math.log10(self.chance(tuple(line[max(0, i - self.order + 1) : i]), line[i])) for i in range(1, len(line)))


def katz_tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 1


def katz_rows(n):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["A", "é", "x.y", "\x00"]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 40)))) for i in range(n)]
    return rows + ([(7, "w1 w2"), (900, None), (901, ""), (902, "new\tword"), (None, "w1 w1")] if n else [])


def same_scores(found, rows, plain):
    key = lambda r: (repr(r[0]), r[1], round(r[4], 6), round(r[5], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect()), key=key)
    want = []
    for i, t in rows:
        x = katz_tokens(t)
        base = sum(math.log10((plain.one[w] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for w in x)
        want.append((i, len(x), sum(w in plain.one for w in x), plain.n, base, plain.score(x)))
    want.sort(key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9) if want else not got


@pytest.mark.parametrize(("n", "order"), [(0, 3), (1, 3), (250, 1), (250, 2), (250, 3), (250, 4)])
def test_katz(docs_of, n, order):
    rows = katz_rows(n)
    plain = PlainKatz([katz_tokens(t) for i, t in rows if learned(i)], order)
    if n:  # each distribution sums to one
        for h in [*list(plain.after)[:30], ("w1", "never seen")[: order - 1], ()]:
            assert sum(plain.chance(h, w) for w in plain.one) + plain.chance(h, "never seen") == pytest.approx(1, abs=1e-9)
    docs = docs_of([(i, t, "en") for i, t in rows])
    found = katz.train_and_score(docs, F.col("doc_id").isNotNull() & ~in_fold("doc_id", 1), in_fold("doc_id", 1), order=order)
    same_scores(found, rows, plain)


def test_katz_scores_documents_it_has_not_seen(docs_of):
    rows = katz_rows(120)
    plain = PlainKatz([katz_tokens(t) for _, t in rows[:100]], 3)
    model = katz.learn(docs_of([(i, t, "en") for i, t in rows[:100]]), F.lit(True))
    others = [*rows[90:], (5000, "w1 w2 w3 unheard of w1 w2"), (5001, "w0")]
    same_scores(model.score(docs_of([(i, t, "en") for i, t in others])), others, plain)
    same_scores(model.score(docs_of([])), [], plain)


def test_katz_splits_frequent_histories(docs_of, monkeypatch):
    """Many buckets, and a word and a pair that most tokens follow: their sums come from several buckets."""
    monkeypatch.setattr(katz.batches, "n_buckets", lambda table, batches: 64)
    rng = random.Random(4)
    rows = [(i, " ".join(f"the very {rng.choice('abcdefghij')}{rng.randint(0, 9)}" for _ in range(rng.randint(1, 30)))) for i in range(80)]
    plain = PlainKatz([katz_tokens(t) for i, t in rows if learned(i)], 3)
    docs = docs_of([(i, t, "en") for i, t in rows])
    same_scores(katz.train_and_score(docs, ~in_fold("doc_id", 1), in_fold("doc_id", 1)), rows, plain)


def test_katz_counts_pairs_of_rare_histories(docs_of):
    lessons = [f"rare{i} tail{i % 3}" for i in range(30)]
    texts = [*lessons, "rare1 tail1", "rare1 tail2"]
    docs = docs_of([(i, t, "en") for i, t in enumerate(texts)])
    train = F.col("doc_id") < len(lessons)
    model = katz.learn(docs, train)
    split = [[*t.split(), None] for t in lessons]
    times = Counter(Counter(p for x in split for p in zip([None, *x], x)).values())
    assert model.counts[0] == [times[r] for r in range(1, katz.K + 2)]
    scores = {r.doc_id: r.score for r in katz.train_and_score(docs, train, ~train).collect()}
    assert scores[30] > scores[31] + 0.1  # both tails are as frequent, but only the first was seen after rare1


def test_katz_stores_what_scoring_needs(docs_of, monkeypatch):
    """No table of sequences unless a model is asked for, sums only for histories that need them, and no texts."""
    made, packs = [], []
    store, pack = katz.store, katz.batches.pack
    monkeypatch.setattr(katz, "store", lambda frame, name, **how: made.append((store(frame, name, **how), how)) or made[-1][0])
    monkeypatch.setattr(katz.batches, "pack", lambda *given: packs.append(pack(*given)) or packs[-1])
    docs = docs_of([(i, "one two three four " * 5 + f"own{i} end", "en") for i in range(30)])
    assert katz.train_and_score(docs, F.lit(True), F.lit(False)).count() == 30
    assert len(made) == 3 and all(how == {"tidy": True} for _, how in made)
    for table, _ in made[1:]:
        rows = table.table.collect()
        assert all(r[c] is None for r in rows if r["batch"] == katz.TABLE for c in "abcd")
        covered = [katz.unpack_few(r["c"]) for r in rows if r["batch"] >= 0]
        assert covered and not sum(map(len, covered))  # all was learned, so nothing backs off
    assert b"three" not in b"".join(katz.batches.expand(r.blob[8 : 8 + int.from_bytes(r.blob[:8], "little")]) for r in packs[0][0].collect())


def test_distinct():
    rng = np.random.default_rng(1)
    for top in (1, 5, 1 << 20, 1 << 45, (1 << 64) - 1):
        for n in (0, 1, 1000):
            x = rng.integers(0, top, n, np.uint64, endpoint=True)
            for got, want in zip(distinct(x), np.unique(x, return_index=True, return_inverse=True), strict=True):
                assert (got == want).all()


def test_packed_numbers_leave_out_high_bytes_that_are_zero():
    """The work on a packed array goes by the bytes its numbers need, not by the width of their type."""
    pack_array, unpack_array = katz.batches.pack_array, katz.batches.unpack_array
    for top, used in ((0, 1), (255, 1), (256, 2), (70_000, 3), ((1 << 40) - 1, 5), ((1 << 63) - 1, 8)):
        x = np.array([0, top // 3, top] * 50, "<u8")
        assert len(katz.batches.expand(pack_array(x))) == 1 + used * len(x)
        for kind in ("<u8", "<i8"):
            assert (unpack_array(pack_array(x.astype(kind)), kind) == x.astype(kind)).all()
    for x in (np.array([3, -1, 1 << 40], "<i8"), np.zeros(0, "<u4"), np.array([(1 << 64) - 1], "<u8"), np.arange(300).astype("<u2")[::3], np.array([7], np.uint8)):
        got = unpack_array(pack_array(x), x.dtype)
        assert got.dtype == x.dtype and got.tolist() == x.tolist()


def test_by_bucket_keeps_the_order_inside_a_bucket():
    rng = np.random.default_rng(2)
    for top in (1, 200, 1 << 40):
        for n in (0, 1, 1000):
            bucket = rng.integers(0, top, n)
            order, present, bounds = katz.batches.by_bucket(bucket, top)
            assert (order == np.argsort(bucket, kind="stable")).all()
            assert present.tolist() == sorted(set(bucket.tolist())) and len(bounds) == len(present) + 1
            assert all((bucket[order[i:j]] == b).all() and j > i for b, i, j in zip(present, bounds, bounds[1:]))


def worth(likely, shares):
    """Log-likelihood of one text less the price of the languages it has a share of."""
    words = likely.shape[1]
    price = language_mix.PENALTY * 0.5 * np.log(words + 1.0)
    return np.log((likely * shares[:, None]).sum(axis=0)).sum() - price * np.count_nonzero(shares)


def best_shares(likely, rounds=3000):
    shares = np.full(len(likely), 1 / len(likely))
    for _ in range(rounds):
        joint = likely * shares[:, None]
        shares = (joint / joint.sum(axis=0)).sum(axis=1) / likely.shape[1]
    return shares


def test_single_languages_are_never_worth_less_than_a_larger_set():
    """Where one language is answered, no set of more is worth more; and what settle says is left to gain bounds it."""
    rng = np.random.default_rng(12)
    for _ in range(60):
        n_words, n = int(rng.integers(4, 60)), 4
        mix_of = rng.dirichlet(np.full(n, 0.4))
        own = rng.choice(n, n_words, p=mix_of)
        logs = rng.normal(0, 1.2, (n, n_words))
        logs[own, np.arange(n_words)] += rng.uniform(0.5, 3)
        likely = np.exp(logs - logs.max(axis=0))
        words = np.array([n_words])
        shares, fit, more = language_mix.settle(likely, words, np.full((n, 1), 1 / n))
        assert np.log((likely * best_shares(likely)[:, None]).sum(axis=0)).sum() <= fit[0] + more[0] + 1e-6
        found = language_mix.choose(likely, words)[:, 0]
        if np.count_nonzero(found) == 1:
            for code in range(1, 1 << n):
                kept = [k for k in range(n) if code >> k & 1]
                if len(kept) > 1:
                    inside = np.zeros(n)
                    inside[kept] = best_shares(likely[kept], 400)
                    greedy = worth(likely, found)
                    # the elimination itself is greedy; the skipped search must not be what loses
                    if worth(likely, inside) > greedy + 1e-6:
                        top = int(found.argmax())
                        alone = worth(likely, np.eye(n)[top])
                        assert alone < fit[0] + more[0] - 2 * language_mix.PENALTY * 0.5 * np.log(n_words + 1.0)


def test_many_languages_share_fewer_bins(docs_of, monkeypatch):
    assert language_mix.bins_for(4) == language_mix.BINS and language_mix.bins_for(600) == 1 << 14
    assert language_mix.bins_for(10**6) == 256
    monkeypatch.setattr(language_mix, "MOST_CELLS", 1 << 14)
    rows = [(i, f"{chr(97 + i % 9) * 3} {chr(98 + i % 9) * 4} " * 20, f"l{i % 9}") for i in range(90)]
    model = language_mix.learn(docs_of(rows))
    assert model.logs.shape == (9, 1 << 10) and model.langs == sorted(f"l{k}" for k in range(9))
    found = language_mix.identify(docs_of(rows), model, ["doc_id", "lang", "score"]).collect()
    assert all(r.lang_pred == r.lang for r in found) and len(found) == 90


def test_features_of_both_classes_are_kept_without_a_cap(docs_of, spark):
    """Four thousand words, half of them toxic, a quarter clean: all are learned, and neutral ones are not."""
    rng = np.random.default_rng(3)
    words = {k: [f"{k}{i:04d}" for i in range(n)] for k, n in (("tox", 2400), ("fine", 1200), ("plain", 800))}
    rows, marks = [], []
    for i in range(1600):
        toxic = i % 2
        text = [*rng.choice(words["tox" if toxic else "fine"], 60), *rng.choice(words["plain"], 30)]
        rows.append((i, " ".join(text), "en"))
        marks.append((i, toxic))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learn(docs_of(rows), labels, max_rows=400)
    def kept(name):
        column = toxicity.pa.array(words[name], toxicity.pa.string())
        hits = {t for t, f in zip(*toxicity.presence(column)) if model.place[f] >= 0}
        return len(hits) / len(words[name])
    assert kept("tox") > 0.95 and kept("fine") > 0.95 and kept("plain") < 0.1 and len(model.bins) > 3072
    scored = toxicity.score(docs_of(rows), model, ["doc_id", "score", "text"])
    assert scored.columns == ["doc_id", "text", "score"]
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in scored.collect())


def test_toxicity_and_languages_of_empty_documents(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs_of([]), labels)
    assert toxicity.score(docs_of([]), model, ["doc_id"]).count() == 0
    assert toxicity.drop_toxic(docs_of([]), model).count() == 0
    assert [r.score for r in toxicity.score(docs_of([(1, None, None)]), model, ["doc_id"]).collect()] == [0.5]

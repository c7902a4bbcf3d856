"""Host rules, hard negatives and whitening against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.llm import eigen, hard_negatives, host_rules, residues, whitening
from wireloom.llm.common import CHUNK

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = BLANKS.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {i + s for places in at.values() if len(places) > 1 for i in places for s in range(3)}
    lines = [line for line in text.split("\n") if BLANKS.search(line)]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)
    )


def plain_failures(n, chars, symbols, lines, dup, repeats):
    return {
        "few_words": n < 50, "repeat_words": 100 * repeats > 50 * n, "symbols": 100 * symbols > 10 * n,
        "dup_lines": 100 * dup > 30 * lines, "word_length": chars < 3 * n or chars > 10 * n,
    }


def plain_rates(failed):
    """host -> rule -> shrunken rate, for pairs of a host and its document's failures."""
    groups = defaultdict(list)
    for host, found in failed:
        if host is not None:
            groups[host].append(found)
    out = defaultdict(dict)
    for rule in plain_failures(*[0] * 6):
        n = {h: len(v) for h, v in groups.items()}
        k = {h: sum(f[rule] for f in v) for h, v in groups.items()}
        total = sum(n.values())
        mean = sum(k.values()) / total if total else 0
        strength = None
        if len(n) > 1 and total > len(n):
            between = sum(n[h] * (k[h] / n[h] - mean) ** 2 for h in n) / (len(n) - 1)
            inside = sum(n[h] * k[h] / n[h] * (1 - k[h] / n[h]) for h in n) / (total - len(n))
            typical = (total - sum(x * x for x in n.values()) / total) / (len(n) - 1)
            rho = (between - inside) / (between + (typical - 1) * inside) if between + (typical - 1) * inside else 0
            strength = max(0, 1 / rho - 1) if rho > 0 else None
        for h in n:
            out[h][rule] = mean if strength is None else (k[h] + strength * mean) / (n[h] + strength)
    return out


WORDS = ["alpha", "beta", "gamma", "delta", "Ünï", "x", "#tag", "a|b", "\x00", "语言"]
TEXTS = [
    None, "", " \n\t\x0b", "one", "a a a a", "a b c a b c", "same line\nsame line\n\nsame line ", "x\n" * 60, "#*$%&|<> " * 60,
    "Word word WORD " * 30, "\x00 \x00 \x00 \x00", "longwordlongword " * 60, "t\r\nt\n", "é" * 500,
]


def host_docs(seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(rng.choice(WORDS, int(rng.integers(30, 300)))), "en") for i in range(60)]
    return rows


def test_counts_of_texts(docs_of):
    rows = host_docs()
    found = host_rules.count(docs_of(rows), keep=["doc_id", "lang", "score"])
    assert found.columns == ["doc_id", "lang", "score", *host_rules.COUNTS]
    assert {r.doc_id: tuple(r)[3:] for r in found.collect()} == {i: plain_counts(t) for i, t, _ in rows}


def test_long_texts_are_counted_in_pieces():
    rng = np.random.default_rng(1)
    line = " ".join(rng.choice(WORDS, 40))
    long_line = "z" * (CHUNK + 7)
    text = "\n".join([line, *(" ".join(rng.choice(WORDS, 60)) for _ in range(9000)), long_line, line, "z" + long_line, long_line])
    data = text.encode()
    assert len(data) > 4 * CHUNK
    found = host_rules.count_texts(np.frombuffer(data * 2, np.uint8), np.array([0, len(data), 2 * len(data)]))
    assert [tuple(int(c[i]) for c in found) for i in range(2)] == [plain_counts(text)] * 2


def hosted(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, kept string, host string")


def test_host_verdicts(spark):
    rng = np.random.default_rng(5)
    good, short = " ".join(map(str, range(10000, 10060))), "too short"
    rows = []
    for h in range(40):
        share = 0.9 if h in (3, 4) else 0.05 + 0.01 * (h % 7)
        rows += [(f"h{h}", short if rng.random() < share else good) for _ in range(int(rng.integers(5, 60)))]
    rows += [("tiny", short)] + [("hot", good)] * 300 + [("hot", short)] * 60 + [(None, short), (None, good), (None, None)]
    frame = hosted(spark, [(i, t, h, -1, "x", "y") for i, (h, t) in enumerate(rows)]).repartition(5)
    failed = [(h, plain_failures(*plain_counts(t))) for h, t in rows]
    rates = plain_rates(failed)
    verdicts = host_rules.host_verdicts(host_rules.host_failures(host_rules.count(frame, keep=["source"]), "source", host_rules.Limits()))
    held = {r.host: r for r in verdicts.table.collect()}
    assert held.keys() == rates.keys()
    for h, r in held.items():
        for rule, rate in rates[h].items():
            assert r[f"{rule}_rate"] == pytest.approx(rate, abs=1e-12)
        assert list(r.broken) == [rule for rule, rate in rates[h].items() if rate >= 0.5]
    rejected = {h for h, r in held.items() if not r.host_kept}
    assert rejected == {"h3", "h4"}  # "tiny" fails wholly, but one document proves little
    judged = host_rules.judge(frame, keep=["doc_id", "kept", "host"]).collect()
    assert len(judged) == len(rows)
    for r in judged:
        h, t = rows[r.doc_id]
        base = any(failed[r.doc_id][1][rule] for rule in host_rules.BASE)
        assert (r.host, r.base_failed, r.host_kept, r.kept) == ("y", base, h not in rejected, not base and h not in rejected)


def test_host_rules_on_few_hosts(spark):
    none = hosted(spark, [])
    assert host_rules.judge(none, keep=["doc_id"]).collect() == []
    one = hosted(spark, [(i, "few", "h", 0, "", "") for i in range(3)])
    assert [r.host_kept for r in host_rules.judge(one).collect()] == [False] * 3  # the overall rate is the host's
    single = hosted(spark, [(i, "few", f"h{i}", 0, "", "") for i in range(3)] + [(9, None, None, None, None, None)])
    assert Counter(r.host_kept for r in host_rules.judge(single).collect()) == {False: 3, True: 1}


# Exact products


@pytest.mark.parametrize("width, top", [(1, 3), (64, 146), (64, 2**20), (200, 2**26), (3, 2**30), (7, 2**27)])
def test_products_by_residues(width, top):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-top, top + 1, (n, width)) for n in (9, 11))
    a[0], b[0], b[1] = top, top, -top
    primes = residues.primes_for(width * top * top)
    assert len(set(primes)) == len(primes) and np.prod([float(p) for p in primes]) > 2.0 * width * top * top
    got = residues.products(residues.Residues(a, primes), residues.Residues(b, primes))
    assert (got.astype(object) == a.astype(object) @ b.astype(object).T).all()


def test_largest_residues_stay_exact():
    p = residues.primes_for(10**6)[0]
    assert residues.DEPTH * (p // 2) ** 2 <= 2**24
    x = np.arange(-(2**24), 2**24, 997, dtype=np.int64)
    left = residues.reduced(x.astype(np.float32), p).astype(np.int64)
    assert ((x - left) % p == 0).all() and np.abs(left).max() <= p // 2
    with pytest.raises(ValueError):
        residues.primes_for(2**63)


def plain_negatives(rows, n_positives=5, n_negatives=10):
    good = [
        (i, y, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, y, v in rows
        if i is not None and y is not None and v and None not in v and np.isfinite(v).all()
    ]
    anchors = {(i, y, tuple(v)) for i, y, v in good if i % 100 == 0}
    out = []
    for i, y, v in anchors:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good]
        positives = sorted((s, j) for s, j, z in scored if z == y and j != i)[:n_positives]
        for s, p in positives:
            fitting = sorted((t, j) for t, j, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s)[:n_negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(fitting)]
    return Counter(out)


def vector_rows(seed, n, third=False):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), rng.normal(size=6).round(2).tolist()) for i in range(n)]
    if third:
        rows += [(1000 + i, 2, [0.5, -0.25, 1.0, 0, 0, 0.125]) for i in range(n // 2)]
        rows += [(3000 + i, 1, [0.25, -0.125, 0.5, 0, 0, 0.0625]) for i in range(n // 2)]
    return rows


ODD_ROWS = [
    (5000, None, [1.0] * 6), (5100, 1, None), (5200, 1, []), (5300, 1, [1.0, None, 0, 0, 0, 0]), (5400, 1, [float("nan")] * 6),
    (5500, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (5600, 9, [3.0] * 6), (5700, 1, [2.0, 1.0]), (0, 1, [0.5] * 6), (0, 1, [0.5] * 6),
    (1, 1, [0.75] * 6), (1, 1, [0.75] * 6), (100, 1, [0.0] * 6),
]
VECTORS = "vec_id long, label int, embedding array<float>, score double, number long, v string"


def embeddings(spark, rows):
    floats = [v and [None if c is None else float(c) for c in v] for *_, v in rows]
    return spark.createDataFrame([(i, y, v, 0.5, 7, "v") for (i, y, _), v in zip(rows, floats)], VECTORS)


@pytest.mark.parametrize("case", ["empty", "one", "plain", "third", "blocks", "odd"])
def test_hard_negatives(spark, case, monkeypatch):
    rows = {"empty": [], "one": [(0, 1, [1.0] * 6)], "plain": vector_rows(1, 600), "third": vector_rows(2, 450, third=True),
            "blocks": vector_rows(3, 900), "odd": vector_rows(4, 300) + ODD_ROWS}[case]
    if case == "blocks":
        monkeypatch.setattr(hard_negatives, "BLOCK", 3)
        monkeypatch.setattr(hard_negatives, "TILE", (2, 50))
    frame = embeddings(spark, rows).repartition(4)
    found = hard_negatives.mine(frame, F.col("vec_id") % 100 == 0, F.col("label"))
    assert found.columns == hard_negatives.COLUMNS
    assert Counter(map(tuple, found.collect())) == plain_negatives(rows)


def test_windows_round_inwards():
    ratio = hard_negatives.Ratio()
    for p in [*range(-7, 120), 10**18, -(10**18)]:
        low, high = ratio.window(p)
        assert 100 * low >= 30 * p > 100 * (low - 1) and 100 * high <= 90 * p < 100 * (high + 1)


# Whitening


def residuals(m, values, vectors):
    scale = np.abs(m).max()
    return np.abs(m @ vectors - vectors * values).max() / scale, np.abs(vectors.T @ vectors - np.eye(len(values))).max()


@pytest.mark.parametrize("kind", ["random", "equal", "cluster", "diagonal", "one", "two", "rank", "zero"])
def test_leading_eigenpairs(kind):
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    spectrum = {
        "random": rng.random(40), "equal": np.full(40, 3.0), "cluster": np.r_[5 + 1e-13 * np.arange(12), rng.random(28)],
        "rank": np.r_[[4.0, 3.0], np.zeros(38)],
    }
    m = {
        "diagonal": np.diag(np.arange(40.0)), "one": np.array([[2.5]]), "two": np.array([[2.0, 1.0], [1.0, 3.0]]), "zero": np.zeros((5, 5)),
    }.get(kind)
    if m is None:
        m = q @ np.diag(spectrum[kind]) @ q.T
        m = (m + m.T) / 2
    values, vectors = eigen.leading(m * 1e5, 8)
    assert len(values) == min(8, len(m))
    np.testing.assert_allclose(values, np.sort(np.linalg.eigvalsh(m * 1e5))[::-1][:8], rtol=1e-11, atol=1e-9)
    if kind != "zero":
        left, skew = residuals(m * 1e5, values, vectors)
        assert left < 1e-13 and skew < 1e-13


def plain_whitening(rows, k=8):
    good = [(i, v) for i, _, v in rows if v and None not in v and np.isfinite(v).all()]
    width = max(len(v) for _, v in good)
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v + [0.0] * (width - len(v))] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    exact = [[sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in x) / n**3 for b in range(width)] for a in range(width)]
    values, vectors = np.linalg.eigh(np.array(exact))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    return [i for i, _ in good], n, deviations, centred @ vectors / np.sqrt(values), values / np.trace(np.array(exact))


@pytest.mark.parametrize("case", ["plain", "odd"])
def test_whitening(spark, case):
    rng = np.random.default_rng(6)
    mixed = rng.normal(size=(12, 12))
    rows = [(i, 0, (rng.normal(size=12) @ mixed * 0.2 + 3).round(4).tolist()) for i in range(500)]
    if case == "odd":
        rows = rows + [(i, y, v and (v + [0.0] * 12)[:12]) for i, y, v in ODD_ROWS] + rows[:40]
        rows.append((9000, 0, [1.0] * 5))
    frame = embeddings(spark, rows).repartition(4)
    ids, n, deviations, white, explained = plain_whitening(rows)
    found = whitening.whiten(frame).collect()
    assert {(r.n, r.identity_error < 1e-9) for r in found} == {(n, True)} and len({r.identity_error for r in found}) == 1
    assert len(found) == 8 * len(ids)
    for c in range(1, 9):
        own = sorted((r for r in found if r.component == c), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation, abs(r.whitened)))
        want = sorted(zip(ids, deviations, white[:, c - 1]), key=lambda w: (w[0] is None, w[0] or 0, w[1], abs(w[2])))
        assert [(r.vec_id, r.deviation) for r in own] == [(i, d) for i, d, _ in want]
        got, given = np.array([r.whitened for r in own]), np.array([w for *_, w in want])
        sign = np.sign(got @ given)
        np.testing.assert_allclose(got * sign, given, atol=1e-9)
        assert own[0].explained == pytest.approx(explained[c - 1], rel=1e-9)


def test_whitening_without_spread(spark):
    names = whitening.whiten(embeddings(spark, [])).columns
    assert names == [c.split()[0] for c in whitening.SCHEMA.split(", ")]
    assert whitening.whiten(embeddings(spark, [(1, 0, [1.0] * 3)])).count() == 0
    assert whitening.whiten(embeddings(spark, [(i, 0, [1.0] * 3) for i in range(9)])).count() == 0
    flat = whitening.whiten(embeddings(spark, [(i, 0, [1.0, float(i), 2.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and {r.explained for r in flat} == {1.0}


def test_deviations_beyond_a_long():
    mean = whitening.Mean(10**9, (5 * 10**9 + 1, 0))
    assert mean.deviations(np.array([[5, 0], [7, 0], [2**40, 1]])).to_pylist() == [1, (2 * 10**9 - 1) ** 2, None]

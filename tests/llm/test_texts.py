"""Operators on texts against plain versions, on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wireloom.llm import bpe, decontaminate, jaccard, suffix_dedup, token_frames

BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows_for_tests():
    rng = random.Random(5)
    letters = list("abcdeé漢 \n.'") + ["the ", "x<|endoftext|>", "  ", "don't ", "12½ ", "\u00a0"]
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = text(60), text(120)
    rows = [(i, text(rng.randint(0, 80)), "en") for i in range(30)]
    rows += [(30 + i, base, "en") for i in range(6)]  # copies
    rows += [(40 + i, " ".join(base.split()[: 60 + i] + ["edited"] + base.split()[61 + i :]), "en") for i in range(12)]
    rows += [(60 + i, text(20) + " " + passage + " " + text(20), "fr") for i in range(8)]
    rows += [(80 + i, "".join(rng.choices(letters, k=60)), None) for i in range(15)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "!!! ...", "en"), (103, "one two", "en"), (104, "One, TWO", "de"), (7, text(30), "en")]
    rows += [(None, base, "en"), (None, None, None), (33, base, "en"), (110, text(6000), "en"), (111, "z" * 5000, "en")]
    rng.shuffle(rows)
    return rows, passage


ROWS, PASSAGE = rows_for_tests()


@pytest.fixture(scope="module")
def docs(docs_of):
    return docs_of(ROWS).repartition(3).cache()


def order(found):
    return sorted(map(tuple, found), key=repr)


def test_suffix_dedup(docs):
    want = []
    for (i, _, _), (data, gone) in zip(ROWS, plain.repeats([(i, t) for i, t, _ in ROWS])):
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        want.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sum(w[2] for w in want) > 5000
    assert order(suffix_dedup.digests(docs).collect()) == order(want)


def test_suffix_dedup_keeps_rows_and_columns(docs):
    kept = suffix_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    for row in kept.collect():
        assert (row.n_chars is None) == (row.text is None) and (row.text is None or row.n_chars == len(row.text))
        assert (row.batch, row.score, row.uid) == (7, 0.25, "u")


def test_ranks_without_collisions_are_exact():
    data = np.frombuffer(b"ab" * 200 + b"c" + b"ab" * 200, np.uint8)
    at = np.arange(len(data) - suffix_dedup.LENGTH + 1)
    rank = suffix_dedup.rank_windows(data, at)
    whole = [data[i : i + suffix_dedup.LENGTH].tobytes() for i in at]
    assert len(set(zip(rank.tolist(), whole))) == len(set(whole)) == len(set(rank.tolist()))


def test_jaccard(docs):
    sets, links = plain.links([(i, t) for i, t, _ in ROWS])
    up = list(range(len(ROWS)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, found in links.items():
        for b in found:
            up[max(root(a), root(b))] = min(root(a), root(b))
    place = lambda k: (ROWS[k][0] is None, ROWS[k][0] or 0)
    want = []
    for k, s in enumerate(sets):
        same = [j for j, o in enumerate(sets) if s and o == s] or [k]
        tied = [j for j in range(len(ROWS)) if root(j) == root(k)]
        want.append((ROWS[k][0], ROWS[min(same, key=place)][0], len(same), ROWS[min(tied, key=place)][0], len(links[k])))
    _, found = jaccard.similar_texts(docs)
    assert max(w[4] for w in want) > 10
    assert order(found.select("key", "class_id", "copies", "group_id", "n_links").collect()) == order(want)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({root(k) for k in range(len(ROWS))})


def test_jaccard_in_blocks(docs, monkeypatch):
    whole = order(jaccard.similar_texts(docs)[1].select("key", "n_links", "group_id").collect())
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    assert order(jaccard.similar_texts(docs)[1].select("key", "n_links", "group_id").collect()) == whole


def test_pruning_bound():
    assert jaccard.least_matches(36, 0.8, 1e-7) < 0.8 * 36 < jaccard.least_matches(252, 0.8, 0.5)
    rng = np.random.default_rng(0)
    marks = rng.integers(0, 2, (252, 30)).astype(np.uint32)
    a, b = jaccard.pruned_pairs(marks, marks, 0.8, True)
    assert len(a) == 0
    assert len(jaccard.pruned_pairs(marks, marks[:, :3], 0.8, False)[0]) == 3


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_decontamination(spark, docs, block):
    items = [(1, PASSAGE), (2, "one two"), (3, None), (4, ""), (None, PASSAGE[:200]), (10, " ".join(PASSAGE.split()[5:30])), (1, PASSAGE), (5, "Z")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = plain.windows(items)
    want = []
    for i, text, _ in ROWS:
        n, hit, ids = plain.contamination(text, found)
        want.append((i, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    judged = decontaminate.judge(docs, table, ["doc_id"], block_bytes=block)
    assert order(judged.collect()) == order(want) and sum(w[5] for w in want) >= 8
    kept = decontaminate.drop_contaminated(docs, table, block_bytes=block)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


def test_decontamination_without_items(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    judged = decontaminate.judge(docs, none, ["doc_id"]).collect()
    assert sum(r.n_words for r in judged) == sum(len(plain.words(t)) for _, t, _ in ROWS) and not any(r.contaminated for r in judged)


def test_bpe_and_frames(docs, tmp_path):
    library = Tokenizer.from_file(BPE)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in ROWS]
    pack = lambda x: np.array(x, "<u4").tobytes()
    want = [
        (i, len(x), hashlib.sha256(pack(x)).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest())
        for (i, _, _), x in zip(ROWS, ids)
    ]
    assert order(bpe.digests(docs, BPE).collect()) == order(want)
    encoded = bpe.encode(docs, BPE, keep=["doc_id"])
    assert order((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == order((i, tuple(x)) for (i, _, _), x in zip(ROWS, ids))
    back = bpe.decode(encoded, BPE, keep=["doc_id"])
    assert order(back.collect()) == order((i, t or "") for i, t, _ in ROWS)

    manifest = token_frames.write_frames(docs, BPE, 0, folder=str(tmp_path / "frames"))
    read = [tuple(r) for r in token_frames.digests(manifest).collect()]
    assert sorted((repr(i), n, c) for i, _, n, c in read) == sorted((repr(i), len(x) + 1, zlib.crc32(pack(x + [0]))) for (i, _, _), x in zip(ROWS, ids))
    read.sort(key=lambda r: r[1])
    assert [r[1] for r in read] == np.cumsum([0, *(r[2] for r in read)])[:-1].tolist()
    keys = [r[0] for r in read]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    some = token_frames.read_frames(manifest, keys=[110, 101]).collect()
    assert {r.doc_id for r in some} == {110, 101}


def test_random_splits_agree_with_the_library():
    import pyarrow as pa

    rng = random.Random(1)
    pieces = list("  ab's'tredlvm'\n\t  é1²½Ⅷ漢́!.,'\x1c\x85\x00🙂٣") + ["<|endoftext|>", "'re", "'ll", "'ve", "\u3000"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(4000)] + ["ab" * 3000, "<|endof", "text|>", ""]
    library = Tokenizer.from_file(BPE)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for store in (bpe.store_of(BPE), token_frames.library_store(BPE)):
        ids, begins = store.ids_of(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == want


def test_damaged_frame_is_seen(tmp_path):
    import pyarrow.fs

    out = pyarrow.fs.LocalFileSystem().open_output_stream(str(tmp_path / "f"), compression=None)
    writer = token_frames.FrameWriter(out)
    sizes = [1, 0, 70_000, 3, 40_000, 40_000]
    parts = [np.arange(n, dtype=np.uint32) for n in sizes]
    writer.add([1, None, 3, 4, 5, 6], np.concatenate(parts), np.cumsum([0, *sizes]))
    writer.close()
    out.close()
    system = pyarrow.fs.LocalFileSystem()
    reader = token_frames.FrameReader(system.open_input_file(str(tmp_path / "f")))
    assert reader.keys == [1, None, 3, 4, 5, 6] and all((reader.ids(i) == p).all() for i, p in enumerate(parts))
    raw = bytearray((tmp_path / "f").read_bytes())
    whole = token_frames.zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()
    assert whole == np.concatenate(parts).astype("<u4").tobytes()
    reader.frames[0, 2] ^= 1
    reader.kept = (-1, None)
    with pytest.raises(ValueError):
        reader.ids(0)


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert suffix_dedup.digests(none).count() == 0 and jaccard.keep_one(none).count() == 0
    assert decontaminate.judge(none, items, ["doc_id"]).count() == 0 and bpe.digests(none, BPE).count() == 0
    assert token_frames.digests(token_frames.write_frames(none, BPE, 0)).count() == 0


def test_windows_ranked_in_slices(monkeypatch):
    """Several slices of a bucket give what a dictionary of all windows gives."""
    length, rng = suffix_dedup.LENGTH, np.random.default_rng(3)
    passages = [rng.integers(97, 123, length + int(n)).astype(np.uint8) for n in rng.integers(0, 25, 12)]
    asked, least, wanted = [], {}, []
    for batch in range(4):
        which = rng.permutation(12)[:9]
        ids = rng.integers(0, 1000, 9)
        texts = [passages[i] for i in which]
        counts = np.array([len(t) - length + 1 for t in texts], np.uint8)
        windows = [t[k : k + length].tobytes() for t in texts for k in range(len(t) - length + 1)]
        for w, i in zip(windows, np.repeat(ids, counts).tolist()):
            least[w] = min(i, least.get(w, i))
        wanted.append(windows)
        ranks = np.array([suffix_dedup.gram_ranks(t)[0] for t in texts])
        pack = suffix_dedup.pack_array
        asked.append((batch, 0, pack(ranks), b"", pack(counts), pack(ids.astype(np.int64)), suffix_dedup.batches.compress(np.concatenate(texts).tobytes())))
    monkeypatch.setattr(suffix_dedup, "SLICE", 64)
    told = suffix_dedup.least_documents(suffix_dedup.table_of(suffix_dedup.CONTENTS, asked)).to_pylist()
    for row, windows in zip(told, wanted):
        runs = suffix_dedup.unpack_array(row["a"], "<i8"), suffix_dedup.unpack_array(row["b"], "<i8")
        assert np.repeat(*runs).tolist() == [least[w] for w in windows]


def test_only_files_that_may_hold_a_key_are_read(spark, docs_of):
    rows = [(i * 3, f"text {i}", None) for i in range(400)] + [(None, "no key", None), (30, "again", None)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manifest = token_frames.write_frames(docs_of(rows).repartition(3), BPE, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    listed = manifest.orderBy("shard").collect()
    assert len(listed) > 4
    for keys in ([30], [30, 1197], [31], [None], [None, 600], [-5, 5000], [0]):
        files = token_frames.files_with(manifest, keys).collect()
        found = sorted((r.doc_id is not None, r.doc_id or 0) for r in token_frames.read_frames(manifest, keys=keys).collect())
        assert found == sorted((i is not None, i or 0) for i, *_ in rows if i in keys)
        assert len(files) <= len(keys)
    assert token_frames.read_frames(manifest, keys=[]).count() == 0


def test_judged_columns_replace_kept_ones(docs_of):
    docs = docs_of([(1, "one two", "en")]).withColumnRenamed("batch", "n_words").withColumnRenamed("score", "contaminated")
    items = docs_of([(7, "one two", "en")]).selectExpr("cast(doc_id as string) item_id", "text")
    judged = decontaminate.judge(docs, items, ["doc_id", "n_words", "contaminated", "lang"])
    assert judged.columns == ["doc_id", "lang", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert tuple(judged.first())[:5] == (1, "en", 2, 2, 1) and judged.first().contaminated

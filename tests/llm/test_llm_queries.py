"""The registered queries: SQL where there is some, shape and stages."""

import numpy as np
import pytest
from check_queries import connect, difference
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from wireloom.llm import mtree, queries, url_rules
from wireloom.llm.components import connected

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, folder, name):
    assert difference(queries.queries()[name](spark, folder), connect(folder), SQL[name]) is None


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{n}" for n in range(1, 14)} and "pipeline" in names


URLS = [
    None, "", "no scheme", "://", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "x://b.example.com/en",
    "http://notexample.com/en/", "http://example.com/EN/", "http://a.net/es/1?q=://x/fr/", "http://a.net/fr", "http://net/es/", "http://É.net/fr/#a",
    "http://example.com:80/en/", "a\nb://c.net/es/", "http://com/x", "http://x.com?en/", "http://a.com/http://b.net/es/",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS + URLS[7:9])], "page_id long, url string, host string, verdict string")

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fitting = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fitting, key=lambda r: len(r.text), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    judged = url_rules.judge_urls(pages, queries.RULES)
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert found == {i: plain(u) for i, u in enumerate(URLS + URLS[7:9])}
    assert judged.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert url_rules.judge_urls(pages, []).filter("verdict = 'allow'").count() == len(URLS) + 2
    assert url_rules.judge_urls(pages.limit(0), queries.RULES).count() == 0


def test_rarest_token():
    index = url_rules.index_rules(queries.RULES)
    assert sum(map(len, index.values())) == len(queries.RULES) and index["www"][0].text == "www.example.com/en/"
    assert url_rules.rule("block", "a.b/c/de").tokens() == ["a", "b", "c"]  # the last may go on


@pytest.mark.parametrize("size", [0, 1, 40, 900])
def test_top_k(spark, size, monkeypatch):
    monkeypatch.setattr(mtree, "REGION_ROWS", 64)
    monkeypatch.setattr(mtree, "PAGE", 16)
    rng = np.random.default_rng(size)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(size)]
    if size > 1:
        rows += [(2000 + i, [0.5] * 8) for i in range(300)]  # a third is one vector
        rows += [(3000, None), (3020, [1.0, None] + [0.0] * 6), (3040, [float("nan")] * 8), (3060, []), (None, [1.0] * 8), (7, [0.1] * 8), (3080, [2.0] * 3)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(4)
    found = [tuple(r) for r in mtree.top_k(frame, F.col("vec_id") % 20 == 0, k=20).collect()]
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a.tolist(), b.tolist())))
    want = []
    for i, q in good:
        if i % 20 == 0:
            best = sorted((-dot(q, v), j) for j, v in good if j != i)[:20]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(found) == sorted(want)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103), (200, 200), (300, 301), (301, 300)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {105: 100, 103: 100, 301: 300}


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, before, folder)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
        ids = {r.doc_id for r in kept.collect()}
        assert 0 < len(ids) == kept.count() and ids <= {r.doc_id for r in before.collect()}
        before = kept
    last = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in before.collect()}
    assert last.filter("n_tokens <> size(ids)").count() == 0


def test_fifty_thousand_rules(spark):
    """Far more rules than a plan could hold as expressions; every page meets the longest of its own."""
    rules = [url_rules.rule("block" if i % 3 else "allow", f"h{i}.net/a{i % 7}/") for i in range(49_990)]
    rules += [url_rules.rule("block", f"{t}") for t in ("net/", "org", "h7.net/a0/deep/", "x.h7.net/", "ünï.net/é/", "b.org/q/")]
    rows = [(i, f"http://w.h{i * 17}.net/a{(i * 17) % 7 if i % 2 else 6}/z") for i in range(2500)]
    rows += [(9000, "http://x.h7.net/a0/deep/1"), (9001, "http://b.org/q/"), (9002, "http://a.com/"), (9003, "http://ünï.net/é/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    judged = url_rules.judge_urls(pages, rules)
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()
    by_text = {r.text: r for r in rules}

    def plain(url):
        rest = url.split("://")[1]
        host, path = rest.split("/")[0], "/" + rest.split("/", 1)[1]
        labels, parts = host.split("."), path.split("/")
        hosts = [".".join(labels[k:]) for k in range(len(labels))]
        paths = [""] + ["/".join(parts[: k + 1]) + "/" for k in range(len(parts) - 1)]
        fitting = [by_text[h + p] for h in hosts for p in paths if h + p in by_text]
        best = max(fitting, key=lambda r: len(r.text), default=None)
        return (best.text, best.verdict) if best else (None, "allow")

    assert {r.page_id: (r.rule, r.verdict) for r in judged.collect()} == {i: plain(u) for i, u in rows}


def test_buckets_hold_every_rule():
    index = url_rules.index_rules(queries.RULES)
    buckets = url_rules.bucket_table(index)
    assert len(buckets) == len(index) and sorted(r["text"] for b in buckets for r in b) == sorted(r.text for r in queries.RULES)
    assert url_rules.bucket_table({}) == [[]]

import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from trailmill.llm import queries
from trailmill.llm.sharding import shard_documents
from trailmill.llm.url_filter import build_cascade, judge_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size int"


def check_shards(rows, texts, shards):
    sizes = Counter()
    slots = {}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ideal = sum(sizes.values()) / shards
    largest = max(r.size for r in rows)
    assert all(abs(sizes[k] - ideal) <= largest + 0.01 * ideal for k in range(shards))


def test_shards_are_even_and_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op5_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    check_shards(got, texts, 40)


def test_shards_are_runs_of_the_key_order(spark, sf_dir):
    """By brute force: rows sorted by the keys, cut where the running bytes pass each share, within a row and the tolerance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    half = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << 63) - 1))
    keys = {r.doc_id: (r.a, r.b) for r in docs.select("doc_id", half(F.coalesce("text", F.lit(""))).alias("a"), half("doc_id").alias("b")).collect()}
    got = {r.doc_id: r for r in queries.op5_sharding(spark, sf_dir).collect()}
    order = sorted(got, key=lambda i: keys[i])
    shards = [got[i].shard for i in order]
    assert shards == sorted(shards)
    share, below, largest = sum(r.size for r in got.values()) / 40, 0, max(r.size for r in got.values())
    for last, i in zip([None, *order], order):
        if last is not None:
            for border in range(got[last].shard + 1, got[i].shard + 1):
                assert abs(below - border * share) <= largest + 0.01 * share
        below += got[i].size


def test_hot_text_is_split_by_id(spark):
    rows = [(k, "same text " * 5 if k % 3 else f"text {k}", None, None, None, "x", 1) for k in range(900)] + [(2000, None, None, None, None, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = shard_documents(docs, 8)
    assert "lang" in out.columns and out.columns.count("shard") == 1
    check_shards(out.collect(), {r[0]: r[1] for r in rows}, 8)


def test_shards_edges(spark):
    assert shard_documents(spark.createDataFrame([], DOCS), 8).count() == 0
    twice = spark.createDataFrame([(1, "a", None, None, None, None, None)] * 5, DOCS)
    assert shard_documents(twice, 4).groupBy("shard").count().count() == 1
    plan = shard_documents(twice, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_query_equals_sql(spark, sf_dir):
    got = sorted(map(tuple, queries.op6_url_filter(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf_dir}/pages.parquet')")
    want = sorted(con.execute(queries.OP6_SQL).fetchall())
    assert [tuple(str(x) for x in r) for r in got] == [tuple(str(x) for x in r) for r in want]


def test_url_edges(spark):
    rows = [
        (1, None), (2, "no scheme"), (3, ""), (4, "HTTP://A.EXAMPLE.ORG/es/x?y#z"), (5, "http://example.org"), (6, "http://notexample.org/es/"),
        (7, "http://x.com/fr/?a"), (8, "http://x.com/FR/"), (9, "a://b://c.com/de/"), (10, "http://com/de/"), (11, "http://x.com?p=/de/"), (11, "http://x.com/de/#" + "long" * 20_000),
    ]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "verdict string, host string, path string")
    got = sorted(tuple(r) for r in judge_urls(pages, rules, ["page_id"]).collect())
    assert got == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.org", "/es/x", "example.org/es/", "block"),
        (5, "example.org", "", None, "allow"), (6, "notexample.org", "/es/", "org/", "allow"), (7, "x.com", "/fr/", "com/fr/", "allow"), (8, "x.com", "/FR/", None, "allow"),
        (9, "b:", "//c.com/de/", None, "allow"), (10, "com", "/de/", "com/de/", "block"), (11, "x.com", "", None, "allow"), (11, "x.com", "/de/", "com/de/", "block"),
    ])
    parts = sorted(tuple(r) for r in judge_urls(pages, rules, ["page_id"], most_bytes=12).collect())
    assert parts == got  # the same in several classes
    assert judge_urls(pages.limit(0), rules, ["page_id"]).count() == 0
    assert judge_urls(pages, rules.limit(0), ["page_id"]).where("verdict <> 'allow'").count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(400).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = build_cascade(listed, universe, "t")
    assert len(cascade.levels) > 2
    members = {f"k{i * 7}" for i in range(400)}
    assert all((f"k{i}" in cascade) == (f"k{i}" in members) for i in range(4000))

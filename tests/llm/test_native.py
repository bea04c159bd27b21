"""Mixing, decontamination and license scans: SQL, brute force, and edge cases."""

import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, licenses, mixing
from tallyforge.llm import queries as registry

LONG = " ".join(f"w{i}" for i in range(40))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    result = con.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(fix(r[names.index(c)]) for c in df.columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(fix(v) for v in r) for r in df.collect()), key=repr) == want


def test_mix_meets_each_target_and_is_stable(spark):
    data = [(i, "a b c d e"[: 1 + 2 * (i % 5)], ["x", "y", None, "z"][i % 4], "clash") for i in range(200)] + [(7, "again again", "x", "clash")] * 3 + [(None, None, "y", "clash"), (8, "", "empty", "clash")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    out = mixing.mix_to_weights(spark, docs).cache()
    assert out.count() == len(data) and out.schema["size"].dataType.simpleString() == "bigint"
    by = out.groupBy("source").agg(F.sum("size"), F.first("source_size"), F.first("target"), F.sum("taken")).collect()
    assert abs(sum(r[3] for r in by) - sum(r[1] for r in by)) < 1e-6
    for _, size, listed, target, taken in by:
        assert size == listed and target <= 3 * size + 1e-9 and abs(taken - target) <= 0.5
    assert out.filter("taken > 3 * size or taken < 0").isEmpty()
    assert rows(mixing.mix_to_weights(spark, docs.repartition(5))) == rows(out)
    assert mixing.mix_to_weights(spark, docs.limit(0)).isEmpty()


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("0a", 1), ("0b", 10), ("0c", 100)], "skey string, source_size long")
    got = {r["skey"]: r["target"] for r in mixing.source_targets(sizes, (1, 2, 3), 3).collect()}
    assert got == {"0a": 3.0, "0b": 30.0, "0c": 78.0}


def test_overlap_edges(spark):
    items = spark.createDataFrame([(1, LONG), (2, "short item here"), (3, None), (4, "--- !!"), (5, LONG.upper())], "item_id long, text string")
    data = [
        (1, LONG, "x"),
        (2, "W3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 tail", "x"),
        (3, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 tail", "x"),
        (4, "before SHORT, item; here after", "x"),
        (5, None, "x"),
        (6, "", "x"),
        (7, "z " * 3000 + LONG, "x"),
        (1, LONG, "x"),
        (None, LONG, "x"),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_hit string")
    got = defaultdict(list)
    for r in decontaminate.overlap(spark, docs, items).collect():
        got[r["doc_id"]].append((r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]))
    assert got[1] == [(40, 40, 2, True)] * 2 and got[None] == [(40, 40, 2, True)]
    assert got[2] == [(14, 13, 2, True)] and got[3] == [(13, 0, 0, False)]
    assert got[4] == [(5, 3, 1, True)] and got[5] == got[6] == [(0, 0, 0, False)]
    assert got[7] == [(3040, 40, 2, False)]
    assert decontaminate.overlap(spark, docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.overlap(spark, docs.limit(0), items).isEmpty()


def test_columns_named_like_inner_ones(spark):
    """Columns that an operator uses within come back as they were given."""
    from tallyforge.llm import near_dedup, url_filter

    inner = ("v", "rep", "stays", "hit", "items", "sha", "names", "n", "text_a", "bucket", "t", "of", "host2", "seen")
    docs = spark.createDataFrame([(1, LONG, "http://a.b/c"), (2, LONG, "http://a.b/d"), (3, None, None)], "doc_id long, text string, url string")
    docs = docs.select("*", *[F.lit(f"given {c}").alias(c) for c in inner])
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    for out in (decontaminate.overlap(spark, docs, items), licenses.scan_licenses(spark, docs), near_dedup.near_duplicates(spark, docs), near_dedup.one_of_each(spark, docs), url_filter.judge_urls(spark, docs)):
        got = out.collect()
        assert got and all(r[c] == f"given {c}" for r in got for c in inner)


def brute_licenses(text, k=5, threshold=0.8):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    grams = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    found = set()
    for name, t in licenses.TEMPLATES:
        w = re.findall("[a-z0-9]+", t.lower())
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        if len(own & grams) >= threshold * len(own):
            found.add(name)
    return ",".join(sorted(found))


def test_licenses_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(10_000 + i, f"{'filler word ' * i}{t} and more") for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(20_000, None), (20_001, ""), (20_002, "Released under the"), (20_003, "x " * 20_000 + "released UNDER the MIT license")]
    both = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    text = {r["doc_id"]: r["text"] for r in both.collect()}
    got = licenses.scan_licenses(spark, both.withColumn("licenses", F.lit("clash"))).collect()
    assert len(got) == len(text)
    assert {r["doc_id"]: r["licenses"] for r in got} == {i: brute_licenses(t) for i, t in text.items()}
    assert all(r["n_licenses"] == len(set(m["name"] for m in r["matches"])) for r in got)
    assert licenses.scan_licenses(spark, docs.limit(0)).isEmpty()
    assert licenses.scan_licenses(spark, docs, templates=()).agg(F.sum("n_licenses")).first()[0] == 0


def test_recall_of_altered_licenses(spark):
    """Whole licenses with words inserted and replaced, at every alignment that matters: bands lose none in hundreds."""
    rng = random.Random(8)
    whole = [t for _, t in licenses.TEMPLATES if len(t) > 200]
    texts = {}
    for i in range(400):
        w = rng.choice(whole).split()
        for _ in range(rng.randint(0, len(w) // 30)):
            w[rng.randrange(len(w))] = f"other{rng.random()}"
        at = rng.randrange(len(w))
        w[at:at] = [f"insert{i}x{j}" for j in range(rng.choice([0, 0, 5, 40, 90]))]
        texts[i] = " ".join([f"before{i}x{j}" for j in range(rng.randint(0, 300))] + w + [f"after{j}" for j in range(rng.randint(0, 50))])
    texts[400] = " ".join(f"word{i}" for i in range(200_000)) + " " + whole[0]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark, docs).collect()}
    want = {i: brute_licenses(t) for i, t in texts.items()}
    assert sum(bool(x) for x in want.values()) > 250 and got == want

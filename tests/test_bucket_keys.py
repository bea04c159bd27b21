"""Keys of pushed members: shuffled once, by their member's hash, as they come; new ones each once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans.ingestion import bucket_push, unknown_keys

SINGLE = "source_hash string, key_type string, key_value string"
LISTS = "source_hash string, keys array<struct<key_type: string, key_value: string>>"
PUSHED = [("a", [("PO", "x"), ("PO", "x"), ("MSGID", "m")]), ("a", [("PO", "y")]), ("b", [("PO", None)]), ("b", []), ("c", None), (None, [("PO", "x")])]
NEW = {("a", "MSGID", "m"), ("a", "PO", "y"), ("b", "PO", None), (None, "PO", "x")}


def test_lists_of_keys_and_single_ones(spark):
    """Lists and rows of single keys give the same; a key without hash, type or value is always new, once."""
    lists = spark.createDataFrame(PUSHED, LISTS)
    single = spark.createDataFrame([(h, *k) for h, ks in PUSHED for k in ks or []], SINGLE)
    known = [("a", "PO", "x"), ("b", "PO", None), (None, "PO", "x"), ("d", "PO", "z")]
    stored = spark.createDataFrame([(h, [(t, v)]) for h, t, v in known], LISTS), spark.createDataFrame(known, SINGLE)
    for pushed in (lists, single, lists.unionByName(lists)):
        for there in stored:
            got = [tuple(r) for r in unknown_keys(pushed, there).collect()]
            assert len(got) == len(NEW) and set(got) == NEW
    members = spark.createDataFrame([("a", "B1", 1)], "source_hash string, bucket_id string, amount int").withColumn("amount", F.col("amount").cast("decimal(20,4)"))
    out = bucket_push(members.select("bucket_id"), members, members, lists, stored[0])
    assert {r["what"]: r["n"] for r in out["counts"].collect()}["keys"] == 4
    assert sorted(map(repr, map(tuple, out["keys"].collect()))) == sorted(map(repr, [*known, *NEW]))


def test_keys_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pushed, known = spark.range(9).selectExpr("string(id) AS source_hash", "array(struct('PO' AS key_type, string(id) AS key_value)) AS keys"), spark.createDataFrame([("1", "PO", "1")], SINGLE)
        plan = unknown_keys(pushed, known)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(source_hash" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

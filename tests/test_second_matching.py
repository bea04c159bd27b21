"""The second matching meets few claims without shuffling members to them."""

from __future__ import annotations

from tallyforge.plans import buckets as B


def test_second_matching_shuffles_buckets_alone(spark):
    """Members without a parent are never shuffled by it, and the verdicts are those of a plain join."""
    parents = spark.createDataFrame([("p1", 1, "M", "a", 5, 1, None), ("p2", 1, "M", "a", 5, 2, None), ("p3", 1, "M", "b", 7, 1, "x"), ("p4", 1, "M", "", 9, 1, "x"), ("p5", None, "M", "c", 9, 1, "x")], "source_hash string, source_id int, claim_type string, claim_value string, amount long, value_date int, external_ref string")
    slices = spark.createDataFrame([("p1", 10), ("p3", 6), ("p5", 1)], "parent_hash string, amount long")
    members = spark.createDataFrame([("b1", "p1"), ("b1", None), ("b2", "p3"), ("b2", "p1"), ("b3", None), ("b4", "p5"), (None, "p3"), ("b5", "p4")], "bucket_id string, parent_hash string")
    out = B.second_matching(parents, slices, members)
    assert {r["bucket_id"]: r["parent_mismatch"] for r in out.collect()} == {"b1": False, "b2": True, "b3": False, "b4": False, "b5": False, None: True}
    plan = B.second_matching(parents, slices, members.filter("length(bucket_id) > 0"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket_id" in plan and "hashpartitioning(parent_hash" not in plan

"""The composed upsert: settled and replaced rows stay away, amounts are frozen but for slices, only the batch is shuffled."""

import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import ledger as L

SCHEMA = "source_hash string, reco_id string, amount decimal(20,4), status string, parent_hash string"


def rows(spark, *listed):
    return spark.createDataFrame([(h, r, Decimal(a), s, p) for h, r, a, s, p in listed], SCHEMA)


def parents(spark, *listed):
    return spark.createDataFrame(list(listed), "source_hash string, source_id int, claim_type string, claim_value string")


def test_rules(spark):
    live = rows(spark, ("a", None, 1, "PENDING", None), ("b", "K", 2, "MATCHED", None), ("s", "K", 3, "PENDING", "p1"), ("q", "K", 4, "PENDING", None))
    settled = rows(spark, ("z", "K", 9, "MATCHED", None), ("t", "K", 9, "MATCHED", "p5"))
    listed = parents(spark, ("p1", 1, "M", "c"), ("p2", 1, "M", "c"), ("p3", 2, "M", "c"), ("p4", 1, "M", ""), ("p5", 1, "M", None), ("q", 1, "M", "d"))
    batch = rows(spark, ("a", "first", 7, "PENDING", None), ("a", "N", 8, "PENDING", None), ("b", "N", 8, "PENDING", None), ("s", "N", 8, "PENDING", "p1"), ("z", "N", 8, "PENDING", None), *[(p, "N", 8, "PENDING", None) for p in ("p1", "p2", "p3", "p4", "p5", "q", "new")])
    batch = batch.withColumn("no", F.monotonically_increasing_id()).coalesce(1)
    merged = L.ledger_upsert(live, settled, listed, batch, [F.col("no")]).cache()
    got = {r["source_hash"]: (r["reco_id"], int(r["amount"]), r["change"]) for r in merged.collect()}
    assert got == {"a": ("N", 1, "UPDATED"), "b": ("K", 2, "UNCHANGED"), "s": ("N", 8, "UPDATED"), "q": ("N", 4, "UPDATED"), "p3": ("N", 8, "INSERTED"), "p4": ("N", 8, "INSERTED"), "new": ("N", 8, "INSERTED")}
    assert tuple(L.upsert_counts(batch, merged).first()) == (3, 3, 6)
    again = L.ledger_upsert(merged.drop("change"), settled, listed, batch, [F.col("no")])
    assert again.filter("change IN ('INSERTED', 'UPDATED')").isEmpty()


def test_the_ledger_is_not_shuffled(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    big = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("source_hash"), F.lit("K").alias("reco_id"), F.lit(1).cast("decimal(20,4)").alias("amount"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("parent_hash"))
    live, settled = (L.stored_by_key(spark, big.filter(F.col("source_hash").endswith(x)), f"{name}_{x}", str(tmp_path / x), buckets=8) for x in ("1", "2"))
    batch = big.limit(500).withColumn("no", F.lit(1))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = L.ledger_upsert(live, settled, parents(spark, ("x", 1, "M", "c")), batch, [F.col("no")])
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert merged.filter("change = 'INSERTED'").count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # only the few columns of slices that stand for parents leave the stores' buckets, never their rows
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    for i, line in enumerate(lines):
        if f"{name}_" in line and "reco_id" in line:
            above = [x for j, x in enumerate(lines[:i]) if depth(x) < min(depth(y) for y in lines[j + 1 : i + 1])]
            assert not any("Exchange hashpartitioning" in x for x in above), plan
    assert any(f"{name}_1" in x and "reco_id" in x for x in lines)


def test_known_keys_of_one_constant_meet_no_row_twice(spark):
    from tallyforge.operators.merge import insert_new

    known = spark.range(5000).select(F.lit("none").alias("k"))
    staged = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    out = insert_new(known, staged, "k", [F.col("id")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("LeftAnti") :] and out.count() == 3000

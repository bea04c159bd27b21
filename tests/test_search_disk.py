"""The stored index and a search shuffle few rows: values once for their runs, and identifiers that may be a text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import search as X


@pytest.fixture
def shuffled(spark):
    """Rows that stages shuffled since the last call."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    seen = set()

    def since() -> int:
        listed = store.stageList(None, False, False, none, None)
        new = {listed.apply(i).stageId(): listed.apply(i).shuffleWriteRecords() for i in range(listed.size()) if listed.apply(i).stageId() not in seen}
        seen.update(new)
        return sum(new.values())

    since()
    return since


def test_index_and_search_shuffle_little(spark, tmp_path, shuffled):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries = spark.range(4000).select("id", *[F.concat(F.lit(p), F.col("id") + 10000).alias(f) for p, f in zip("KXRM", X.ENTRY_FIELDS, strict=True)])
        statuses = spark.range(2000).select(F.concat(F.lit("P"), "id").alias("po_id"), F.concat(F.lit("K"), "id").alias("reco_id"))
        # two keys and one lot, each of 1,000 members
        keys = spark.range(2000).select((F.col("id") % 2).cast("string").alias("lot_id"), F.lit("PO").alias("key_type"), F.concat(F.lit("key"), F.col("id") % 2).alias("key_value"))
        found = X.identifiers({"live": entries}, statuses, keys, statuses.limit(0), keys.select("lot_id"))
        folder = str(tmp_path / "index")
        X.write_index(found, folder)
        assert shuffled() < 16000 + 500  # each value of an entry once for its runs; not the identifiers, nor 64,000 runs
        asked = spark.createDataFrame([("K10007", False), ("key1", False), ("R1000", True), ("x13999", True), ("k9", True)], "text string, broad boolean")
        got = sorted(map(tuple, X.search(spark, folder, asked).select("text", "source", "field", "reco_id", "lot_id").collect()))
        ten = [("R1000", "live", "ref_no", f"K1000{i}", None) for i in range(10)]
        assert got == [("K10007", "live", "reco_id", "K10007", None), *ten, ("key1", "lot_key", "key PO", None, "1"), ("x13999", "live", "external_ref", "K13999", None)]
        assert X.maybe(spark.read.parquet(f"{folder}/values"), asked.limit(2)).count() < 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_texts_leave_out_what_is_no_text(spark):
    values = spark.range(40000).select(F.concat(F.lit("v"), "id").alias("value"), F.col("id"))
    asked = spark.range(0, 40000, 10).select(F.concat(F.lit("v"), "id").alias("text"))
    left = X.maybe(values, asked)
    assert left.filter("id % 10 = 0").count() == 4000 and left.count() < 4000 + 36000 / 8


def test_keys_of_texts_are_shuffled_once(spark):
    """What the texts name goes by key to where the sums are; it isn't made distinct by another shuffle before."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries = spark.createDataFrame([("K", "EUR", 1), ("K", "EUR", -1), ("L", "USD", 2)], "reco_id string, currency string, amount int").withColumn("amount", F.col("amount").cast("decimal(20,4)"))
        found = X.found_groups(entries, spark.createDataFrame([("a", "K", None), ("a", "K", "L"), ("a", None, "K")], "text string, reco_id string, lot_id string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(text#" in x]
        assert sorted((r["text"], r["reco_id"], r["n"], r["is_balanced"]) for r in found.collect()) == [("a", "K", 2, True), ("a", "L", 1, False)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

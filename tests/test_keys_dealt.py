"""Entries that share a key, or have none, don't meet in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators.aggregates import NO_KEY
from tallyforge.operators.stores import joined_by_key


def shares(df) -> list[int]:
    return sorted((r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()), reverse=True)


def test_entries_without_a_key_are_dealt(spark):
    """Null and underivable keys are in many partitions of the join, each entry once, with what there is for its key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        key = F.when(F.col("id") % 3 == 0, NO_KEY).when(F.col("id") % 3 == 1, F.concat(F.lit("K"), F.col("id") % 5))
        entries = spark.range(6000).select("id", key.alias("reco_id"))
        by_key = spark.createDataFrame([(NO_KEY, "none"), ("K1", "one"), (None, "null")], "reco_id string, statuses string")
        out = joined_by_key(entries, by_key)
        want = {NO_KEY: "none", "K1": "one"}
        got = out.select("id", "reco_id", "statuses").collect()
        assert sorted(r["id"] for r in got) == list(range(6000)) and all(r["statuses"] == want.get(r["reco_id"]) for r in got)
        for part in ("reco_id is null", f"reco_id = '{NO_KEY}'"):
            n = shares(out.filter(part))
            assert len(n) > 4 and n[0] < 2000 * 0.6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")

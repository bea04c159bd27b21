"""Moves between ledgers keep the tasks that sort keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators.merge import MOVE_TASKS, settle


def shares(df) -> list[int]:
    return sorted((r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()), reverse=True)


def test_moving_rows_keep_their_tasks(spark):
    """Adaptive execution leaves few tasks to keys, which compress well; the sorted sides of a move keep theirs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        live, settled = spark.range(5000).withColumn("flow_id", F.col("id") % 2), spark.range(0, 5000, 7).withColumn("flow_id", F.lit(9).cast("long"))
        stay, there, gone = settle(live, settled, F.col("flow_id") == 1, "id")
        assert (stay.count(), there.filter("flow_id = 1").count(), gone.count()) == (2500, 2500 - 357, 357)
        assert len(shares(there.filter("flow_id = 1"))) > MOVE_TASKS // 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

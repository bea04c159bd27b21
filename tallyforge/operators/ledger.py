"""The ledger's upsert as a whole, on stores that are bucketed by the rows' identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.merge import upsert
from tallyforge.operators.windows import keep_in_batch

#: Columns that an update always takes from the batch, and those that it takes for slices alone.
CONTEXT = ("reco_id", "transaction_particulars", "ref_no", "remarks_1", "transaction_id", "payload", "ingestion_run_id", "parent_hash")
OF_SLICES = ("amount", "direction")


def stored_by_key(spark: SparkSession, df: DataFrame, name: str, folder: str, key: str = "source_hash", buckets: int = 32) -> DataFrame:
    """Stores a table in buckets of its key, sorted within: joins on the key need no shuffle of it."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", folder).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def replaced_parents(staged: DataFrame, parents: DataFrame, slices: Sequence[DataFrame]) -> DataFrame:
    """Hashes of staged rows that their slices stand for: some slice of their claim group, or of their own, is in a store.

    ``parents`` is (source_hash, source_id, claim_type, claim_value); those without a claim are groups of one. Only
    groups of staged rows are looked at, and a store gives its distinct parents before anything meets.
    """
    group = F.when(F.coalesce("claim_value", F.lit("")) == "", F.col("source_hash")).otherwise(F.concat_ws("|", F.col("source_id").cast("string"), "claim_type", "claim_value"))
    grouped = parents.select("source_hash", group.alias("claim_group"))
    ours = grouped.join(staged.select("source_hash"), "source_hash", "left_semi")
    near = grouped.join(ours.select("claim_group").distinct(), "claim_group", "left_semi")
    held = slices[0].select("parent_hash")
    for other in slices[1:]:
        held = held.unionByName(other.select("parent_hash"))
    standing = near.join(held.filter("parent_hash is not null").distinct().withColumnRenamed("parent_hash", "source_hash"), "source_hash", "left_semi")
    return ours.join(standing.select("claim_group").distinct(), "claim_group", "left_semi").select("source_hash")


def ledger_upsert(live: DataFrame, settled: DataFrame, parents: DataFrame, staged: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The live ledger after a batch, with ``change``; a batch that comes again changes nothing.

    Of rows that share a hash the batch's last counts. Rows that are settled don't come back, nor do parents that their
    slices stand for (``replaced_parents``). A row that is there takes the batch's context while it is pending; its
    amount and direction are frozen unless the batch's row is a slice (has a parent). Columns that a ledger lacks are
    left out. With live and settled rows stored by their hash (``stored_by_key``) only the batch is shuffled.
    """
    last = keep_in_batch(staged, "source_hash", list(order), last=True)
    fresh = last.join(settled.select("source_hash"), "source_hash", "left_anti")
    slices = live.filter("parent_hash is not null"), settled.filter("parent_hash is not null")
    fresh = fresh.join(replaced_parents(fresh, parents, slices), "source_hash", "left_anti")
    of_slice = F.col("new_parent_hash").isNotNull()
    policy = {c: "new" for c in CONTEXT if c in live.columns}
    policy |= {c: F.when(of_slice, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")) for c in OF_SLICES if c in live.columns}
    return upsert(live, fresh.select(*live.columns), "source_hash", policy, [F.lit(0)], guard=F.col("old_status") == "PENDING")


def upsert_counts(staged: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: how many of a batch's rows came in, changed a row, or did neither."""
    done = merged.agg(F.count_if(F.col("change") == "INSERTED").cast("long").alias("inserted"), F.count_if(F.col("change") == "UPDATED").cast("long").alias("updated"))
    both = staged.agg(F.count("*").cast("long").alias("n")).join(F.broadcast(done), F.lit(True))  # a row each
    return both.select("inserted", "updated", (F.col("n") - F.col("inserted") - F.col("updated")).alias("skipped"))

"""Splitting claim groups: parents are registered, their slices come in, the movements go, stale slices are reaped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.aggregates import rows, total
from tallyforge.operators.stores import upsert_parents, upsert_slices
from tallyforge.operators.windows import canonical_parent

CLAIM = ["source_id", "claim_type", "claim_value"]


def split_groups(parents: DataFrame, staged_parents: DataFrame, live: DataFrame, settled: DataFrame, slices: DataFrame) -> dict[str, DataFrame]:
    """All tables after a batch of claim groups, and what was done: one consistent version for the caller to swap in.

    ``slices`` are (claim, source_hash, reco_id, amount, ...) of the groups. Parents are upserted first, so that a new
    group's anchor is its oldest parent, and a slice hangs on its group's anchor. Movements of the parents leave the live
    ledger; those that are settled already are flagged and stay where they are. Slices that the groups no longer have go.
    Groups without a parent have nothing to hang slices on, so these are left out.
    """
    merged = upsert_parents(parents, staged_parents, [F.col("value_date"), F.col("order_key")])
    touched = staged_parents.select(*CLAIM).distinct()
    anchors = canonical_parent(merged.join(touched, CLAIM, "left_semi")).select(*CLAIM, F.col("source_hash").alias("parent_hash"))
    hung = slices.join(anchors, CLAIM)
    pushed = staged_parents.select("source_hash").distinct()
    gone = live.join(pushed, "source_hash", "left_semi")
    late = settled.join(pushed, "source_hash", "left_semi").select("source_hash", F.lit(True).alias("late"))
    flagged = merged.join(late, "source_hash", "left")
    flagged = flagged.withColumn("parent_emarged", F.coalesce("late", "parent_emarged")).drop("late")
    kept = live.join(pushed, "source_hash", "left_anti")
    entries = upsert_slices(kept, hung.select(*live.columns), settled, [F.col("amount")])
    stale = entries.join(anchors.select("parent_hash"), "parent_hash", "left_semi").join(hung.select("source_hash"), "source_hash", "left_anti")
    rest = entries.join(stale.select("source_hash"), "source_hash", "left_anti")
    def counted(df: DataFrame, **named: Column) -> DataFrame:
        """(what, n): how many rows meet each condition, in one pass over them."""
        sums = df.agg(*[F.count_if(cond).cast("long").alias(what) for what, cond in named.items()])
        return sums.select(F.inline(F.array(*[F.struct(F.lit(what).alias("what"), F.col(what).alias("n")) for what in named])))

    all_, change = F.lit(True), F.col("change")
    counts = counted(merged, parents_inserted=change == "INSERTED", parents_updated=change == "UPDATED")
    counts = counts.unionByName(counted(entries, slices_inserted=change == "INSERTED", slices_updated=change == "UPDATED"))
    counts = counts.unionByName(counted(hung.join(settled, "source_hash", "left_semi"), slices_skipped=all_))
    counts = counts.unionByName(counted(gone, movements_withdrawn=all_)).unionByName(counted(late, parents_settled=all_)).unionByName(counted(stale, slices_reaped=all_))
    return {"parents": flagged, "live": rest, "anchors": anchors, "counts": counts}


def search_expansion(hits: DataFrame, merges: DataFrame, members: DataFrame, entries: DataFrame, statuses: DataFrame, most_payments: int | None = None) -> dict[str, DataFrame]:
    """What hangs on found settlement keys and buckets, (reco_id, bucket_id) with a null for either.

    ``merges`` is (node, root) of merged buckets: a bucket brings all of its chain. A bucket is the key of its entries.
    Buckets come with sums, keys with the sums of their groups, payments in a fixed order, all of them unless a limit is given (``plans.search.payment_page`` gives them by pages).
    """
    buckets = hits.select("bucket_id").unionByName(hits.select(F.col("reco_id").alias("bucket_id"))).filter("bucket_id is not null")
    buckets = buckets.join(members.select("bucket_id").distinct(), "bucket_id", "left_semi").distinct()
    chain = merges.join(buckets, merges["node"] == buckets["bucket_id"]).select("root").distinct()
    chained = merges.join(chain, "root").select(F.col("node").alias("bucket_id"))
    buckets = buckets.unionByName(chained).distinct()
    keys = hits.select("reco_id").filter("reco_id is not null").unionByName(buckets.select(F.col("bucket_id").alias("reco_id"))).distinct()
    of_buckets = members.join(buckets, "bucket_id", "left_semi").groupBy("bucket_id").agg(rows().alias("members"), total().alias("net"))
    groups = entries.join(keys, "reco_id", "left_semi").groupBy("flow_id", "reco_id", "currency").agg(rows().alias("n"), total().alias("net"))
    payments = statuses.join(keys, "reco_id", "left_semi")
    if most_payments is not None:
        payments = payments.orderBy("reco_id", "po_id", "status_at", "amount").limit(most_payments)
    return {"buckets": of_buckets, "groups": groups, "payments": payments}

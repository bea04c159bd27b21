"""Reattribution of bookings that can be taken back: commit, replay from the log, restore."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.identity import packed, unpacked
from tallyforge.operators.aggregates import MONEY
from tallyforge.operators.merge import upsert
from tallyforge.plans.search import maybe
from tallyforge.session import stored

#: Columns that a slice takes from its booking.
CONTEXT = ("flow_id", "account", "currency", "direction", "value_date", "particulars")
#: Targets are broadcast up to this size, at so many bytes each.
BROADCAST_BYTES, TARGET_BYTES = 32 << 20, 64
#: Marks a slice of a batch that has been settled before.
SETTLED = "settled before"
LEDGER = ("source_hash", *CONTEXT, "reco_id", "amount", "status", "parent_hash")


def slice_hash(claim: Column, target: Column) -> Column:
    """A slice's identity: its claim and where it goes, so that it stays the same whenever it is committed again."""
    return F.sha2(F.concat_ws("|", F.lit("slice"), F.upper(claim), target), 256)


def judge(live: DataFrame, log: DataFrame, targets: DataFrame, items: DataFrame) -> DataFrame:
    """A row a booking that ``items`` (claim, source_hash, target, amount) ask for, with the first reason to refuse it.

    The booking is read from the live ledger, or else from the log of earlier commits (``replay``). Refused are bookings
    of no target, that are nowhere, that the log holds for another claim, that aren't pending, whose particulars no
    longer name the claim, with a target that nothing carries in the booking's flow, and whose slices are zero or
    exceed the booking by their magnitude. ``booking`` holds the booking's columns, ``aims`` its (target, amount).

    Items go to their booking's hash once; all that is asked of a booking, and by whom, is gathered there.
    """
    is_aim = F.col("target").isNotNull()
    dealt = items.filter("claim is not null AND source_hash is not null").repartition("source_hash")
    # a target that comes twice, once with zero, is of one slice; a zero among the items themselves is still refused
    slices = dealt.groupBy("claim", "source_hash", "target").agg(F.sum(F.abs("amount")).cast(MONEY).alias("amount"), F.bool_or(F.col("amount") == 0).alias("zero"))
    # most of a ledger isn't asked for, and stays where it is
    here = maybe(live, items, "source_hash", "source_hash").select("source_hash", F.struct(*LEDGER[1:]).alias("here"))
    stored = log.select("source_hash", F.col("claim").alias("log_claim"), F.struct(*LEDGER[1:]).alias("stored"))
    asked = slices.join(here, "source_hash", "left").join(stored, "source_hash", "left")
    asked = asked.withColumn("booking", F.coalesce("here", "stored")).withColumn("replay", F.col("here").isNull() & F.col("stored").isNotNull())
    there = targets.select("flow_id", "target").distinct().withColumn("known", F.lit(True))
    if targets.count() * TARGET_BYTES <= BROADCAST_BYTES:
        there = F.broadcast(there)
    known = asked.withColumn("flow_id", F.col("booking.flow_id")).join(there, ["flow_id", "target"], "left")
    on = known.groupBy("claim", "source_hash", "booking", "replay", "log_claim").agg(
        F.count_if(is_aim).alias("aimed"),
        F.sum(F.when(is_aim, F.col("amount"))).alias("total"),
        F.bool_or(is_aim & F.col("zero")).alias("any_zero"),
        F.count_if(is_aim & F.col("known").isNull()).alias("unknown"),
        F.collect_list(F.when(is_aim, F.struct("target", "amount"))).alias("aims"),
    )
    on = on.withColumn("slices", F.nullif("aimed", F.lit(0))).withColumn("sliced", F.when(F.col("aimed") > 0, F.coalesce("total", F.lit(0)).cast(MONEY)))
    refusal = (
        F.when(F.col("aimed") == 0, "NO_TARGET")
        .when(F.col("booking").isNull(), "NOT_FOUND")
        .when(F.col("replay") & (F.upper("log_claim") != F.upper("claim")), "OTHER_CLAIM")
        .when(~F.col("replay") & (F.col("booking.status") != "PENDING"), "NOT_PENDING")
        .when(~F.contains(F.upper(F.coalesce("booking.particulars", F.lit(""))), F.upper("claim")), "CLAIM_GONE")
        .when(F.col("unknown") > 0, "UNKNOWN_TARGET")
        .when(F.col("any_zero"), "ZERO_SLICE")
        .when(F.col("sliced") > F.abs("booking.amount"), "EXCEEDS_BOOKING")
    )
    return on.select("claim", "source_hash", "booking", "replay", "slices", "sliced", refusal.alias("refusal"), "aims")


def commit(live: DataFrame, settled: DataFrame, log: DataFrame, targets: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """All tables after a batch of reattributions, and what became of each: {live, log, results}.

    Of an accepted booking (``judge``) the row leaves the live ledger for the log, and a slice for each target comes in:
    its identity is the claim and the target, its sign the booking's, its key the target. Slices that are there already
    follow the new amounts while pending; those of the claim that are no target any more go; settled slices stay as they
    are and don't come again. So a batch that is committed again, with the booking in the log, gives the same ledger.
    A booking that two claims of a batch ask for goes to the least claim, the other is refused as TAKEN. The verdicts
    are stored once, as all three tables stand on them.
    """
    judged = judge(live, log, targets, items)
    winner = F.min(F.when(F.col("refusal").isNull(), F.col("claim"))).over(Window.partitionBy("source_hash"))
    judged = judged.withColumn("winner", winner).withColumn("refusal", F.coalesce("refusal", F.when(F.col("winner") != F.col("claim"), "TAKEN"))).drop("winner")
    judged = stored(judged, "judged")
    accepted = judged.filter("refusal is null").select("claim", "source_hash", "booking", "aims")
    made = accepted.withColumn("aim", F.explode("aims")).select("claim", "source_hash", "booking", "aim.target", F.col("aim.amount").alias("size"))
    sign = F.when(F.col("booking.amount") < 0, -1).otherwise(1)
    slices = made.select(
        slice_hash(F.col("claim"), F.col("target")).alias("source_hash"),
        *[F.col(f"booking.{c}").alias(c) for c in CONTEXT],
        F.col("target").alias("reco_id"),
        (sign * F.col("size")).cast(MONEY).alias("amount"),
        F.lit("PENDING").alias("status"),
        F.col("source_hash").alias("parent_hash"),
    )
    bookings = accepted.select("source_hash")
    # identities are shuffled as bytes; what is settled comes with a status of its own, changes nothing and isn't inserted
    short = packed("source_hash").alias("source_hash")
    kept = live.select(short, *LEDGER[1:]).join(bookings.select(short), "source_hash", "left_anti").select(*LEDGER)
    known = settled.select(short).distinct().withColumn("__settled", F.lit(True))
    fresh = slices.select(short, *LEDGER[1:]).join(known, "source_hash", "left").withColumn("status", F.when(F.col("__settled"), SETTLED).otherwise(F.col("status"))).select(*LEDGER)
    policy = {"amount": "new", "direction": "new", "reco_id": "new", "parent_hash": "new"}
    merged = upsert(kept, fresh, "source_hash", policy, [F.col("amount")], guard=(F.col("old_status") == "PENDING") & (F.col("new_status") != SETTLED))
    merged = merged.filter(~((F.col("change") == "INSERTED") & (F.col("status") == SETTLED))).withColumn("source_hash", unpacked("source_hash"))
    # of what the batch leaves as it is, pending slices of its bookings are no target any more
    suspect = F.coalesce((F.col("change") == "KEPT") & (F.col("status") == "PENDING") & F.col("parent_hash").isNotNull(), F.lit(False))
    still = merged.filter(suspect).join(bookings.withColumnRenamed("source_hash", "parent_hash"), "parent_hash", "left_anti")
    after = merged.filter(~suspect).unionByName(still.select(*merged.columns))
    entry = accepted.select("source_hash", "claim", *[F.col(f"booking.{c}").alias(c) for c in LEDGER[1:]])
    new_log = log.join(bookings, "source_hash", "left_anti").select("source_hash", "claim", *LEDGER[1:]).unionByName(entry)
    outcome = judged.select("claim", "source_hash", "replay", "slices", "sliced", "refusal", F.col("refusal").isNull().alias("applied"))
    return {"live": after, "log": new_log, "results": outcome}


def restore(live: DataFrame, settled: DataFrame, log: DataFrame, claims: DataFrame) -> dict[str, DataFrame]:
    """Takes commits of some claims back: {live, log, refused}; the bookings come from the log, pending slices go.

    A claim of which a slice is settled, or no longer pending, stays as it is and is listed in ``refused``: its booking
    can't come back beside a slice of it. The log loses what it gave back, so a later commit begins anew.
    """
    ours = log.join(claims.select(F.upper("claim").alias("__claim")).distinct(), F.upper("claim") == F.col("__claim"), "left_semi")
    held = reduce(lambda a, b: a.unionByName(b), [live.filter("status <> 'PENDING'").select("parent_hash"), settled.select("parent_hash")])
    fixed = ours.join(held.filter("parent_hash is not null").distinct().withColumnRenamed("parent_hash", "source_hash"), "source_hash", "left_semi")
    back = ours.join(fixed.select("source_hash"), "source_hash", "left_anti")
    parents = back.select(F.col("source_hash").alias("parent_hash"))
    kept = live.filter("parent_hash is not null").select(*LEDGER).join(parents, "parent_hash", "left_anti").select(*LEDGER)
    return {
        "live": live.filter("parent_hash is null").select(*LEDGER).unionByName(kept).unionByName(back.select(*LEDGER)),
        "log": log.join(back.select("source_hash"), "source_hash", "left_anti").select(*log.columns),
        "refused": fixed.select("claim", "source_hash"),
    }

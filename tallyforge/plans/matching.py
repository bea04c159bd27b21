"""Matching: automatic runs, forced matches, exclusions, snapshots, activity, deep search, merge chains."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.aggregates import NO_KEY, balanced_groups, judged_baskets, matchable, rows, total
from tallyforge.operators.merge import settle
from tallyforge.session import shared_folder


def group_id(run: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(run), F.col("flow_id").cast("string"), "reco_id", "currency"), 256)


def auto_match(live: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """(match groups, live rows with match_group): one aggregate finds the groups, one join marks their rows.

    The join comes from the same partitioning as the aggregate, so rows are shuffled once by their key.
    """
    groups = balanced_groups(live).withColumn("match_group", group_id(run))
    keys = ["flow_id", "reco_id", "currency"]
    marked = live.join(groups.select(*keys, "match_group"), keys, "left")
    open_ = (F.col("status") == "PENDING") & F.col("match_group").isNotNull()
    return groups, marked.withColumn("status", F.when(open_, "MATCHED").otherwise(F.col("status")))


def run_counters(live: DataFrame) -> DataFrame:
    """Groups and rows that an automatic run settles, and what stays."""
    groups, marked = auto_match(live, "run")
    return marked.agg(
        F.count_distinct("match_group").cast("long").alias("groups"), F.count_if(F.col("status") == "MATCHED").cast("long").alias("matched"), F.count_if(F.col("status") == "PENDING").cast("long").alias("pending"), total(F.when(F.col("status") == "MATCHED", F.col("amount"))).alias("matched_net")
    )


def force_match(live: DataFrame, baskets: DataFrame, run: str = "forced") -> tuple[DataFrame, DataFrame]:
    """(groups, live rows with match_group): baskets of (basket_id, id) that may match as a whole are FORCED, all others stay.

    Groups are the judged baskets with the reason of a refusal (``basket_check``); an accepted one has a match_group.
    Nothing is read to the driver, so any number of baskets goes at once.
    """
    own = F.sha2(F.concat_ws("|", F.lit(run), F.col("basket_id").cast("string")), 256)
    judged, accepted = judged_baskets(live, baskets)
    groups = judged.withColumn("match_group", F.when(F.col("may_match"), own))
    marked = live.join(accepted, "id", "left").select(*live.columns, F.when(F.col("basket_id").isNotNull(), own).alias("match_group"))
    return groups, marked.withColumn("status", F.when(F.col("match_group").isNotNull(), "FORCED").otherwise(F.col("status")))


def exclude(live: DataFrame, settled: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves rows with an active exclusion to the settled ledger."""
    active = exclusions.filter("cancelled_at is null").select(F.col("entry_id").alias("id")).distinct().withColumn("excluded", F.lit(True))
    marked = live.join(active, "id", "left")
    marked = marked.withColumn("status", F.when(F.col("excluded"), "EXCLUDED").otherwise(F.col("status"))).drop("excluded")
    new_live, new_settled, _ = settle(marked, settled, F.col("status") == "EXCLUDED", "id")
    return new_live, new_settled


def snapshot(live: DataFrame, settled: DataFrame, exclusions: DataFrame, cutoff: str) -> DataFrame:
    """Entries and their state at a time: three disjoint parts, of which the settled ledger alone knows when it settled."""
    t = F.lit(cutoff).cast("timestamp_ntz")
    active = exclusions.filter((F.col("created_at") <= t) & (F.col("cancelled_at").isNull() | (F.col("cancelled_at") > t))).select(F.col("entry_id").alias("id")).distinct().withColumn("excluded", F.lit(True))
    pick = lambda df, state: df.select("id", "flow_id", "reco_id", "amount", "value_date", "external_ref", state.alias("state"))
    now = live.filter(F.col("created_at") <= t).join(active, "id", "left")
    early, late = settled.filter(F.col("settled_at") <= t), settled.filter((F.col("settled_at") > t) & (F.col("created_at") <= t))
    return pick(now, F.when(F.col("excluded"), "EXCLUDED").otherwise("PENDING")).unionByName(pick(early, F.col("status"))).unionByName(pick(late, F.lit("PENDING")))


def daily_activity(log: DataFrame, users: DataFrame, day: str) -> DataFrame:
    """What each user did on a day, with the user's name if there is one."""
    of_day = log.filter(F.to_date("ts") == F.lit(day).cast("date"))
    return of_day.join(users, "user_id", "left").groupBy("user_id", "user_name", "action").agg(rows().alias("n"))


#: Tasks that take rows apart by key: what they read is small, what they hold of it isn't.
INDEX_TASKS = 600
OF_ENTRIES, OF_MEMBERS = ("reco_id", "external_ref", "ref_no", "remarks_1"), ("po_id", "bucket_id")


def named(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(reco_id, field, value) of the fields of each row that have a value, in upper case."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.upper(f).alias("value")) for f in fields])
    return df.select("reco_id", F.explode(pairs).alias("x")).select("reco_id", "x.field", "x.value").filter("value is not null and reco_id is not null")


def keyed_members(members: DataFrame) -> DataFrame:
    return members.withColumn("reco_id", F.concat(F.lit("ORD"), F.col("order_key").cast("string")))


def identifiers(entries: DataFrame, members: DataFrame) -> DataFrame:
    """(reco_id, field, value) of every identifier by which an entry or a bucket can be found, as often as it is there."""
    return named(entries, OF_ENTRIES).unionByName(named(keyed_members(members), OF_MEMBERS))


def identifier_index(entries: DataFrame, members: DataFrame) -> DataFrame:
    """The identifiers once each.

    Rows are shuffled by their key as they are, with all identifiers in one row, which are taken apart behind it. Only
    rows whose key can't be derived, which would meet in one task, are taken apart before.
    """
    real = F.col("reco_id") != NO_KEY
    by_key = lambda df, fields: named(df.filter(real).select("reco_id", *[f for f in fields if f != "reco_id"]).repartition(INDEX_TASKS, "reco_id"), fields).distinct()
    members = keyed_members(members)
    no_key = named(entries.filter(~real), OF_ENTRIES).unionByName(named(members.filter(~real), OF_MEMBERS)).distinct()
    return by_key(entries, OF_ENTRIES).unionByName(by_key(members, OF_MEMBERS)).unionByName(no_key)


def deep_search(index: DataFrame, entries: DataFrame, text: str, broad: bool = False, most: int = 2000) -> DataFrame:
    """Entries of the keys that an identifier names exactly; only if none does, and on demand, of those it is part of."""
    exact = index.filter(F.col("value") == text.upper())
    hits = exact.select("reco_id").distinct()
    if broad and exact.isEmpty():
        hits = index.filter(F.contains(F.col("value"), F.lit(text.upper()))).select("reco_id").distinct()
    found = entries.join(hits, "reco_id", "left_semi")
    return found.orderBy("value_date", "id", "amount", "external_ref").limit(most).select("id", "reco_id", "amount", "status")


def merge_chains(spark: SparkSession, merges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the least node that each is merged with, over links (old, new), cycles included.

    Labels spread over links and jump to their label's label; each round ends in the shared checkpoint folder.
    """
    shared_folder(spark, "chains")  # a checkpoint folder is set from here on
    both = merges.select(F.col("old").alias("a"), F.col("new").alias("b")).unionByName(merges.select(F.col("new").alias("a"), F.col("old").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("root")).checkpoint()
    for _ in range(most):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("n"))
        spread = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "n").alias("root"))
        new = spread.join(labels.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", "old", F.least("root", "next").alias("root")).checkpoint()
        labels = new.select("node", "root")
        if new.filter("old <> root").isEmpty():
            return labels
    raise RuntimeError(f"chains are longer than 2^{most}")


def new_run() -> str:
    return uuid.uuid4().hex


__all__ = ["auto_match", "daily_activity", "deep_search", "exclude", "force_match", "identifier_index", "identifiers", "matchable", "merge_chains", "new_run", "run_counters", "snapshot"]

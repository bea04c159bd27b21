"""Stores of the ledger: parents, slices, bulk keys, look-ups over both stores, traces of writes, lists of runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.aggregates import MONEY, NO_KEY, rows, status_histogram, total
from tallyforge.operators.merge import upsert

#: Parts over which entries without a usable key are dealt.
SALTS = 64


def upsert_parents(parents: DataFrame, staged: DataFrame, order: list[Column]) -> DataFrame:
    """Parents by source_hash: every column follows the batch but parent_emarged, which is decided elsewhere."""
    policy = {c: "new" for c in parents.columns if c not in ("source_hash", "parent_emarged")}
    return upsert(parents, staged, "source_hash", policy, order)


def upsert_slices(live: DataFrame, staged: DataFrame, settled: DataFrame, order: list[Column]) -> DataFrame:
    """Slices by source_hash into the live ledger, without those that are settled.

    Pending rows take key, amount, direction, parent and payload of the batch; a batch without a run keeps the row's run.
    """
    follow = ("reco_id", "amount", "direction", "parent_hash", "payload")
    policy: Mapping[str, str] = {**{c: "new" for c in follow if c in live.columns}, "ingestion_run_id": "new_or_old"}
    fresh = staged.join(settled.select("source_hash"), "source_hash", "left_anti")
    return upsert(live, fresh, "source_hash", policy, order, guard=F.col("old_status") == "PENDING")


def upsert_bulk_keys(known: DataFrame, staged: DataFrame, order: list[Column]) -> DataFrame:
    """(po_id, reco_id, init_module, member_count) by po_id, rewritten only if key or member count differ."""
    differs = ~F.col("new_reco_id").eqNullSafe(F.col("old_reco_id")) | ~F.col("new_member_count").eqNullSafe(F.col("old_member_count"))
    return upsert(known, staged, "po_id", {"reco_id": "new", "init_module": "new", "member_count": "new"}, order, guard=differs)


def traced_collisions(staged: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Keys that a batch has more than once: how many rows, the sum that vanishes, and the amount that stays, the last."""
    ordered = F.struct(*order, F.col("amount"))
    grouped = staged.groupBy(key).agg(rows().alias("n"), total().alias("sum"), F.max(ordered)["amount"].cast(MONEY).alias("kept"))
    return grouped.filter("n > 1").select(key, "n", "kept", (F.col("sum") - F.col("kept")).cast(MONEY).alias("lost"))


def traced_rewrites(live: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Rows of a batch that find their key under another settlement key: old and new, and whether the write is skipped."""
    old = live.select(key, F.col("reco_id").alias("old_reco_id"), F.col("amount").alias("old_amount"), (F.col("status") != "PENDING").alias("skipped"))
    new = staged.select(key, F.col("reco_id").alias("new_reco_id"), F.col("amount").alias("new_amount"))
    return new.join(old, key).filter(~F.col("old_reco_id").eqNullSafe(F.col("new_reco_id")))


def entries_of_keys(live: DataFrame, settled: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of both stores with one of the settlement keys, and the store that each is in, by value date and id."""
    both = live.withColumn("store", F.lit("live")).unionByName(settled.withColumn("store", F.lit("settled")))
    return both.join(keys.select("reco_id").distinct(), "reco_id", "left_semi").orderBy("value_date", "id")


def movements_to_sync(live: DataFrame, settled: DataFrame, scope: str) -> DataFrame:
    """Rows whose payments' statuses are to be fetched: pending live ones, or (scope all) those of both stores."""
    named = lambda df: df.filter(F.col("external_ref").isNotNull())
    return named(live).unionByName(named(settled)) if scope == "all" else named(live.filter("status = 'PENDING'"))


def marked_exclusions(entries: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Entries with their open exclusion, if any, and whether one may still be made or taken back."""
    open_ = exclusions.filter("cancelled_at is null").groupBy(F.col("entry_id").alias("id")).agg(F.max_by("reason", F.struct("created_at", "reason")).alias("reason"))
    marked = entries.join(open_, "id", "left")
    return marked.withColumn("may_exclude", F.col("reason").isNull() & (F.col("status") == "PENDING")).withColumn("may_cancel", F.col("reason").isNotNull())


def ordered_slices(slices: DataFrame, parent: str, label: str) -> DataFrame:
    """Slices that aren't zero with their place: greatest absolute amount first, then by label."""
    w = Window.partitionBy(parent).orderBy(F.abs("amount").desc(), F.col(label).asc())
    return slices.filter("amount <> 0").withColumn("place", F.row_number().over(w))


def run_summary(runs: DataFrame, actionable: list[str]) -> DataFrame:
    """Counters of runs (run_id, kind, status): what an analysis saw and may act on, what a commit did and failed to do."""
    analysis = F.col("kind") == "ANALYZE"
    n = lambda cond: F.count_if(cond).cast("long")
    return runs.groupBy("run_id", "kind").agg(
        rows().alias("movements"),
        n(analysis & F.col("status").isin(*actionable)).alias("actionable"),
        n(~analysis & (F.col("status") == "APPLIED")).alias("applied"),
        n(~analysis & (F.col("status") == "FAILED")).alias("failed"),
    )


def kept_runs(runs: DataFrame, most: int = 50) -> DataFrame:
    """The last runs by start, ties by number: what a store of runs keeps when it is pruned."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(most)


def listed(rows_: DataFrame, wanted: Mapping[str, object], newest: str, tie: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of a list, the newest first, ties by the greater ``tie``; only rows that have each wanted value that isn't null."""
    for name, value in wanted.items():
        if value is not None:
            rows_ = rows_.filter(F.col(name) == F.lit(value))
    return rows_.orderBy(F.col(newest).desc(), F.col(tie).desc()).offset(skip).limit(limit)


def write_by_family(rows_: DataFrame, folder: str, key: str, sep: str = ";") -> DataFrame:
    """Writes merged extracts, a folder for each ``family``, the canonical key as last column; gives how many rows each has."""
    names = [c for c in rows_.columns if c not in ("family", key)]
    rows_.select("family", *names, key).write.partitionBy("family").option("header", True).option("escape", '"').csv(folder, sep=sep)
    back = rows_.sparkSession.read.option("header", True).option("escape", '"').option("multiLine", True).csv(folder, sep=sep)
    return back.groupBy("family").agg(rows().alias("rows"), F.count_distinct(key).cast("long").alias("keys"))


def bucket_report(members: DataFrame, keys: DataFrame, top: int = 3) -> DataFrame:
    """Per bucket: members, sums, its spread of amounts, and its ``top`` key values by members, ties by value."""
    sums = members.groupBy("bucket_id").agg(
        rows().alias("members"), total().alias("net"), F.min("amount").alias("least"), F.max("amount").alias("greatest"), F.size(F.collect_set("kind")).cast("long").alias("kinds")
    )
    by_hash = lambda df: df.repartition("source_hash").distinct()  # noqa: E731  (rows are distinct where they are joined)
    linked = by_hash(members.select("bucket_id", "source_hash")).join(by_hash(keys), "source_hash")
    held = linked.select("bucket_id", "key_type", "key_value").repartition("bucket_id").groupBy("bucket_id", "key_type", "key_value").agg(rows().alias("n"))
    w = Window.partitionBy("bucket_id").orderBy(F.desc("n"), "key_type", "key_value")
    first = held.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    text = F.concat_ws(" ", F.concat_ws(":", "key_type", "key_value"), F.col("n").cast("string"))
    lists = first.groupBy("bucket_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), ", ").alias("top_keys"))
    return sums.join(lists, "bucket_id", "left")


def traced_key(members: DataFrame, keys: DataFrame, key_type: str, key_value: Column) -> DataFrame:
    """Buckets that carry a key, with their members in all and those that carry it."""
    on = keys.filter((F.col("key_type") == key_type) & (F.col("key_value") == key_value)).select("source_hash").distinct().withColumn("carries", F.lit(1))
    marked = members.select("bucket_id", "source_hash").join(on, "source_hash", "left")
    return marked.groupBy("bucket_id").agg(rows().alias("members"), F.sum(F.coalesce("carries", F.lit(0))).cast("long").alias("carrying")).filter("carrying > 0")


def key_sharing(keys: DataFrame) -> DataFrame:
    """How many key values are shared by how many members, per type of key."""
    sizes = keys.distinct().groupBy("key_type", "key_value").agg(rows().alias("members"))
    return sizes.groupBy("key_type", "members").agg(rows().alias("key_values"))


def joined_by_key(entries: DataFrame, by_key: DataFrame) -> DataFrame:
    """Entries with what ``by_key`` has for their key, if anything; it has a key once.

    Entries without a key, and those whose key can't be derived, are a fixed share of a ledger and would all meet in one
    task: they are dealt over ``SALTS`` parts, and a row for the underivable key is there in each.
    """
    open_ = F.col("reco_id").isNull() | (F.col("reco_id") == NO_KEY)
    dealt = entries.withColumn("__part", F.when(open_, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    parts = F.when(F.col("reco_id") == NO_KEY, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(by_key.withColumn("__part", F.explode(parts)), ["reco_id", "__part"], "left").drop("__part")


def export_table(entries: DataFrame, statuses: DataFrame, flows: DataFrame) -> DataFrame:
    """Entries as the 19 columns of their export: payments as counts by status, times as one moment or a span."""
    on = joined_by_key(entries, status_histogram(statuses)).join(flows, "flow_id", "left")
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    low, high = day("first_at"), day("last_at")
    span = F.when(low == high, low).when(low == "", high).when(high == "", low).otherwise(F.concat_ws(" → ", low, high))
    columns = {
        "Flow": F.coalesce("flow_name", F.concat(F.lit("#"), F.col("flow_id").cast("string"))),
        "Key": F.col("reco_id"),
        "Account": F.col("account"),
        "Currency": F.col("currency"),
        "Amount": F.col("amount").cast("string"),
        "Direction": F.col("direction"),
        "Value date": day("value_date"),
        "Operation date": day("operation_date"),
        "Event type": F.col("event_type"),
        "Transaction ID": F.col("id").cast("string"),
        "External ref": F.col("external_ref"),
        "File name": F.col("file_name"),
        "Particulars": F.col("particulars"),
        "Ref no": F.col("ref_no"),
        "Remarks 1": F.col("remarks_1"),
        "Status": F.col("status"),
        "Matched at": day("matched_at"),
        "Payments": F.coalesce("statuses", F.lit("")),
        "Payment time": F.when(F.col("statuses").isNull(), "").otherwise(span),
    }
    return on.select(*[c.alias(name) for name, c in columns.items()])


def snapshot_sheets(snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary by flow and state, entries) of a snapshot: the two sheets of its export."""
    return snapshot.groupBy("flow_id", "state").agg(rows().alias("n"), total().alias("net")), snapshot

"""Grouped computations over the ledger, its buckets and its feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import stored

#: A settlement key that stands for "none can be derived"; it never matches anything.
NO_KEY = "Not Supported"
MONEY = "decimal(20,4)"


def total(column: str | Column = "amount") -> Column:
    """An exact sum at the precision of money; zero for no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast(MONEY)


def rows() -> Column:
    return F.count("*").cast("long")


def matchable(entries: DataFrame) -> DataFrame:
    """Pending rows whose key may match."""
    return entries.filter((F.col("status") == "PENDING") & F.col("reco_id").isNotNull() & (F.col("reco_id") != NO_KEY))


def balanced_groups(entries: DataFrame) -> DataFrame:
    """Groups of flow, key and currency that sum to exactly zero."""
    return pending_groups(entries).filter(F.col("total") == 0)


def pending_groups(entries: DataFrame) -> DataFrame:
    """Every matchable group with its sum and size, balanced or not."""
    return matchable(entries).groupBy("flow_id", "reco_id", "currency").agg(total().alias("total"), rows().alias("n"))


def flow_kpis(entries: DataFrame) -> DataFrame:
    """Per flow and status: rows, net, credits and debits."""
    return entries.groupBy("flow_id", "status").agg(
        rows().alias("n"),
        total().alias("net"),
        total(F.when(F.col("amount") > 0, F.col("amount"))).alias("credit"),
        total(F.when(F.col("amount") < 0, F.col("amount"))).alias("debit"),
    )


def kpis_at_run(entries: DataFrame, run: int) -> DataFrame:
    """KPIs as they stood after run ``run``: later rows don't exist yet."""
    return flow_kpis(entries.filter(F.col("ingestion_run_id") <= run))


def oldest_pending(live: DataFrame) -> DataFrame:
    return live.groupBy("flow_id").agg(F.min("value_date").alias("oldest"))


def daily_ingestion(runs: DataFrame, year: int, month: int) -> DataFrame:
    """Rows ingested per flow and day of a month, and how many runs failed."""
    of_month = runs.filter((F.year("day") == year) & (F.month("day") == month))
    return of_month.groupBy("flow_id", F.dayofmonth("day").alias("dom")).agg(F.sum("rows_ok").alias("rows_ok"), F.count_if(F.col("status") == "FAILED").cast("long").alias("failed"))


def dashboard(flows: DataFrame, entries: DataFrame, since: str) -> DataFrame:
    """One row per flow, zero where nothing happened: counts by status, matched with forced, new rows since a day."""
    n = lambda cond: F.count_if(cond).cast("long")
    by_flow = entries.groupBy("flow_id").agg(
        n(F.col("status") == "PENDING").alias("pending"),
        n(F.col("status").isin("MATCHED", "FORCED")).alias("matched"),
        n(F.col("status") == "EXCLUDED").alias("excluded"),
        n(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")).alias("fresh"),
        F.sum(F.when(F.col("status") == "PENDING", F.col("amount"))).cast(MONEY).alias("pending_net"),
    )
    filled = flows.join(by_flow, "flow_id", "left")
    return filled.select("flow_id", "flow_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pending", "matched", "excluded", "fresh")], F.coalesce("pending_net", F.lit(0)).cast(MONEY).alias("pending_net"))


def bucket_summary(members: DataFrame) -> DataFrame:
    """Size, sums, currencies, currencies that don't net to zero, dates and status counts of each bucket."""
    per_currency = members.groupBy("bucket_id", "currency").agg(
        F.sum("amount").alias("net"),
        F.sum(F.when(F.col("amount") < 0, F.col("amount"))).alias("debit"),
        F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("credit"),
        rows().alias("n"),
        F.min("value_date").alias("first_date"),
        F.max("value_date").alias("last_date"),
        F.count_if(F.col("status") == "PENDING").alias("pending"),
        F.count_if(F.col("status") == "MATCHED").alias("matched"),
    )
    return per_currency.groupBy("bucket_id").agg(
        F.sum("n").alias("member_count"),
        total("net").alias("net"),
        total("debit").alias("debit"),
        total("credit").alias("credit"),
        F.count("currency").cast("long").alias("currencies"),
        F.count_if(F.col("net") != 0).cast("long").alias("unbalanced"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum("pending").alias("pending"),
        F.sum("matched").alias("matched"),
    )


def bucket_state(summary: DataFrame) -> DataFrame:
    """Adds state and is_balanced: a merged bucket stays so, others are matched once nothing is pending.

    A column ``merged`` says which buckets are merged into another; without it none is. A bucket is balanced if every
    currency nets to zero.
    """
    merged = F.coalesce("merged", F.lit(False)) if "merged" in summary.columns else F.lit(False)
    state = F.when(merged, "merged").when((F.col("member_count") > 0) & (F.col("pending") == 0) & (F.col("matched") > 0), "matched").otherwise("pending")
    return summary.withColumn("state", state).withColumn("is_balanced", (F.col("member_count") > 0) & (F.col("unbalanced") == 0))


def row_changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """INSERT, UPDATE and DELETE rows between two versions of a table, with the old and new values as JSON."""
    old = before.select(F.col(key).alias("old_key"), *[F.col(c).alias(f"old_{c}") for c in columns])
    new = after.select(F.col(key).alias("new_key"), *[F.col(c).alias(f"new_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    both = old.join(new, F.col("old_key") == F.col("new_key"), "full_outer")
    action = F.when(F.col("old_key").isNull(), "INSERT").when(F.col("new_key").isNull(), "DELETE").when(~same, "UPDATE")
    return both.withColumn("action", action).filter("action is not null").select(F.coalesce("new_key", "old_key").alias(key), "action", *[f"{v}_{c}" for c in columns for v in ("old", "new")])


def status_histogram(statuses: DataFrame) -> DataFrame:
    """Per key a text of status counts, busiest first, and the span of times; an unknown status counts as ``?``."""
    counted = statuses.groupBy("reco_id", F.coalesce("status", F.lit("?")).alias("status")).agg(rows().alias("n"), F.min("status_at").alias("lo"), F.max("status_at").alias("hi"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "status", "n")))
    text = F.array_join(F.transform(pairs, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["status"])), " · ")
    return counted.groupBy("reco_id").agg(text.alias("statuses"), F.sum("n").alias("payments"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"))


def status_options(statuses: DataFrame) -> DataFrame:
    """Distinct statuses with their counts."""
    return statuses.groupBy(F.coalesce("status", F.lit("?")).alias("status")).agg(rows().alias("n"))


def bucket_flags(members: DataFrame) -> DataFrame:
    """Whether a bucket has slices only, and whether any slice is in it."""
    sliced = F.col("parent_hash").isNotNull()
    return members.groupBy("bucket_id").agg(F.bool_and(sliced).alias("synthetic_only"), F.bool_or(sliced).alias("any_slice"))


def hub_keys(keys: DataFrame, least: int = 2) -> DataFrame:
    """Key values that link at least ``least`` members."""
    return keys.groupBy("key_type", "key_value").agg(F.count_distinct("source_hash").cast("long").alias("members")).filter(F.col("members") >= least)


def hub_signatures(members: DataFrame, keys: DataFrame, least: int = 2) -> DataFrame:
    """Members grouped by the set of hubs that they hang on: one row per set, with members and their sum."""
    if least == 2:  # two extremes say as much as a count of distinct members, and are merged before they are shuffled
        hubs = keys.groupBy("key_type", "key_value").agg(F.min("source_hash").alias("a"), F.max("source_hash").alias("b")).filter("a <> b")
    else:
        hubs = hub_keys(keys, least)
    on = keys.join(stored(hubs.select("key_type", "key_value"), "hubs"), ["key_type", "key_value"])
    sets = on.groupBy("source_hash").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "key_type", "key_value"))), "|").alias("signature"))
    joined = members.join(sets, "source_hash", "left")
    return joined.groupBy(F.coalesce("signature", F.lit("")).alias("signature")).agg(rows().alias("members"), total().alias("net"))


def members_by_kind(members: DataFrame) -> DataFrame:
    """Members by kind and direction, with counts by status."""
    direction = F.when(F.col("amount") < 0, "DEBIT").otherwise("CREDIT")
    return members.groupBy("kind", direction.alias("direction")).agg(rows().alias("n"), total().alias("net"), F.count_if(F.col("status") == "PENDING").cast("long").alias("pending"))


def key_types(keys: DataFrame) -> DataFrame:
    """Distinct values and links per type of key."""
    return keys.groupBy("key_type").agg(F.count_distinct("key_value").cast("long").alias("key_values"), rows().alias("links"))


def key_values(keys: DataFrame, key_type: str) -> DataFrame:
    """Members per value of a type of key."""
    return keys.filter(F.col("key_type") == key_type).groupBy("key_value").agg(F.count_distinct("source_hash").cast("long").alias("members"))


def casing_conflicts(payments: DataFrame, column: str) -> DataFrame:
    """Values that occur in more than one spelling once case is folded."""
    grouped = payments.groupBy(F.upper(column).alias("folded")).agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias("spellings"), F.count_distinct(column).cast("long").alias("n_spellings"), rows().alias("n"))
    return grouped.filter("n_spellings > 1")


def bulk_groups(payments: DataFrame, module: str = "MULTI") -> DataFrame:
    """Messages that are bulks: at least two payments, or any that came in as several lines."""
    grouped = payments.groupBy("message_id").agg(F.count_distinct("po_id").cast("long").alias("members"), F.bool_or(F.col("init_module") == module).alias("multiline"))
    return grouped.filter((F.col("members") >= 2) | F.col("multiline"))


def key_windows(rows_: DataFrame, key: str, date: str, before: int, after: int) -> DataFrame:
    """[first date - before days, last date + after days + 1) of each key."""
    day = F.to_date(date)
    return rows_.groupBy(key).agg(F.date_sub(F.min(day), before).alias("date_from"), F.date_add(F.max(day), after + 1).alias("date_to"))


def feed_statistics(rows_: DataFrame, file: str, key: str) -> DataFrame:
    """Rows, rows with a key, and distinct keys of each file."""
    filled = F.nullif(F.col(key), F.lit(""))
    return rows_.groupBy(file).agg(rows().alias("rows"), F.count(filled).cast("long").alias("with_key"), F.count_distinct(filled).cast("long").alias("keys"))


def match_rates(left: DataFrame, hits: DataFrame, key: str, by: str) -> DataFrame:
    """Per group: distinct keys, those that have a hit, and their share in percent (null for none)."""
    marked = left.join(hits.select(F.col(key).alias("hit_key")).distinct(), F.col(key) == F.col("hit_key"), "left")
    of_key = marked.groupBy(by, key).agg(F.bool_or(F.col("hit_key").isNotNull()).alias("hit"))
    return of_key.groupBy(by).agg(F.count(key).cast("long").alias("keys"), F.count_if("hit").cast("long").alias("matched")).withColumn(
        "pct", F.round(F.lit(100.0) * F.col("matched") / F.nullif(F.col("keys"), F.lit(0)), 2)
    )


def basket_check(live: DataFrame, baskets: DataFrame) -> DataFrame:
    """A row for each basket of (basket_id, id): what it holds, whether it may be matched by force, and else why not.

    An id that is asked for twice counts once. A basket is refused if an id isn't in the live ledger (it never was, or is
    settled), if a row isn't pending, if flows or currencies differ, or if the sum isn't zero; the first of these is the
    refusal, and ``missing`` and ``not_pending`` list all bad ids. An id that several acceptable baskets ask for goes to
    the least of them, the others are refused as TAKEN. ``reco_id`` is the rows' key if they have one alone.
    """
    return judged_baskets(live, baskets)[0]


def judged_baskets(live: DataFrame, baskets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``basket_check``, (basket_id, id) of the accepted baskets).

    Rows are shuffled once by id, where they meet the ledger, and once by basket, and are stored with their basket's
    refusal; after that only ids that several baskets ask for are compared.
    """
    asked = baskets.select("basket_id", "id").repartition("id").distinct().withColumn("shared", F.count("*").over(Window.partitionBy("id")) > 1)
    found = asked.join(live.select("id", F.lit(True).alias("here"), "flow_id", "currency", "amount", "status", "reco_id"), "id", "left")
    away, busy = F.col("here").isNull(), F.col("here") & (F.col("status") != "PENDING")
    w = Window.partitionBy("basket_id")
    one = lambda c: F.coalesce(F.min(c).over(w) == F.max(c).over(w), F.lit(False))
    refusal = (
        F.when(F.bool_or(away).over(w), "NOT_FOUND")
        .when(F.bool_or(busy).over(w), "NOT_PENDING")
        .when(~one("flow_id"), "FLOWS")
        .when(~one("currency"), "CURRENCIES")
        .when(F.coalesce(F.sum("amount").over(w), F.lit(0)) != 0, "NOT_BALANCED")
    )
    on = stored(found.withColumn("refusal", refusal), "baskets")
    listed = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("id")))).cast("array<string>"), ",")
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")
    sums = on.groupBy("basket_id").agg(
        rows().alias("n"),
        distinct("flow_id").alias("flows"),
        distinct("currency").alias("currencies"),
        total().alias("total"),
        listed(away).alias("missing"),
        listed(busy).alias("not_pending"),
        F.min("flow_id").alias("flow_id"),
        F.min("currency").alias("currency"),
        F.when(F.min("reco_id") == F.max("reco_id"), F.min("reco_id")).alias("reco_id"),
        F.min("refusal").alias("refusal"),
    )
    fit = on.filter("refusal is null")
    first = F.min("basket_id").over(Window.partitionBy("id"))
    taken = stored(fit.filter("shared").select("basket_id", first.alias("first")).filter("basket_id <> first").select("basket_id").distinct(), "taken")
    judged = sums.join(taken.withColumn("taken", F.lit("TAKEN")), "basket_id", "left").withColumn("refusal", F.coalesce("refusal", "taken")).drop("taken")
    accepted = fit.select("basket_id", "id").join(taken, "basket_id", "left_anti").repartition("id").distinct()  # the ledger may have an id twice
    return judged.withColumn("may_match", F.col("refusal").isNull()), accepted

"""Joins between feeds: lookups, fallbacks, ranges, semi and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def key_lookup(keys: DataFrame, payments: DataFrame, key: str, column: str) -> DataFrame:
    """Payments whose ``column`` is one of the distinct keys, both in upper case."""
    wanted = keys.select(F.upper(key).alias("lookup_key")).filter("lookup_key is not null").distinct()
    return payments.withColumn("lookup_key", F.upper(column)).join(wanted, "lookup_key")


def reference_of_payment(orders: DataFrame, payments: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Per key the first of two identifiers of its payments that isn't blank (least value of several)."""
    found = payments.select(F.col(key), F.coalesce(blank_to_null(first), blank_to_null(second)).alias("resolved")).filter("resolved is not null")
    return orders.select(key).distinct().join(found, key).groupBy(key).agg(F.min("resolved").alias("resolved"))


def return_to_payment(returns: DataFrame, payments: DataFrame, how: str = "inner") -> DataFrame:
    """Two hops: a return to its original payment, to that payment's identifiers."""
    return returns.select("return_po", "original_po").join(payments.select(F.col("po_id").alias("original_po"), "pacs008", "message_id"), "original_po", how)


def fan_out(payments: DataFrame, seeds: DataFrame) -> DataFrame:
    """All payments of the messages that the seed payments belong to."""
    messages = payments.join(seeds.select("po_id").distinct(), "po_id", "left_semi").select("message_id").distinct()
    return payments.join(messages, "message_id", "left_semi")


def windowed_lookup(keys: DataFrame, payments: DataFrame, key: str, date: str) -> DataFrame:
    """Payments of a key within the key's own dates [date_from, date_to); undated payments always fit.

    The key is the hash key, dates are a residue, so a reused label meets its own rows only.
    """
    on = payments.join(keys, key)
    day = F.to_date(date)
    return on.filter(F.col(date).isNull() | ((day >= F.col("date_from")) & (day < F.col("date_to"))))


def first_hit(left: DataFrame, lookups: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """Adds ``value`` and ``tier``: the first lookup (column, DataFrame of key, value) that has the row's key.

    Only rows without a hit so far meet the next lookup, as its condition says.
    """
    out = left
    for i, (column, table) in enumerate(lookups):
        keyed = table.select(F.col(table.columns[0]).alias(f"__k{i}"), F.col(table.columns[1]).alias(f"__v{i}"))
        missed = reduce(lambda a, b: a & b, [F.col(f"__v{j}").isNull() for j in range(i)], F.lit(True))
        out = out.join(keyed, missed & (F.col(column) == F.col(f"__k{i}")), "left")
    values = [F.col(f"__v{i}") for i in range(len(lookups))]
    tier = reduce(lambda rest, i: F.when(values[i].isNotNull(), i + 1).otherwise(rest), range(len(lookups) - 1, -1, -1), F.lit(None).cast("int"))
    return out.withColumn(value, F.coalesce(*values)).withColumn("tier", tier).select(*left.columns, value, "tier")


def any_key_lookup(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Per key one entry whose reco_id, ref_no or remarks_1 is that key: live before settled, then least id, amount."""
    listed = entries.select("id", "amount", "status", F.explode(F.array_distinct(F.array("reco_id", "ref_no", "remarks_1"))).alias("lookup_key")).filter("lookup_key is not null")
    hits = listed.join(keys.select("lookup_key").distinct(), "lookup_key")
    best = F.min(F.struct((F.col("status") != "PENDING").cast("int").alias("store"), "id", "amount"))
    return hits.groupBy("lookup_key").agg(best.alias("b"), F.count("*").cast("long").alias("hits")).select("lookup_key", "b.store", "b.id", "b.amount", "hits")


def two_feeds(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two feeds (key, amount): whether each key matched, and by how much amounts differ."""
    a, b = left.select(F.col(key).alias("k1"), F.col("amount").alias("amount_1")), right.select(F.col(key).alias("k2"), F.col("amount").alias("amount_2"))
    both = a.join(b, F.col("k1") == F.col("k2"), "full_outer")
    matched = F.col("k1").isNotNull() & F.col("k2").isNotNull()
    return both.select(
        F.coalesce("k1", "k2").alias(key),
        "amount_1",
        "amount_2",
        F.when(matched, "Y").otherwise("N").alias("matched"),
        (F.coalesce("amount_1", F.lit(0)) - F.coalesce("amount_2", F.lit(0))).cast("decimal(20,4)").alias("delta"),
    )


def member_with_entry(members: DataFrame, live: DataFrame, settled: DataFrame) -> DataFrame:
    """Members with the amount and status of their entry, live before settled."""
    a = live.select("entry_key", F.col("amount").alias("live_amount"), F.col("status").alias("live_status"))
    b = settled.select("entry_key", F.col("amount").alias("settled_amount"), F.col("status").alias("settled_status"))
    joined = members.join(a, "entry_key", "left").join(b, "entry_key", "left")
    return joined.select(*members.columns, F.coalesce("live_amount", "settled_amount").alias("entry_amount"), F.coalesce("live_status", "settled_status").alias("entry_status"))


def with_status_in(entries: DataFrame, statuses: DataFrame, wanted: list[str]) -> DataFrame:
    """Entries of a key that has a payment in one of the statuses; ``?`` stands for no status."""
    hit = F.col("status").isin([w for w in wanted if w != "?"])
    hit = hit | F.col("status").isNull() if "?" in wanted else hit
    return entries.join(statuses.filter(hit).select("reco_id").distinct(), "reco_id", "left_semi")


def not_yet_known(rows: DataFrame, stores: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the stores."""
    known = reduce(lambda a, b: a.unionByName(b), [s.select(key) for s in stores])
    return rows.join(known, key, "left_anti")


def still_replaced(parents: DataFrame, slices: DataFrame) -> DataFrame:
    """Parents that may not come back, since a slice of their claim group, or of their own, stands in either ledger.

    Parents without a claim are groups of one.
    """
    group = F.when(F.col("claim_value") == "", F.col("source_hash")).otherwise(F.concat_ws("|", F.col("source_id").cast("string"), "claim_type", "claim_value"))
    grouped = parents.withColumn("claim_group", group)
    held = grouped.join(slices.select(F.col("parent_hash").alias("source_hash")).distinct(), "source_hash", "left_semi").select("claim_group").distinct()
    return grouped.join(held, "claim_group", "left_semi").drop("claim_group")


def active_at(entries: DataFrame, exclusions: DataFrame, cutoff: str) -> DataFrame:
    """Entries with the exclusion that was active at a time: made by then, and not cancelled by then; the latest of several."""
    t = F.lit(cutoff).cast("timestamp_ntz")
    active = exclusions.filter((F.col("created_at") <= t) & (F.col("cancelled_at").isNull() | (F.col("cancelled_at") > t)))
    latest = active.groupBy(F.col("entry_id").alias("id")).agg(F.max(F.struct("created_at", "user_id", "reason")).alias("x"))
    return entries.join(latest.select("id", F.col("x.created_at").alias("excluded_at"), F.col("x.user_id").alias("excluded_by"), F.col("x.reason").alias("reason")), "id", "left")


def run_at(text: Column, n: int):
    """The function of a place to the run of n characters from there."""
    return lambda i: F.substr(text, i, F.lit(n))


def text_lookup(keys: DataFrame, entries: DataFrame, exact: str, text: str, gram: int = 4) -> DataFrame:
    """Entries that name a key: by equality of ``exact`` first, then, for keys without such a hit, anywhere in ``text``.

    The second step finds candidates by an equi join on runs of ``gram`` characters, a key's last one with all of a
    text's (a shorter key's whole with all runs of its length), and keeps those whose text contains the key. So no text
    is compared with keys that share nothing with it.
    """
    wanted = keys.select(F.upper("lookup_key").alias("lookup_key")).filter("lookup_key <> ''").distinct()
    equal = entries.select("id", F.upper(exact).alias("lookup_key")).join(wanted, "lookup_key").select("lookup_key", "id", F.lit("EXACT").alias("stage"))
    rest = wanted.join(equal.select("lookup_key").distinct(), "lookup_key", "left_anti").withColumn("gram", F.right("lookup_key", F.lit(gram)))
    lengths = sorted(r[0] for r in wanted.select(F.least(F.length("lookup_key"), F.lit(gram))).distinct().collect())  # at most ``gram`` numbers
    body = F.upper(text)
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(body) - n + 1, F.lit(1))), run_at(body, n)) for n in lengths]
    if not runs:
        return equal
    # texts aren't carried along with their runs: candidates are (id, key), and meet the text once
    split = entries.select("id", F.explode(F.array_distinct(F.concat(*runs))).alias("gram"))
    pairs = split.join(rest, "gram").select("id", "lookup_key").distinct()
    found = pairs.join(entries.select("id", body.alias("body")), "id").filter(F.contains("body", "lookup_key"))
    return equal.unionByName(found.select("lookup_key", "id", F.lit("TEXT").alias("stage")).distinct())


def payments_behind(movements: DataFrame, payments: DataFrame, own: str, other: str) -> DataFrame:
    """Movements with the number and sum of the payments that carry their key, in upper case; payments are summed first."""
    sums = payments.groupBy(F.upper(other).alias("k")).agg(F.count("*").cast("long").alias("n"), F.sum("amount").cast("decimal(20,4)").alias("total"))
    return movements.withColumn("k", F.upper(own)).join(sums, "k").drop("k")


def status_lookups(movements: DataFrame, payments: DataFrame, fields: list[str]) -> DataFrame:
    """(movement_id, field, status, n): payments by status behind each movement by each of the fields, counted by key first."""
    one = lambda f: movements.select("movement_id", F.upper(f).alias("k")).join(payments.groupBy(F.upper(f).alias("k"), "status").agg(F.count("*").cast("long").alias("n")), "k").select("movement_id", F.lit(f).alias("field"), "status", "n")
    return reduce(lambda a, b: a.unionByName(b), map(one, fields))


def base_reference(movements: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of a movement by its transaction id, which external references carry before ``#``."""
    return entries.withColumn("transaction_id", F.split("external_ref", "#")[0]).join(movements.select("transaction_id").distinct(), "transaction_id").select("id", "transaction_id", "external_ref", "amount")


def resolve_target(keys: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """Target of each key by the first tier (key, target) that has any: one target resolves it, several are ambiguous."""
    left, parts = keys.select("lookup_key").distinct(), []
    for i, tier in enumerate(tiers):
        hits = left.join(tier.toDF("lookup_key", "target"), "lookup_key").groupBy("lookup_key").agg(F.count_distinct("target").cast("long").alias("n"), F.min("target").alias("target"))
        parts.append(hits.select("lookup_key", F.lit(i + 1).alias("tier"), F.when(F.col("n") == 1, F.col("target")).alias("target"), F.when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS").alias("outcome")))
        left = left.join(hits.select("lookup_key"), "lookup_key", "left_anti")
    parts.append(left.select("lookup_key", F.lit(None).cast("int").alias("tier"), F.lit(None).cast("string").alias("target"), F.lit("NONE").alias("outcome")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def candidate_rates(rows: DataFrame, hits: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """How many of the rows each pair (own column, other's column) matches, on one denominator."""
    base = rows.select("row_id", *{a for a, _ in pairs})
    one = None
    for a, b in pairs:
        keys = hits.select(F.upper(b).alias("hit")).filter("hit is not null").distinct()
        n = base.join(keys, F.upper(a) == F.col("hit"), "left").agg(F.count_distinct("row_id").cast("long").alias("rows"), F.count_distinct(F.when(F.col("hit").isNotNull(), F.col("row_id"))).cast("long").alias("matched"))
        n = n.select(F.lit(f"{a}={b}").alias("pair"), "rows", "matched")
        one = n if one is None else one.unionByName(n)
    return one


def rekey_bulks(entries: DataFrame, bulks: DataFrame) -> DataFrame:
    """Pending entries of a bulk's members get the bulk's key (never their own again); others stay."""
    keyed = bulks.select(F.col("member_key").alias("reco_id"), "bulk_key").filter("member_key <> bulk_key").dropDuplicates(["reco_id"])
    joined = entries.join(keyed, "reco_id", "left")
    new = F.when(F.col("status") == "PENDING", F.coalesce("bulk_key", "reco_id")).otherwise(F.col("reco_id"))
    return joined.select(*[c for c in entries.columns if c != "reco_id"], new.alias("reco_id"), (F.col("bulk_key").isNotNull() & (F.col("status") == "PENDING")).alias("rekeyed"))

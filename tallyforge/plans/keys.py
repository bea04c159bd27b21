"""Derivation of settlement keys from movements: one cascade of conditions over four lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.normalise import clean, segments
from tallyforge.operators.aggregates import NO_KEY

# Fixed values of the feeds.
INSTANT = ("SWIFT", "SCRT1", "BKRTP", "REV SCRT1")
BULK = ("SCTXB", "SDDXB", "SDXBB")
SINGLE = ("NCC", "NCP", "RRS")
RETURNED = ("RCC", "RCP")
CHANNELS = ("Z6", "Z9")


def settlement_keys(movements: DataFrame, payments: DataFrame, reversals: DataFrame, returns: DataFrame, bulks: DataFrame) -> DataFrame:
    """Movements with reco_id and rule (which branch decided); null keys are retried, ``Not Supported`` never.

    The four tables are (key, value) with unique keys: payment order to key, reversed reference to key, return to key,
    reference to its bulk's key. The branch follows from the movement alone and asks for one look-up at most, so the
    tables are joined as one, by (table, key), and only with the movements that ask.
    """
    part = lambda i: F.try_element_at(F.col("seg"), F.lit(i))
    hashed = F.col("particulars").contains("##")
    ref, single = clean(F.col("ref_no")), clean(part(4))
    returned = F.when(hashed, clean(F.element_at("seg", -1))).otherwise(single)
    first, second = F.upper(F.trim(part(1))), F.coalesce(F.upper(F.trim(part(2))), F.lit(""))
    none, no_key = F.lit(None).cast("string"), F.lit(NO_KEY)
    n = F.size("seg")
    # (rule, condition, table to ask, key to ask for, value if nothing is asked or found)
    rules = [
        ("channel", F.col("channel").isin(*CHANNELS), None, none, ref),
        ("no_segments", F.col("particulars").isNull() | (n <= 1), None, none, no_key),
        ("return", first == "NDRT", "return", returned, none),
        ("instant", first.isin(*INSTANT) & ref.isNotNull(), "bulk", ref, ref),
        ("instant_reversal", (first == "REV SCRT1") & (n > 3), None, none, part(4)),
        ("instant_single", first.isin(*INSTANT) & second.isin(*SINGLE), None, none, none),
        ("bulk", first.isin(*BULK) & second.isin("I", "O"), None, none, clean(F.col("remarks_1"))),
        ("bulk_return", first.isin(*BULK) & second.isin(*RETURNED), "return", returned, none),
        ("bulk_single", first.isin(*BULK) & second.isin(*SINGLE) & (n >= 4), "payment", single, none),
        ("bulk_other", first.isin(*BULK), "reversal", part(2), no_key),
        ("other_return", second.isin(*RETURNED), "return", returned, none),
        ("other_single", second.isin(*SINGLE) & (n >= 4), "payment", single, none),
        ("other", F.lit(True), "reversal", part(2), no_key),
    ]
    made: Column | None = None
    for name, holds, table, key, value in reversed(rules):
        row = F.struct(F.lit(name).alias("rule"), F.lit(table).cast("string").alias("table"), key.alias("key"), value.alias("value"))
        made = row if made is None else F.when(F.coalesce(holds, F.lit(False)), row).otherwise(made)
    ruled = movements.withColumn("seg", segments(F.col("particulars"))).withColumn("__r", made)
    tables = {"return": returns, "payment": payments, "reversal": reversals, "bulk": bulks}
    every = reduce(lambda a, b: a.unionByName(b), [t.toDF("__key", "__value").withColumn("__table", F.lit(name)) for name, t in tables.items()])
    # rows that ask nothing are dealt by their own hash, so that they don't meet in one task
    own = F.coalesce(F.when(F.col("__r.table").isNotNull(), F.col("__r.key")), F.xxhash64(*movements.columns).cast("string"))
    asked = ruled.select(*movements.columns, "__r", own.alias("__ask"))
    on = [asked["__ask"] == every["__key"], F.col("__r.table") == every["__table"]]
    return asked.join(every, on, "left").select(*movements.columns, F.coalesce("__value", "__r.value").alias("reco_id"), F.col("__r.rule").alias("rule"))

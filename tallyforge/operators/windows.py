"""First, last and top rows of groups, pairing by position, gap filling, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str | Column], order: list[Column], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each group in an order that callers make total."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rank") <= most).drop("__rank")


def canonical_parent(parents: DataFrame) -> DataFrame:
    """The first parent of each claim: by value date, external reference (nulls last), hash."""
    claimed = parents.filter(F.col("claim_value") != "")
    return ranked(claimed, ["source_id", "claim_type", "claim_value"], [F.col("value_date").asc(), F.col("external_ref").asc_nulls_last(), F.col("source_hash").asc()])


def keep_in_batch(rows: DataFrame, key: str, ordinal: list[Column], last: bool = False) -> DataFrame:
    """One row per key: the first to arrive, or the last."""
    return ranked(rows, [key], [c.desc() if last else c.asc() for c in ordinal])


def latest_active(exclusions: DataFrame) -> DataFrame:
    """The latest exclusion of each entry that isn't cancelled."""
    best = F.max(F.struct("created_at", "user_id", "reason")).alias("x")
    return exclusions.filter("cancelled_at is null").groupBy("entry_id").agg(best).select("entry_id", "x.created_at", "x.user_id", "x.reason")


def paired_tags(rows: DataFrame, group: str, place: str, tag: str, opening: str, closing: str) -> DataFrame:
    """Each opening row with the text of the closing row right after it, or with none."""
    w = Window.partitionBy(group).orderBy(place)
    after = rows.withColumn("__tag", F.lead(tag).over(w)).withColumn("__text", F.lead("text").over(w))
    return after.filter(F.col(tag) == opening).select(group, place, "text", F.when(F.col("__tag") == closing, F.col("__text")).otherwise("").alias("detail"))


def filled_export(rows: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key with the last value of each column that isn't empty, in the order of the exports."""
    last = lambda c: F.max_by(F.col(c), F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.struct(*order))).alias(c)
    return rows.groupBy(key).agg(*[last(c) for c in columns], F.count("*").cast("long").alias("versions"))


def export_conflicts(rows: DataFrame, key: str, order: list[Column], column: str) -> DataFrame:
    """Values that differ from the last value before them that wasn't empty."""
    filled = F.nullif(F.col(column), F.lit(""))
    w = Window.partitionBy(key).orderBy(*order)
    known = rows.withColumn("__now", filled).withColumn("__before", F.last(filled, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return known.filter(F.col("__now") != F.col("__before")).select(key, F.col("__before").alias("old"), F.col("__now").alias("new"), "file_no")


def recent_runs(runs: DataFrame, most: int) -> DataFrame:
    """The latest ``most`` runs of each flow."""
    return ranked(runs, ["flow_id"], [F.col("started_at").desc(), F.col("run_id").desc()], most)


def heaviest(rows: DataFrame, by: str, amount: str, label: str) -> DataFrame:
    """Per group the label of the greatest absolute amount; the least label among equals."""
    w = Window.partitionBy(by).orderBy(F.abs(amount).desc(), F.col(label).asc())
    return rows.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").select(by, label, amount)


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """A page in an order that callers make total."""
    return df.orderBy(*order).offset(skip).limit(limit)


def once_across_files(rows: DataFrame, natural: str, content: list[str], order: list[str]) -> DataFrame:
    """Rows of overlapping files once, the first in ``order``, with the number of duplicates that each stands for.

    A row is known by its natural key, or where that is null or empty by its content. An aggregate keeps the least row,
    so copies are met before the shuffle.
    """
    key = F.nullif(F.col(natural), F.lit(""))
    body = F.when(key.isNull(), F.struct(*content))
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    one = rows.groupBy(key.alias("__key"), body.alias("__content")).agg(first.alias("r"), (F.count("*") - 1).cast("long").alias("duplicates"))
    return one.select("r.*", "duplicates")

"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, an exact cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import table, without

#: White space of a word count: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
OUT = ("size", "source_size", "target", "taken")


def word_count(text: str) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Targets per source from (skey, source_size), one row per source.

    Weights repeat over the sources in order of ``skey``. The sum of all sizes is shared by weight; a target stops
    at ``most`` times its source's size and the excess goes to the others by weight, which is the water level at
    which the capped shares use up the whole: with sources in order of cap / weight, a source is capped while its
    ratio is at most (whole - caps before) / (weights from here on).
    """
    listed = F.array(*[F.lit(int(w)) for w in weights])
    one = Window.partitionBy(F.lit(0))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(one.orderBy("skey")) - 1)
        .withColumn("weight", F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight").cast("double"))
    )
    by_ratio = one.orderBy("ratio", "rank")
    levels = ranked.withColumn(
        "level",
        (
            F.sum("source_size").over(one)
            - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).cast("double")
        / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).cast("double"),
    )
    water = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(one)
    return levels.withColumn("water", water).select(
        "skey",
        "source_size",
        F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap").cast("double"))
        .otherwise(F.col("water") * F.col("weight").cast("double"))
        .alias("target"),
    )


def mix_to_weights(
    spark: SparkSession,
    docs: DataFrame,
    *,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    seed: str = "mix",
    key_digits: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words that the mix takes, repeats counted).

    Each row gets a random key from its id; a source's rows stand in the order of their keys. The key's first
    ``key_digits`` hex digits deal a source out over 16**key_digits ranges, so that a source with a third of all rows
    has as many tasks as any other; sums per range, then within a range, give every row the words before it. A source
    whose target holds e whole epochs and r words more takes every row e times, then rows up to word r: the row at
    the cut is taken in part, so the source meets its budget to the word. Only ranges and sources, never rows, meet in
    one window; reruns agree, since keys and orders are functions of the rows.

    Null texts and empty texts have size 0 and take 0. A null source is a source of its own, the last in order. Null
    ids share one key; rows of equal id stand by size, so repeated rows give the same rows in any run. Empty tables
    give empty results. Input columns named like an output column are replaced.
    """
    docs = without(docs, [c for c in OUT if c not in (id_col, text_col, source_col)])
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = (
        docs.withColumn("__size", word_count(text_col))
        .withColumn("__skey", F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))))
        .withColumn("__key", F.md5(F.concat(ident, F.lit(":" + seed)).cast("binary")))
        .withColumn("__range", F.substring("__key", 1, key_digits))
    )
    ranges = table(spark, rows.groupBy(F.col("__skey").alias("skey"), F.col("__range").alias("range")).agg(F.sum("__size").alias("range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("skey").agg(F.sum("range_size").alias("source_size")), weights, most)
    before = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .join(targets, "skey")
        .select(F.col("skey").alias("__skey"), F.col("range").alias("__range"), "offset", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    )
    inside = Window.partitionBy("__skey", "__range").orderBy("__key", ident, "__size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
        .join(offsets, ["__skey", "__range"])
        .withColumn("__before", F.col("offset") + F.col("__inside"))
        .withColumn("__budget", F.floor(F.col("__target") + 0.5))
        .withColumn("__epochs", F.expr("if(__source_size > 0, __budget div __source_size, 0L)"))
        .withColumn("__rest", F.col("__budget") - F.col("__epochs") * F.col("__source_size"))
    )
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("__size"), F.col("__rest") - F.col("__before")))
    return placed.select(
        *[F.col(c) for c in docs.columns],
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__epochs") * F.col("__size") + last).cast("long").alias("taken"),
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_to_weights(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS k
  FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY skey) - 1 AS rk FROM s),
w AS (SELECT *, (1 + rk % 3)::BIGINT AS weight, 3 * source_size AS cap, (3 * source_size)::DOUBLE / (1 + rk % 3)::DOUBLE AS ratio FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT skey, source_size, CASE WHEN ratio <= level OR (SELECT max(level) FROM l WHERE ratio > level) IS NULL THEN cap::DOUBLE
             ELSE (SELECT max(level) FROM l WHERE ratio > level) * weight::DOUBLE END AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY k, coalesce(doc_id::VARCHAR, ''), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef
      FROM d JOIN t USING (skey))
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - bef)) END::BIGINT AS taken
FROM p
"""

"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Whatever columns ``documents`` has besides are carried along; an input column with the name of an operator's own output
is never lost, as stages but the last return the columns that they were given. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table
from tallyforge.llm.decontaminate import OUT, overlap
from tallyforge.llm.mixing import mix_to_weights
from tallyforge.llm.near_dedup import one_of_each
from tallyforge.llm.pii import OUT as FOUND
from tallyforge.llm.pii import find_personal_data
from tallyforge.llm.quality import score_quality, training_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects: a score below 0.3 on the whole text.

    Null and empty texts have no features; they all get the score of the bias, so they stay or go together. Repeated rows
    are scored alike, and of very long texts all is read. A row whose id is null can't be learned from, but is scored.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    extra = [F.col(c).alias(f"__given_{c}") for c in docs.columns if c not in keep]
    scored = score_quality(spark, docs.select(*keep, *extra), training_rows(labels)).filter("predicted = 1")
    return scored.select(*[F.col(c if c in keep else f"__given_{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one of least id; of rows that share id and class, one.

    Every null text is a class of its own by its id, empty texts are copies of each other. Ties of ids within a class are
    broken by the text's digest, so reruns agree on the text that stays.
    """
    return one_of_each(spark, docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a benchmark item contaminates: windows of items cover a twentieth of their words.

    Null and empty texts, and all texts if there are no items, stay; repeated rows stay or go together.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = [c for c in docs.columns if c.lower() not in OUT]
    extra = [F.col(c).alias(f"__given_{c}") for c in docs.columns if c not in names]
    judged = overlap(spark, docs.select(*names, *extra), items).filter(~F.col("contaminated"))
    return judged.select(*[F.col(c if c in names else f"__given_{c}").alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars follows the new text.

    All rows stay. A null text stays null, with a null n_chars; texts without personal data are unchanged.
    """
    given = {c: f"__given_{c}" for c in docs.columns if c.lower() in (*FOUND, "redacted")}
    found = find_personal_data(spark, docs.withColumnsRenamed(given), redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[(new[c] if c in new else F.col(given.get(c, c))).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the words to take of each document; documents that the mix doesn't take go.

    Null and empty texts have no words, so nothing is taken of them and they go. A null source is a source. Rows that
    share an id are drawn one by one, in an order that reruns keep.
    """
    return mix_to_weights(spark, docs).filter(F.col("taken") > 0)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: Scores and weighted hashes are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

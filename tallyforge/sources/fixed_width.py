"""Fixed-width records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.normalise import MONEY
from tallyforge.sources.records import split_records

# Fixed values of the format: name, first character (from 0), end.
LAYOUT = (("head", 0, 1), ("counter", 1, 31), ("sent", 31, 61), ("event", 61, 69), ("period", 69, 81), ("day", 81, 89), ("currency", 89, 92), ("amount", 92, 119), ("ref", 119, 139), ("online", 139, 140))
LEAST, WIDTH = 139, 141


def read_fixed_width(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """Records of text files, header and trailer left out."""
    return fixed_width_rows(spark.read.text(path), config.get("negative", "WITHDRAW"))


def fixed_width_rows(lines: DataFrame, negative: str = "WITHDRAW", keep: Sequence[str] = ()) -> DataFrame:
    """Fields of each line: control characters go, short lines are errors, the amount is read before its sign is set.

    ``keep`` names columns of ``lines`` that come with the fields.
    """
    bare = lines.select(*keep, F.regexp_replace("value", "[\\x00-\\x1f\\x7f]", "").alias("line")).filter(~F.col("line").startswith("0") & ~F.col("line").startswith("9") & (F.trim("line") != ""))
    padded = F.rpad("line", WIDTH, " ")
    cut = bare.select(*keep, "line", *[F.trim(F.substring(padded, a + 1, b - a)).alias(name) for name, a, b in LAYOUT])
    value = F.replace(F.replace("amount", F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast(MONEY)
    day = F.try_to_timestamp(F.col("day"), F.lit("yyyyMMdd")).cast("date")
    error = F.when(F.length("line") < LEAST, "short").when(value.isNull(), "amount").when(day.isNull(), "date")
    return cut.select(*keep, "counter", "event", day.alias("day"), "currency", F.when(F.upper("event") == negative, -F.abs(value)).otherwise(value).cast(MONEY).alias("amount"), "ref", error.alias("_error"))


def read_slabs(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """Records of files without line ends, ``length`` characters each: a large file is read by several tasks, a packed one by one.

    Columns are those of the records, their file and number, and ``_error``, also of a file that can't be decoded.
    """
    options = {k: config[k] for k in ("encoding", "glob", "range_bytes") if k in config}
    slabs = split_records(spark, path, "fixed", length=config.get("length", 3269), least=LEAST, width=WIDTH, **options)
    bad = slabs.filter("_error is not null").select("file", "_error")
    return fixed_width_rows(slabs.filter("_error is null"), config.get("negative", "WITHDRAW"), ["file", "no"]).unionByName(bad, allowMissingColumns=True)


def slab_rows(files: DataFrame, length: int = 3269, negative: str = "WITHDRAW", text: str = "value") -> DataFrame:
    """Fields of records that follow each other without line ends, ``length`` characters each; ``files`` has one row a file.

    A text is gone through once; of each record only the characters that have fields are taken, and a cut-off last one
    stays as short as it is.
    """
    head = min(WIDTH, length)
    slabs = files.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{1,{head}}}).{{0,{length - head}}}"), F.lit(1))).alias("slab"))
    return fixed_width_rows(slabs.select(F.when(F.length("slab") >= LEAST, F.rpad("slab", WIDTH, " ")).otherwise(F.col("slab")).alias("value")), negative)

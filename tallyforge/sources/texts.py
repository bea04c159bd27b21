"""Texts with weights from ledgers or files, tables found by their names, and workbooks written where the rows are."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.delimited import first_existing
from tallyforge.sources.workbook import to_workbooks

#: Names by which a file's column of texts goes, in this order.
TEXT_COLUMNS = ("transaction_particulars", "TransactionParticulars")


def weighted(texts: DataFrame) -> DataFrame:
    """(text, weight): each distinct text of one column that isn't blank, and how often it comes."""
    name = texts.columns[0]
    return texts.select(F.col(name).alias("text")).filter(F.trim("text") != "").groupBy("text").agg(F.count("*").cast("long").alias("weight"))


def weighted_from_ledgers(ledgers: Sequence[DataFrame], column: str = "transaction_particulars") -> DataFrame:
    """(text, weight) over all of some ledgers' rows; blank texts are no texts, outer spaces count."""
    one, *others = [df.select(column) for df in ledgers]
    for df in others:
        one = one.unionByName(df)
    return weighted(one.filter(F.col(column) != ""))


def weighted_from_csv(spark: SparkSession, path: str, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """(text, weight) of delimited files: the first of the columns that they have, trimmed; without any it is an error."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    found = first_existing(raw, [c.lower() for c in columns])
    if found is None:
        raise ValueError(f"none of {', '.join(columns)} in {path}; there are {', '.join(raw.columns)}")
    return weighted(raw.select(F.trim(found).alias("text")))


def weighted_from_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text, weight) of text files: every line that isn't blank is a text, as it stands."""
    return weighted(spark.read.text(path))


def tables_like(spark: SparkSession, parts: Sequence[str], prefix: str = "") -> list[str]:
    """Names of the session's tables and views that contain one of ``parts`` after a prefix, whatever the case, sorted."""
    low = [p.lower() for p in parts]
    names = {t.name for t in spark.catalog.listTables() if t.name.lower().startswith(prefix.lower())}
    return sorted(n for n in names if any(p in n.lower() for p in low))


def union_of_tables(spark: SparkSession, names: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """(table_name, columns) of all rows of some tables; ``columns`` maps names to types, and a table that lacks one has null."""
    if not names:
        return spark.createDataFrame([], ", ".join(["table_name string", *(f"`{c}` {t}" for c, t in columns.items())]))
    out = None
    for name in names:
        df = spark.table(name)
        have = {c.lower(): c for c in df.columns}
        part = df.select(F.lit(name).alias("table_name"), *[(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
        out = part if out is None else out.unionByName(part)
    return out


def write_workbooks(df: DataFrame, folder: str, most: int = 50_000, sheet: str = "rows") -> DataFrame:
    """Writes rows as workbooks of at most ``most`` rows into a folder, by the tasks that hold them; (file, rows) of each.

    Files have fresh names, so a task that is lost or repeated leaves files that no row of the result names; read the
    result once, and store it.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs

        fs, own = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        fs.create_dir(own, recursive=True)
        for batch in batches:
            names = []
            for content in batch.column(0):
                names.append(f"{uuid.uuid4().hex}.xlsx")
                with fs.open_output_stream(f"{own}/{names[-1]}") as file:
                    file.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1)], ["file", "rows"])

    return to_workbooks(df, most, sheet, places=False).mapInArrow(run, "file string, rows long")

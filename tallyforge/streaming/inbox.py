"""An inbox as a stream of files: each is read once, counted as a run, and moved to the processed or the error folder."""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.windows import keep_in_batch
from tallyforge.plans.ingestion import run_state

RUN = "file string, rows_in long, rows_ok long, rows_ko long, rows_duplicate long, status string, error string"
#: Messages of errors that a run keeps.
MESSAGES = 50


def file_system(path: str):
    """The Arrow file system of a path or URI, the path in it, and what stands before that in the URI."""
    import pyarrow.fs

    if path.startswith("file:/") and not path.startswith("file://"):  # as Hadoop writes local paths
        path = path.replace("file:", "file://", 1)
    fs, own = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return fs, own, path.removesuffix(own) if path.endswith(own) else "file://"


def below(root: str, path: str) -> str:
    """The path in its normal form; one that leaves ``root``, by dots or by a link, is refused."""
    import os

    real = os.path.realpath if "://" not in root or root.startswith("file:") else posixpath.normpath
    base, own = real(file_system(root)[1]), real(file_system(path)[1])
    if own != base and not own.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"outside of the inbox: {path}")
    return own


def listing(root: str, folder: str, pattern: str = "*") -> list[str]:
    """Files right in a folder of the inbox that fit a pattern, hidden ones aside, in the order of their names.

    A folder that isn't there is made, and empty. A folder or a link that leads out of ``root`` is refused.
    """
    import pyarrow.fs

    below(root, folder)
    fs, own, before = file_system(folder)
    fs.create_dir(own, recursive=True)
    found = fs.get_file_info(pyarrow.fs.FileSelector(own))
    names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(".") and fnmatch.fnmatch(f.base_name, pattern))
    for name in names:
        below(root, name)
    return [before + n for n in names]


def move(path: str, folder: str) -> None:
    """Moves a file that is there into a folder; one that has gone already stays gone."""
    import pyarrow.fs

    fs, own, _ = file_system(path)
    target = file_system(folder)[1]
    fs.create_dir(target, recursive=True)
    if fs.get_file_info(own).type == pyarrow.fs.FileType.File:
        fs.move(own, f"{target}/{own.rsplit('/', 1)[-1]}")


def runs_of(entries: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """A run for each of ``files``: rows read, new, in error and known before, its state, and its first errors by number."""
    counted = entries.groupBy("file").agg(
        F.count(F.lit(1)).cast("long").alias("rows_in"),
        F.count("_error").cast("long").alias("rows_ko"),
        F.min(F.when(F.col("_error").isNotNull(), F.struct("no", "_error"))).alias("first"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("_error").isNotNull(), F.col("_error")))), 1, MESSAGES).alias("messages"),
    )
    new = fresh.groupBy("file").agg(F.count(F.lit(1)).cast("long").alias("rows_ok"))
    on = files.join(counted, "file", "left").join(new, "file", "left").fillna(0, ["rows_in", "rows_ok", "rows_ko"])
    error = F.when(F.size("messages") > 0, F.array_join("messages", "\n"))
    duplicate = F.col("rows_in") - F.col("rows_ok") - F.col("rows_ko")
    return on.select("file", "rows_in", "rows_ok", "rows_ko", duplicate.alias("rows_duplicate"), run_state(F.col("rows_ok"), F.col("rows_ko")).alias("status"), error.alias("error"))


def run_inbox(
    spark: SparkSession,
    root: str,
    folder: str,
    read: Callable[[SparkSession, list[str]], DataFrame],
    identity: Column,
    out: str,
    *,
    pattern: str = "*",
    files_at_once: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """Takes in all files of an inbox as a stream; (entries, runs), with what earlier calls took in.

    ``read`` gives the rows of files with ``file``, ``no`` and ``_error``; ``identity`` is a row's hash, by which it comes
    in once over all files and batches, the first by (file, no). Errors of rows or of whole files never stop other rows
    or files. A file none of whose rows came in, but some failed, goes to ``error`` below ``out``, others to
    ``processed``; this is a batch's last step. Results and progress are below ``out`` by batch, so a batch that is run
    again after a loss finds its files where they are and writes the same again. A folder that leaves ``root`` is refused.
    """
    listing(root, folder, pattern)
    places = {name: f"{out}/{name}" for name in ("processed", "error")}
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).load(folder).select("path")
    def each(batch: DataFrame, number: int) -> None:
        named = [unquote(r["path"]) for r in batch.collect() if not r["path"].rsplit("/", 1)[-1].startswith((".", "_"))]  # files_at_once at most
        here = []
        for path in sorted(named):
            name = path.rsplit("/", 1)[-1]
            fs = file_system(path)[0]
            tried = [path, *(f"{p}/{name}" for p in places.values())]
            here.append(next((p for p in tried if fs.get_file_info(file_system(p)[1]).is_file), path))
        if not here:
            return
        entries = read(spark, here).withColumn("source_hash", identity)
        entries.write.mode("overwrite").parquet(f"{out}/staged/batch={number}")
        staged = spark.read.schema(entries.schema).parquet(f"{out}/staged/batch={number}")
        first = keep_in_batch(staged.filter("_error is null"), "source_hash", [F.col("file"), F.col("no")])
        stored = f"{out}/entries"
        if number:
            before = spark.read.schema(f"{ddl(staged)}, batch int").option("basePath", stored).parquet(stored).filter(F.col("batch") < number)
            first = first.join(before.select("source_hash"), "source_hash", "left_anti")
        first.write.mode("overwrite").parquet(f"{stored}/batch={number}")
        fresh = spark.read.schema(ddl(staged)).parquet(f"{stored}/batch={number}")
        files = spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in here], "file string")
        runs_of(staged, fresh, files).write.mode("overwrite").parquet(f"{out}/runs/batch={number}")
        failed = {r["file"] for r in spark.read.schema(RUN).parquet(f"{out}/runs/batch={number}").filter("status = 'FAILED'").select("file").collect()}
        for path in here:
            move(path, places["error" if path.rsplit("/", 1)[-1] in failed else "processed"])

    job = stream.writeStream.option("checkpointLocation", f"{out}/progress").foreachBatch(each).trigger(availableNow=True).start()
    job.awaitTermination()
    # a stream of files passes empty ones over: each is a run of no rows
    empty = [p for p in listing(root, folder, pattern) if file_system(p)[0].get_file_info(file_system(p)[1]).size == 0]
    if empty:
        none = spark.createDataFrame([], "file string, no long, _error string")
        runs_of(none, none, spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in empty], "file string")).write.mode("append").parquet(f"{out}/runs/batch=-1")
        for path in empty:
            move(path, places["processed"])
    runs = spark.read.schema(f"{RUN}, batch int").parquet(f"{out}/runs")
    return spark.read.parquet(f"{out}/entries"), runs


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

"""Rows that wait for their key: state tables of a stream that retry what is unresolved whenever lookups arrive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.identity import packed, unpacked
from tallyforge.operators.windows import keep_in_batch
from tallyforge.session import shared_folder

KEY = "struct<kind:string,value:string>"
LOOKUP = "kind string, value string, reco_id string"
BULK = "member string, bulk string"
#: Lookups are broadcast up to this size, at so many bytes each.
BROADCAST_BYTES, LOOKUP_BYTES = 32 << 20, 80
COUNTERS = ("rows_in", "rows_ko", "rows_duplicate", "resolved", "retried", "resolved_late", "unresolved")


@dataclass
class Waiting:
    """Tables of one ledger in a folder; ``schema`` is the DDL of a row besides the columns that this adds.

    A row has ``source_hash`` (its identity), ``keys`` (candidates for its key, best first), ``retry_keys`` (those that
    count after its first batch) and ``_error``. Every batch writes folders of its own number and reads those before
    it, so a batch that runs again after a loss writes the same again:

    * ``rows/batch=n/known=1``: rows whose key was found in batch n; they never change again but for their bulk;
    * ``rows/batch=n/known=0``: all rows that still wait after batch n;
    * ``lookups/batch=n`` and ``bulks/batch=n``: keys that became known in batch n, and members of bulks;
    * ``failed/batch=n``: rows with errors; ``counters/batch=n``: what the batch did.

    What waits meets the lookups of the new batch alone, as it has met all others before; new rows meet all of them. A
    row is written once a batch; candidates that count no more aren't kept, and an identity of hex digits is kept as the
    bytes that it stands for (``packed``).
    """

    spark: SparkSession
    folder: str
    schema: str

    def __post_init__(self) -> None:
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        self.names = [f.name for f in fields]
        row = ", ".join(f"`{f.name}` {'binary' if f.name == 'source_hash' else f.dataType.simpleString()}" for f in fields)
        self.schemas = {"lookups": LOOKUP, "bulks": BULK, "rows": f"{row}, reco_id string, tier int, first_in int, known int", "counters": ", ".join(f"{k} long" for k in COUNTERS)}
        for name, schema in self.schemas.items():  # every table has a batch before the first
            first = f"{self.folder}/{name}/batch=-1"
            self.spark.createDataFrame([], schema).drop("known").write.mode("ignore").parquet(f"{first}/known=0" if name == "rows" else first)

    def table(self, name: str, upto: int | None = None, only: int | None = None) -> DataFrame:
        """A table's rows of batches up to a number, or of one batch."""
        read = self.spark.read.schema(f"{self.schemas[name]}, batch int").option("basePath", f"{self.folder}/{name}")
        found = read.parquet(f"{self.folder}/{name}" if only is None else f"{self.folder}/{name}/batch={only}")
        return found if upto is None else found.filter(F.col("batch") <= upto)

    def put(self, df: DataFrame, name: str, number: int, by: tuple[str, ...] = (), **counted: Column) -> dict[str, int]:
        """Writes a batch's part of a table; gives its number of rows, and other numbers, counted while they are written."""
        seen = Observation()
        out = df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counted.items()])
        out.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.folder}/{name}/batch={number}")
        return seen.get

    def kept(self, known: int, upto: int | None = None, only: int | None = None) -> DataFrame:
        """Rows as they are kept: those whose key was found, or that wait."""
        return self.table("rows", upto, only).filter(F.col("known") == known).drop("known")

    def resolved_rows(self, upto: int | None = None) -> DataFrame:
        return self.kept(1, upto).drop("first_in").withColumnRenamed("batch", "resolved_in").withColumn("source_hash", unpacked("source_hash"))

    def unresolved_rows(self, number: int) -> DataFrame:
        return self.kept(0, only=number).drop("batch", "reco_id", "tier").withColumn("source_hash", unpacked("source_hash"))

    def step(self, number: int, rows: DataFrame, lookups: DataFrame, bulks: DataFrame | None = None, settled: DataFrame | None = None) -> dict[str, int]:
        """One batch: new rows and lookups come in, and rows whose key is known now leave the wait; its counters.

        ``rows_duplicate`` counts what brings no new row: repeated, waiting already, resolved or settled.

        Of rows that share a hash the last by ``order_in_batch`` (a column that callers may add) counts. Rows that are
        resolved or settled already are duplicates and change nothing; a waiting row that comes again takes its new
        columns and keys, and its amount as it was is the caller's to freeze. A key that comes again keeps its first
        meaning within a batch order of (reco_id), and the meaning of the first batch over later ones.
        """
        order = [F.col("order_in_batch")] if "order_in_batch" in rows.columns else [F.lit(0)]
        own = rows.select(*self.names, *(["order_in_batch"] if "order_in_batch" in rows.columns else []), F.col("_error"))
        came = own.agg(F.count(F.lit(1)).alias("rows_in"), F.count("_error").alias("rows_ko"), F.max(F.size("keys")).alias("places")).first()
        self.put(own.filter("_error is not null").select(*self.names, "_error"), "failed", number)

        once = lookups.groupBy("kind", "value").agg(F.min("reco_id").alias("reco_id")).filter("kind is not null and value is not null and reco_id is not null")
        known = self.table("lookups", number - 1).drop("batch")
        self.put(once.join(known, ["kind", "value"], "left_anti"), "lookups", number)
        if bulks is not None:
            self.put(bulks.groupBy("member").agg(F.min("bulk").alias("bulk")), "bulks", number)

        # tables are joined only if there is something in them; what waits and what is new meet in one join
        old = self.kept(0, only=number - 1).select(*self.names, "first_in")
        waits = old.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("retry_keys")).alias("places")).first()
        tried = old.select("*", F.col("retry_keys").alias("__keys"), F.lit(False).alias("__new"))
        if any_new := came["rows_in"] > came["rows_ko"]:
            new = own.filter("_error is null").drop("_error").withColumn("source_hash", packed("source_hash"))
            new = keep_in_batch(new, "source_hash", order, last=True).select(*self.names)
            done = self.kept(1, number - 1).select("source_hash")
            for other in ([done] if done.count() else []) + ([settled.select(packed("source_hash").alias("source_hash"))] if settled is not None else []):
                new = new.join(other, "source_hash", "left_anti")
            tried = new.select(*self.names, F.lit(number).alias("first_in"), F.col("keys").alias("__keys"), F.lit(True).alias("__new"))
            if waits["n"]:
                rest = [n for n in self.names if n != "source_hash"]
                both = old.select("source_hash", F.struct(*rest, "first_in").alias("o")).join(new.select("source_hash", F.struct(*rest).alias("n")), "source_hash", "full_outer")
                is_new = F.col("n").isNotNull()
                value = [F.when(is_new, F.col(f"n.{x}")).otherwise(F.col(f"o.{x}")).alias(x) for x in rest]
                tried = both.select("source_hash", *value, F.coalesce("o.first_in", F.lit(number)).alias("first_in"), F.when(is_new, F.col("n.keys")).otherwise(F.col("o.retry_keys")).alias("__keys"), is_new.alias("__new"))
        lookups = self.table("lookups", number, None if any_new else number).withColumn("__fresh", F.col("batch") == number).drop("batch")
        tried = found(tried, lookups, max(came["places"] or 0, waits["places"] or 0))
        # keys count in a row's first batch alone, and none once its key is found
        none = F.lit(None).cast(f"array<{KEY}>")
        is_late, is_known = F.col("first_in") < number, F.col("reco_id").isNotNull()
        slim = {"keys": none, "retry_keys": F.when(~is_known, F.col("retry_keys")), "known": is_known.cast("int")}
        n = self.put(
            tried.withColumns(slim).select(*self.names, "reco_id", "tier", "first_in", "known"), "rows", number, ("known",),
            resolved=F.count("reco_id"), retried=F.count_if(is_late), resolved_late=F.count_if(is_late & is_known),
        )
        counters = {"rows_in": came["rows_in"], "rows_ko": came["rows_ko"], **{k: n[k] for k in ("resolved", "retried", "resolved_late")}, "unresolved": n["n"] - n["resolved"]}
        counters["rows_duplicate"] = counters["rows_in"] - counters["rows_ko"] - (n["n"] - n["retried"])
        self.put(self.spark.createDataFrame([tuple(counters[k] for k in COUNTERS)], self.schemas["counters"]), "counters", number)
        return counters

    def counters(self) -> DataFrame:
        """What each batch did, as the rows were counted while they were written; a batch that ran again counts once."""
        return self.table("counters")

    def entries(self, number: int) -> DataFrame:
        """All rows after a batch: reco_id, tier and resolved_in are null for those that wait.

        A row whose key is a member of a bulk has the bulk's key, whatever came first.
        """
        both = self.resolved_rows(number).unionByName(self.unresolved_rows(number).drop("first_in"), allowMissingColumns=True)
        bulks = self.table("bulks", number).groupBy("member").agg(F.min_by("bulk", F.struct("batch", "bulk")).alias("bulk"))
        return both.join(bulks, F.col("reco_id") == F.col("member"), "left").withColumn("reco_id", F.coalesce("bulk", "reco_id")).drop("bulk", "member")


def found(rows: DataFrame, lookups: DataFrame, places: int) -> DataFrame:
    """Adds reco_id and tier: the first of ``__keys``, at most ``places``, that the lookups know; tier counts it from 1.

    Rows that aren't ``__new`` are answered by ``__fresh`` lookups alone. Rows meet few lookups (counted) where they are,
    place by place. Else candidates go out as (hash, place, key) and come back as the best per hash, so a key that many
    rows share is the many side of a join with one lookup and may be split; rows meet their answer on their own hash.
    """
    n = lookups.count() if places else 0
    if not n:
        return rows.drop("__keys", "__new").withColumn("reco_id", F.lit(None).cast("string")).withColumn("tier", F.lit(None).cast("int"))
    if n * LOOKUP_BYTES <= BROADCAST_BYTES:
        out = rows
        for i in range(places):
            look = lookups.select(F.struct("kind", "value").alias(f"__key{i}"), F.col("reco_id").alias(f"__reco{i}"), F.col("__fresh").alias(f"__fresh{i}"))
            of, here = F.get("__keys", F.lit(i)), F.col(f"__key{i}")
            out = out.join(F.broadcast(look), [of["kind"] == here["kind"], of["value"] == here["value"]], "left").drop(f"__key{i}")
        hits = [F.when(F.col("__new") | F.col(f"__fresh{i}"), F.col(f"__reco{i}")) for i in range(places)]
        tier = F.coalesce(*[F.when(h.isNotNull(), F.lit(i + 1)) for i, h in enumerate(hits)])
        return out.withColumn("reco_id", F.coalesce(*hits)).withColumn("tier", tier).drop("__keys", "__new", *[f"__{x}{i}" for i in range(places) for x in ("reco", "fresh")])
    asked = rows.select("source_hash", "__new", F.posexplode("__keys").alias("place", "key")).select("source_hash", "__new", "place", "key.kind", "key.value").filter("value is not null")
    best = asked.join(lookups, ["kind", "value"]).filter("__new OR __fresh").groupBy("source_hash").agg(F.min(F.struct("place", "reco_id")).alias("b"))
    best = best.select("source_hash", F.col("b.reco_id").alias("reco_id"), (F.col("b.place") + 1).alias("tier"))
    return rows.drop("__keys", "__new").join(best, "source_hash", "left")


def key(kind: str, value) -> object:
    """A candidate key as a column."""
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))


def run_stream(spark: SparkSession, stream: DataFrame, waiting: Waiting, split) -> int:
    """Runs a stream to its end through ``waiting``; ``split`` gives (rows, lookups, bulks or None) of a batch.

    Gives the last batch's number. Progress and tables are in the shared folder, so a run that is broken off goes on
    with the batch that it was at.
    """
    last = [-1]

    def each(batch: DataFrame, number: int) -> None:
        waiting.step(number, *split(batch))
        last[0] = number

    job = stream.writeStream.option("checkpointLocation", f"{waiting.folder}/progress").foreachBatch(each).trigger(availableNow=True).start()
    job.awaitTermination()
    return last[0]


def waiting_table(spark: SparkSession, schema: str, folder: str | None = None) -> Waiting:
    """State tables in a folder, by default a new one in the shared folder."""
    return Waiting(spark, folder or shared_folder(spark, "waiting"), f"{schema}, source_hash string, keys array<{KEY}>, retry_keys array<{KEY}>")

"""Search by identifiers: a stored index whose exact and substring look-ups read few of its files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.aggregates import MONEY, rows, total
from tallyforge.session import stored

#: Letters of a run by which substrings are looked up, and folders of an index.
GRAM, BUCKETS = 3, 64
#: Fields of an entry that can be searched, in the order in which a hit is named.
ENTRY_FIELDS = ("reco_id", "external_ref", "ref_no", "remarks_1")
#: Identifiers that are searched by a part: keys of lots, and entries that have a key.
BROAD = "source = 'lot_key' OR (row IS NOT NULL AND reco_id IS NOT NULL)"
#: Bits that texts set at most, to leave out identifiers that are none of them.
MOST_BITS = 1 << 28
IDENTIFIER = "value string, source string, field string, place int, row string, reco_id string, lot_id string"


def bucket_of(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int").alias("bucket")


def grams(value: Column) -> Column:
    """The runs of ``GRAM`` letters of a text in upper case, one for each place; none for a shorter one."""
    up = F.upper(value)
    starts = F.sequence(F.lit(1), F.length(up) - (GRAM - 1))
    runs = F.transform(starts, lambda i: F.substr(up, i, F.lit(GRAM)))
    return F.when(F.length(up) >= GRAM, runs).otherwise(F.array().cast("array<string>"))


def identifiers(entries: Mapping[str, DataFrame], statuses: DataFrame, keys: DataFrame, bulks: DataFrame, lots: DataFrame, fields: Sequence[str] = ENTRY_FIELDS) -> DataFrame:
    """(value, source, field, place, row, reco_id, lot_id): all by which a payment, lot or entry can be found.

    ``entries`` maps a store's name to its rows (with ``id``); ``statuses`` is (po_id, reco_id), ``keys`` (lot_id, key_type,
    key_value), ``bulks`` (po_id, reco_id), ``lots`` (lot_id). A value that a row has in several fields counts for the
    first of them. Keys and lots, which many members share, come once; rows that are given twice come twice, as a search
    makes its hits distinct. Each field is a pass over its store, so that a task that writes stays small.
    """
    none = F.lit(None).cast("string")
    made = lambda df, value, source, field, row, reco, lot, place=0: df.select(value.cast("string").alias("value"), F.lit(source).alias("source"), field.alias("field"), F.lit(place).alias("place"), row.alias("row"), reco.alias("reco_id"), lot.alias("lot_id"))
    out = made(statuses, F.col("po_id"), "status", F.lit("po_id"), none, F.col("reco_id"), none)
    out = out.unionByName(made(keys.distinct(), F.col("key_value"), "lot_key", F.concat(F.lit("key "), "key_type"), none, none, F.col("lot_id")))
    out = out.unionByName(made(bulks, F.col("po_id"), "bulk_key", F.lit("po_id"), none, F.col("reco_id"), none))
    out = out.unionByName(made(lots.distinct(), F.col("lot_id"), "lot", F.lit("id"), none, none, F.col("lot_id")))
    held = [F.col(f).cast("string") for f in fields]
    for name, df in entries.items():
        for i, f in enumerate(fields):
            new = reduce(lambda a, b: a & b, [~held[i].eqNullSafe(before) for before in held[:i]], held[i].isNotNull())
            out = out.unionByName(made(df.filter(new), held[i], name, F.lit(f), F.col("id").cast("string"), F.col("reco_id"), none, i))
    return out.filter("value is not null")


def write_index(found: DataFrame, folder: str) -> None:
    """Stores identifiers in folders by their value's hash, and values by their letters' runs in folders by the run's hash.

    A search for a value reads one folder of the first, a search for a part of one the folder of its first run. Rows are
    written where they are; only values, each once, are shuffled for their runs. A run and its places are in the value, so
    they aren't stored. Sorted values take few bytes.
    """
    kept = lambda df: df.sortWithinPartitions("bucket", "value").write.option("compression", "zstd").partitionBy("bucket")
    kept(found.withColumn("bucket", bucket_of("value"))).parquet(f"{folder}/values")
    values = found.sparkSession.read.schema(f"{IDENTIFIER}, bucket int").parquet(f"{folder}/values").filter(BROAD).select("value")
    n = values.count()
    tasks = 1 + max(min(n // 200_000, 32), n // 2_000_000)
    folders = F.array_distinct(F.transform(grams(F.col("value")), bucket_of))
    kept(values.repartition(tasks, "value").distinct().select("value", F.explode(folders).alias("bucket"))).parquet(f"{folder}/grams")


def search(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """(text, source, field, reco_id, lot_id, broad_used): what each query of (text, broad) names, each once.

    A text is trimmed and first looked for as it is, in all five places: payment statuses, keys of lots, bulks, lots,
    entries. Only if that finds nothing and the query is broad, entries that have a key and keys of lots are looked for
    in which it is a part, whatever its case; an entry counts for the first field that holds it. Values are cut where a
    text's first run of three letters is, at the lengths of the texts that begin so, and the piece is the key of an equi
    join (``parts``); texts of fewer letters are compared with every value. Empty texts find nothing. No result is cut.
    The index is read and filtered where it is: only identifiers that may be a text (``maybe``) are shuffled.
    """
    values = spark.read.schema(f"{IDENTIFIER}, bucket int").parquet(f"{folder}/values")
    asked = queries.select(F.trim("text").alias("text"), "broad").filter("text <> ''").groupBy("text").agg(F.max("broad").alias("broad"))
    asked = stored(asked.withColumn("at", bucket_of("text")), "asked")
    exact = asked.join(maybe(values, asked), [asked["text"] == F.col("value"), asked["at"] == F.col("bucket")])
    exact = stored(exact.select("text", "source", "field", "reco_id", "lot_id").distinct(), "exact")
    rest = stored(asked.filter("broad").join(exact.select("text").distinct(), "text", "left_anti").select("text"), "rest")
    runs = spark.read.schema("value string, bucket int").parquet(f"{folder}/grams")
    few = F.length(F.upper("text")) < GRAM
    # there are few different texts of so few letters
    short = values.filter(BROAD).select("value").join(F.broadcast(rest.filter(few)), F.contains(F.upper("value"), F.upper("text"))).select("text", "value").distinct()
    like = parts(rest.filter(~few), runs).unionByName(short).withColumn("at", bucket_of("value")).withColumnRenamed("value", "like")
    like = stored(like, "like")
    broad = like.join(values.filter(BROAD), [like["like"] == values["value"], like["at"] == values["bucket"]])
    first = broad.groupBy("text", "source", "row", "reco_id", "lot_id", F.when(F.col("row").isNull(), F.col("field")).alias("of")).agg(F.min_by("field", "place").alias("field"))
    broad = first.select("text", "source", "field", "reco_id", "lot_id").distinct()
    return exact.withColumn("broad_used", F.lit(False)).unionByName(broad.withColumn("broad_used", F.lit(True)))


def maybe(values: DataFrame, asked: DataFrame, value: str = "value", text: str = "text") -> DataFrame:
    """The identifiers whose value is some text, and a few of the others, found without a shuffle.

    The texts' hashes set bits, 16 or more for a text but no more than ``MOST_BITS`` (32 MB) in all, which every task gets;
    so about one in 16 of the others is left in, and more of them beyond 16 million texts.
    """
    bits = 1 << 15
    while bits < min(16 * asked.count(), MOST_BITS):
        bits *= 2
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    marks = asked.groupBy(F.bitmap_bucket_number(at(text)).alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at(text))).alias("set"))
    place = F.bitmap_bit_position(at(value))
    byte = F.conv(F.hex(F.substr("set", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1
    return values.join(F.broadcast(marks), F.bitmap_bucket_number(at(value)) == F.col("no")).filter(is_set).select(*values.columns)


def parts(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(text, value), each once: values of which a text of at least ``GRAM`` letters is a part, whatever its case.

    A place of a value is looked at only if the run there is some text's first one, at the lengths of these texts, and if
    a text of that length and both ends exists. So pieces grow with the index, not with texts times values, however
    common the runs are that a text has.
    """
    up = texts.select("text", F.upper("text").alias("piece"))
    ends = stored(up.select(F.left("piece", F.lit(GRAM)).alias("gram"), F.length("piece").alias("n"), F.right("piece", F.lit(GRAM)).alias("last")).distinct(), "ends")
    starts = stored(ends.groupBy("gram").agg(F.collect_set("n").alias("lengths")).withColumn("bucket", bucket_of("gram")), "starts")
    # stored, so they are known to be few; the runs of a value are looked at in its folders alone
    within = runs.join(starts.select("bucket").distinct(), "bucket", "left_semi")
    here = within.select("value", "bucket", F.posexplode(grams(F.col("value"))).alias("place", "gram")).join(starts, ["gram", "bucket"])
    tail = F.substr(F.upper("value"), F.col("place") + 1)
    cut = here.select("value", "gram", tail.alias("tail"), F.explode("lengths").alias("n")).filter(F.length("tail") >= F.col("n"))
    cut = cut.select("value", "gram", "n", F.left("tail", F.col("n")).alias("piece")).withColumn("last", F.right("piece", F.lit(GRAM)))
    return cut.join(ends, ["gram", "n", "last"], "left_semi").select("value", "piece").join(up, "piece").select("text", "value").distinct()


def payment_page(statuses: DataFrame, keys: DataFrame, after: tuple[str, str] | None = None, size: int = 1000) -> DataFrame:
    """One page of the payments of some keys, by (reco_id, po_id): the ``size`` that follow ``after``.

    The last row of a page is the next one's ``after``; pages cover all payments, however many there are, if po_id
    tells a key's payments apart.
    """
    on = statuses.join(keys.select("reco_id").distinct(), "reco_id", "left_semi")
    if after is not None:
        on = on.filter((F.col("reco_id") > after[0]) | ((F.col("reco_id") == after[0]) & (F.col("po_id") > after[1])))
    return on.orderBy("reco_id", "po_id").limit(size)


def found_groups(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Sums of the entries behind each query's keys and lots, by key and currency, over both stores.

    Entries are summed up by key before they meet the queries, so a key that very many entries and queries share (that of
    unresolved rows) doesn't pair them all.
    """
    keys = matches.select("text", "reco_id").unionByName(matches.select("text", F.col("lot_id").alias("reco_id"))).filter("reco_id is not null")
    keys = keys.repartition("reco_id").distinct()  # made distinct where they are joined
    groups = entries.groupBy("reco_id", "currency").agg(rows().alias("n"), total().cast(MONEY).alias("net"))
    return groups.join(keys, "reco_id").select("text", "reco_id", "currency", "n", "net", (F.col("net") == 0).alias("is_balanced"))

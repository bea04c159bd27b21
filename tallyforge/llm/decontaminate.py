"""Benchmark decontamination by winnowing: fingerprints of documents and items are joined, hits are extended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import joined, table, without

#: Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z counts as a-z.
WORD = r"[\p{Alnum}\P{ASCII}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text: Column) -> Column:
    """Words of a text in their own case; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shifted(a: Column, by: int) -> Column:
    """The array without its first ``by`` entries."""
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def pairwise(a: Column, by: int, op) -> Column:
    """op(a[i], a[i + by]) for every i that has both."""
    whole = F.slice(a, F.lit(1), F.greatest(F.size(a) - by, F.lit(0)))
    return F.zip_with(whole, shifted(a, by), op)


def spans(df: DataFrame, src: str, out: str, n: int, op) -> DataFrame:
    """Adds op over each run of n entries of an array, by doubling: each pass joins two shorter runs."""
    df, have = df.withColumn(out, F.col(src)), 1
    while have < n:
        by = min(have, n - have)
        df, have = df.withColumn(out, pairwise(F.col(out), by, op)), have + by
    return df


def hashed_runs(df: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Adds ``g<n>`` for each n: the hashes of all runs of n entries of the array ``words`` (in lower case).

    Runs of powers of two are shared between lengths; a run of another length joins two that overlap. Every letter is
    in lower case here, so more words are equal than in the exact comparison, never fewer.
    """
    df, have = df.withColumn("__p1", F.transform("words", lambda w: F.xxhash64(w))), 1
    together = lambda a, b: F.xxhash64(a, b)
    made = ["__p1"]
    while 2 * have <= max(lengths, default=1):
        df, have = df.withColumn(f"__p{2 * have}", pairwise(F.col(f"__p{have}"), have, together)), 2 * have
        made.append(f"__p{have}")
    for n in lengths:
        power = 1 << (n.bit_length() - 1)
        df = df.withColumn(f"g{n}", pairwise(F.col(f"__p{power}"), n - power, together) if n > power else F.col(f"__p{n}"))
    return df.drop(*made)


def keyed(hashes: Column, n: int) -> Column:
    """Hashes of runs as keys that also tell which length they are for."""
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(n)))


def prints(df: DataFrame, k: int, span: int, short: Sequence[int]) -> DataFrame:
    """Adds ``prints``: keys of the winnowed k-grams (the least of each run of span - k + 1) and of all runs of short lengths.

    Two texts that share ``span`` words in a row share the fingerprint of that run.
    """
    runs = hashed_runs(df, sorted({k, *short}))
    runs = spans(runs, f"g{k}", "__m", span - k + 1, lambda a, b: F.least(a, b))
    found = [keyed(F.array_distinct("__m"), span), *(keyed(F.array_distinct(f"g{n}"), n) for n in short)]
    return runs.withColumn("prints", F.concat(*found))


def overlap(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    *,
    span: int = 13,
    k: int = 6,
    share: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    A window is ``span`` consecutive words of an item, or all words of an item that has fewer; a document word inside
    an occurrence of a window is hit; a document is contaminated if share * n_hit >= n_words > 0 and n_hit > 0.

    1. Keys of the items (winnowed k-grams, and whole runs of the lengths below ``span`` that items have) are joined
       with those of the documents, made in one pass over each text; this tells which documents may be hit.
    2. In these documents the places of all keys are joined with the items' once more. Windows that a place may lie in
       are written out there alone, and joined with the item windows on their full text, so collisions never count.
    3. Windows that occur are united per document.

    Work on a document grows with its length and with its hits, never with the number of other documents or copies.
    A null or empty text has no words; so has an item, which then has no window. Rows are told apart by id and text,
    repeated rows all get the same values; null ids are allowed. No items: nothing is hit. Input columns named like an
    output column are replaced.
    """
    docs = without(docs, [c for c in OUT if c not in (id_col, text_col)])
    items = items.select(F.col(item_id_col).cast("string").alias("item"), words(F.translate(F.col(item_text_col), UPPER, LOWER)).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(span))
    windows = (
        items.withColumn("len", length)
        .select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1), lambda s: F.array_join(F.slice("words", s, F.col("len")), " "))).alias("window"))
        .distinct()
    )
    windows = table(spark, windows, "windows")
    short = sorted(r[0] for r in windows.filter(F.col("len") < span).select("len").distinct().collect())  # at most span - 1 numbers
    me = F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text")
    low = lambda text: words(F.lower(text))
    item_prints = prints(items.withColumn("words", F.transform("words", lambda w: F.lower(w))), k, span, short)
    # explode() would have Catalyst filter on the array first, which repeats all of its passes; so the outer form
    known = table(spark, item_prints.select(F.explode_outer("prints").alias("print")).filter("print is not null").distinct(), "prints")
    found = prints(docs.select(*me, low(F.col(text_col)).alias("words")), k, span, short).select("__id", "__text", F.explode_outer("prints").alias("print"))
    found = joined(spark, found.filter("print is not null"), known, "print", "left_semi", 16)
    spots = table(spark, found.select(F.col("__id").alias("__sid"), F.col("__text").alias("__stext")).distinct(), "spots")

    same = (F.col("__id").eqNullSafe(F.col("__sid"))) & (F.col("__text").eqNullSafe(F.col("__stext")))
    candidates = joined(spark, docs.select(*me, F.col(text_col).alias("__t")), spots, same, "left_semi").dropDuplicates(["__id", "__text"])
    candidates = table(spark, candidates, "candidates")
    runs = hashed_runs(candidates.select("__id", "__text", low(F.col("__t")).alias("words")), sorted({k, *short}))
    of_length = lambda n: lambda h, i: F.struct(F.lit(n).alias("len"), i.alias("at"), h.alias("print"))
    placed = F.concat(*(F.transform(keyed(F.col(f"g{k if n == span else n}"), n), of_length(n)) for n in [span, *short]))
    places = runs.select("__id", "__text", F.explode_outer(placed).alias("p")).select("__id", "__text", "p.len", "p.at", "p.print")
    places = joined(spark, places, known, "print", "left_semi", 16)
    # a place lies inside every window that begins up to span - k words before it
    back = F.when(F.col("len") == span, F.lit(span - k)).otherwise(F.lit(0))
    begins = places.select("__id", "__text", "len", F.explode(F.sequence(F.greatest(F.col("at") - back, F.lit(0)), "at")).alias("start"))
    begins = begins.groupBy(F.col("__id").alias("__sid"), F.col("__text").alias("__stext")).agg(F.collect_set(F.struct("len", "start")).alias("begins"))
    begins = table(spark, begins, "begins")
    exact = candidates.select("__id", "__text", words(F.translate("__t", UPPER, LOWER)).alias("words")).join(begins, same)
    fits = F.filter("begins", lambda x: x["start"] + x["len"] <= F.size("words"))
    window = F.transform(fits, lambda x: F.struct(x["len"].alias("len"), x["start"].alias("start"), F.array_join(F.slice("words", x["start"] + 1, x["len"]), " ").alias("window")))
    tried = exact.select("__id", "__text", F.explode_outer(window).alias("w")).select("__id", "__text", "w.len", "w.start", "w.window")
    hits = joined(spark, tried, windows, ["len", "window"], "inner", 160).select("__id", "__text", "len", "start", "item")
    stretch = F.struct("start", (F.col("start") + F.col("len")).alias("stop"))
    spans_of = hits.groupBy("__id", "__text").agg(F.array_sort(F.collect_set(stretch)).alias("s"), F.array_sort(F.collect_set("item")).alias("i"))
    covered = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], x["stop"]).alias("upto")),
        lambda a: a["n"],
    )
    sha = F.sha2(F.array_join("i", ","), 256)
    result = spans_of.select(F.col("__id").alias("__sid"), F.col("__text").alias("__stext"), covered.cast("long").alias("__hit"), F.size("i").cast("long").alias("__items"), sha.alias("__sha"))
    counted = candidates.select("__id", "__text", F.regexp_count("__t", F.lit(WORD)).cast("long").alias("__of"))
    enough = (F.col("__hit") * share >= F.col("__of")).alias("__enough")
    result = table(spark, result.join(counted, same).select("__sid", "__stext", "__hit", "__items", "__sha", enough), "hits")
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return joined(spark, docs.select(*docs.columns, *me, n_words.alias("n_words")), result, same, "left", 160).select(
        *docs.columns,
        "n_words",
        F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("__items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("__sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce("__enough", F.lit(False)).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return overlap(spark, docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP10_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 13) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bl)),
dwin AS (SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t
         FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, n, s, item FROM dwin JOIN win USING (n, t)),
pos AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, n, s FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item)::BIGINT AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS sha FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

"""Reattribution of bookings to buckets: control of announced against dumped payments, statuses, orphans, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.normalise import segment_shape
from tallyforge.operators.aggregates import MONEY, NO_KEY, rows, total


def conservation_control(links: DataFrame, dumps: DataFrame) -> DataFrame:
    """Count and sum of dumped payments against what each link announces and books; the first failing test names it.

    A message that is listed twice is a duplicate, whatever else holds.
    """
    sums = dumps.groupBy("pmsgid").agg(rows().alias("found"), F.round(F.sum("amount"), 2).cast(MONEY).alias("dumped"))
    twice = F.count("*").over(Window.partitionBy("pmsgid")) > 1
    on = links.withColumn("twice", twice).join(sums, "pmsgid", "left")
    found, dumped = F.coalesce("found", F.lit(0)), F.coalesce("dumped", F.lit(0))
    verdict = (
        F.when(F.col("twice"), "DUPLICATE_MOVEMENT")
        .when(found == 0, "NOT_FOUND")
        .when((F.col("booked") == 0) & (dumped != 0), "NOT_SETTLED")
        .when(found != F.col("announced"), "COUNT_MISMATCH")
        .when(dumped != F.round("booked", 2), "AMOUNT_MISMATCH")
        .otherwise("OK")
    )
    return on.select("link_id", "pmsgid", "announced", "booked", found.cast("long").alias("found"), dumped.cast(MONEY).alias("dumped"), verdict.alias("verdict"))


def group_slices(rows_: DataFrame, most: int = 50) -> DataFrame:
    """Payments by message and target: a payment that comes twice counts once, with its amounts added; long lists go."""
    one = rows_.groupBy("pmsgid", "target", "po_id").agg(total().alias("amount"))
    listed = F.array_join(F.array_sort(F.collect_list("po_id")), ",")
    return one.groupBy("pmsgid", "target").agg(total().alias("amount"), rows().alias("payments"), F.when(F.count("*") <= most, listed).alias("po_list"))


def proposal_status(control: DataFrame, live: DataFrame, settled: DataFrame, committed: DataFrame, targets: DataFrame, unsupported: DataFrame | None = None) -> DataFrame:
    """Status of each message's proposal; tables are (pmsgid, ...) and the first condition that holds decides.

    ``unsupported`` lists messages whose movement comes from a source of a kind that can't be attributed anew.
    """
    hits = live.groupBy("pmsgid").agg(rows().alias("live_hits"), F.bool_and(F.col("status") == "PENDING").alias("pending"))
    flag = lambda df, name: df.select("pmsgid").distinct().withColumn(name, F.lit(True))
    on = control.join(hits, "pmsgid", "left").join(flag(settled, "settled"), "pmsgid", "left").join(flag(committed, "committed"), "pmsgid", "left").join(flag(targets, "target"), "pmsgid", "left")
    on = on.join(flag(unsupported, "unsupported"), "pmsgid", "left") if unsupported is not None else on.withColumn("unsupported", F.lit(False))
    n, yes = F.coalesce("live_hits", F.lit(0)), lambda c: F.coalesce(c, F.lit(False))
    status = (
        F.when(F.col("found") == 0, "NO_DUMP_ROWS")
        .when(n > 1, "ENTRY_AMBIGUOUS")
        .when((n == 0) & yes("settled"), "EMARGED")
        .when((n == 0) & yes("committed") & ~yes("target"), "ALREADY_COMMITTED")
        .when(((n > 0) | yes("committed")) & yes("unsupported"), "FLOW_UNSUPPORTED")
        .when((n == 0) & yes("committed"), "TO_REPLAY")
        .when(n == 0, "ENTRY_NOT_FOUND")
        .when(~yes("pending"), "ENTRY_NOT_PENDING")
        .when(~yes("target"), "NO_TARGET")
        .when(yes("committed"), "TO_RECOMMIT")
        .otherwise("PROPOSED")
    )
    return on.select(*control.columns, status.alias("status"))


def slice_guard(slices: DataFrame, booked: DataFrame) -> DataFrame:
    """Whether a booking's slices may be committed, and why not: none there, one of zero, or more than was booked.

    Slices count by their magnitude, whatever sign they come with; they may fall short of the booking. ``sign`` is the
    booking's, and all of its slices take it (``signed_slices``).
    """
    size = F.abs("amount")
    sums = slices.groupBy("pmsgid").agg(total(size).alias("sliced"), F.bool_or(F.col("amount") == 0).alias("any_zero"))
    on = booked.join(sums, "pmsgid", "left").withColumn("sliced", F.coalesce("sliced", F.lit(0)).cast(MONEY))
    refusal = F.when(F.col("any_zero").isNull(), "NO_SLICE").when(F.col("any_zero"), "ZERO_SLICE").when(F.col("sliced") > F.abs("booked"), "EXCEEDS_BOOKING")
    sign = F.when(F.col("booked") < 0, -1).otherwise(1)
    return on.select("link_id", "pmsgid", "booked", sign.alias("sign"), "sliced", refusal.alias("refusal"), refusal.isNull().alias("may_commit"))


def signed_slices(slices: DataFrame, guard: DataFrame) -> DataFrame:
    """The slices of bookings that may be committed, with the booking's sign."""
    on = slices.join(guard.filter("may_commit").select("link_id", "pmsgid", "sign"), "pmsgid")
    return on.withColumn("amount", (F.col("sign") * F.abs("amount")).cast(MONEY)).drop("sign")


def committed_orphans(live: DataFrame, found: DataFrame) -> DataFrame:
    """The live ledger after orphans that one key resolves have got it: pending rows without a key alone change."""
    key = found.filter("outcome = 'RESOLVED'").select("movement_id", F.col("keys").alias("found_key"))
    on = live.join(key, "movement_id", "left")
    open_ = F.col("found_key").isNotNull() & (F.col("status") == "PENDING") & (F.col("reco_id").isNull() | (F.col("reco_id") == NO_KEY))
    return on.withColumn("change", F.when(open_, "RESOLVED").otherwise("KEPT")).withColumn("reco_id", F.when(open_, F.col("found_key")).otherwise(F.col("reco_id"))).drop("found_key")


def orphan_keys(ref_no: Column, particulars: Column) -> Column:
    """Keys of an unresolved movement, of the first rule that yields any; rules never mix."""
    last = F.when(ref_no.contains("##"), F.element_at(F.split(ref_no, "##"), -1))
    rules = [
        F.array_compact(F.array(F.nullif(F.trim(last), F.lit("")))),
        F.array_compact(F.array(F.nullif(F.regexp_extract(particulars, "(?i)^[^/]*/(?:NCC|NCP|RRS|RCC|RCP)/[IO]/([^/]{4,})", 1), F.lit("")))),
        F.array_distinct(F.regexp_extract_all(particulars, F.lit("\\b(?:PF|P|S)([0-9]{6,})\\b"), F.lit(0))),
        F.array_distinct(F.regexp_extract_all(particulars, F.lit("(?<![0-9A-Za-z])[0-9]{6,}(?![0-9A-Za-z])"), F.lit(0))),
    ]
    out = F.array().cast("array<string>")
    for r in reversed(rules):
        r = F.coalesce(r, F.array().cast("array<string>"))
        out = F.when(F.size(r) > 0, r).otherwise(out)
    return out


def orphans(movements: DataFrame, known: DataFrame) -> DataFrame:
    """Unresolved movements with their keys and whether one key resolves them."""
    keyed = movements.withColumn("keys", orphan_keys(F.col("ref_no"), F.col("particulars")))
    one = keyed.withColumn("key", F.when(F.size("keys") == 1, F.col("keys")[0])).join(known.select(F.col("key").alias("hit")).distinct(), F.col("key") == F.col("hit"), "left")
    outcome = F.when(F.size("keys") == 0, "NO_KEY").when(F.size("keys") > 1, "KEY_AMBIGUOUS").when(F.col("hit").isNull(), "KEY_UNKNOWN").otherwise("RESOLVED")
    return one.select("movement_id", F.array_join("keys", ",").alias("keys"), outcome.alias("outcome"))


def segments(texts: DataFrame, column: str, weight: str, literal_most: int, separator: str) -> DataFrame:
    """(text, weight, n, place, value, literal, token) of each segment of segmented texts.

    A place with few values (or the first of several) is literal, others show their shape. Only distinct values per
    place are counted, after a map-side distinct; texts meet the places' verdicts once.
    """
    split = texts.select(column, weight, F.split(column, separator, -1).alias("seg")).withColumn("n", F.size("seg"))
    places = split.select(column, weight, "n", F.posexplode("seg").alias("place", "value"))
    verdicts = places.select("n", "place", "value").distinct().groupBy("n", "place").agg(rows().alias("values"))
    literal = (F.col("values") <= literal_most) | ((F.col("n") > 1) & (F.col("place") == 0))
    shown = F.when(F.col("value") == "", "∅").otherwise(F.col("value"))
    token = F.when(literal, shown).otherwise(F.concat(F.lit("<"), segment_shape(F.col("value")), F.lit(">")))
    return places.join(verdicts, ["n", "place"]).select(column, weight, "n", "place", "value", literal.alias("literal"), token.alias("token"))


def pattern_of(tokens: DataFrame, column: str, weight: str) -> DataFrame:
    """(text, pattern, weight): the tokens of each text in their order."""
    listed = F.array_sort(F.collect_list(F.struct("place", "token")))
    pattern = F.array_join(F.transform(listed, lambda x: x["token"]), " / ")
    return tokens.groupBy(column).agg(pattern.alias("pattern"), F.first(weight).alias("weight"))


def mine_patterns(texts: DataFrame, column: str, weight: str, literal_most: int = 25, separator: str = "/") -> DataFrame:
    """Patterns of segmented texts with their weight, their number of texts and the least text as an example."""
    tokens = segments(texts, column, weight, literal_most, separator)
    patterns = pattern_of(tokens, column, weight)
    return patterns.groupBy("pattern").agg(F.sum("weight").cast("long").alias("weight"), rows().alias("texts"), F.min(column).alias("example"))


def place_values(texts: DataFrame, column: str, weight: str, top: int = 5, literal_most: int = 25, separator: str = "/") -> DataFrame:
    """Per pattern and variable place: how many values it has, and the ``top`` heaviest, ties by value.

    Values are counted before they are ranked, and the rank's limit is applied before the shuffle as well, so a place
    with very many values sends few of them.
    """
    tokens = segments(texts, column, weight, literal_most, separator)
    patterns = pattern_of(tokens, column, weight).select(column, "pattern")
    held = tokens.filter(~F.col("literal")).join(patterns, column).groupBy("pattern", "place", "value").agg(F.sum(weight).alias("w"))
    w = Window.partitionBy("pattern", "place").orderBy(F.desc("w"), "value")
    first = held.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"])
    samples = first.groupBy("pattern", "place").agg(F.array_join(listed, " | ").alias("samples"))
    return held.groupBy("pattern", "place").agg(rows().alias("values")).join(samples, ["pattern", "place"])

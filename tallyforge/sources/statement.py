"""Bank statement messages with ``:61:`` lines and their ``:86:`` details."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.normalise import MONEY, clean, detail_line, entry_date, original_amount, short_date, signed, subfield_head, subfield_of, subfield_pairs
from tallyforge.sources.records import split_records

#: Fixed value of the format: date, entry date, mark, funds code, amount, type, owner's reference, bank's reference.
LINE = r"^(\d{6})(\d{4})?(RC|RD|C|D)([A-Z])?(\d+,\d*)([A-Z][A-Z0-9]{3})((?:(?!//)[^\n])*)(?://([^\n]*))?"
#: The groups of a line that are read.
PARTS = (1, 2, 3, 5, 7, 8)


def read_statements(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """Entries of statement files, cut into messages where these begin: a large file is read by several tasks.

    A file that can't be read or decoded is one row whose ``_error`` says so; a line that can't be read is one, too.
    """
    options = {k: config[k] for k in ("encoding", "glob", "range_bytes") if k in config}
    parts = split_records(spark, path, "separator", separator="{1:F01", **options)
    parts = parts.withColumn("message_id", F.concat_ws("#", "file", (F.col("no") - 1).cast("string"))).withColumnRenamed("value", "text")
    bad = parts.filter("_error is not null").select(F.col("file").alias("message_id"), "_error")
    return statement_rows(parts.filter(F.contains("text", F.lit(":61:")))).unionByName(bad, allowMissingColumns=True)


def statement_rows(messages: DataFrame) -> DataFrame:
    """Entries of messages (message_id, text): each ``:61:`` with the ``:86:`` right after it, or with none.

    Lines without a tag continue the tag above them. Tags are paired within their message only; an unfinished message
    goes on to its end. A row keeps both candidates for its reference: what follows the ``:61:`` line, or else the
    detail's +00, as ``transaction_ref``, and the detail's +21 as ``ref_21``.
    """
    # up to the first end, without the line end before it; the white space after the begin doesn't count
    after = F.ltrim(F.substr("text", F.locate("{4:", "text") + 3), F.lit(" \t\n\x0b\f\r"))
    upto = F.substring_index(after, "-}", 1)
    body = F.when(F.contains(after, F.lit("-}")) & F.endswith(upto, F.lit("\n")), F.left(upto, F.length(upto) - 1)).otherwise(upto)
    body = F.when(F.contains("text", F.lit("{4:")), body).otherwise(F.col("text"))
    cut = F.filter(F.split(F.concat(F.lit("\n"), F.replace(body, F.lit("\r"), F.lit(""))), r"\n(?=:\d{2}[A-Z]?:)"), lambda x: x.startswith(":"))
    # a message is a row, so its tags are paired where they are, without a shuffle
    tags = messages.select("message_id", cut.alias("__tags"))
    of_tag = lambda t: F.transform(F.filter("__tags", lambda x: x.startswith(f":{t}:")), lambda x: F.substr(x, F.lit(len(t) + 3)))
    greatest = lambda t: F.array_max(F.transform(of_tag(t), lambda x: F.trim(x)))
    coded = lambda x: F.nullif(F.regexp_extract(x, "^[DC][0-9]{6}([A-Z]{3})", 1), F.lit(""))
    # the first balance tag that names a currency, in this order
    balance = F.coalesce(*[F.array_max(F.transform(of_tag(t), coded)) for t in ("60F", "60M", "62F", "62M")])

    def entry(x: Column, i: Column) -> Column:
        after = F.try_element_at("__tags", i + 2)
        detail = F.when(after.startswith(":86:"), F.substr(after, F.lit(5))).otherwise("")
        return F.when(x.startswith(":61:"), F.struct(i.alias("place"), F.substr(x, F.lit(5)).alias("value"), detail.alias("detail")))

    entries = F.filter(F.transform("__tags", entry), lambda x: x.isNotNull())
    # what holds for a whole message is found once, before its entries become rows
    heads = tags.select("message_id", greatest("25").alias("account"), balance.alias("currency"), greatest("20").alias("statement_ref"), entries.alias("__entries"))
    paired = heads.withColumn("__entry", F.explode_outer("__entries")).filter(F.col("__entry").isNotNull()).select("*", "__entry.*").drop("__entries", "__entry")
    # the line is matched once; none of its parts holds a line end
    parts = F.split(F.regexp_replace("value", f"(?s)^(?:{LINE[1:]}.*|.*)$", "\n".join(f"${i}" for i in PARTS)), "\n")
    part = lambda i: F.nullif(F.get("__parts", F.lit(PARTS.index(i))), F.lit(""))
    day = short_date(part(1))
    # column by column, so that no step is repeated in the next one's expression
    cut_up = paired.withColumn("__parts", parts).withColumn("__line", detail_line(F.col("detail"))).withColumn("__pairs", subfield_pairs(F.col("__line")))
    sub = lambda code: subfield_of(F.col("__pairs"), code)
    of = lambda code: clean(sub(code))
    customer = clean(F.regexp_extract("value", r"(?s)\n(.*)", 1))
    return cut_up.select(
        "message_id",
        "place",
        "account",
        "currency",
        day.alias("value_date"),
        F.when(part(2).isNotNull(), entry_date(part(2), day)).otherwise(day).alias("entry_date"),
        signed(F.replace(part(5), F.lit(","), F.lit(".")).try_cast(MONEY), part(3)).cast(MONEY).alias("amount"),
        F.trim(part(7)).alias("owner_ref"),
        F.trim(part(8)).alias("bank_ref"),
        sub("20").alias("sub_20"),
        F.when(F.size("__pairs") > 0, subfield_head(F.col("__line"))).alias("gvc"),
        "statement_ref",
        customer.alias("customer_ref"),
        F.coalesce(customer, of("00")).alias("transaction_ref"),
        of("21").alias("ref_21"),
        original_amount(sub("26")).alias("ocmt"),
        F.when(part(1).isNull(), "line").alias("_error"),
    )

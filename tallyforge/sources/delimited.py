"""Delimited files: cash feeds, payment dumps with aliased headers, exports wrapped in quotes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.normalise import MONEY, clean, tolerant_decimal
from tallyforge.operators.filters import not_dropped
from tallyforge.sources.records import split_records

CASH = {"delimiter": ";", "drop": ["InDoubt"], "zero": "Reverse"}


def read_cash_feed(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """Rows of a cash feed in canonical form, one bad row never stops a file.

    Amounts are unsigned cents; a reversed row counts as zero; rows with a dropped status go.
    """
    c = {**CASH, **config}
    raw = spark.read.csv(path, header=True, sep=c["delimiter"], encoding=c.get("encoding", "UTF-8"), mode="PERMISSIVE", inferSchema=False, enforceSchema=False)
    return cash_rows(raw, c["drop"], c["zero"])


def cash_rows(raw: DataFrame, drop: Sequence[str], zero: str) -> DataFrame:
    kept = raw.filter(not_dropped(F.col("Status"), drop))
    at = F.try_to_timestamp(F.concat_ws(" ", F.trim("Date"), F.trim("Time")), F.lit("dd-MMM-yyyy HH:mm:ss")).cast("timestamp_ntz")
    cents = clean(F.col("Amount")).try_cast("decimal(18,0)")
    amount = F.when(F.lower("Status").contains(zero.lower()), F.lit(0)).otherwise(cents / 100).cast(MONEY)
    error = F.when(cents.isNull(), "amount").when(at.isNull(), "date").when(clean(F.col("TxnId")).isNull(), "id")
    return kept.select(clean(F.col("TxnId")).alias("external_ref"), clean(F.col("Reference")).alias("reco_id"), clean(F.col("CCPAccount")).alias("account"), amount.alias("amount"), at.alias("value_date"), error.alias("_error"))


#: Date directives of feed configurations and the pattern letters that read the same digits.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "f": "SSSSSS"}


def date_pattern(fmt: str) -> str:
    """A format of % directives as a datetime pattern; one digit is enough where another sign follows."""
    out, at = "", 0
    while at < len(fmt):
        if fmt[at] == "%":
            letters = DIRECTIVES[fmt[at + 1]]
            alone = len(letters) == 2 and letters != "yy" and fmt[at + 2 : at + 3] != "%" and fmt[at - 1 : at] != fmt[at + 1 : at + 2] and (at < 2 or fmt[at - 2] != "%")
            out, at = out + (letters[0] if alone else letters), at + 2
        else:
            out, at = out + (f"'{fmt[at]}'" if fmt[at].isalpha() else "''" if fmt[at] == "'" else fmt[at]), at + 1
    return out


def read_moment(text: Column, fmt: str) -> Column:
    """A time by a format of % directives, null if it doesn't fit; months by name go by their first three letters."""
    named = F.regexp_replace(text, "([A-Za-z]{3})[A-Za-z]+", "$1") if "%b" in fmt else text
    return F.try_to_timestamp(named, F.lit(date_pattern(fmt))).cast("timestamp_ntz")


#: Canonical fields that a configuration's column_map may name; amount and dates are read besides.
ENTRY_TEXTS = ("reco_id", "account", "currency", "event_type", "external_ref", "transaction_particulars", "ref_no", "remarks_1")


def read_delimited(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """Entries of delimited files as a feed's configuration says; neither a bad row nor a bad file stops the others.

    Columns: file, no (the record's number in its file: with a header the first row is 2, else 1), the canonical texts,
    amount, direction, value_date, operation_date and ``_error`` (what is wrong with a row, or with a whole file, which
    is one row then). Records with line ends in quotes stay whole, and one file is read by several tasks.

    Configuration: delimiter, encoding, has_header, decimal_separator, default_currency, column_map, date_format,
    operation_date_format, datetime_fields and datetime_format, amount_in_cents, direction (field, keywords,
    reversal_keyword, default), skip_status (field, values), zero_amount_when (field, contains).
    """
    mapped = config.get("column_map", {})
    direction, skip, zero = config.get("direction") or {}, config.get("skip_status") or {}, config.get("zero_amount_when") or {}
    used = [*mapped.values(), *config.get("datetime_fields", ()), *(x["field"] for x in (direction, skip, zero) if x)]
    options = {k: config[k] for k in ("encoding", "glob", "range_bytes") if k in config}
    raw = split_records(spark, path, "quoted", columns=list(dict.fromkeys(used)), delimiter=config.get("delimiter", ","), header=config.get("has_header", True), **options)
    if skip:
        raw = raw.filter(F.col("_error").isNotNull() | ~F.lower(F.trim(F.coalesce(F.col(f"`{skip['field']}`"), F.lit("")))).isin(*[v.strip().lower() for v in skip["values"]]))
    return delimited_entries(raw, config)


def delimited_entries(raw: DataFrame, config: Mapping) -> DataFrame:
    """Canonical entries of parsed records; see ``read_delimited``."""
    mapped = config.get("column_map", {})
    field = lambda name: F.col(f"`{name}`")
    get = lambda key: clean(field(mapped[key])) if mapped.get(key) else F.lit(None).cast("string")
    number = F.replace(get("amount"), F.lit(config.get("decimal_separator", ".")), F.lit(".")).try_cast(MONEY)
    if config.get("amount_in_cents"):
        number = (number / 100).cast("decimal(20,2)").cast(MONEY)
    turn = config.get("direction") or {}
    if turn:
        low = F.lower(F.coalesce(field(turn["field"]), F.lit("")))
        sense = F.coalesce(*[F.when(low.contains(word.lower()), F.lit(to)) for word, to in turn["keywords"].items()], F.lit(None))
        if turn.get("reversal_keyword"):  # turns round what a keyword says, never the default
            sense = F.when(low.contains(turn["reversal_keyword"].lower()), F.when(sense == "debit", "credit").when(sense.isNotNull(), "debit")).otherwise(sense)
        sense = F.coalesce(sense, F.lit(turn.get("default")))
    else:
        sense = F.when(number >= 0, "credit").otherwise("debit")
    fields, plain = config.get("datetime_fields"), config.get("date_format", "%Y-%m-%d")
    if fields:
        text = clean(F.array_join(F.filter(F.array(*[F.coalesce(F.trim(field(f)), F.lit("")) for f in fields]), lambda x: x != ""), " "))
        moment = read_moment(text, config.get("datetime_format", "%Y-%m-%d %H:%M:%S"))
    else:
        text = get("value_date")
        moment = read_moment(text, plain)
    # step by step, so that no expression is repeated in the next one
    step = raw.select("file", "no", "_error", *[get(k).alias(k) for k in ENTRY_TEXTS], get("amount").alias("__raw"), number.alias("__number"), sense.alias("__sense"), text.alias("__text"), moment.alias("value_date"), read_moment(get("operation_date"), config.get("operation_date_format", plain)).alias("__operation"), *([field(config["zero_amount_when"]["field"]).alias("__zero")] if config.get("zero_amount_when") else []))
    amount = F.when(F.col("__sense") == "debit", -F.abs("__number")).otherwise(F.abs("__number")) if turn else F.col("__number")
    if config.get("zero_amount_when"):
        amount = F.when(F.lower(F.coalesce("__zero", F.lit(""))).contains(config["zero_amount_when"]["contains"].lower()), F.lit(0)).otherwise(amount)
    error = (
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(F.col("__raw").isNull(), "missing amount")
        .when(F.col("__number").isNull(), "invalid amount")
        .when(F.col("__sense").isNull(), "unmapped direction")
        .when(F.col("__text").isNull(), "missing value date")
        .when(F.col("value_date").isNull(), "invalid value date")
    )
    texts = [F.coalesce(k, F.lit(config.get("default_currency", "EUR"))).alias(k) if k == "currency" else F.col(k) for k in ENTRY_TEXTS]
    return step.select("file", "no", *texts, amount.cast(MONEY).alias("amount"), F.col("__sense").alias("direction"), "value_date", F.coalesce("__operation", "value_date").alias("operation_date"), error.alias("_error"))


def read_wrapped(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """(file, no, value, _error): records of exports, unwrapped where their first line is the fake header.

    Records go on over line ends until their quotes close; a large file is read by several tasks.
    """
    options = {k: config[k] for k in ("encoding", "glob", "range_bytes") if k in config}
    return split_records(spark, path, "wrapped", **options).select("file", "no", "value", "_error")


def first_existing(df: DataFrame, names: Sequence[str]) -> Column | None:
    """The first of the names that the file has as a column: a choice of the plan, not of each row."""
    have = {c.lower(): c for c in df.columns}
    return next((F.col(have[n]) for n in names if n in have), None)


def read_dump(spark: SparkSession, path: str, fields: Mapping[str, Sequence[str]], delimiters: str = ";,\t|") -> DataFrame:
    """A payment dump: the separator is the one its header has most of, fields are found under any of their names."""
    head = spark.read.text(path).first()
    line = head[0].lstrip("﻿") if head else ""
    raw = spark.read.csv(path, header=True, sep=max(delimiters, key=line.count), inferSchema=False)
    raw = raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])
    picked = {name: first_existing(raw, names) for name, names in fields.items()}
    return raw.select(*[(clean(col) if col is not None else F.lit(None).cast("string")).alias(name) for name, col in picked.items()])


def unwrapped(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of an export that has each record in quotes: the outer quotes go, doubled ones become single."""
    text = F.col(column)
    inner = F.when(text.rlike('^".*"$'), F.replace(F.substr(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))).otherwise(text)
    return lines.filter(text != "?column?").withColumn(column, inner)


def rejoined(files: DataFrame, text: str = "value") -> DataFrame:
    """Records of wrapped exports, one row a file in ``text``: a record goes on over lines until its quotes close.

    Only a file whose first line is the fake header is unwrapped; of each record one layer of quotes goes and doubled
    ones become single. Records come with their place. A file is one row, so this is for exports of the size of a task.
    """
    lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    wrapped = F.trim(F.replace(lines[0], F.lit('"'), F.lit(""))) == "?column?"
    body = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    found = F.regexp_extract_all(body, F.lit('(?m)^\\s*"(?:[^"]++|""|"(?!\\s*$))*+"\\s*$|^[^"\n][^\n]*$'), F.lit(0))
    record = F.transform(found, lambda r: F.trim(r))
    inner = F.transform(record, lambda r: F.when(r.startswith('"'), F.replace(F.substr(r, F.lit(2), F.length(r) - 2), F.lit('""'), F.lit('"'))).otherwise(r))
    plain = F.filter(lines, lambda x: x != "")
    return files.select(*[c for c in files.columns if c != text], F.posexplode(F.when(wrapped, inner).otherwise(plain)).alias("place", text))


#: Service types of a link workbook that may be attributed anew, and the names its columns go by.
LINK_SERVICES = ("RCP", "RCC", "RRS", "WCC")
LINK_FIELDS = {"pmsgid": ("pmsgid", "msgid"), "service": ("serviceid", "service"), "announced": ("num_records", "numrecords"), "booked": ("settlement_amount", "settlementamt")}


def link_rows(sheet: DataFrame, services: Sequence[str] = LINK_SERVICES) -> tuple[DataFrame, DataFrame]:
    """(rows to attribute, rows per service) of a link sheet: fields under any of their names, blank rows skipped.

    Every service is counted, kept or not; a row without one counts under ``?``. An unreadable count or amount is zero.
    """
    named = sheet.toDF(*[c.strip().lower() for c in sheet.columns])
    picked = {name: first_existing(named, names) for name, names in LINK_FIELDS.items()}
    if picked["pmsgid"] is None:
        raise ValueError("no msgid column")
    text = lambda name: clean(picked[name].cast("string")) if picked[name] is not None else F.lit(None).cast("string")
    rows_ = named.select(text("pmsgid").alias("pmsgid"), F.coalesce(F.upper(text("service")), F.lit("?")).alias("service"), text("announced").alias("announced"), text("booked").alias("booked")).filter("pmsgid is not null")
    kept = F.col("service").isin(*services)
    counts = rows_.groupBy("service").agg(F.count("*").cast("long").alias("n")).withColumn("kept", kept)
    count, amount = F.col("announced").try_cast("long"), tolerant_decimal(F.col("booked"))
    out = rows_.filter(kept).select("pmsgid", "service", F.coalesce(count, F.lit(0)).alias("announced"), F.coalesce(amount, F.lit(0)).cast(MONEY).alias("booked"))
    return out, counts

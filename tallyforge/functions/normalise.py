"""Column functions that bring feed values into one form."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(20,4)"
IBAN = "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"
UUID = "^[0-9A-Fa-f]{8}-?([0-9A-Fa-f]{4}-?){3}[0-9A-Fa-f]{12}$"
#: Fixed value: formats of feed times, tried in this order.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")


def clean(c: Column) -> Column:
    """Trimmed, empty as null."""
    return F.nullif(F.trim(c), F.lit(""))


def tolerant_decimal(c: Column) -> Column:
    """A decimal with either separator: of both, the last is the decimal point; spaces don't count; else null."""
    bare = F.regexp_replace(c, "[\\s\\u00a0\\u202f]", "")
    comma, dot = F.instr(F.reverse(bare), ","), F.instr(F.reverse(bare), ".")
    comma_last = (comma > 0) & ((dot == 0) | (comma < dot))
    return F.when(comma_last, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit(""))).try_cast(MONEY)


def strict_amount(c: Column) -> tuple[Column, Column]:
    """(amount, error): empty, unreadable and zero amounts are errors."""
    amount = c.try_cast(MONEY)
    error = F.when(clean(c).isNull(), "no amount").when(amount.isNull(), "unreadable amount").when(amount == 0, "zero amount")
    return F.when(error.isNull(), amount), error


def lenient_amount(c: Column) -> Column:
    return F.coalesce(c.try_cast(MONEY), F.lit(0)).cast(MONEY)


def from_cents(c: Column) -> Column:
    return (c.cast("decimal(18,0)") / 100).cast("decimal(20,2)")


def signed(amount: Column, mark: Column) -> Column:
    """Debits (D, RD) are negative, credits positive."""
    return F.when(F.upper(mark).isin("D", "RD"), -F.abs(amount)).otherwise(F.abs(amount))


def zero_if(amount: Column, field: Column, word: str) -> Column:
    return F.when(F.lower(field).contains(word.lower()), F.lit(0).cast(MONEY)).otherwise(amount)


def direction_by_keyword(field: Column, words: Sequence[tuple[str, str]], reversal: str, default: str | None) -> Column:
    """The direction of the first listed word in the field, turned round by the reversal word."""
    low = F.lower(field)
    found = F.coalesce(*[F.when(low.contains(w.lower()), F.lit(d)) for w, d in words], F.lit(default))
    other = F.when(found == "DEBIT", "CREDIT").when(found == "CREDIT", "DEBIT")
    return F.when(low.contains(reversal.lower()), other).otherwise(found)


def direction_by_code(code: Column, codes: Mapping[str, str], amount: Column) -> Column:
    """The direction of a code; of an unknown one, that of the sign."""
    listed = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(listed, code), F.when(amount < 0, "DEBIT").otherwise("CREDIT"))


def time_ladder(c: Column) -> Column:
    """The first format that reads the text, without its offset."""
    bare = F.regexp_replace(F.trim(c), "(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    bare = F.when(F.trim(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.trim(c)).otherwise(bare)
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in TIME_FORMATS]).cast("timestamp_ntz")


def int_date(c: Column) -> Column:
    """yyyymmdd as a date, else null."""
    return F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).cast("date")


def short_date(c: Column) -> Column:
    """yymmdd of this century."""
    return F.try_to_timestamp(F.concat(F.lit("20"), c), F.lit("yyyyMMdd")).cast("date")


def date_and_time(day: Column, time: Column) -> Column:
    """yyyymmdd and hhmmss (zeros in front may lack)."""
    return F.try_to_timestamp(F.concat(day.cast("string"), F.lpad(time.cast("string"), 6, "0")), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def entry_date(mmdd: Column, value_date: Column) -> Column:
    """mmdd in the year of the value date; the value date if there is no such day."""
    return F.coalesce(F.try_to_timestamp(F.concat(F.year(value_date).cast("string"), mmdd), F.lit("yyyyMMdd")).cast("date"), value_date)


def segments(particulars: Column) -> Column:
    """Segments of particulars: ``##`` separates where it occurs, else ``/``."""
    return F.when(particulars.contains("##"), F.split(particulars, "##")).otherwise(F.split(particulars, "/"))


def end_to_end(c: Column) -> Column:
    """Upper case; 32 hex digits lose their dashes, anything else is cut at 124."""
    up = F.upper(F.trim(c))
    bare = F.replace(up, F.lit("-"), F.lit(""))
    return F.when(bare.rlike("^[0-9A-F]{32}$"), bare).otherwise(F.left(up, F.lit(124)))


def shaped_like_account(c: Column) -> Column:
    """IBANs and UUIDs, which are no payment keys."""
    return F.upper(F.trim(c)).rlike(IBAN) | F.trim(c).rlike(UUID)


def payment_order(particulars: Column, ref_no: Column) -> Column:
    """The last ``##`` segment, else the reference, else the fourth segment."""
    seg = segments(particulars)
    return F.coalesce(F.when(particulars.contains("##"), clean(F.element_at(seg, -1))), clean(ref_no), clean(F.try_element_at(seg, F.lit(4))))


def family(particulars: Column) -> Column:
    """Kind of a movement by the first segment, then by the second."""
    seg = segments(particulars)
    first, second = F.upper(F.trim(seg[0])), F.upper(F.trim(F.try_element_at(seg, F.lit(2))))
    return (
        F.when(first == "NDRT", "RETURN")
        .when(first == "NDRJ", "REJECT")
        .when(first == "NDGB", "BULK_MESSAGE")
        .when(first.isin("SWIFT", "SCRT1", "BKRTP", "REV SCRT1"), "INSTANT")
        .when(first.isin("SCTXB", "SDDXB", "SDXBB") & second.isin("I", "O"), "BULK")
        .when(second.isin("RCC", "RCP"), "RETURN")
        .when(second.isin("NCC", "NCP", "RRS"), "SINGLE")
        .otherwise("UNKNOWN")
    )


def reference_keys(c: Column, prefix: str) -> Column:
    """The reference, and without its prefix."""
    return F.array_distinct(F.array_compact(F.array(c, F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1000)))))


def segment_shape(c: Column) -> Column:
    return F.when(F.trim(c) == "", "EMPTY").when(c.rlike("^[0-9]+$"), "NUM").when(c.rlike("^[A-Za-z0-9]+$") & c.rlike("[0-9]"), "ALNUM").otherwise("TEXT")


def subfields(text: Column) -> Column:
    """Map of ``+NN`` subfields of a statement's detail; a later value of a code wins; ``_gvc`` has what stands before."""
    joined = detail_line(text)
    return subfield_map(joined, subfield_pairs(joined))


def detail_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit(""))


def subfield_pairs(line: Column) -> Column:
    found = F.regexp_extract_all(line, F.lit("\\+([0-9]{2}[^+]*(?:\\+(?![0-9]{2})[^+]*)*)"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.left(x, F.lit(2)).alias("code"), F.substr(x, F.lit(3)).alias("value")))


def subfield_of(pairs: Column, code: str) -> Column:
    """The last value under a code; null without one."""
    return F.try_element_at(F.filter(pairs, lambda p: p["code"] == code), F.lit(-1))["value"]


def subfield_head(line: Column) -> Column:
    return F.regexp_extract(line, "^([^+]*(?:\\+(?![0-9]{2})[^+]*)*)", 1)


def subfield_map(line: Column, pairs: Column) -> Column:
    codes = F.array_distinct(F.transform(pairs, lambda p: p["code"]))
    last = F.transform(codes, lambda c: F.struct(c.alias("key"), F.element_at(F.filter(pairs, lambda p: p["code"] == c), -1)["value"].alias("value")))
    lead = F.array(F.struct(F.when(F.size(pairs) == 0, "_raw").otherwise("_gvc").alias("key"), subfield_head(line).alias("value")))
    return F.map_from_entries(F.concat(lead, last))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[clean(c) for c in columns])


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def without_prefix(value: Column, prefix: str, fallback: Column) -> Column:
    """A detail's key without its prefix; the whole of it where it lacks the prefix; else the fallback."""
    bare = clean(value)
    return F.coalesce(F.when(bare.startswith(prefix), F.substr(bare, F.lit(len(prefix) + 1))).otherwise(bare), clean(fallback))


def operation_type(module: Column) -> Column:
    """P2P or EMC by the initiating module; another module's own name; UNKNOWN without one."""
    name = F.upper(clean(module))
    return F.when(name == "WEROEMC", "EMC").when(name == "WERO", "P2P").otherwise(F.coalesce(name, F.lit("UNKNOWN")))


def operation_type_of(module: Column, source: Column, payment_type: Column, vop: Column) -> Column:
    """P2P or EMC by the first that tells: the initiating module, the source's name, the payment's type, a payee check.

    A source with NCP in its name is P2P, with NCC is EMC; a type EMC, or any result of a payee check, is EMC. Cells count
    in upper case, and an empty one says nothing; if none tells, UNKNOWN.
    """
    up = lambda c: F.upper(F.coalesce(c, F.lit("")))
    return (
        F.when(up(module) == "WERO", "P2P")
        .when(up(module) == "WEROEMC", "EMC")
        .when(up(source).contains("NCP"), "P2P")
        .when(up(source).contains("NCC"), "EMC")
        .when((up(payment_type) == "EMC") | (up(vop) != ""), "EMC")
        .otherwise("UNKNOWN")
    )


def original_amount(field: Column) -> Column:
    """The original amount, with its currency before it, that a detail's +26 names after /OCMT/."""
    return F.nullif(F.regexp_extract(field, "/OCMT/([A-Z]{3}[0-9,]+)", 1), F.lit(""))


def payload_json(df: DataFrame, names: Sequence[str]) -> Column:
    """Columns of a row as JSON that any reader takes: decimals as text, days and times in ISO 8601, nulls kept."""

    def safe(name: str) -> Column:
        kind = df.schema[name].dataType.simpleString()
        if kind.startswith("decimal"):
            return F.col(name).cast("string").alias(name)
        if kind in ("timestamp", "timestamp_ntz"):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
        return (F.col(name).cast("string") if kind == "date" else F.col(name)).alias(name)

    return F.to_json(F.struct(*[safe(n) for n in names]), {"ignoreNullFields": "false"})


def uuid_variants(key: Column) -> Column:
    """The key, the key without dashes, and, of 32 hexadecimal digits, the key with dashes; each once."""
    cut = lambda a, n: F.substring(key, a, n)
    dashed = F.when(key.rlike("^[0-9A-Fa-f]{32}$"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)))
    return F.array_distinct(F.array_compact(F.array(key, F.replace(key, F.lit("-"), F.lit("")), dashed)))


def export_family(file_name: Column) -> Column:
    """The table that a file is an export of: its stem in lower case, with the direction suffix o, 0 or i folded."""
    stem = F.lower(F.regexp_replace(file_name, r"\.[^.]*$", ""))
    base = F.regexp_extract(stem, "^(.+?)_([oi0])$", 1)
    mark = F.when(F.regexp_extract(stem, "^(.+?)_([oi0])$", 2) == "i", "_i").otherwise("_o")
    return F.when(base != "", F.concat(base, mark)).otherwise(stem)


def coded_direction(code: Column, codes: Mapping[str, str], pending: Sequence[str], amount: Column) -> tuple[Column, Column, Column]:
    """(direction, amount with that sign, whether the direction isn't known yet).

    A pending code has the sign's direction for now and says so; an unknown one, or none, has the sign's.
    """
    unknown = F.coalesce(clean(code).isin(*pending), F.lit(False))
    by_sign = F.when(amount < 0, "DEBIT").otherwise("CREDIT")
    direction = F.when(unknown, by_sign).otherwise(direction_by_code(clean(code), codes, amount))
    return direction, F.when(direction == "DEBIT", -F.abs(amount)).otherwise(F.abs(amount)).cast(MONEY), unknown


def movement_type(particulars: Column) -> Column:
    """The first segment of a movement's particulars in upper case, 16 characters at most; SCTXB without one."""
    first = F.when(particulars.contains("##"), F.split(particulars, "##")[0]).otherwise(F.split(particulars, "/")[0])
    return F.left(F.coalesce(F.upper(clean(first)), F.lit("SCTXB")), F.lit(16))


def channel_of(raw: Column, payload: Column) -> Column:
    """The channel in upper case, of the raw column or else of the stored payload."""
    return F.upper(first_filled(raw, F.get_json_object(payload, "$.Initiating_channel")))


def iso_moment(day: Column) -> Column:
    """A day or time in ISO 8601 without an offset."""
    return F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")


def feed_config(defaults: Mapping, given: Mapping, identifiers: Sequence[str], required: Sequence[str]) -> dict:
    """Defaults with the given values of known names; identifiers must be bare names, with a schema or without."""
    out = {**defaults, **{k: v for k, v in given.items() if k in defaults}}
    for name in identifiers:
        value = str(out[name]).strip() if out.get(name) not in (None, "") else None
        if value is not None and not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", value):
            raise ValueError(f"{name} is no identifier: {value!r}")
        out[name] = value
    for name in required:
        if not out.get(name):
            raise ValueError(f"{name} is missing")
    return out


def extract_key(day: Column, transaction: Column, serial: Column) -> Column:
    """Day, transaction and serial number of an extract's row; a serial is filled up to six digits and never cut."""
    text = serial.cast("string")
    return F.concat_ws("-", F.date_format(day, "yyyyMMdd"), transaction, F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text))

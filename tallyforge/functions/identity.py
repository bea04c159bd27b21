"""Identities of rows, buckets and slices, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name space of bucket ids: the RFC 4122 URL name space.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def joined(*parts: Column) -> Column:
    """Parts with bars between them; a null part is empty."""
    return F.concat_ws("|", *[text_of(p) for p in parts])


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def file_hash(flow: Column, reco: Column, account: Column, currency: Column, amount: Column, value_date: Column, ref: Column) -> Column:
    return F.sha2(joined(flow, reco, account, currency, amount, iso(value_date), ref), 256)


def stable_hash(flow: Column, account: Column, currency: Column, amount: Column, value_date: Column, ref: Column) -> Column:
    """The file hash without the settlement key, which may change."""
    return F.sha2(joined(flow, account, currency, amount, iso(value_date), ref), 256)


def ledger_hash(flow: Column, ref: Column, account: Column, operation: Column, value: Column) -> Column:
    """Identity of a ledger row: its reference recurs, so the day counts, of the operation or else of the value."""
    return F.sha2(joined(flow, ref, account, F.to_date(F.coalesce(operation, value))), 256)


def bucket_name(*parts: Column) -> Column:
    """Identity of a bucket: upper case, absent parts empty."""
    return F.concat_ws("|", *[F.upper(text_of(p)) for p in parts])


def uuid5(name: Column) -> Column:
    """RFC 4122 version 5 id of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    cut = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(cut(17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(19, 2), F.lit("-"), cut(21, 12))


def slice_reference(key: Column, bucket: Column) -> Column:
    """A reference that is the same in every run: the key, shortened, with digests of key and bucket."""
    return F.concat(F.lit("KEY:"), F.left(key, F.lit(88)), F.lit("~"), F.left(F.sha1(key), F.lit(8)), F.lit("~"), F.left(F.sha1(bucket), F.lit(10)))


def packed(c: str) -> Column:
    """A text as bytes, after a byte that says whether they are the text's or, for pairs of hex digits, those it stands for."""
    text = F.col(c)
    return F.when(F.rlike(text, F.lit("^(?:[0-9a-f]{2})+$")), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), F.encode(text, "UTF-8")))


def unpacked(c: str) -> Column:
    rest = F.substr(F.col(c), F.lit(2))
    return F.when(F.substr(F.col(c), F.lit(1), F.lit(1)) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))

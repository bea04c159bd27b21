"""The three legs of a payment scheme by a feed's configuration, and the outer join of two feeds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.normalise import MONEY, clean, end_to_end, feed_config, operation_type_of
from tallyforge.operators.joins import two_feeds
from tallyforge.plans.ingestion import three_leg_entries

#: Names of columns that a configuration may give, with what they are if it doesn't; null means: of the payment.
DEFAULTS = {
    "scheme_ref": "e2e_ref", "scheme_amount": "amount", "scheme_status": "status", "scheme_day": "day", "scheme_statuses": [],
    "payment_ref": "e2e_ref", "payment_day": "payment_date", "payment_currency": None, "payment_modules": ["WERO"], "returns_enabled": True,
    "return_day": None, "return_amount": None, "return_status": None,
}
NAMES = ("scheme_ref", "scheme_amount", "scheme_status", "scheme_day", "payment_ref", "payment_day", "payment_currency", "return_day", "return_amount", "return_status")
NEEDED = ("scheme_ref", "scheme_amount", "scheme_day", "payment_ref", "payment_day")


def legs_config(given: Mapping) -> dict:
    """A checked configuration: names are bare identifiers, modules and statuses trimmed, the statuses in upper case."""
    out = feed_config(DEFAULTS, given, NAMES, NEEDED)
    out["payment_modules"] = [m.strip() for m in out["payment_modules"] or [] if m and m.strip()]
    if not out["payment_modules"]:
        raise ValueError("payment_modules is empty")
    out["scheme_statuses"] = sorted({s.strip().upper() for s in out["scheme_statuses"] or [] if s and s.strip()})
    if out["scheme_statuses"] and not out["scheme_status"]:
        raise ValueError("scheme_status is missing")
    return out


def three_legs(scheme: DataFrame, payments: DataFrame, returns: DataFrame, config: Mapping, since: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scheme, payments, returns) as (reco_id, po_id, amount, status, day, currency), from ``since`` on.

    Scheme rows count if their status, in upper case, is listed (any, if none is); payments if their initiating module
    is; returns if their original payment's is. A return has its original's key, and its amount, status and day unless
    the configuration names columns of its own. Keys are end-to-end references in one form.
    """
    cfg = legs_config(config)
    rows = scheme.filter(F.col(cfg["scheme_day"]) >= since)
    if cfg["scheme_statuses"]:
        rows = rows.filter(F.upper(cfg["scheme_status"]).isin(*cfg["scheme_statuses"]))
    status = F.trim(cfg["scheme_status"]) if cfg["scheme_status"] else F.lit(None).cast("string")
    out = lambda df, ref, po, amount, status, day, currency: df.select(end_to_end(ref).alias("reco_id"), po.alias("po_id"), amount.cast(MONEY).alias("amount"), status.alias("status"), day.alias("day"), currency.alias("currency"))
    none = F.lit(None).cast("string")
    first = out(rows, F.col(cfg["scheme_ref"]), clean(F.col(cfg["scheme_ref"])), F.col(cfg["scheme_amount"]), status, F.col(cfg["scheme_day"]), none)
    ours = payments.filter(F.col("init_module").isin(*cfg["payment_modules"]))
    money = F.col(cfg["payment_currency"]) if cfg["payment_currency"] else none
    second = out(ours.filter(F.col(cfg["payment_day"]) >= since), F.col(cfg["payment_ref"]), F.trim("po_id"), F.col("amount"), F.trim("status"), F.col(cfg["payment_day"]), money)
    if not cfg["returns_enabled"]:
        return first, second, second.limit(0)
    back = returns.select(*[F.col(c).alias(f"r_{c}") for c in returns.columns]).join(ours, F.trim("r_original_po") == F.trim("po_id"))
    of = lambda name, else_: F.col(f"r_{cfg[name]}") if cfg[name] else else_
    day = of("return_day", F.col(cfg["payment_day"]))
    third = out(back.filter(day >= since), F.col(cfg["payment_ref"]), F.trim("r_return_po"), of("return_amount", F.col("amount")), F.trim(of("return_status", F.col("status"))), day, money)
    return first, second, third


def configured_entries(scheme: DataFrame, payments: DataFrame, returns: DataFrame, config: Mapping, since: Column, flow_id: int) -> DataFrame:
    """Ledger entries of the three legs (``three_leg_entries``) that a configuration selects."""
    return three_leg_entries(*three_legs(scheme, payments, returns, config, since), flow_id)


def marked_feeds(left: DataFrame, right: DataFrame, key: str, day: str, time: str) -> DataFrame:
    """Two feeds joined by key with match, difference, mark-off day and time, and the operation type of either side.

    ``left`` and ``right`` are (key, amount); ``right`` has module, source, payment_type and vop besides, by which rows are
    typed (``operation_type_of``). Unmatched rows have no mark-off.
    """
    kinds = ("module", "source", "payment_type", "vop")
    facts = right.groupBy(key).agg(*[F.max(c).alias(c) for c in kinds])
    both = two_feeds(left, right, key).join(facts, key, "left")
    hit = F.col("matched") == "Y"
    return both.select(key, "amount_1", "amount_2", "matched", "delta", F.when(hit, day).alias("mark_off_day"), F.when(hit, time).alias("mark_off_time"), operation_type_of(*[F.col(c) for c in kinds]).alias("operation_type"))

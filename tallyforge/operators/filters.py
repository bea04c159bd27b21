"""Row filters that read paths share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.normalise import any_of
from tallyforge.operators.joins import with_status_in


def filter_entries(
    entries: DataFrame,
    statuses_of: DataFrame | None = None,
    *,
    ids: Sequence[int] | None = None,
    flow_id: int | None = None,
    statuses: Sequence[str] | None = None,
    amount_min: float | None = None,
    amount_max: float | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    account: str | None = None,
    texts: Mapping[str, str] | None = None,
    payment_statuses: Sequence[str] | None = None,
) -> DataFrame:
    """Entries that meet every condition given; an empty list of ids is met by none, a last day counts whole."""
    if ids is not None:
        entries = entries.filter(F.col("id").isin(list(ids)) if ids else F.lit(False))
    if flow_id is not None:
        entries = entries.filter(F.col("flow_id") == flow_id)
    if statuses is not None:
        entries = entries.filter(F.col("status").isin(list(statuses)))
    if amount_min is not None:
        entries = entries.filter(F.abs("amount") >= amount_min)
    if amount_max is not None:
        entries = entries.filter(F.abs("amount") <= amount_max)
    if date_from is not None:
        entries = entries.filter(F.col("value_date") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        entries = entries.filter(F.col("value_date") < F.lit(date_to).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    if account is not None:
        entries = entries.filter(F.col("account") == account)
    if texts:
        entries = entries.filter(any_of([F.contains(F.lower(F.col(k)), F.lit(x.lower())) for k, x in texts.items()]))
    if payment_statuses is not None and statuses_of is not None:
        entries = with_status_in(entries, statuses_of, list(payment_statuses))
    return entries


def stores_for(live: DataFrame, settled: DataFrame, status: str | None) -> DataFrame:
    """The ledger that can hold a status: pending rows are live, others settled; both without a status."""
    if status is None:
        return live.unionByName(settled)
    return live if status == "PENDING" else settled


def not_dropped(status: Column, drop: Sequence[str]) -> Column:
    """Statuses outside the set, whatever their case; no status stays."""
    return status.isNull() | ~F.lower(F.trim(status)).isin([d.lower() for d in drop])


def since(rows: DataFrame, at: str, start: str, **allowed: list) -> DataFrame:
    """Rows from a moment on whose columns have one of the allowed values: plain predicates that reach the scan."""
    out = rows.filter(F.col(at) >= F.lit(start).cast("timestamp_ntz"))
    for column, values in allowed.items():
        out = out.filter(F.col(column).isin(*values))
    return out


def extract_for(rows: DataFrame, kept: DataFrame, key: str, named: DataFrame, by: str) -> DataFrame:
    """Rows whose ``key`` is among ``kept``, with what ``named`` knows by ``by``; of a repeated name the rows repeat."""
    return rows.join(kept.select(key).distinct(), key, "left_semi").join(named, by, "left")

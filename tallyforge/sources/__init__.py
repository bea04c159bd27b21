"""Readers of bank and ledger feeds; each gives a DataFrame whose ``_error`` says what is wrong with a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.sources.delimited import read_cash_feed, read_delimited, read_wrapped
from tallyforge.sources.fixed_width import read_fixed_width, read_slabs
from tallyforge.sources.statement import read_statements
from tallyforge.sources.workbook import read_typed_workbooks, read_workbooks
from tallyforge.sources.xml_feed import read_xml, read_xml_entries

Reader = Callable[[SparkSession, str, dict], DataFrame]

READERS: dict[str, Reader] = {
    "csv": read_cash_feed,
    "delimited": read_delimited,
    "wrapped": read_wrapped,
    "excel": read_workbooks,
    "workbook": read_typed_workbooks,
    "xml": read_xml,
    "xml_paths": read_xml_entries,
    "fixed_width": read_fixed_width,
    "slabs": read_slabs,
    "mt940": read_statements,
}


def reader(kind: str) -> Reader:
    """The reader of a kind of feed."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; there are {', '.join(sorted(READERS))}")
    return READERS[kind]

"""Workbooks of exports: cells without places take half the bytes and are read like those with places."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from tallyforge.sources import texts, workbook

ROWS = [["ORD1", None, "a<b", 3, ""], [None, None, None, None, "x"], ["ORD2", "EUR", "</c>", None, None], ["ORD3", None, None, -1, "/>"]]
NAMES = ["k", "c", "t", "n", "e"]


def books():
    columns = [pa.array([r[i] for r in ROWS], pa.int64() if i == 3 else pa.string()) for i in range(5)]
    batch = pa.RecordBatch.from_arrays(columns, NAMES)
    return [workbook.book_bytes({"s": (NAMES, workbook.rows_xml(batch, places))}) for places in (True, False)]


@pytest.mark.parametrize("wanted", [None, {0}, {2, 3}, {4}, {0, 1, 2, 3, 4}, {1, 7}])
def test_cells_without_places_are_read_alike(wanted):
    named, bare = [list(workbook.typed_cells(b, 0, None if wanted is None else lambda first: wanted)) for b in books()]
    shown = lambda rows: [(n, [c for i, c in enumerate(cells) if wanted is None or i in wanted]) for n, cells in rows[1:]]
    full = lambda rows: [(n, cells + [None] * (5 - len(cells))) for n, cells in rows]
    assert shown(full(named)) == shown(full(bare)) and len(bare) == 5
    assert [list(workbook.sheet_rows(b)) for b in books()][0] == list(workbook.sheet_rows(books()[1]))


def test_only_needed_cells_are_left():
    row = b'<row r="2"><c t="inlineStr"><is><t>a</t></is></c><c/><c><v>1</v></c><c s="1"><v>2</v></c><c t="b"><v>1</v></c></row>'
    slim = workbook.without_places({2})
    assert slim(row * 2) == b'<row r="2"><c/><c/><c><v>1</v></c></row>' * 2
    short, named = b'<row r="2"><c/></row>', b'<row r="2"><c r="A2"/><c r="B2"/><c r="C2"/></row>'
    assert slim(short + named) == short + named


def test_exports_take_half(spark, tmp_path):
    i = F.col("id")
    df = spark.range(0, 5000, 1, 1).select(F.concat(F.lit("ORD"), i).alias("Key"), *[F.concat(F.lit("v"), i % (n + 2)).alias(f"c{n}") for n in range(16)], i.cast("string").alias("id"))
    sizes = workbook.to_workbooks(df).agg(F.sum(F.length("content"))).first()[0]
    texts.write_workbooks(df, str(tmp_path / "books"), sheet="entries").write.parquet(str(tmp_path / "files"))
    files = pyarrow.fs.LocalFileSystem().get_file_info(pyarrow.fs.FileSelector(str(tmp_path / "books")))
    assert sum(f.size for f in files) < 0.6 * sizes
    back = workbook.read_typed_workbooks(spark, str(tmp_path / "books"), {"sheet": "entries", "columns": {"id": "long", "Key": "string", "c3": "string"}})
    assert back.filter("_error IS NULL AND Key = concat('ORD', id) AND c3 = concat('v', id % 5)").count() == 5000

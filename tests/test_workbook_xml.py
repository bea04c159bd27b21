"""Typed workbooks and XML by paths: sheets by name and place, styles, gaps, bad files; repeated and missing elements."""

import datetime
import io
import zipfile
from decimal import Decimal

import pytest

from tallyforge.sources import reader, workbook
from tallyforge.sources.xml_feed import read_xml_paths, steps

DAY = datetime.datetime(2024, 2, 29, 13, 45, 30)


def book():
    rows = [[1, 2.5, DAY, " x ", True], [None] * 5, [2, None, None, "", None], ["3", "1 000,25", "20240102", 7, "no"], ["x", "y", "z", None, None]]
    return workbook.book_bytes({"first": (["a"], [["one"]]), "data": (["k", "v", "at", "name", "flag"], rows)})


def with_files(content, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, parts.pop(name.replace("/", "_").replace(".", "_"), old.read(name)))
        for name, body in parts.items():
            new.writestr(name, body)
    return out.getvalue()


def read(spark, contents, config, columns=None):
    files = spark.createDataFrame([(bytearray(x),) for x in contents], "content binary")
    return workbook.typed_rows(files, columns or {"k": "long", "v": "decimal", "at": "timestamp", "name": "string", "none": "double"}, config).collect()


def test_typed_values_by_sheet_name(spark):
    got = read(spark, [book()], {"sheet": "data", "decimal_separator": ","})
    assert [tuple(r) for r in got] == [
        (2, 1, Decimal("2.5000"), DAY, "x", None, None),
        (4, 2, None, None, None, None, None),
        (5, 3, Decimal("1000.2500"), datetime.datetime(2024, 1, 2), "7", None, None),
        (6, None, None, None, None, None, "not of its type: k, v, at"),
    ]
    assert [r["k"] for r in read(spark, [book()], {"sheet": 1, "skip_rows": 2, "decimal_separator": ","})] == [2, 3, None]
    assert [tuple(r) for r in read(spark, [book()], {"sheet": 0, "has_header": False}, {"0": "string"})] == [(1, "a", None), (2, "one", None)]


def test_bad_files_are_rows(spark):
    got = read(spark, [b"no zip", book(), b""], {"sheet": "nowhere"})
    assert sorted(r["_error"] for r in got) == ["unreadable: BadZipFile", "unreadable: BadZipFile", "unreadable: KeyError"]


def test_styles_shared_texts_and_the_other_epoch():
    main = workbook.MAIN[1:-1]
    styles = f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;d&quot;"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/><numFmt numFmtId="172" formatCode="[h]:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="172"/></cellXfs></styleSheet>'
    cells = '<c r="A1" s="1"><v>45000</v></c><c r="B1" s="2"><v>45000</v></c><c r="D1" t="s"><v>1</v></c><c r="E1" t="e"><v>#N/A</v></c><c r="F1" s="3"><v>1.5</v></c><c r="AA1" t="str"><v>far</v></c>'
    sheet = f'<worksheet xmlns="{main}"><sheetData><row r="1"/><row r="7">{cells}</row></sheetData></worksheet>'
    shared = f'<sst xmlns="{main}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>'
    raw = with_files(book(), xl_styles_xml=styles, xl_worksheets_sheet1_xml=sheet)
    raw = with_files(raw, **{"xl/sharedStrings.xml": shared})
    (number, values), = workbook.typed_cells(raw)
    assert number == 7 and len(values) == 27 and values[26] == "far"
    assert values[:6] == [datetime.datetime(2023, 3, 15), 45000, None, "bc", None, datetime.datetime(1899, 12, 31, 12)]
    early = zipfile.ZipFile(io.BytesIO(raw)).read("xl/workbook.xml").decode().replace("<sheets>", '<workbookPr date1904="1"/><sheets>')
    assert next(workbook.typed_cells(with_files(raw, xl_workbook_xml=early)))[1][0] == datetime.datetime(2027, 3, 16)


def test_long_sheets_leave_in_portions(spark, monkeypatch):
    raw = workbook.book_bytes({"s": (["n"], [[i] for i in range(25_000)])})
    got = read(spark, [raw], {}, {"n": "long"})
    assert [r["n"] for r in got] == list(range(25_000)) and got[-1]["row_no"] == 25_001


XML = """<d xmlns:n="u"><n:E id=" 1 "><A c="X">5</A><A c="Y">6</A><B><C><D/><D>late</D></C><C><D>other</D></C></B></n:E>
<E><A>7</A><B/><Z>alt</Z></E><E id=""/><F><E id="4"><B><C/><C><D>in second</D></C></B></E></F></d>"""


@pytest.mark.parametrize("size", [9, 70, 1_000_000])
def test_paths_take_the_first_hit(spark, tmp_path, size):
    (tmp_path / "a.xml").write_text(XML)
    fields = {"id": "@id", "a": "A", "ccy": "n:A/@n:c", "d": ["B/C/D", "Z"], "z": ["Z/text()", "./A"]}
    df = read_xml_paths(spark, str(tmp_path), {"record_xpath": "/d/n:E", "field_xpaths": fields, "range_bytes": size})
    assert [tuple(r)[2:-1] for r in df.orderBy("no").collect()] == [("1", "5", "X", None, "5"), (None, "7", None, "alt", "alt"), (None,) * 5, ("4", None, None, "in second", None)]
    with pytest.raises(ValueError):
        steps("A[1]/B")


def test_elements_in_comments_are_none_and_broken_ones_say_so(spark, tmp_path):
    body = '<d><!-- <E><A>no</A></E> --><E a="x > y"><A>1</A><![CDATA[</E><E>]]></E><E/><EE><A>no</A></EE><E><A>2</E><E><E><A>in</A></E></E>'
    (tmp_path / "a.xml").write_text(body)
    (tmp_path / "b.xml").write_bytes("<d><E><A>é</A></E></d>".encode("latin-1"))
    for size in (7, 1_000_000):
        rows = read_xml_paths(spark, str(tmp_path), {"record_xpath": "E", "field_xpaths": {"a": "A"}, "range_bytes": size}).collect()
        own = sorted((r["no"], r["a"], r["_error"]) for r in rows if r["file"] == "a.xml")
        assert [x[::2] for x in own] == [(1, None), (2, None), (3, "not well-formed"), (4, None), (5, None)]
        assert [x[1] for x in own if x[0] != 3] == ["1", None, None, "in"]
    entries = reader("xml_paths")(spark, str(tmp_path), {"record_xpath": "E", "field_xpaths": {"amount": "A"}, "glob": "a*"}).orderBy("no").collect()
    assert [r["_error"] for r in entries] == ["missing value date", "missing amount", "not well-formed", "missing amount", "invalid amount"]


def test_only_the_asked_cells_are_parsed_and_rows_of_the_others_stay(spark, monkeypatch):
    monkeypatch.setattr(workbook, "PORTION", 300)
    rows = [[i, f"<{i}>", None if i % 3 else "x"] for i in range(50)]
    raw = workbook.book_bytes({"s": (["a", "b", "c"], rows)})
    seen = []
    real = workbook.typed_value
    monkeypatch.setattr(workbook, "typed_value", lambda *a: seen.append(a[0].get("r")) or real(*a))
    got = list(workbook.typed_cells(raw, 0, lambda first: {2}))[1:]
    assert [n for n, _ in got] == list(range(2, 52)) and [v[2] if len(v) > 2 else None for _, v in got] == [r[2] for r in rows]
    assert list(workbook.typed_cells(raw))[1:] == [(i, r) for i, r in enumerate(rows, 2)]
    seen.clear()
    assert len(list(workbook.typed_cells(raw, 0, lambda first: {0}))) == 51
    assert not [r for r in seen[3:] if r[0] != "A" and int(r[1:]) > 20]  # cells that nobody asks for are cut out unparsed


def test_comments_prefixes_and_faults_are_read_element_by_element():
    main = workbook.MAIN[1:-1]
    row = '<row r="{0}"><c r="A{0}"><v>{0}</v></c></row>'
    for sheet in (
        f'<worksheet xmlns="{main}"><sheetData>{row.format(1)}<!-- </row> -->{row.format(2)}</sheetData></worksheet>',
        f'<x:worksheet xmlns:x="{main}"><x:sheetData>{row.format(1)}{row.format(2)}</x:sheetData></x:worksheet>'.replace("<", "<x:").replace("<x:/", "</x:").replace("x:x:", "x:"),
        f'<?xml version="1.0"?>\n<worksheet xmlns="{main}"><cols/><sheetData>{row.format(1)}<row/>{row.format(2)}</sheetData><after/></worksheet>',
    ):
        assert list(workbook.typed_cells(with_files(book(), xl_worksheets_sheet1_xml=sheet))) == [(1, [1]), (2, [2])]
    broken = workbook.typed_cells(with_files(book(), xl_worksheets_sheet1_xml=f'<worksheet xmlns="{main}"><sheetData>{row.format(1)}<row r="2"><c></row></sheetData></worksheet>'))
    assert next(broken) == (1, [1])
    with pytest.raises(workbook.ElementTree.ParseError):
        next(broken)


def test_workbooks_of_whole_columns_equal_those_of_single_cells():
    import pyarrow as pa

    columns = {"s": ["<a&b>", None, ""], "n": [1, None, -3], "f": [1.5, float("nan"), None], "b": [True, None, False], "t": [datetime.datetime(2024, 1, 2, 3), None, None]}
    batch = pa.RecordBatch.from_pydict(columns)
    by_cell = ["".join(workbook.cell_xml(None if v != v else v, f"{workbook.column_name(j)}{i + 2}") for j, v in enumerate(c[i] for c in columns.values())) for i in range(3)]
    assert workbook.rows_xml(batch) == by_cell

"""XLSX workbooks: rows of a sheet from the files' bytes, and bytes of a workbook from rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timedelta
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """Cells of a sheet as text, row by row; gaps are null, rows of nulls are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    value = c.find(f"{MAIN}v")
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                    cells += [None] * (at - 1 - len(cells)) + [text if text else None]
                row.clear()
                if any(x is not None for x in cells):
                    yield cells


#: Numbers of built-in formats that show a date or time, and the day from which serial numbers count.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
EPOCH, EPOCH_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a sheet that leave a task at once.
ROWS = 10_000
#: Bytes of a sheet that are parsed at once.
PORTION = 1 << 18


def part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def sheet_path(z: zipfile.ZipFile, sheet: int | str) -> tuple[str, datetime]:
    """The part that holds a sheet, by its place from 0 or by its name, and the day that its dates count from."""
    book, relations = part(z, "xl/workbook.xml"), part(z, "xl/_rels/workbook.xml.rels")
    sheets = book.findall(f"{MAIN}sheets/{MAIN}sheet")
    found = sheets[sheet] if isinstance(sheet, int) else next((x for x in sheets if x.get("name") == sheet), None)
    if found is None:
        raise KeyError(f"no sheet {sheet!r}")
    target = next(r.get("Target") for r in relations if r.get("Id") == found.get(RELATION))
    base = book.find(f"{MAIN}workbookPr")
    early = base is not None and base.get("date1904", "0") in ("1", "true")
    return (target.lstrip("/") if target.startswith("/") else f"xl/{target}"), EPOCH_1904 if early else EPOCH


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose format shows a date or time."""
    styles = part(z, "xl/styles.xml")
    if styles is None:
        return set()
    own = {}
    for f in styles.iter(f"{MAIN}numFmt"):
        bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", f.get("formatCode", "").lower())
        own[int(f.get("numFmtId"))] = bool(re.search("[dmyhs]", bare.split(";")[0])) and "general" not in bare
    cells = styles.find(f"{MAIN}cellXfs")
    formats = [int(x.get("numFmtId", "0")) for x in cells] if cells is not None else []
    return {i for i, n in enumerate(formats) if own.get(n, n in DATE_FORMATS)}


def typed_value(cell: ElementTree.Element, shared: list[str], dates: set[int], epoch: datetime):
    """A cell's value: text, whole number, fraction, truth value or time; null if it is empty or an error."""
    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) or None
    if value is None or not value.text or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)] or None
    if kind == "str":
        return value.text
    if kind == "b":
        return value.text == "1"
    if kind == "d":
        return datetime.fromisoformat(value.text.rstrip("Z"))
    number = float(value.text)
    if int(cell.get("s", "0")) in dates:
        return epoch + timedelta(milliseconds=round(number * 86_400_000))
    return int(value.text) if re.fullmatch(r"-?\d+", value.text) else number


def column_index(name: str) -> int:
    """The place of a cell from 1, by the letters of its name; 0 without any."""
    at = 0
    for x in re.match("[A-Z]*", name)[0]:
        at = at * 26 + ord(x) - 64
    return at


def row_elements(file, slim: Callable[[bytes], bytes]) -> Iterator[tuple[ElementTree.Element, Callable[[], ElementTree.Element]]]:
    """The rows of a sheet: each as an element of the cells that ``slim`` leaves, and what gives the row with all cells.

    Portions of whole rows are parsed at once and dropped, so a long sheet isn't held. A ``</row>`` ends a row wherever it
    stands, unless there is a comment, plain characters or an instruction; a sheet with one of these, or whose rows have
    a prefix, is parsed element by element, as is a portion that isn't well-formed.
    """

    def rows(portion: bytes) -> list[ElementTree.Element]:
        return list(ElementTree.fromstring(head + portion).iter(f"{MAIN}row"))

    head, rest, block = None, b"", file.read(PORTION)
    if found := re.match(rb"(?:\xef\xbb\xbf)?(?:<\?xml[^>]*\?>)?\s*<worksheet(?=[\s>])[^!?]*?<sheetData(?:\s[^>]*)?(?<!/)>", block):
        head, rest = found[0], block[found.end() :]
    while head is not None:
        last = b"</sheetData" in rest
        if last:  # what follows the rows is parsed with the last of them
            rest += file.read()
        end = len(rest) if last else rest.rfind(b"</row>") + 6
        if b"<!" in rest or b"<?" in rest:
            break
        if end >= 6:
            portion = rest[:end] if last else rest[:end] + b"</sheetData></worksheet>"
            try:
                parsed = rows(slim(portion))
            except ElementTree.ParseError:
                break  # the rows before the fault come all the same
            whole = lru_cache(1)(lambda portion=portion: rows(portion))
            for i, e in enumerate(parsed):
                yield e, lambda i=i: whole()[i]
            rest = rest[end:]
        if last:
            return
        block = file.read(PORTION)
        if not block:
            break
        rest += block
    parser = ElementTree.XMLPullParser(("start", "end"))
    above: list = []
    for piece in (block if head is None else head + rest, *iter(lambda: file.read(PORTION), b""), None):
        parser.feed(piece) if piece is not None else parser.close()
        for event, e in parser.read_events():
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag == f"{MAIN}row":
                yield e, lambda e=e: e
                above[-1].remove(e)


def typed_cells(content: bytes, sheet: int | str = 0, wanted: Callable[[list], set[int]] | None = None) -> Iterator[tuple[int, list]]:
    """(row number, values) of a sheet, row by row as the file is read; gaps are null, rows of nulls are left out.

    ``wanted`` gives, for the first row, the places whose values are needed; cells elsewhere are null in the rows after it.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        path, epoch = sheet_path(z, sheet)
        texts, dates = part(z, "xl/sharedStrings.xml"), date_styles(z)
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in texts] if texts is not None else []
        places: dict[str, int] = {}
        number, needed, others, slimmed = 0, None, None, None

        def slim(portion: bytes) -> bytes:
            return slimmed(others.sub(b"", portion)) if others else portion

        def values(row: ElementTree.Element) -> list:
            cells: list = []
            at = 0
            for c in row.iter(f"{MAIN}c"):
                letters = c.get("r", "").rstrip("0123456789")
                at = places.get(letters) if letters else at + 1  # a cell without a place follows the one before it
                if at is None:
                    at = places[letters] = column_index(letters)
                if needed is None or at - 1 in needed:
                    cells += [None] * (at - 1 - len(cells)) + [typed_value(c, shared, dates, epoch)]
            return cells

        with z.open(path) as f:
            for e, whole in row_elements(f, slim):
                number = int(e.get("r", number + 1))
                cells = values(e)
                if any(x is not None for x in cells) or needed is not None and any(typed_value(c, shared, dates, epoch) is not None for c in whole().iter(f"{MAIN}c")):
                    yield number, cells
                    if wanted is not None and needed is None:
                        needed = wanted(cells)
                        names = "|".join(column_name(i) for i in needed)
                        others = re.compile(rf'<c r="(?!(?:{names})[0-9])[A-Z]+[0-9]+"[^<>]*(?:(?<=/)>|>(?:[^<]++|<(?!/c>))*+</c>)'.encode())
                        slimmed = without_places(needed)


def without_places(needed: set[int]) -> Callable[[bytes], bytes]:
    """What empties the cells that aren't needed in rows whose cells name no place; other rows stay as they are."""
    cell = rb"<c(?:/>| (?!r=)[^<>]*+(?:(?<=/)>|>(?:[^<]++|<(?!/c>))*+</c>)|>(?:[^<]++|<(?!/c>))*+</c>)"
    pattern, new, skipped = rb"(<row(?: [^<>]*)?>)", rb"\1", 0
    for n, i in enumerate(sorted(needed), 2):
        pattern += rb"(?:%s){%d}(%s)" % (cell, i - skipped, cell)
        new += b"<c/>" * (i - skipped) + rb"\g<%d>" % n
        skipped = i + 1
    rows = re.compile(pattern + rb"(?:%s)*+(?=</row>)" % cell)
    return lambda portion: rows.sub(new, portion)


@lru_cache(100_000)
def moment(text: str, form: str) -> datetime:
    return datetime.strptime(text, form)


def as_type(value, kind: str, options: Mapping):
    """A cell as string, long, double, decimal or timestamp; a value that isn't one raises ValueError. Null stays null.

    Texts lose outer spaces, and an empty one is null; numbers in texts may have spaces and another decimal separator.
    A timestamp is read from a date cell, else by ``date_format``: ``int_yyyymmdd`` or a format of % directives.
    """
    text = str(value).strip() if value is not None else ""
    if not text:
        return None
    if kind == "string":
        return text
    if kind == "timestamp":
        if isinstance(value, datetime):
            return value
        form = options.get("date_format", "int_yyyymmdd")
        return moment(str(int(float(text))), "%Y%m%d") if form in ("int_yyyymmdd", "excel_date") else moment(text, form)
    if isinstance(value, (bool, datetime)):
        raise ValueError(f"no number: {text}")
    bare = text if isinstance(value, (int, float)) else text.replace(" ", "").replace(options.get("decimal_separator", "."), ".")
    try:
        number = Decimal(bare)
    except InvalidOperation:
        raise ValueError(f"no number: {text}") from None
    if kind == "long":
        if number != number.to_integral_value():
            raise ValueError(f"no whole number: {text}")
        return int(number)
    return float(number) if kind == "double" else number.quantize(Decimal("0.0001"))


#: Types of columns by what a configuration calls them.
CELL_TYPES = {"string": "string", "long": "bigint", "double": "double", "decimal": "decimal(20,4)", "timestamp": "timestamp_ntz"}


def typed_rows(files: DataFrame, columns: Mapping[str, str], config: Mapping) -> DataFrame:
    """(row_no, columns, _error) of workbooks (column ``content``); ``columns`` maps header names to kinds of values.

    ``sheet`` is a place from 0 or a name; the first row is the header unless ``has_header`` says otherwise (columns are
    then places, as text); ``skip_rows`` rows after it are left out, as are rows without any value. A column that the
    sheet lacks is null; a value of another kind is null, and ``_error`` names its column. A file that can't be read, or
    has no such sheet, is one row with its error. Rows leave a task in portions, as the sheet is read.
    """
    schema = ", ".join(["row_no bigint", *(f"`{c}` {CELL_TYPES[k]}" for c, k in columns.items()), "_error string"])
    sheet, header, skip = config.get("sheet", 0), config.get("has_header", True), int(config.get("skip_rows", 0))

    def read(content: bytes):
        place: dict[str, int] = {}
        first = True
        def wanted(cells: list) -> set[int]:
            if not header:
                return {int(c) for c in columns}
            return {i for i, v in enumerate(cells) if v is not None and str(v).strip() in columns}

        for number, cells in typed_cells(content, sheet, wanted):
            if first and header:
                place = {str(v).strip(): i for i, v in enumerate(cells) if v is not None}
                top, first = number, False
                continue
            if first:
                top, first = 0, False
            if number <= top + skip:
                continue
            out, bad = [number], []
            for c, kind in columns.items():
                at = place.get(c) if header else int(c)
                try:
                    out.append(as_type(cells[at], kind, config) if at is not None and at < len(cells) else None)
                except ValueError:
                    out.append(None)
                    bad.append(c)
            yield (*out, f"not of its type: {', '.join(bad)}" if bad else None)

    def run(batches):
        import pyarrow as pa

        kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "decimal(20,4)": pa.decimal128(20, 4), "timestamp_ntz": pa.timestamp("us")}
        types = [pa.int64(), *(kinds[CELL_TYPES[k]] for k in columns.values()), pa.string()]
        names = ["row_no", *columns, "_error"]

        def portion(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for content in batch.column(0):
                held = []
                try:
                    for row in read(content.as_py()):
                        held.append(row)
                        if len(held) == ROWS:
                            yield portion(held)
                            held = []
                except (zipfile.BadZipFile, KeyError, IndexError, AttributeError, ElementTree.ParseError) as e:
                    held.append((None, *(None for _ in columns), f"unreadable: {type(e).__name__}"))
                if held:
                    yield portion(held)

    return files.select("content").mapInArrow(run, schema)


def read_typed_workbooks(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """Typed rows of the workbooks below a path; each file is one task's, as its bytes can't be split."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", config.get("glob", "*.xlsx")).load(path)
    return typed_rows(files, config["columns"], config)


def cell_xml(value, name: str = "") -> str:
    """A cell of a text, number, truth value or time (style 1); without a name it follows the one before it."""
    at = f' r="{name}"' if name else ""
    if value is None:
        return f"<c{at}/>"
    if isinstance(value, bool):
        return f'<c{at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime):
        return f'<c{at} s="1"><v>{(value.replace(tzinfo=None) - EPOCH) / timedelta(days=1)!r}</v></c>'
    if isinstance(value, (int, float, Decimal)):
        return f"<c{at}><v>{value}</v></c>"
    return f'<c{at} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def column_name(i: int) -> str:
    name, n = "", i + 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def book_bytes(sheets: Mapping[str, tuple[list[str], list[list] | list[str]]]) -> bytes:
    """A workbook of sheets by name, each (header, rows); a row is a list of values, or its cells from row 2 on as XML."""
    package, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(sheets) + 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        related = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{related}<Relationship Id="r{len(sheets) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN[1:-1]}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        for i, (header, rows) in enumerate(sheets.values(), 1):
            lines = (f'<row r="{r}">' + (values if isinstance(values, str) else "".join(cell_xml(v, f"{column_name(j)}{r}") for j, v in enumerate(values))) + "</row>" for r, values in enumerate([header, *rows], 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def workbook_bytes(header: list[str], rows: list[list]) -> bytes:
    """A workbook of one sheet."""
    return book_bytes({"rows": (header, rows)})


def rows_xml(batch, places: bool = True) -> list[str]:
    """The cells of an Arrow batch's rows as XML, from row 2 on: whole columns at once where values are texts or whole numbers."""
    import pyarrow as pa
    import pyarrow.compute as pc

    numbers = pc.cast(pa.array(range(2, len(batch) + 2), pa.int64()), pa.string())
    columns = []
    for j, values in enumerate(batch.columns):
        letters = column_name(j)
        begin = [f'<c r="{letters}', numbers, '"'] if places else [pa.scalar("<c")]
        made = lambda *parts: pc.binary_join_element_wise(*begin, *parts, "")  # noqa: B023, E731
        if pa.types.is_string(values.type):
            for plain, escaped in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
                values = pc.replace_substring(values, plain, escaped)
            full = made(' t="inlineStr"><is><t xml:space="preserve">', values, "</t></is></c>")
        elif pa.types.is_integer(values.type):
            full = made("><v>", pc.cast(values, pa.string()), "</v></c>")
        else:
            plain = [None if isinstance(v, float) and v != v else v for v in values.to_pylist()]
            columns.append(pa.array([cell_xml(v, f"{letters}{r}" if places else "") for r, v in enumerate(plain, 2)], pa.string()))
            continue
        columns.append(pc.coalesce(full, made("/>") if places else pa.scalar("<c/>")))
    return pc.binary_join_element_wise(*columns, "").to_pylist()


def to_workbooks(df: DataFrame, most: int = 50_000, sheet: str = "rows", places: bool = True) -> DataFrame:
    """(content, rows): workbooks of at most ``most`` rows each, made where the rows are, in a sheet of that name.

    A sheet ``info`` with the number of rows comes before one of another name than ``rows``. Cells need not name their
    ``places``, as none is left out; without them a workbook takes half the bytes.
    """
    names = df.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                sheets = {"info": (["rows"], [[len(part)]])} if sheet != "rows" else {}
                book = book_bytes({**sheets, sheet: (names, rows_xml(part, places))})
                yield pa.RecordBatch.from_arrays([pa.array([book], pa.binary()), pa.array([len(part)], pa.int64())], ["content", "rows"])

    return df.mapInArrow(run, "content binary, rows long")


def workbook_rows(files: DataFrame, columns: list[str], sheet: int = 1, skip: int = 0) -> DataFrame:
    """Rows of workbooks (column ``content``) as text, found by header names; a file that can't be read is one error row."""
    schema = ", ".join([*(f"`{c}` string" for c in columns), "_error string"])

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for content in pdf["content"]:
                try:
                    rows = list(sheet_rows(bytes(content), sheet))[skip:]
                    head = {h: i for i, h in enumerate(rows[0])} if rows else {}
                    out = [[r[head[c]] if c in head and head[c] < len(r) else None for c in columns] + [None] for r in rows[1:]]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out = [[None] * len(columns) + [f"unreadable: {type(e).__name__}"]]
                yield pd.DataFrame(out, columns=[*columns, "_error"], dtype=object)

    return files.select("content").mapInPandas(run, schema)


def read_workbooks(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """Rows of the workbooks below a path; each file is one task's, as its bytes can't be split."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", config.get("glob", "*.xlsx")).load(path)
    return workbook_rows(files, config["columns"], config.get("sheet", 1), config.get("skip_rows", 0))

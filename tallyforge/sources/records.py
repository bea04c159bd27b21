"""Records of large files: a Python Data Source whose partitions are byte ranges that begin at record boundaries.

A first pass counts, per range and per state in which the range may begin, the records that begin in it, and says in
which state it ends. Folding these few numbers gives every range its real state and the number of its first record; the
second pass reads records by ranges. A range owns the records that begin in it and reads on to the end of the last.
"""

from __future__ import annotations

import codecs
import csv
import fnmatch
import io
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCAN = "file string, start bigint, stop bigint, n0 bigint, n1 bigint, s0 int, s1 int, head string, error string"
RANGE_BYTES = 32_000_000
BLOCK = 1 << 20
#: Fixed value: the line that an export begins with whose records are in quotes.
FAKE_HEADER = "?column?"
#: Encodings in which a line feed is one byte that no other character holds: only these can be cut by bytes.
CUTTABLE = re.compile("utf-?8(-sig)?|ascii|us-ascii|latin-?1|iso-?8859-?[0-9]+|cp125[0-9]|windows-125[0-9]", re.I)


def is_utf8(encoding: str) -> bool:
    return encoding.lower().startswith("utf")


class Bytes:
    """A file by positions, read in blocks."""

    def __init__(self, path: str) -> None:
        import pyarrow.fs

        fs, own = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        self.file = fs.open_input_file(own)
        self.size = self.file.size()

    def read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, min(stop, self.size) - start))

    def lines(self, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """(position, line with its end) of all lines that begin in [start, stop), then of those after it."""
        at = start
        if start and self.read(start - 1, start) != b"\n":
            at = next((i for i in self.breaks(start)), self.size)
        rest, pos = b"", at
        while pos < self.size or rest:
            block = self.read(pos + len(rest), pos + len(rest) + BLOCK)
            data = rest + block
            cut = len(data) if not block else data.rfind(b"\n") + 1
            for line in data[:cut].splitlines(keepends=True) if b"\r" not in data[:cut] else re.findall(rb"[^\n]*\n|[^\n]+$", data[:cut]):
                yield pos, line
                pos += len(line)
            rest = data[cut:]

    def breaks(self, start: int) -> Iterator[int]:
        """Positions after line feeds from ``start`` on."""
        while start < self.size:
            block = self.read(start, start + BLOCK)
            for m in re.finditer(b"\n", block):
                yield start + m.end()
            start += len(block)


class Packed:
    """A compressed file, read from its begin to its end by one task."""

    def __init__(self, path: str) -> None:
        import pyarrow.fs

        fs, own = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        self.file = fs.open_input_stream(own, compression="gzip")

    def texts(self, encoding: str) -> Iterator[str]:
        """Its characters, unpacked block by block."""
        decoder = codecs.getincrementaldecoder(encoding)()
        while block := self.file.read(BLOCK):
            yield decoder.decode(block)
        yield decoder.decode(b"", final=True)


def tail(raw: bytes) -> int:
    """How many bytes at the begin go on with the character before."""
    return len(raw) - len(raw.lstrip(bytes(range(0x80, 0xC0))))


def whole_text(file: Bytes, start: int, stop: int, encoding: str) -> str:
    """The characters that begin in a range."""
    own, after = file.read(start, stop), file.read(stop, stop + 3)
    if is_utf8(encoding):
        own = own[tail(own) if start else 0 :] + after[: tail(after)]
    return own.decode(encoding)


class Cut:
    """How records follow from lines: the state is 1 within a record that goes on, else 0."""

    def __init__(self, encoding: str = "utf-8", blank: bool = False) -> None:
        self.encoding, self.keep_blank = encoding, blank

    def after(self, line: str, state: int) -> int:
        """The state after a line."""
        return 0

    def begins(self, line: str) -> bool:
        """Whether a line that begins a record counts: blank ones don't, unless they are wanted."""
        return self.keep_blank or bool(line.strip())

    def scan(self, file: Bytes, start: int, stop: int, head: str | None) -> tuple:
        """(records if begun in state 0, in state 1, end states) over the lines that begin in the range."""
        count, state = [0, 0], [0, 1]
        for pos, raw in file.lines(start, stop):
            if pos >= stop:
                break
            line = raw.decode(self.encoding)
            for i in (0, 1):
                count[i] += state[i] == 0 and self.begins(line)
                state[i] = self.after(line, state[i])
        return (*count, *state)

    def records(self, file: Bytes, start: int, stop: int, state: int, head: str | None) -> Iterator[tuple[int, str]]:
        """(position, text) of the records that begin in the range."""
        begun, parts = None, []
        for pos, raw in file.lines(start, stop):
            if pos >= stop and begun is None:
                break
            line = raw.decode(self.encoding)
            if state == 0 and begun is None:
                if pos >= stop:
                    break
                begun, parts = pos, []
            state = self.after(line, state)
            if begun is not None:
                parts.append(line)
            if state == 0 and begun is not None:
                if self.begins(parts[0]):
                    yield begun, self.text("".join(parts))
                begun = None
        if begun is not None and self.begins(parts[0]):
            yield begun, self.text("".join(parts))

    def text(self, record: str) -> str:
        return record.removesuffix("\n").removesuffix("\r")


class Quoted(Cut):
    """Delimited records: a line end within a quoted field doesn't end the record. Quotes count at a field's begin only."""

    def __init__(self, encoding: str, delimiter: str, quote: str, blank: bool) -> None:
        super().__init__(encoding, blank)
        self.delimiter, self.quote = delimiter, quote
        q = re.escape(quote)
        self.closing = re.compile(f"[^{q}]*(?:{q}{q}[^{q}]*)*{q}(?!{q})")

    def after(self, line: str, state: int) -> int:
        if self.quote not in line:
            return state
        at = 0
        while True:
            if state:
                end = self.closing.match(line, at)
                if end is None:
                    return 1
                at, state = end.end(), 0
            elif at == 0 and line.startswith(self.quote):
                at, state = len(self.quote), 1
                continue
            at = line.find(self.delimiter + self.quote, at)
            if at < 0:
                return 0
            at, state = at + len(self.delimiter + self.quote), 1


class Wrapped(Cut):
    """Exports that have each record in quotes: a record that begins with one goes on to a line that ends in one.

    One layer of quotes goes and doubled ones become single. Only a file whose first line is the fake header is
    unwrapped; other files are read line by line.
    """

    def after(self, line: str, state: int) -> int:
        bare = line.strip()
        if state:
            return 0 if bare.endswith('"') else 1
        return 1 if bare.startswith('"') and not (bare.endswith('"') and len(bare) >= 2) else 0

    def text(self, record: str) -> str:
        bare = record.strip()
        if not bare.startswith('"'):
            return bare
        return bare[1:-1].replace('""', '"') if bare.endswith('"') and len(bare) >= 2 else bare.strip('"')


class Separated:
    """Records that begin with a separator; what stands before the first is a record if it isn't blank."""

    def __init__(self, encoding: str, separator: str) -> None:
        self.encoding, self.mark = encoding, separator.encode(encoding)

    def places(self, file: Bytes, start: int, stop: int) -> Iterator[int]:
        """Positions of separators that begin in the range."""
        at = start
        while at < stop:
            block = file.read(at, min(at + BLOCK, stop) + len(self.mark) - 1)
            for m in re.finditer(re.escape(self.mark), block):
                if at + m.start() < min(at + BLOCK, stop):
                    yield at + m.start()
            at += BLOCK

    def begins(self, file: Bytes, start: int, stop: int) -> Iterator[int]:
        if start == 0:
            first = next(self.places(file, 0, file.size), file.size)
            if file.read(0, first).strip():
                yield 0
        yield from self.places(file, start, stop)

    def scan(self, file: Bytes, start: int, stop: int, head: str | None) -> tuple:
        n = sum(1 for _ in self.records(file, start, stop, 0, head))  # decoded, too: a bad one makes a bad file
        return n, n, 0, 0

    def records(self, file: Bytes, start: int, stop: int, state: int, head: str | None) -> Iterator[tuple[int, str]]:
        before = None
        for at in self.begins(file, start, stop):
            if before is not None and at != before:
                yield before, file.read(before, at).decode(self.encoding)
            before = at
        if before is not None:
            end = next(self.places(file, max(stop, before + 1), file.size), file.size)
            yield before, file.read(before, end).decode(self.encoding)


class Elements:
    """XML elements of a name, prefixes aside, wherever they stand; one within another is a record, too.

    The state is 1 within a comment or a section of plain characters, where nothing is an element.
    """

    def __init__(self, encoding: str, tag: str) -> None:
        name = rb"(?:[\w.-]+:)?" + re.escape(tag.encode(encoding))
        self.encoding = encoding
        self.open = re.compile(rb"<!--|<!\[CDATA\[|<" + name + rb"(?=[\s/>])")
        self.close = re.compile(rb"-->|\]\]>")
        attributes = rb"(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*+"
        self.mark = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<" + name + rb"(?=[\s/>])" + attributes + rb"(/?)>|</" + name + rb"\s*>", re.S)

    def places(self, file: Bytes, start: int, stop: int, state: int):
        """Positions of elements that begin in the range; at last the state in which it ends, as a negative number."""
        data, at, size = file.read(start, stop + 512), 0, stop - start
        while True:
            m = (self.close if state else self.open).search(data, at)
            if m is None or m.start() >= size:
                yield -1 - state
                return
            if state:
                state = 0
            elif m[0].startswith(b"<!"):
                state = 1
            else:
                yield start + m.start()
            at = m.end()

    def scan(self, file: Bytes, start: int, stop: int, head: str | None) -> tuple:
        counts, ends = [], []
        for state in (0, 1):
            found = list(self.places(file, start, stop, state))
            counts.append(len(found) - 1)
            ends.append(-1 - found[-1])
        whole_text(file, start, stop, self.encoding)
        return (*counts, *ends)

    def records(self, file: Bytes, start: int, stop: int, state: int, head: str | None) -> Iterator[tuple[int, str]]:
        data, upto = file.read(start, stop), stop
        for place in self.places(file, start, stop, state):
            if place < 0:
                return
            depth, at = 0, place - start
            while True:
                m = self.mark.search(data, at)
                if m is None:
                    if upto >= file.size:
                        break  # an element without an end goes on to the end of the file
                    data += file.read(upto, upto + BLOCK)
                    upto += BLOCK
                    continue
                at = m.end()
                if not m[0].startswith(b"<!"):
                    depth += -1 if m[0].startswith(b"</") else 0 if m[1] else 1
                    if depth <= 0:
                        break
            yield place, data[place - start : at if m else len(data)].decode(self.encoding)


class Slabs:
    """Records of a fixed number of characters without any ends; the last may be shorter. The state is a character count.

    Of records of at least ``least`` characters the first ``width`` leave, filled up with spaces.
    """

    def __init__(self, encoding: str, length: int, least: int | None = None, width: int = 0) -> None:
        self.encoding, self.length, self.least, self.width = encoding, length, least, width

    def text(self, slab: str) -> str:
        return slab if self.least is None or len(slab) < self.least else slab[: self.width].ljust(self.width)

    def scan(self, file: Bytes | Packed, start: int, stop: int, head: str | None) -> tuple:
        n = sum(map(len, file.texts(self.encoding))) if isinstance(file, Packed) else len(whole_text(file, start, stop, self.encoding))
        return n, n, 0, 0

    def unpacked(self, file: Packed) -> Iterator[tuple[int, str]]:
        at, held = 0, ""
        width = (lambda s: len(s) if s.isascii() else len(s.encode(self.encoding))) if is_utf8(self.encoding) else len
        for text in file.texts(self.encoding):
            held += text
            whole = len(held) - len(held) % self.length
            for i in range(0, whole, self.length):
                slab = held[i : i + self.length]
                yield at, self.text(slab)
                at += width(slab)
            held = held[whole:]
        if held:
            yield at, self.text(held)

    def records(self, file: Bytes | Packed, start: int, stop: int, state: int, head: str | None) -> Iterator[tuple[int, str]]:
        if isinstance(file, Packed):
            yield from self.unpacked(file)
            return
        raw = file.read(start, stop + 4 * self.length + 4)
        skip = tail(raw) if is_utf8(self.encoding) and start else 0
        text = raw[skip:].decode(self.encoding, "ignore" if is_utf8(self.encoding) and stop + 4 * self.length + 4 < file.size else "strict")
        width = (lambda s: len(s.encode(self.encoding))) if is_utf8(self.encoding) else len
        first = -state % self.length
        at = start + skip + width(text[:first])
        for i in range(first, len(text), self.length):
            if at >= stop:
                break
            slab = text[i : i + self.length]
            yield at, self.text(slab)
            at += width(slab)


class Range(InputPartition):
    """A byte range of a file, or one that only says what is wrong with the file."""

    def __init__(self, file: str, start: int, stop: int, state: int = 0, no: int = 0, head: str | None = None, error: str | None = None) -> None:
        self.file, self.start, self.stop, self.state, self.no, self.head, self.error = file, start, stop, state, no, head, error


class RecordReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.o = {k.lower(): v for k, v in dict(options).items()}
        self.encoding = self.o.get("encoding", "utf-8")
        self.header = self.o.get("header", "false") == "true"
        self.columns = json.loads(self.o.get("columns", "null"))

    def cut(self, head: str | None):
        kind, encoding = self.o["cut"], self.encoding
        if kind == "element":
            return Elements(encoding, self.o["tag"])
        if kind == "separator":
            return Separated(encoding, self.o["separator"])
        if kind == "fixed":
            return Slabs(encoding, int(self.o["length"]), int(self.o["least"]) if "least" in self.o else None, int(self.o.get("width", 0)))
        if kind == "quoted":
            return Quoted(encoding, self.o.get("delimiter", ","), self.o.get("quote", '"'), not self.header)
        if kind == "wrapped" and head is not None and head.strip().strip('"') == FAKE_HEADER:
            return Wrapped(encoding)
        return Cut(encoding)

    def opened(self, path: str) -> Bytes | Packed:
        return Packed(path) if self.packed(path) else Bytes(path)

    def packed(self, path: str) -> bool:
        """Whether a file is unpacked: only slabs are read as a stream."""
        return self.o["cut"] == "fixed" and path.endswith(".gz")

    def head_of(self, file: Bytes) -> str | None:
        """The first record of a file whose cut needs it."""
        if self.o["cut"] == "wrapped":
            line = next(file.lines(0, file.size), (0, b""))[1]
            return line.decode(self.encoding, "replace")
        if self.o["cut"] == "quoted" and self.header:
            return next(Quoted(self.encoding, self.o.get("delimiter", ","), self.o.get("quote", '"'), False).records(file, 0, file.size, 0, None), (0, ""))[1]
        return None

    def partitions(self):
        if self.o["phase"] == "read":
            return [Range(*p) for p in json.loads(self.o["plan"])] or [Range("", 0, 0)]
        import pyarrow.fs

        size = int(self.o.get("range_bytes", RANGE_BYTES)) if CUTTABLE.fullmatch(self.encoding) else 1 << 62
        out = []
        for path in json.loads(self.o["paths"]):
            if path.startswith("file:/") and not path.startswith("file://"):  # as Hadoop writes local paths
                path = path.replace("file:", "file://", 1)
            fs, own = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
            base = path.removesuffix(own) if path.endswith(own) else ""
            info = fs.get_file_info(own)
            if info.type == pyarrow.fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(own, recursive=True))
            for f in sorted((f for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.o.get("glob", "*")) and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
                step = max(f.size, 1) if self.packed(f.path) else size
                out += [Range(base + f.path, a, min(a + step, f.size)) for a in range(0, max(f.size, 1), step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        if part.file:
            yield from self.scanned(part) if self.o["phase"] == "scan" else self.rows(part)

    def scanned(self, part: Range):
        head = error = None
        found = (0, 0, 0, 0)
        try:
            file = self.opened(part.file)
            head = self.head_of(file)
            found = self.cut(head).scan(file, part.start, part.stop, head)
        except (OSError, UnicodeError, LookupError) as e:
            error = f"file error: {type(e).__name__}"
        yield (part.file, part.start, part.stop, *found, head if part.start == 0 else None, error)

    def rows(self, part: Range):
        name = part.file.rsplit("/", 1)[-1]
        empty = [None] * len(self.columns) if self.columns is not None else [None]
        if part.error:
            yield (name, None, None, *empty, part.error)
            return
        file = self.opened(part.file)
        # the header of delimited files and the fake one of wrapped files are records by number, but no rows
        no = part.no
        skip = 1 if self.header or (self.o["cut"] == "wrapped" and isinstance(self.cut(part.head), Wrapped)) else 0
        place = None
        if self.columns is not None:
            names = self.fields(part.head) if self.header else None
            place = [(names.index(c) if c in names else None) if names is not None else int(c) for c in self.columns]
        for at, text in self.cut(part.head).records(file, part.start, part.stop, part.state, part.head):
            no += 1
            if no <= skip:
                continue
            if place is None:
                yield (name, at, no, text, None)
            else:
                values = self.fields(text)
                yield (name, at, no, *(values[i] if i is not None and i < len(values) else None for i in place), None)

    def fields(self, record: str) -> list[str]:
        return next(csv.reader(io.StringIO(record, newline=""), delimiter=self.o.get("delimiter", ","), quotechar=self.o.get("quote", '"')), [])


class RecordSource(DataSource):
    """Options: phase, cut, paths and those of the cut; use ``split_records``."""

    @classmethod
    def name(cls) -> str:
        return "record_ranges"

    def schema(self) -> str:
        if self.options.get("phase") == "scan":
            return SCAN
        columns = json.loads(self.options.get("columns", "null"))
        return f"file string, start bigint, no bigint, {', '.join(f'`{c}` string' for c in columns) if columns is not None else 'value string'}, _error string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def planned(ranges: list) -> list[list]:
    """Each range with its state, its first record's number and its file's head; a bad file is one range with its error."""
    plan: list[list] = []
    files: dict[str, list] = {}
    for r in sorted(ranges, key=lambda r: (r["file"], r["start"])):
        files.setdefault(r["file"], []).append(r)
    for file, parts in files.items():
        error = next((r["error"] for r in parts if r["error"]), None)
        if error:
            plan.append([file, 0, 0, 0, 0, None, error])
            continue
        state = no = chars = 0
        for r in parts:
            plan.append([file, r["start"], r["stop"], chars if r["fixed"] else state, -(-chars // r["fixed"]) if r["fixed"] else no, parts[0]["head"], None])
            chars += r["n0"]
            no += r["n1"] if state else r["n0"]
            state = r["s1"] if state else r["s0"]
    return plan


def split_records(spark: SparkSession, path: str | list[str], cut: str, *, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """(file, start, no, value, _error): the records of files, or of those below folders, each read by several tasks.

    ``cut`` is ``lines``, ``quoted`` (delimited records, with ``delimiter``, ``quote``, ``header``), ``wrapped``,
    ``separator`` (with ``separator``), ``element`` (of XML, with ``tag``) or ``fixed`` (with ``length``, and ``least`` and
    ``width``: of records of ``least`` characters as many as ``width`` leave; each ``.gz`` file is unpacked by one task); ``encoding`` and ``glob`` go with all. ``no``
    numbers a file's records from 1, the header included; ``start`` is a record's first byte. With ``columns`` quoted
    records are parsed into these, by the names in the file's header or, without one, by place.

    Blank records are left out, but delimited ones without a header. A file that can't be opened or decoded is one row
    whose ``_error`` says so. Files in encodings that can't be cut by bytes are read by one task each. The driver holds
    a few numbers per range, as it holds a table's list of files.
    """
    spark.dataSource.register(RecordSource)
    given = {"cut": cut, "paths": json.dumps([path] if isinstance(path, str) else path), "range_bytes": str(range_bytes), **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}}
    source = lambda phase: spark.read.format("record_ranges").options(phase=phase, **given)
    ranges = [{**r.asDict(), "fixed": int(options["length"]) if cut == "fixed" else 0} for r in source("scan").load().collect()]
    read = source("read").option("plan", json.dumps(planned(ranges)))
    return (read.option("columns", json.dumps(columns)) if columns is not None else read).load()

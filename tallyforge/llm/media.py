"""Media columns: content-addressed payloads in tar shards; rows carry digest, shard, offset and length."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import shared_dir, table, without

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk: all that metadata columns need.
HEADER_BYTES = 33
BLOCK = 512
SHARD_BYTES = 64_000_000
OUT = ("digest", "shard", "offset", "length", "n_bytes", "width", "height", "bits")


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text with bytes 0 up to a positive multiple of ``WIDTH``, and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes((-len(raw)) % WIDTH or (0 if raw else WIDTH)), len(raw)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG, ``WIDTH`` samples a line, whose samples are the payload's bytes."""
    lines = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    head = struct.pack(">IIBBBBB", WIDTH, len(payload) // WIDTH, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` wrote; checks every chunk."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data = 8, b""
    while at < len(media):
        size = struct.unpack(">I", media[at : at + 4])[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum differs")
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = zlib.decompress(data)
    return b"".join(lines[i + 1 : i + 1 + WIDTH] for i in range(0, len(lines), WIDTH + 1))


def tar_header(name: str, size: int) -> bytes:
    """A ustar member header."""
    head = bytearray(BLOCK)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"%011o\0" % 0), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(value)] = value
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def filesystem(path: str):
    """The Arrow file system of a folder's URI, and the path in it."""
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


class Shard:
    """A tar file under construction; members are named by digest and written once each."""

    def __init__(self, folder: str) -> None:
        self.name = f"{uuid.uuid4().hex}.tar"
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/{self.name}"
        self.out, self.at, self.members = self.fs.open_output_stream(self.path), 0, {}

    def add(self, payload: bytes) -> tuple[str, int, int]:
        """(digest of the media, offset, length) of the payload's media, which is stored if it is new here."""
        own = hashlib.sha256(payload).digest()
        if own not in self.members:
            media = to_png(payload)
            digest = hashlib.sha256(media).hexdigest()
            self.out.write(tar_header(digest, len(media)))
            self.out.write(media)
            self.out.write(bytes(-len(media) % BLOCK))
            self.members[own] = (digest, self.at + BLOCK, len(media))
            self.at += BLOCK + len(media) + (-len(media) % BLOCK)
        return self.members[own]

    def close(self) -> None:
        self.out.write(bytes(2 * BLOCK))
        self.out.close()


def writer(folder: str):
    """A mapInArrow function: (..., text) to (..., digest, shard, offset, length, n_bytes).

    Each task writes shards of its own under fresh names, so an attempt that is lost or repeated leaves shards that no
    row names, and never touches those of another.
    """

    def run(batches):
        import pyarrow as pa

        shard = None
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1):
                payload, size = padded(text.as_py())
                if shard and shard.at > SHARD_BYTES:
                    shard.close()
                    shard = None
                shard = shard or Shard(folder)
                digest, offset, length = shard.add(payload)
                rows.append((digest, shard.name, offset, length, size))
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "digest", "shard", "offset", "length", "n_bytes"])
        if shard:
            shard.close()

    return run


class Ranges:
    """Range reads from shards; the last shard stays open."""

    def __init__(self, folder: str) -> None:
        self.fs, self.base = filesystem(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.name, self.file = shard, self.fs.open_input_file(f"{self.base}/{shard}")
        self.file.seek(offset)
        return self.file.read(length)


def header_reader(folder: str):
    """A mapInArrow function that adds width, height and bits from the first ``HEADER_BYTES`` of each row's media."""

    def run(batches):
        import pyarrow as pa

        ranges = Ranges(folder)
        for batch in batches:
            names = batch.schema.names
            got = []
            for shard, offset in zip(batch.column(names.index("shard")).to_pylist(), batch.column(names.index("offset")).to_pylist(), strict=True):
                head = ranges.read(shard, offset, HEADER_BYTES)
                if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
                    raise ValueError(f"no media at {shard}:{offset}")
                got.append(struct.unpack(">IIB", head[16:25]))
            columns = [pa.array([g[j] for g in got], pa.int32()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, "width", "height", "bits"])

    return run


def fields_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def store_media(spark: SparkSession, docs: DataFrame, *, folder: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Stores every text as media; returns ``docs`` without the text, with ``OUT``, and the folder of the shards.

    The text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64, become the samples of an 8-bit grey PNG,
    stored once per shard under its digest in a tar file. The index is written as a table before it is used, so a
    later read sees the shards of the attempts that won. Metadata columns come from header-only range reads.

    A null text counts as empty; equal texts have equal digests. Rows are independent; an empty table gives no shards.
    Shards go to ``folder``, by default a new one in the shared folder. Input columns named like an output column are
    replaced. ``keep`` names the columns to return besides (default: all but the text).
    """
    folder = folder or f"{shared_dir(spark)}/media/{uuid.uuid4().hex}"
    docs = without(docs, [c for c in OUT if c != text_col])
    names = [c for c in docs.columns if c != text_col] if keep is None else keep
    rows = docs.select(*names, F.col(text_col).alias("__text"))
    index = rows.mapInArrow(writer(folder), f"{fields_of(rows.drop('__text'))}{', ' if names else ''}digest string, shard string, offset long, length long, n_bytes long")
    index = table(spark, index, "media-index")
    return index.mapInArrow(header_reader(folder), fields_of(index) + ", width int, height int, bits int"), folder


def feature_reader(folder: str):
    """A mapInArrow function over the index that reads each payload back and computes features of its samples."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ranges, memory = Ranges(folder), (None, None)
        for batch in batches:
            names = batch.schema.names
            place = [batch.column(names.index(c)).to_pylist() for c in ("shard", "offset", "length", "digest")]
            got = []
            for shard, offset, length, digest in zip(*place, strict=True):
                if memory[0] != digest:
                    media = ranges.read(shard, offset, length)
                    if hashlib.sha256(media).hexdigest() != digest:
                        raise ValueError(f"{shard}:{offset} doesn't hold {digest}")
                    payload = from_png(media)
                    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                    share = counts[counts > 0] / len(payload)
                    feature = f"png:{WIDTH}x{len(payload) // WIDTH}:8:mean={counts @ np.arange(256) / len(payload):.4f}:bits={-(share @ np.log2(share)) + 0.0:.4f}:zero={counts[0]}"
                    memory = (digest, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), digest, feature))
                got.append(memory[1])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([g[j] for g in got], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return run


def media_features(index: DataFrame, folder: str) -> DataFrame:
    """The index with sizes, digests and a feature string of the payloads as read back from the shards."""
    return index.mapInArrow(feature_reader(folder), fields_of(index) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index, folder = store_media(spark, docs)
    read = media_features(index, folder)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")

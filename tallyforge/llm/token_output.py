"""Token ids as directly addressable codes: chunk levels with continuation bitmaps and rank directories, in shards."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import chunks, shared_dir, table
from tallyforge.llm.media import filesystem

MAGIC = b"TKDAC001"
#: Bits that share an entry of a rank directory.
BLOCK = 512
#: A shard is closed once it holds so many ids.
SHARD_IDS = 16_000_000
#: Ids decoded at once when a shard is read through.
WINDOW_IDS = 1_000_000
#: Distinct pieces whose ids a worker remembers; others are encoded anew in each chunk of texts.
PIECES = 1_000_000
#: White space before a space or line break: there the piece before can't be cut off (see ``pieces``).
WIDE = re.compile(r"\s[ \n]")
EDGE = re.compile(r"(?<=\S)(?=[ \n])")
#: A piece that can stand on a line of its own.
LINE = re.compile(r" ?\S+")
OUT = ("start", "n_tokens", "ids_crc32")


class Levels:
    """Ids split into 8-bit chunks, lowest first; a bit of each chunk tells whether the id goes on in the next level.

    Level l holds one entry for every id that has more than l chunks, in the ids' order, so the entry of an id in level
    l + 1 is the number of bits set before its entry in level l.
    """

    def __init__(self) -> None:
        self.n, self.chunks, self.more = 0, [], []

    def add(self, ids) -> None:
        import numpy as np

        self.n += len(ids)
        rest, level = np.asarray(ids, np.uint32), 0
        while len(rest):
            if level == len(self.chunks):
                self.chunks.append([])
                self.more.append([])
            more = rest > 0xFF
            self.chunks[level].append((rest & 0xFF).astype(np.uint8))
            self.more[level].append(more)
            rest, level = rest[more] >> 8, level + 1

    def sections(self):
        """(name, bytes) of each level: chunks, bitmap and rank directory (bits set before each block)."""
        import numpy as np

        for level, (parts, more) in enumerate(zip(self.chunks, self.more, strict=True)):
            yield f"chunks{level}", np.concatenate(parts).tobytes()
            bits = np.concatenate(more)
            yield f"bits{level}", np.packbits(bits, bitorder="little").tobytes()
            ends = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.uint64)
            yield f"ranks{level}", np.concatenate((np.zeros(1, np.uint64), np.cumsum(ends)[:-1])).astype("<u8").tobytes()


class ShardWriter:
    """A shard under construction: the documents' ids, then sections and a footer that names their places."""

    def __init__(self, folder: str) -> None:
        self.fs, self.base = filesystem(folder)
        self.name = f"{uuid.uuid4().hex}.dac"
        self.levels, self.keys, self.sizes = Levels(), [], []

    def add(self, keys, sizes, ids) -> None:
        """Documents' keys (an Arrow array), their numbers of ids, and these ids end to end."""
        self.keys.append(keys)
        self.sizes.append(sizes)
        self.levels.add(ids)

    def close(self) -> tuple[str, int, int]:
        """Writes the file; (name, documents, ids)."""
        import numpy as np
        import pyarrow as pa

        sizes = np.concatenate(self.sizes)
        sink = pa.BufferOutputStream()
        column = pa.chunked_array(self.keys)
        with pa.ipc.new_stream(sink, pa.schema([("key", column.type)])) as out:
            out.write_table(pa.table({"key": column}))
        self.fs.create_dir(self.base, recursive=True)
        places, at = {}, len(MAGIC)
        with self.fs.open_output_stream(f"{self.base}/{self.name}") as file:
            file.write(MAGIC)
            ends = np.cumsum(sizes).astype("<u8").tobytes()
            for name, body in (*self.levels.sections(), ("ends", ends), ("keys", sink.getvalue().to_pybytes())):
                file.write(body)
                places[name] = [at, len(body)]
                at += len(body)
            footer = json.dumps({"docs": len(sizes), "ids": self.levels.n, "levels": len(self.levels.chunks), "places": places}).encode()
            file.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        return self.name, len(sizes), self.levels.n


class Shard:
    """Random access to a shard by range reads: ``token`` reads a few bytes of each level, ``ids`` a slice of each."""

    def __init__(self, folder: str, name: str) -> None:
        fs, base = filesystem(folder)
        path = f"{base}/{name}"
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.read(size - 16, 16) if size >= 24 else b""
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        length = int.from_bytes(tail[:8], "little")
        footer = json.loads(self.read(size - 16 - length, length))
        self.docs, self.n, self.levels, self.places = footer["docs"], footer["ids"], footer["levels"], footer["places"]

    def read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def part(self, name: str, start: int, stop: int, width: int = 1):
        """Entries [start, stop) of a section of entries ``width`` bytes wide."""
        import numpy as np

        body = self.read(self.places[name][0] + start * width, (stop - start) * width)
        return np.frombuffer(body, np.uint8 if width == 1 else "<u8")

    def bits(self, level: int, start: int, stop: int):
        import numpy as np

        first = start // 8
        packed = self.part(f"bits{level}", first, (stop + 7) // 8)
        return np.unpackbits(packed, bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)

    def rank(self, level: int, at: int) -> int:
        """Bits set before entry ``at`` of a level."""
        block = at // BLOCK
        return int(self.part(f"ranks{level}", block, block + 1, 8)[0]) + int(self.bits(level, block * BLOCK, at).sum())

    def ids(self, start: int, stop: int):
        """Ids [start, stop) of the shard."""
        import numpy as np

        if not 0 <= start <= stop <= self.n:
            raise IndexError(f"[{start}, {stop}) of {self.n} ids")
        out = np.zeros(stop - start, np.uint32)
        where, level, count = None, 0, stop - start
        while count:
            chunk = self.part(f"chunks{level}", start, start + count).astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= chunk
            else:
                out[where] |= chunk
            more = self.bits(level, start, start + count)
            where = np.flatnonzero(more) if where is None else where[more]
            if level + 1 < self.levels:
                start = self.rank(level, start)
            level, count = level + 1, len(where)
        return out

    def token(self, at: int) -> int:
        """One id, without decoding its neighbours."""
        return int(self.ids(at, at + 1)[0])

    def ends(self, start: int, stop: int):
        """Ids up to the end of each of the documents [start, stop)."""
        return self.part("ends", start, stop, 8).astype("int64")

    def keys(self):
        """The documents' keys, in order."""
        import pyarrow as pa

        at, length = self.places["keys"]
        return pa.ipc.open_stream(self.read(at, length)).read_all().column("key").combine_chunks()

    def close(self) -> None:
        self.file.close()


def pieces(text: str) -> list[str]:
    """Cuts a text before spaces and line breaks such that encoding the pieces gives the same ids as encoding the text.

    The tokenizer's pattern makes a token of white space and what follows, or of a run of one class; none holds white space
    after something else, and only a run of white space looks ahead. So before each space or
    line break that follows another character than white space a new token begins, whatever stands on either side.
    """
    if WIDE.search(text) is None:
        first, *rest = text.replace("\n", " \n").split(" ") if "\n" in text[1:] else text.split(" ")
        return [first, *[p if p[:1] == "\n" else " " + p for p in rest]]
    return EDGE.split(text)


class Codes(dict):
    """Numbers pieces in order of appearance."""

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        return at


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, which sees each distinct piece once while it is remembered."""

    def __init__(self, spec: str) -> None:
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        known = json.loads(spec)
        cut = known.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        #: Only of byte-level tokens without normaliser is it known that texts can be cut before spaces.
        self.pieces = pieces if plain and not known.get("normalizer") else lambda text: [text]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if plain and len(line) == 1 else None
        self.forget(np)

    def forget(self, np) -> None:
        self.codes, self.sizes, self.flat = Codes(), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        import numpy as np

        # pieces on lines of their own are encoded as one text: a line break after a word is a token by itself
        simple = [self.line is not None and LINE.fullmatch(p) is not None for p in new]
        parts = [np.zeros(0, np.uint32)]
        together = [p for p, ok in zip(new, simple, strict=True) if ok]
        sizes = np.zeros(len(new), np.int64)
        if together:
            lines = self.tokenizer.encode_batch_fast(["\n".join(together) + "\n"], add_special_tokens=False)[0]
            ids = np.array(lines.ids, np.uint32)
            ends = np.flatnonzero(ids == self.line)
            sizes[np.flatnonzero(simple)] = np.diff(ends, prepend=-1) - 1
            parts.append(np.delete(ids, ends))
        others = self.tokenizer.encode_batch_fast([p for p, ok in zip(new, simple, strict=True) if not ok], add_special_tokens=False)
        sizes[~np.array(simple, bool)] = [len(e.ids) for e in others]
        parts += [np.array(e.ids, np.uint32) for e in others]
        # places of the pieces' ids, in the order in which they were encoded
        order = np.concatenate((np.flatnonzero(simple), np.flatnonzero(~np.array(simple, bool))))
        starts = np.empty(len(new), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order] + len(self.flat)
        self.sizes, self.starts = np.concatenate((self.sizes, sizes)), np.concatenate((self.starts, starts))
        self.flat = np.concatenate((self.flat, *parts))

    def encode(self, texts: list[str], end_id: int):
        """(sizes, ids): of each text all its ids and ``end_id``, end to end."""
        import numpy as np

        known = len(self.codes)
        if known > PIECES:
            self.forget(np)
            known = 0
        number = self.codes.__getitem__
        rows = [np.fromiter(map(number, parts), np.int64, len(parts)) for parts in map(self.pieces, texts)]
        if len(self.codes) > known:
            self.learn(list(islice(self.codes, known, None)))
        of = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        sizes = self.sizes[of]
        last = np.cumsum([len(r) for r in rows]) - 1  # every text has a piece, an empty one the empty piece
        sizes[last] += 1
        total = int(sizes.sum())
        begin = np.cumsum(sizes) - sizes
        at = np.arange(total) + np.repeat(self.starts[of] - begin, sizes)
        ends = begin[last] + sizes[last] - 1
        at[ends] = 0
        ids = self.flat[at] if len(self.flat) else np.zeros(total, np.uint32)
        ids[ends] = end_id
        return np.diff(ends, prepend=-1), ids


@lru_cache(1)
def encoder_of(spec: str) -> Encoder:
    """The process's encoder: what it remembers serves all tasks."""
    return Encoder(spec)


def writer(folder: str, spec, end_id: int, shard_ids: int):
    """A mapInArrow function: (key, text) in order to one row a shard: (shard, docs, ids).

    Shards get fresh names, so an attempt that is lost or repeated leaves shards that no row names.
    """

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        encoder, shard = encoder_of(spec.value), None
        schema = pa.schema([("shard", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
        row = lambda s: pa.RecordBatch.from_pylist([dict(zip(schema.names, s.close(), strict=True))], schema)
        for batch in batches:
            for start, stop in chunks(batch.column(1), min(1_000_000, shard_ids)):
                part = batch.slice(start, stop - start)
                sizes, ids = encoder.encode([t or "" for t in part.column(1).to_pylist()], end_id)
                shard = shard or ShardWriter(folder)
                shard.add(part.column(0), sizes, ids)
                if shard.levels.n >= shard_ids:
                    yield row(shard)
                    shard = None
        if shard:
            yield row(shard)

    return run


def write_tokens(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    *,
    end_id: int = 0,
    folder: str | None = None,
    shard_ids: int = SHARD_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, str]:
    """Encodes every text and writes all ids to shards in ascending order of ids of rows; returns (manifest, folder).

    ``tokenizer`` is the text of a tokenizers JSON file; it is broadcast, so executors need no such file. Each text's
    ids are followed by ``end_id``. Rows are dealt by ranges of (id, text hash, row number) and sorted within; each task
    writes shards of about ``shard_ids`` ids. The manifest has a row a shard: shard, docs, ids, base (ids of all shards
    before it), stored before it is used, so it names the shards of the attempts that won.

    Rows with a null id come first, rows of equal id stand by the hash of their text; equal rows are told apart by
    their place in the input alone, so ranges split them, however many there are. Null texts are empty. One text is
    encoded at once: a worker needs about 100 bytes for each of its ids. An empty table gives an empty manifest. Other
    columns are left out, whatever their names.
    """
    folder = folder or f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    spec = spark.sparkContext.broadcast(tokenizer)
    order = [F.col("__key").asc_nulls_first(), F.col("__hash"), F.col("__row")]
    rows = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__key", "__text")
    shards = rows.mapInArrow(writer(folder, spec, end_id, shard_ids), "shard string, docs long, ids long")
    # ids of rows rise with the partition, then with the row in it, as ranges and shards do
    shards = table(spark, shards.withColumn("no", F.monotonically_increasing_id()), "token-shards")
    task = F.shiftright("no", 33)
    tasks = shards.groupBy(task.alias("task")).agg(F.sum("ids").alias("of_task"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("of_task").over(before.orderBy("task")), F.lit(0)).alias("before_task"))  # a row a task
    within = F.coalesce(F.sum("ids").over(before.partitionBy("task").orderBy("no")), F.lit(0))
    manifest = shards.withColumn("task", task).withColumn("within", within).join(tasks, "task")
    return manifest.select("shard", "docs", "ids", (F.col("before_task") + F.col("within")).alias("base")), folder


def reader(folder: str, with_ids: bool):
    """A mapInArrow function: (shard, base) to one row a document, read back in windows of ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name)
                keys, ends, at = shard.keys(), shard.ends(0, shard.docs), 0
                while at < shard.docs:
                    begin = int(ends[at - 1]) if at else 0
                    stop = max(at + 1, int(np.searchsorted(ends, begin + WINDOW_IDS, side="right")))
                    found = shard.ids(begin, int(ends[stop - 1])).astype("<u4")
                    cuts = np.concatenate(([0], ends[at:stop] - begin))
                    raw = memoryview(found.tobytes())
                    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    columns = [keys.slice(at, stop - at), pa.array(base + begin + cuts[:-1], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(sums, pa.int64())]
                    names = ["key", *OUT]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    at = stop
                shard.close()

    return run


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str, key_type: str = "long", *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row a document from the shards: the id column, start, n_tokens, ids_crc32, and with ``with_ids`` the ids.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is of the ids as little-endian 32-bit integers.
    """
    spread = min(max(1, manifest.count()), 4 * spark.sparkContext.defaultParallelism)
    rows = manifest.select("shard", "base").repartition(spread, "shard")
    read = rows.mapInArrow(reader(folder, with_ids), f"key {key_type}, start long, n_tokens long, ids_crc32 long{', ids array<int>' if with_ids else ''}")
    return read.withColumnRenamed("key", id_col)


def op13_token_output(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with open(tokenizer_file, encoding="utf-8") as file:
        manifest, folder = write_tokens(spark, docs, file.read())
    return read_tokens(spark, manifest, folder, docs.schema["doc_id"].dataType.simpleString()).select("doc_id", "start", "n_tokens", "ids_crc32")

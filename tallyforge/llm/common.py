"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A side of at most so many bytes, by its counted rows, is broadcast; beyond it is shuffled.
BROADCAST_BYTES = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A local session without that setting (a test) gets a folder of its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(own)
    return own


def table(spark: SparkSession, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    With ``rows``, a bound of its rows, the write has a task for every 10,000 of them, but one per core at least,
    instead of one for every shuffle partition.
    """
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // 10_000))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(spark: SparkSession, left: DataFrame, right: DataFrame, on, how: str, width: int = 64) -> DataFrame:
    """Join with ``right``, a stored table of about ``width`` bytes a row, which is broadcast if its counted rows allow it."""
    return left.join(F.broadcast(right) if right.count() * width <= BROADCAST_BYTES else right, on, how)


def text_rows(docs: DataFrame, names: Sequence[str], text_col: str) -> tuple[DataFrame, int, str]:
    """(rows, place, schema): ``names`` of ``docs`` with the text once, its place, and the DDL of ``names``.

    A text that isn't among ``names`` comes last, as __text; functions over these rows return the first len(names) columns.
    """
    rows = docs.select(*[F.col(f"`{n}`") for n in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    if text_col in names:
        return rows, list(names).index(text_col), schema
    return docs.select(*[F.col(f"`{n}`") for n in names], F.col(text_col).alias("__text")), len(names), schema


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop input columns whose names an operator is about to write."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def held_in(id_col: str, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``rest``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == rest


def mix64(x):
    """A 64-bit finaliser over a numpy uint64 array (wraps on purpose)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column, most_bytes: int = 250_000):
    """Slices (start, stop) of an Arrow string column of about ``most_bytes`` of text each; a longer text is alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


class Words:
    """Word hashes of a chunk of texts.

    ``doc`` is the row of each word, ``hash`` its 64-bit hash; ``data``, ``start`` and ``end`` give its bytes.
    A word is a run of bytes other than ASCII white space; with ``letters``, of ASCII letters and digits and bytes
    beyond ASCII.
    """

    def __init__(self, texts, letters: bool = False) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        self.n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.data, self.at = raw, at - at[0]
        inside = self.letters()[raw] if letters else ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        first = np.zeros(len(raw) + 1, bool)  # words never run across two texts
        first[self.at] = True
        before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.concatenate((inside[1:], [False])) if len(raw) else inside
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.doc = np.searchsorted(self.at, self.start, side="right") - 1

    @cached_property
    def spans(self):
        return Spans(self.data)

    @cached_property
    def hash(self):
        return self.spans.hashes(self.start, self.end)

    @staticmethod
    def letters():
        """Which of the 256 bytes belong to words of letters."""
        import numpy as np

        b = np.arange(256)
        return ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)

    def ngrams(self, k: int):
        """(doc, hash) of each run of k words; a text of fewer words, but not none, has one run of all of them."""
        import numpy as np

        n = len(self.hash)
        with np.errstate(over="ignore"):
            if n >= k:
                keep = self.doc[: n - k + 1] == self.doc[k - 1 :]
                h = np.zeros(n - k + 1, np.uint64)
                for j in range(k):
                    h = mix64(h + self.hash[j : n - k + 1 + j] + np.uint64(j + 1))
                doc, h = self.doc[: n - k + 1][keep], h[keep]
            else:
                doc, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            count = np.bincount(self.doc, minlength=self.n)
            short = np.flatnonzero((count > 0) & (count < k))
            if len(short):
                begin = np.searchsorted(self.doc, short)
                extra = np.zeros(len(short), np.uint64)
                for j in range(k - 1):
                    on = count[short] > j
                    extra[on] = mix64(extra[on] + self.hash[begin[on] + j] + np.uint64(j + 101))
                doc, h = np.concatenate((doc, short)), np.concatenate((h, extra))
        return doc, h


def powers(n: int):
    """(powers of an odd base, powers of its inverse) modulo 2**64, ``n`` of each at least."""
    size = max(1 << 12, 1 << (n - 1).bit_length())
    return kept_powers(size) if size <= 1 << 20 else made_powers(size)


def made_powers(n: int):
    import numpy as np

    base = 0x5851F42D4C957F2D
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        run = np.full(n, np.uint64(x))
        run[0] = 1
        both.append(np.multiply.accumulate(run))
    return both


kept_powers = lru_cache(4)(made_powers)


class Spans:
    """64-bit hashes of byte spans of an array, by prefix sums of a polynomial in an odd base."""

    def __init__(self, raw) -> None:
        import numpy as np

        with np.errstate(over="ignore"):
            codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            up, self.undo = powers(len(raw) + 1)
            self.sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(codes[raw] * up[: len(raw)], out=self.sums[1:])

    def hashes(self, start, end):
        """Hashes of the spans [start, end)."""
        import numpy as np

        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.undo[start] + (end - start).astype(np.uint64))

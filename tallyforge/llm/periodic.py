"""Periodic runs of words by recompression: a run-length grammar answers exact extensions of candidates on harmonic grids."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import chunks, text_rows

#: A run is at least so many words long, and at least so many times its period.
LEAST, TIMES = 6, 4
#: Candidates that are extended at once.
TOGETHER = 200_000
OUT = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed", "runs")


def named(keys):
    """Numbers of equal keys: (number of each entry, how many)."""
    import numpy as np

    found, name = np.unique(keys, return_inverse=True)
    return name.astype(np.int64), len(found)


class Level:
    """A string of symbols and how the next level groups it.

    ``symbol`` are the symbols; ``first`` the first child of each symbol of the next level, ``up`` the next level's
    symbol that each belongs to. ``blocks``: the groups are maximal blocks of one symbol; else pairs or single symbols.
    """

    def __init__(self, symbol, head, blocks: bool) -> None:
        import numpy as np

        self.symbol, self.head, self.blocks = symbol, head, blocks
        self.first = np.flatnonzero(head)
        self.up = np.cumsum(head) - 1
        self.size = np.diff(self.first, append=len(symbol))

    def mirrored(self) -> Level:
        """The same level of the reversed string: groups read from their other ends."""
        import numpy as np

        last = np.append(self.head[1:], True)[::-1]
        return Level(self.symbol[::-1], last, self.blocks)


class Grammar:
    """The run-length grammar of a string that recompression builds, kept as its levels.

    Block compression replaces each maximal block of a symbol by one symbol; pair compression deals the symbols into two
    classes and replaces each pair of a left and a right one. Both look at neighbours alone, so equal substrings are
    grouped alike but for their ends. They alternate until no symbol occurs twice: no comparison goes further up.
    """

    def __init__(self, symbols) -> None:
        import numpy as np

        self.levels: list[Level] = []
        symbol, n = named(np.asarray(symbols, np.int64))
        salt = 0
        while n < len(symbol):
            other = np.concatenate(([True], symbol[1:] != symbol[:-1]))
            if not other.all():
                level = Level(symbol, other, True)
                symbol, n = named(symbol[level.first] * (len(symbol) + 1) + level.size)
                self.levels.append(level)
                continue
            pairs = np.zeros(len(symbol), bool)
            while not pairs.any():  # two neighbours differ, so some split tells them apart
                salt += 1
                left = self.side(n, salt)[symbol]
                forth, back = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
                pairs[1:] = forth if forth.sum() >= back.sum() else back
            level = Level(symbol, ~pairs, False)
            second = np.where(level.size == 2, symbol[np.minimum(level.first + 1, len(symbol) - 1)] + 1, 0)
            symbol, n = named(symbol[level.first] * (n + 1) + second)
            self.levels.append(level)
        self.top = symbol

    @staticmethod
    def side(n: int, salt: int):
        """A bit for each of n symbols."""
        import numpy as np

        with np.errstate(over="ignore"):
            x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(63)).astype(bool)

    def mirrored(self) -> Grammar:
        own = object.__new__(Grammar)
        own.levels, own.top = [level.mirrored() for level in self.levels], self.top[::-1]
        return own

    def extensions(self, a, b):
        """For each pair of different places, how far the string reads the same from both.

        The string must end in a symbol that occurs once, which stops every comparison. A query climbs while both
        places start groups, after at most one step over equal symbols (or over what is left of equal blocks) on each
        level; where the symbols differ it comes down again, stepping over the equal children before the difference.
        """
        import numpy as np

        begin = np.asarray(a, np.int64)
        a, b = begin.copy(), np.array(b, np.int64)
        stop = np.full(len(a), len(self.levels))
        live = np.arange(len(a))
        for at, level in enumerate(self.levels):
            if not len(live):
                break
            x, y = a[live], b[live]
            same = level.symbol[x] == level.symbol[y]
            inside = same & ~(level.head[x] & level.head[y])
            if inside.any():
                x, y = x.copy(), y.copy()
                if level.blocks:
                    left = lambda v: level.first[level.up[v]] + level.size[level.up[v]] - v
                    rx, ry = left(x[inside]), left(y[inside])
                    step, even = np.minimum(rx, ry), rx == ry
                else:
                    step, even = 1, True
                x[inside] += step
                y[inside] += step
                a[live], b[live] = x, y
                even = even & level.head[x[inside]] & level.head[y[inside]]
                same[inside] = even
            stop[live[~same]] = at
            live = live[same]
            a[live], b[live] = level.up[a[live]], level.up[b[live]]
        for at in range(len(self.levels) - 1, -1, -1):
            level = self.levels[at]
            down = np.flatnonzero(stop > at)
            x, y = a[down], b[down]
            lx, ly = level.size[x], level.size[y]
            x, y = level.first[x], level.first[y]
            step = np.where(level.symbol[x] == level.symbol[y], np.minimum(lx, ly) if level.blocks else 1, 0)
            a[down], b[down] = x + step, y + step
        return a - begin


def grid(n: int, longest: int, symbols):
    """Chunks of candidates (place, period): equal words ``period`` apart, on a grid for each period.

    A run of period p has at least max(6, 4p) words, so max(6, 4p) - p places in a row whose word recurs p words on:
    one of them is on a grid of that spacing. The grids of all periods have about n ln(n) / 3 places.
    """
    import numpy as np

    period = np.arange(1, longest // TIMES + 1)
    spacing = np.maximum(LEAST, TIMES * period) - period
    counts = np.maximum(0, -(-(n - period) // spacing))
    sums, start = np.cumsum(counts), 0
    while start < len(period):
        done = sums[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sums, done + 5 * TOGETHER, side="right")))
        part = counts[start:stop]
        p = np.repeat(period[start:stop], part)
        at = (np.arange(len(p)) - np.repeat(np.cumsum(part) - part, part)) * np.repeat(spacing[start:stop], part)
        keep = symbols[at] == symbols[at + p]
        at, p = at[keep], p[keep]
        for i in range(0, len(p), TOGETHER):
            yield at[i : i + TOGETHER], p[i : i + TOGETHER]
        start = stop


def runs_of(symbols, longest: int):
    """All runs of a string as (start, length, period), by start and period; ``longest`` bounds a run's length.

    The string must end in a symbol that occurs once. A run is a stretch with smallest period q of at least
    max(6, 4q) symbols that can't be extended. A stretch found with several periods has the least of them, since of two
    periods within half of its length the smaller divides the other.
    """
    import numpy as np

    symbols = np.asarray(symbols, np.int64)
    n, found = len(symbols), [np.zeros((0, 3), np.int64)]
    grammar = mirror = None
    for at, p in grid(n, longest, symbols):
        if grammar is None:
            # a symbol of its own in front stops comparisons to the left
            grammar = Grammar(np.concatenate(([symbols.max() + 1], symbols)))
            mirror = grammar.mirrored()
        forth = grammar.extensions(at + 1, at + p + 1)
        back = mirror.extensions(n - at, n - at - p)  # from the places before
        start, stop = at - back, at + p + forth
        keep = stop - start >= np.maximum(LEAST, TIMES * p)
        if keep.any():
            found.append(np.unique(np.stack((start[keep], (stop - start)[keep], p[keep]), 1), axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def planted(words: list, key: str | None) -> list:
    """The words, of every tenth key with a stretch that repeats from some place on; a null key changes nothing."""
    h, n = zlib.crc32((key or "").encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * ((n - a) // p + 1))[: n - a]


def analysed(texts: list[list[bytes]]):
    """(runs, collapsed) of each list of words: a word goes if a run contains it after that run's first period."""
    import numpy as np

    number: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.empty(int((sizes + 1).sum()), np.int64)
    for at, words in zip(begin, texts, strict=True):
        symbols[at : at + len(words)] = [number.setdefault(w, len(number)) for w in words]
    symbols[begin + sizes] = len(number) + np.arange(len(texts))  # every text ends in a symbol of its own
    every = runs_of(symbols, int(sizes.max(initial=0)))
    of = np.searchsorted(begin, every[:, 0], side="right") - 1
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    for i, words in enumerate(texts):
        runs = every[cut[i] : cut[i + 1]] - [begin[i], 0, 0]
        if len(runs):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
            words = [w for w, inside in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not inside]
        yield runs, b" ".join(words)


def worker(n_out: int, text_at: int, key_at: int | None, texts: bool):
    """A mapInArrow function that adds the columns of ``OUT``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start, stop in chunks(batch.column(text_at)):
                part = batch.slice(start, stop - start)
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column(text_at).to_pylist()]
                if key_at is not None:
                    keys = part.column(key_at).to_pylist()
                    words = [planted(w, None if k is None else str(k)) for w, k in zip(words, keys, strict=True)]
                rows = []
                for runs, collapsed in analysed(words):
                    best = [None] * 4
                    if len(runs):
                        s, length, p = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                        best = [s, length, p, 1000 * length // p]
                    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs.tolist())
                    row = [len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()]
                    rows.append(row + [collapsed.decode("utf-8", "surrogatepass"), runs.tolist()] if texts else row)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + ([pa.string(), pa.list_(pa.list_(pa.int64()))] if texts else [])
                columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_out], *columns], [*part.schema.names[:n_out], *OUT[: len(kinds)]])

    return run


def find_runs(docs: DataFrame, *, text_col: str = "text", plant_by: str | None = None, keep: list[str] | None = None, texts: bool = False) -> DataFrame:
    """``docs`` with n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256.

    Words are runs of other than ASCII white space. A run is a stretch of words with smallest period q, at least
    max(6, 4q) words long, that no neighbouring word extends; the longest is the first in ties, then that of least
    period. ``texts`` adds ``collapsed``, the text without the words that a run contains after its first period, and
    ``runs``, all of them as [start, length, period]. ``plant_by`` names a column by whose crc32 every tenth text gets a
    repeated stretch first. Columns named like an output column are replaced. ``keep`` names the columns to return
    besides (default: all).

    Rows are independent and nothing is shuffled; work grows with a text's words times their logarithm, memory with the
    longest text. Null and empty texts have no words: no run, four nulls, digests of nothing. Equal texts give equal
    rows unless planted apart; a null ``plant_by`` plants nothing. An empty table gives an empty result.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT or c in (text_col, plant_by)]
    rows, text_at, schema = text_rows(docs, names, text_col)
    key_at = None
    if plant_by is not None:
        rows, key_at = rows.withColumn("__plant", F.col(f"`{plant_by}`").cast("string")), len(rows.columns)
    added = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    added += ", collapsed string, runs array<array<long>>" if texts else ""
    return rows.mapInArrow(worker(len(names), text_at, key_at, texts), f"{schema}{', ' if names else ''}{added}")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_runs(docs, plant_by="doc_id", keep=["doc_id"])

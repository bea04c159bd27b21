"""Importance resampling towards a target: exact CRC buckets of word n-grams, a head-tail vocabulary, Gumbel top-k."""

from __future__ import annotations

import math
import uuid
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Words, chunks, table, without

BUCKETS = 10_000
#: Slots of the two head tables: frequent words and frequent pairs. They are broadcast, 20 and 12 bytes a slot.
WORD_SLOTS, PAIR_SLOTS = 1 << 16, 1 << 17
#: Words or pairs that make up a smaller share of a chunk of texts aren't reported as candidates of the head.
SHARE = 20_000
#: Frequent pairs are pairs of so many most frequent words at most.
PAIRED = 1 << 15
#: Bytes of text that are worked on at once; a longer text is cut between words.
PIECE = 1_000_000
#: Longest word of the head: its bytes fit one 64-bit key.
KEY_BYTES = 8
#: Words up to so many bytes are hashed in columns and shifted over by one table look-up.
SHORT = 64
OUT = ("n_features", "weight", "score", "rank")


@lru_cache(1)
def crc_table():
    """The 256 byte steps of CRC-32."""
    import numpy as np

    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def one_more(crc, byte):
    """CRC-32 of texts with one more byte each."""
    import numpy as np

    inner = ~crc
    return ~(crc_table()[(inner ^ byte) & np.uint32(0xFF)] ^ (inner >> np.uint32(8)))


@lru_cache(1)
def shifts():
    """[length][byte][value]: what a byte of a CRC becomes when as many bytes as ``length`` follow; then powers of two.

    The CRC of a text followed by another is the first's CRC, shifted over the second's length, xor the second's CRC.
    """
    import numpy as np

    t = crc_table()
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)

    def tables(images):
        """Byte tables of the linear map that takes bit i to images[i]."""
        out = np.zeros((4, 256), np.uint32)
        for i in range(32):
            on = (np.arange(256) >> (i % 8)) & 1 == 1
            out[i // 8][on] ^= images[i]
        return out

    def apply(tab, x):
        return tab[0][x & 255] ^ tab[1][(x >> 8) & 255] ^ tab[2][(x >> 16) & 255] ^ tab[3][x >> 24]

    small, images = [tables(bits)], bits
    for _ in range(SHORT):
        images = t[images & np.uint32(0xFF)] ^ (images >> np.uint32(8))
        small.append(tables(images))
    powers = [small[SHORT]]
    for _ in range(26):
        powers.append(tables(apply(powers[-1], apply(powers[-1], bits))))
    return np.stack(small).reshape(-1), np.stack(powers).reshape(-1)


def followed(crc, crc2, length):
    """CRC-32 of first texts followed by second ones of ``length`` bytes."""
    import numpy as np

    small, powers = shifts()

    def over(tab, at, x):
        at = at * 1024
        return tab[at + (x & 255)] ^ tab[at + 256 + ((x >> 8) & 255)] ^ tab[at + 512 + ((x >> 16) & 255)] ^ tab[at + 768 + (x >> 24)]

    out = over(small, length % SHORT, crc)
    for bit in range(int(length.max(initial=0) // SHORT).bit_length()):
        on = np.flatnonzero((length // SHORT) >> bit & 1)
        out[on] = over(powers, np.full(len(on), bit), out[on])
    return out ^ crc2


def direct(data, start, end):
    """CRC-32 of byte spans: short ones column by column, longer ones by one call each."""
    import numpy as np

    out, size = np.zeros(len(start), np.uint32), end - start
    order = np.argsort(-size, kind="stable")
    cut = int((size > SHORT).sum())
    for i in order[:cut]:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    order = order[cut:]
    left, begin = size[order], start[order]
    state = np.zeros(len(order), np.uint32)
    for column in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -column, side="left"))  # longest first: those that have a byte here
        state[:n] = one_more(state[:n], data[begin[:n] + column])
    out[order] = state
    return out


def keys_of(data, start, end):
    """The bytes of words of up to ``KEY_BYTES`` bytes as one number, exactly; 0 for longer ones."""
    import numpy as np

    size = end - start
    padded = np.concatenate((data, np.zeros(KEY_BYTES, np.uint8)))
    key = np.zeros(len(start), np.uint64)
    for i in range(KEY_BYTES):
        key |= np.where(i < size, padded[start + i], 0).astype(np.uint64) << np.uint64(8 * i)
    return np.where(size <= KEY_BYTES, key, np.uint64(0))


class Slots:
    """A broadcast table from 64-bit keys to rows, one probe a key; of keys that meet in a slot the first stays."""

    def __init__(self, keys, slots: int) -> None:
        import numpy as np

        self.bits = 64 - (slots.bit_length() - 1)
        keys = np.asarray(keys, np.uint64)
        slot = self.slot(keys)
        self.taken = np.unique(slot, return_index=True)[1] if len(keys) else np.zeros(0, np.int64)
        self.key, self.row = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.key[slot[self.taken]] = keys[self.taken]
        self.row[slot[self.taken]] = self.taken

    def slot(self, keys):
        import numpy as np

        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.bits)).astype(np.int64)

    def find(self, keys):
        """Row of each key, -1 for keys that aren't here."""
        import numpy as np

        slot = self.slot(keys)
        return np.where(self.key[slot] == keys, self.row[slot], -1)


class Vocabulary:
    """Head of the vocabulary: CRC states of frequent words, buckets of frequent pairs. All else is tail.

    What is in the head decides on speed alone: tail words take their CRC from their bytes, and a feature with one, or
    a pair or triple that the head doesn't hold, gets its exact CRC from the words' CRCs and lengths.
    """

    def __init__(self, word_keys, pair_keys, buckets: int = BUCKETS) -> None:
        import numpy as np

        word_keys = np.array(word_keys, np.int64).astype(np.uint64)
        raw = word_keys.astype("<u8").view(np.uint8).reshape(-1, KEY_BYTES)
        self.size = (raw != 0).sum(1)
        begin = np.arange(len(word_keys)) * KEY_BYTES
        self.crc = direct(raw.reshape(-1), begin, begin + self.size)
        self.words, self.buckets = Slots(word_keys, WORD_SLOTS), buckets
        pair_keys = np.array(pair_keys, np.int64).astype(np.uint64)
        one, two = (pair_keys >> np.uint64(32)).astype(np.int64), (pair_keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.pairs = Slots(pair_keys, PAIR_SLOTS)
        self.pair_crc = followed(one_more(self.crc[one], np.uint8(32)), self.crc[two], self.size[two])
        self.pair_bucket = (self.pair_crc % np.uint32(buckets)).astype(np.int32)


def lowered(data):
    """Bytes with A-Z as a-z."""
    import numpy as np

    return data + (((data >= 65) & (data <= 90)) * np.uint8(32))


class Features:
    """Buckets of all features of a chunk of texts: each is listed under the word that it ends with.

    ``doc`` and ``buckets`` go together; ``n_words`` counts per text.
    """

    def __init__(self, words: Words, head: Vocabulary) -> None:
        import numpy as np

        data, start, end, doc = lowered(words.data), words.start, words.end, words.doc
        key, size = keys_of(data, start, end), end - start
        row = head.words.find(key)
        crc = head.crc[row] if len(head.crc) else np.zeros(len(row), np.uint32)
        tail = np.flatnonzero(row < 0)
        crc[tail] = direct(data, start[tail], end[tail])
        mod = np.uint32(head.buckets)
        spaced = one_more(crc, np.uint8(32))
        pair = np.flatnonzero(doc[1:] == doc[:-1]) + 1 if len(doc) else np.zeros(0, np.int64)
        both = (row[pair - 1] >= 0) & (row[pair] >= 0)
        known = np.where(both, head.pairs.find(pair_key(row[pair - 1], row[pair])), -1)
        pair_crc = head.pair_crc[known] if len(head.pair_crc) else np.zeros(len(pair), np.uint32)
        pair_bucket = head.pair_bucket[known] if len(head.pair_crc) else np.zeros(len(pair), np.int32)
        new = np.flatnonzero(known < 0)
        pair_crc[new] = followed(spaced[pair[new] - 1], crc[pair[new]], size[pair[new]])
        pair_bucket[new] = pair_crc[new] % mod
        by_end = np.zeros(len(doc), np.uint32)
        by_end[pair] = pair_crc
        three = np.flatnonzero(doc[2:] == doc[:-2]) + 2 if len(doc) > 2 else np.zeros(0, np.int64)
        triple = followed(one_more(by_end[three - 1], np.uint8(32)), crc[three], size[three]) % mod
        self.n_words = np.bincount(doc, minlength=words.n)
        self.doc = np.concatenate((doc, doc[pair], doc[three]))
        self.end = np.concatenate((np.arange(len(doc)), pair, three))
        self.buckets = np.concatenate(((crc % mod).astype(np.int64), pair_bucket.astype(np.int64), triple.astype(np.int64)))


def pair_key(one, two):
    """Two rows of the head as one key, never 0."""
    import numpy as np

    return (one.astype(np.uint64) << np.uint64(32)) | two.astype(np.uint64)


def slices(column):
    """(rows of an Arrow column of texts, their texts, words of each to leave out) in chunks of about ``PIECE`` bytes.

    A longer text comes in pieces cut between words; each but the first begins with the two words before it, as runs
    of words may end in the piece that began there: these two are to be left out as ends of features.
    """
    import numpy as np
    import pyarrow as pa

    inside = Words.letters()
    for start, stop in chunks(column, PIECE):
        text = column[start].as_py() or ""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if stop - start == 1 else np.zeros(0, np.uint8)
        if len(raw) <= PIECE:
            yield np.arange(start, stop), column.slice(start, stop - start), np.zeros(stop - start, np.int64)
            continue
        letter = inside[raw]
        gaps, begins = np.flatnonzero(~letter), np.flatnonzero(letter & np.concatenate(([True], ~letter[:-1])))
        at = 0
        while at < len(raw):
            next_gap = int(np.searchsorted(gaps, at + PIECE))
            cut = int(gaps[next_gap]) if next_gap < len(gaps) else len(raw)
            before = min(2, int(np.searchsorted(begins, at)))
            back = int(begins[np.searchsorted(begins, at) - before]) if before else at
            yield np.array([start]), pa.array([raw[back:cut].tobytes().decode("utf-8", "surrogatepass")]), np.array([before])
            at = cut


def features(texts, skip, head: Vocabulary) -> Features:
    """Features of texts without those that end in one of the first ``skip`` words of their text."""
    import numpy as np

    words = Words(texts, letters=True)
    found = Features(words, head)
    if skip.any():
        first = np.searchsorted(words.doc, np.arange(words.n))
        new = found.end >= (first + skip)[found.doc]
        found.doc, found.buckets = found.doc[new], found.buckets[new]
        found.n_words = found.n_words - skip
    return found


def head_candidates(spec=None):
    """A mapInArrow function over (text): (key, n) of words or pairs that are frequent in a chunk of texts.

    What makes up a share of 1 / ``SHARE`` of all is as frequent in some chunk, so it is reported there.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        head = None if spec is None else head_of(spec)
        for batch in batches:
            for _, texts, _ in slices(batch.column(0)):
                words = Words(texts, letters=True)
                key = keys_of(lowered(words.data), words.start, words.end)
                if head is not None:
                    row = head.words.find(key)
                    pair = (words.doc[1:] == words.doc[:-1]) & (row[1:] >= 0) & (row[:-1] >= 0) & (np.maximum(row[1:], row[:-1]) < PAIRED)
                    key = pair_key(row[:-1][pair], row[1:][pair])
                else:
                    key = key[key != 0]
                found, n = np.unique(key, return_counts=True)
                keep = n * SHARE >= len(words.doc)
                yield pa.RecordBatch.from_arrays([pa.array(found[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))], ["key", "n"])

    return run


HEADS: dict[str, Vocabulary] = {}


def head_of(spec) -> Vocabulary:
    """The vocabulary of a broadcast (name, word keys, pair keys, buckets), made once a process; the last one is kept."""
    name, *rest = spec.value
    if name not in HEADS:
        HEADS.clear()
        HEADS[name] = Vocabulary(*rest)
    return HEADS[name]


def most_frequent(texts: DataFrame, most: int, spec=None) -> list[int]:
    """Keys of at most the ``most`` most frequent words, or with a head of words, of pairs of these."""
    found = texts.mapInArrow(head_candidates(spec), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return [r["key"] for r in found.orderBy(F.desc("n"), "key").limit(most).collect()]


def bucket_counts(texts: DataFrame, spec, buckets: int) -> list[int]:
    """Features of all texts per bucket, summed in each task first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        head, total = head_of(spec), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part, skip in slices(batch.column(0)):
                total += np.bincount(features(part, skip, head).buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = [0] * buckets
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * log of the smoothed share in the target by that in the source) of each bucket."""
    s_all, t_all, n = float(sum(source)), float(sum(target)), float(len(source))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target, strict=True)]


def weigher(spec, gain: list[int], n_out: int, text_at: int):
    """A mapInArrow function that adds n_words, n_features and weight to the first ``n_out`` columns."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        head, of = head_of(spec), np.array(gain, np.int64)
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for row, texts, skip in slices(batch.column(text_at)):
                found = features(texts, skip, head)
                order = np.argsort(found.doc, kind="stable")
                edges = np.searchsorted(found.doc[order], np.arange(len(row) + 1))
                total = np.concatenate(([0], np.cumsum(of[found.buckets[order]])))
                for target, add in zip(sums, (found.n_words, np.diff(edges), np.diff(total[edges])), strict=True):
                    target[row] += add
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_out], *map(pa.array, sums)], [*batch.schema.names[:n_out], "__words", "n_features", "weight"])

    return run


def gumbel(id_col: str, seed: str) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits of sha256 of '<seed>:<id>'."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_resample(
    spark: SparkSession,
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 5,
    least_words: int = 20,
    seed: str = "42",
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with n_features, weight, score and rank: which documents a sample towards ``target`` takes, in order.

    Features are all runs of one to three words, in buckets by their CRC-32; a bucket's gain is the log of its smoothed
    share in ``target`` by that in ``docs``, a document's weight the sum of its features' gains, its score that and a
    Gumbel number from its id, so the highest scores are a sample without replacement. Of the documents with at least
    ``least_words`` words, ``percent`` per cent are drawn, rounded down; ``rank`` counts them from 1, others have null.

    1. Words and pairs that are frequent in any chunk of texts are summed; the most frequent go into the head.
    2. Every task sums buckets over its texts; 10,000 sums at most reach the driver, which makes the gains.
    3. Every text is weighed; slim rows are sorted by ranges of (drawable, score, id), and a row's place in all is its
       place in its range and the sizes of the ranges before.

    Null and empty texts have no features, weight 0, and aren't drawn. A null id counts as the empty text in the Gumbel
    number and comes first among ties; rows of equal score and id stand in any order, so their ranks are shared out
    among equals (a row number splits them over ranges). No target, or no documents: gains of nothing, empty results.
    ``keep`` names the columns to return besides (default: all but the text); those named like an output column are
    replaced. A text of any length is worked on in pieces.
    """
    names = [c for c in without(docs, OUT).columns if c != text_col] if keep is None else list(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("__text"), *([] if id_col in names else [F.col(id_col).alias("__id")]))
    texts, wanted = docs.select(F.col(text_col).alias("text")), target.select(F.col(target_text_col).alias("text"))
    sc = spark.sparkContext
    both = texts.unionByName(wanted)
    head_words = most_frequent(both, WORD_SLOTS // 2)
    spec = sc.broadcast((uuid.uuid4().hex, head_words, [], buckets))
    pairs = most_frequent(both, PAIR_SLOTS // 2, spec)
    spec = sc.broadcast((uuid.uuid4().hex, head_words, pairs, buckets))
    gain = gains(bucket_counts(texts, spec, buckets), bucket_counts(wanted, spec, buckets))

    out = [*names, *([] if id_col in names else ["__id"])]
    rows = rows.select(*[F.col(f"`{c}`") for c in out], "__text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema.fields)
    weighed = rows.mapInArrow(weigher(spec, gain, len(out), len(out)), f"{schema}, __words long, n_features long, weight long")
    ident = id_col if id_col in names else "__id"
    scored = weighed.withColumn("score", F.col("weight") + gumbel(ident, seed)).withColumn("__row", F.monotonically_increasing_id())
    scored = table(spark, scored, "importance")
    drawable = F.col("__words") >= least_words
    counted = scored.agg(F.count_if(drawable)).first()[0]
    order = [drawable.desc(), F.col("score").desc(), F.col(ident).asc_nulls_first(), F.col("__row")]
    # the number of a sorted row holds its range and its place in it
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).drop("__row").withColumn("__no", F.monotonically_increasing_id())
    placed = table(spark, placed, "importance-order")
    ranges = placed.groupBy(F.shiftright("__no", 33).alias("__range")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # a row a range
    ranked = placed.withColumn("__range", F.shiftright("__no", 33)).join(F.broadcast(ranges), "__range")
    rank = F.col("__before") + F.col("__no").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = counted * percent // 100
    return ranked.select(*names, "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance_resample(spark, docs, target, keep=["doc_id"])


#: CRC-32 has no SQL function: it is a fold over half bytes, with the sixteen half-byte steps as a list.
OP11_SQL = r"""
WITH steps AS (SELECT list(s ORDER BY i) AS t FROM (
       SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS s FROM range(16) r(i))),
texts AS (SELECT true AS doc, doc_id, row_number() OVER () AS rid, text FROM documents UNION ALL SELECT false, NULL, row_number() OVER (), text FROM benchmark),
words AS (SELECT doc, doc_id, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS (SELECT doc, rid, array_to_string(list_slice(w, i, i + k - 1), ' ') AS f, count(*) AS n
          FROM (SELECT doc, rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 4) r(k)) GROUP BY ALL),
coded AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(h), 2), lambda i: [('0x' || h[i + 2])::BIGINT, ('0x' || h[i + 1])::BIGINT]))),
                 lambda c, b: xor(c >> 4, t[1 + (xor(c, b) & 15)])), 4294967295) % 10000 AS bucket
          FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feats)), steps),
placed AS (SELECT doc, rid, bucket, sum(n) AS n FROM feats JOIN coded USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (doc), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT doc), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sa + 10000) / ((s + 1) * (ta + 10000))))::BIGINT AS gain
          FROM sums, (SELECT sum(s) AS sa, sum(t) AS ta FROM sums)),
weights AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE doc GROUP BY rid),
scored AS (SELECT doc_id, rid, len(w) >= 20 AS able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM words LEFT JOIN weights USING (rid) WHERE doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id, rid) AS r, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 5 * n // 100 THEN r END AS rank FROM ranked
"""

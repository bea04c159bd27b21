"""Toxicity: a noisy-channel decoder restores disguised words under a character model, then the restored text is scored."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import Spans, Words, chunks, held_in, joined, mix64, table, text_rows, without

OUT = ("score", "predicted")
#: What a sign may stand for, besides itself.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
#: Tokens with more than one path through the lattice. A disguised word holds a letter and a sign, or is spelled out
#: with separators, or repeats a letter three times or more. Patterns begin where a run of their characters does, so
#: that a long run is read once.
SPACED = r"(?<![^\W_])(?:[a-z0-9@$!|+](?:[ ._\-*]{1,2})){2,}[a-z0-9@$!|+](?![^\W_])"
SIGNED = r"(?<![a-z])[a-z]++[0-9@$!|+(€*]++(?:[a-z][a-z0-9@$!|+(€*]*+)?|(?<![0-9@$!|+(€])[0-9@$!|+(€]++[a-z][a-z0-9@$!|+(€*]*+"
REPEATED = r"(?<![^\W\d_])(?=[^\W\d_]*?([a-z])\1\1)[^\W\d_]++"
DISGUISED = re.compile(f"{SPACED}|{SIGNED}|{REPEATED}")
ENDS = "0123456789@$!|+(€*"
ALPHABET = 30  # 0: anything but letters; 1-26: a-z; 27: letters beyond ASCII; 28: digits
BUCKETS = 1 << 18
#: Bytes of a word's prefixes; the last is the whole word, however long.
PREFIXES = (3, 4, 5, 6, 1 << 40)
#: Runs in scripts that put no spaces between words: they are cut into runs of three characters that overlap.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{4,}")
FEATURES = 7
#: Bytes of text that are worked on at once, about; a longer text is alone.
CHUNK = 500_000
#: Labelled rows that calibrate the score, at most.
SAMPLE = 20_000
#: Weight of the prior in a feature's log odds, in words.
PRIOR = 20.0


def symbol_table():
    import numpy as np

    t = np.zeros(256, np.int64)
    t[97:123] = np.arange(1, 27)
    t[65:91] = np.arange(1, 27)
    t[128:] = 27
    t[48:58] = 28
    return t


def trigram_counts(batches):
    """mapInArrow: (text) to (gram, n), the character trigrams of each batch; runs of bytes beyond ASCII count once each."""
    import numpy as np
    import pyarrow as pa

    table, total = symbol_table(), np.zeros(ALPHABET**3, np.int64)
    for batch in batches:
        for start, stop in chunks(batch.column(0)):
            words = Words(batch.column(0).slice(start, stop - start))
            s = table[words.data]
            if len(s) > 2:
                total += np.bincount((s[:-2] * ALPHABET + s[1:-1]) * ALPHABET + s[2:], minlength=ALPHABET**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])


def character_model(docs: DataFrame, text_col: str):
    """log P(third | two before) as an array, from the trigrams of all texts (at most ALPHABET**3 sums reach the driver)."""
    import numpy as np

    sums = docs.select(text_col).mapInArrow(trigram_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(ALPHABET**3)
    count[np.asarray(sums.column(0))] = np.asarray(sums.column(1))
    count = count.reshape(ALPHABET, ALPHABET, ALPHABET)
    two = count.sum(axis=0)  # (middle, last)
    back = (two + 0.1) / (two + 0.1).sum(axis=1, keepdims=True)
    return np.log((count + 5 * back[None]) / (count.sum(axis=2, keepdims=True) + 5))


class Decoder:
    """Viterbi over the lattice of a disguised token.

    Each sign is itself (at a price) or a letter that it may stand for, a separator within a spelled-out word is
    nothing, and a letter again after itself is nothing or itself. A state is the last two characters that came out;
    paths are scored by the character model and the channel's prices, and end at a word's end.
    """

    KEEP, SWAP, DROP, AGAIN = -4.0, -1.0, -0.2, -3.0

    def __init__(self, model) -> None:
        self.model, self.seen = model.tolist(), {}

    def __call__(self, token: str) -> str:
        got = self.seen.get(token)
        if got is None:
            if re.fullmatch(SPACED, token):
                got = " ".join(self.decode(x, True) for x in self.words(token))
            else:
                got = self.decode(token, False)
            if len(token) <= 64:  # what is kept is bounded in bytes; longer tokens are decoded each time
                if len(self.seen) > 100_000:
                    self.seen.clear()
                self.seen[token] = got
        return got

    @staticmethod
    def words(token: str) -> list[str]:
        """The words of a spelled-out run: it is split at double spaces, unless all its gaps are such."""
        return token.split("  ") if re.search(r"[^\W_][ ._\-*][^\W_]", token) else [token]

    @staticmethod
    @lru_cache(4096)
    def symbol(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 28 if c.isdigit() else 27 if c.isalpha() else 0

    def decode(self, token: str, spelled: bool) -> str:
        # a state has its score and what came out, as the last character and a pointer to those before
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i, c in enumerate(token):
            options: list[tuple[str, float]] = []
            if spelled and c in " ._-*" and i % 2 + (i > 1) and not (c == "*" and token[i - 1] in " ._-"):
                options.append(("", self.DROP))
            else:
                letter = c.isalpha()
                options.append((c, 0.0 if letter else self.KEEP))
                options += [(x, self.SWAP) for x in SIGNS.get(c, "")]
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, text) in states.items():
                for out, price in options:
                    moves = [(out, price)]
                    if out and text and text[0] == out:
                        moves = [("", 0.0), (out, price + (self.AGAIN if i > 1 and token[i - 1] == token[i - 2] else 0.0))]
                    for o, p in moves:
                        if o:
                            s = self.symbol(o)
                            key, value = (b, s), score + p + self.model[a][b][s]
                        else:
                            key, value = (a, b), score + p
                        if key not in new or value > new[key][0]:
                            new[key] = (value, (o, text) if o else text)
            states = new
        _, last = max(((score + self.model[a][b][0], text) for (a, b), (score, text) in states.items()), key=lambda x: x[0])
        out = []
        while last:
            out.append(last[0])
            last = last[1]
        return "".join(reversed(out))


def suspects(column) -> dict[int, set[int]]:
    """Lines (by number) of each lower-case text that may hold a disguised token.

    Each such token has a sign beside a letter, a letter three times in a row, or two single characters with
    separators around them.
    """
    import numpy as np

    words = Words(column)
    raw = words.data
    if len(raw) < 3:
        return {}
    letter = (raw >= 97) & (raw <= 122)
    sign = np.isin(raw, np.frombuffer(b"0123456789@$!|+(*\xac", np.uint8))  # the last byte of the euro sign
    gap = np.isin(raw, np.frombuffer(b" ._-*", np.uint8))
    flag = np.zeros(len(raw), bool)
    flag[:-1] |= (sign[:-1] & letter[1:]) | (letter[:-1] & sign[1:])
    flag[:-2] |= letter[:-2] & (raw[1:-1] == 0xE2) & (raw[2:] == 0x82)  # a euro sign after a letter
    flag[:-2] |= letter[:-2] & (raw[1:-1] == raw[:-2]) & (raw[2:] == raw[:-2])
    lone = np.zeros(len(raw), bool)
    lone[1:-1] = (letter | sign)[1:-1] & gap[2:] & ~((raw[:-2] >= 128) | letter[:-2])
    lone[0] = (letter | sign)[0] & gap[1]
    near = np.zeros(len(raw), bool)
    near[:-2] |= lone[:-2] & lone[2:]
    near[:-3] |= lone[:-3] & lone[3:]
    at = np.flatnonzero(flag | near)
    if not len(at):
        return {}
    doc = np.searchsorted(words.at, at, side="right") - 1
    lines = np.concatenate(([0], np.cumsum(raw == 10)))
    line = lines[at] - lines[words.at[doc]]
    found: dict[int, set[int]] = {}
    for d, n in set(zip(doc.tolist(), line.tolist(), strict=True)):
        found.setdefault(d, set()).add(n)
    return found


def restored(decoder: Decoder, texts) -> list[str]:
    """Lower-case texts with each disguised token followed by what it was decoded to, where that differs."""
    import pyarrow.compute as pc

    def swap(m: re.Match) -> str:
        token, got = m[0], []
        core, letters = token.rstrip("!|+(*"), token.rstrip(ENDS)
        if core != token and DISGUISED.fullmatch(core):  # the signs at the end may be punctuation
            got.append(decoder(core))
        whole = decoder(token)
        if letters == token or not whole.endswith(token[len(letters) :]) or DISGUISED.fullmatch(letters):
            got.append(whole)
        got = [x for x in dict.fromkeys(got) if x != token]
        return " ".join([token, *got, ""]) if got else token

    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    out = lower.to_pylist()
    for i, numbers in suspects(lower).items():
        lines = out[i].split("\n")
        for n in numbers:
            lines[n] = DISGUISED.sub(swap, lines[n])
        out[i] = "\n".join(lines)
    return out


def in_threes(text: str) -> str:
    """The text with each long run in a script without spaces as its runs of three characters."""
    if text.isascii():
        return text
    return UNSPACED.sub(lambda m: " ".join(m[0][i : i + 3] for i in range(len(m[0]) - 2)), text)


def word_buckets(texts):
    """(rows, doc, buckets): the row of each distinct word of each text of a chunk, and buckets of its prefixes.

    ``buckets`` has a column for each of ``PREFIXES``; -1 where the word is shorter.
    """
    import numpy as np
    import pyarrow as pa

    words = Words(pa.array([in_threes(t) for t in texts], pa.large_string()), letters=True)
    with np.errstate(over="ignore"):
        key = mix64(words.hash + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    start, end = words.start[at], words.end[at]
    size = end - start
    buckets = np.full((len(at), len(PREFIXES)), -1, np.int64)
    for j, n in enumerate(PREFIXES):
        on = size >= n if n < PREFIXES[-1] else np.ones(len(size), bool)
        h = words.spans.hashes(start[on], np.minimum(start[on] + n, end[on]))
        buckets[on, j] = (h % np.uint64(BUCKETS)).astype(np.int64)
    return words.n, words.doc[at], buckets


def feature_counts(model):
    """mapInArrow: (label, half, text) to (bucket, n00, n01, n10, n11): words per half and label that have the feature.

    The row of bucket BUCKETS has the numbers of all words.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        decoder, total = Decoder(model.value), np.zeros((BUCKETS + 1, 4), np.int64)
        for batch in batches:
            for start, stop in chunks(batch.column(2), CHUNK):
                part = batch.slice(start, stop - start)
                cell = np.asarray(part.column(1)) * 2 + np.asarray(part.column(0))
                _, doc, buckets = word_buckets(restored(decoder, part.column(2)))
                for column in buckets.T:
                    on = column >= 0
                    np.add.at(total, (column[on], cell[doc[on]]), 1)
                total[BUCKETS] += np.bincount(cell[doc], minlength=4)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, j]) for j in range(4))], ["bucket", "n00", "n01", "n10", "n11"])

    return run


def evidence(weights, decoder, column):
    """Features of each text from the log odds of its distinct words (a word's is the greatest of its prefixes').

    The three greatest, how many are above 1, 2 and 3 (log of one more), and the number of words (likewise).
    """
    import numpy as np

    n, doc, buckets = word_buckets(restored(decoder, column))
    word = np.where(buckets >= 0, weights[buckets], -9.0).max(axis=1) if len(doc) else np.zeros(0)
    out = np.zeros((n, FEATURES))
    order = np.lexsort((-word, doc))
    size = np.bincount(doc, minlength=n)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    for k in range(3):
        on = order[rank == k]
        out[doc[on], k] = np.clip(word[on], 0, 6)
    for k, above in enumerate((1.0, 2.0, 3.0)):
        out[:, 3 + k] = np.log1p(np.bincount(doc, word > above, minlength=n))
    out[:, 6] = np.log1p(size)
    return out


def half_evidence(model, halves):
    """mapInArrow: (label, half, text) to (label, features), by what the other half has learned."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        decoder = Decoder(model.value)
        for batch in batches:
            for start, stop in chunks(batch.column(2), CHUNK):
                part = batch.slice(start, stop - start)
                half = np.asarray(part.column(1))[:, None]
                first, second = (evidence(w, decoder, part.column(2)) for w in halves.value)
                x = np.where(half == 0, second, first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), FEATURES).cast(pa.list_(pa.float64()))], ["label", "x"])

    return run


def log_odds(counts, words):
    """Smoothed log odds of label 1 for words with each feature, relative to the labels' own shares of words."""
    import numpy as np

    share = (words[1] + 1) / (words.sum() + 2)
    return np.log((counts[:, 1] + PRIOR * share) / (counts[:, 0] + PRIOR * (1 - share))) - math.log(share / (1 - share))


def logistic(x, y, weak: float = 1.0):
    """Weights and intercept of a logistic regression by Newton steps, with a weak prior on the weights."""
    import numpy as np

    x = np.column_stack((x, np.ones(len(x))))
    prior = np.full(x.shape[1], weak)
    prior[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - prior * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior)
        step = np.linalg.solve(h, g)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE):
    """(character model, log odds by feature, weights) from all texts and all labelled rows.

    Log odds are learned on either half of the labelled rows and tried on the other, where at most ``sample`` rows (those
    of least id hash) calibrate the score. The driver receives sums by feature (at most BUCKETS) and that sample's
    features.
    """
    import numpy as np

    model = character_model(docs, text_col)
    shared = spark.sparkContext.broadcast(model)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__lid")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    known = table(spark, known.withColumn("h", F.xxhash64("__lid")), "labels")
    chosen = table(spark, known.orderBy("h", "__lid").limit(sample), "label-sample")

    def labelled(which: DataFrame) -> DataFrame:
        rows = joined(spark, docs.select(F.col(id_col).alias("__did"), F.col(text_col).alias("text")), which, F.col("__did") == F.col("__lid"), "inner")
        return rows.select("__lid", "label", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), F.coalesce("text", F.lit("")).alias("text"))

    parts = [f"n{h}{y}" for h in (0, 1) for y in (0, 1)]
    sums = labelled(known).drop("__lid").mapInArrow(feature_counts(shared), f"bucket int, {', '.join(f'{c} long' for c in parts)}").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in parts]).toArrow()
    counts = np.zeros((BUCKETS + 1, 4))
    counts[np.asarray(sums.column(0))] = np.stack([np.asarray(sums.column(j)) for j in range(1, 5)], axis=1)
    counts, words = counts[:BUCKETS], counts[BUCKETS]
    whole = log_odds(counts[:, :2] + counts[:, 2:], words[:2] + words[2:]).astype(np.float32)
    halves = spark.sparkContext.broadcast([log_odds(counts[:, 2 * h : 2 * h + 2], words[2 * h : 2 * h + 2]).astype(np.float32) for h in (0, 1)])
    # of rows that share an id one is tried, the one of greatest text, so that the sample bounds what the driver receives
    one = labelled(chosen).groupBy("__lid").agg(F.max(F.struct("text", "half", "label")).alias("r")).select("r.label", "r.half", "r.text")
    tried = one.mapInArrow(half_evidence(shared, halves), "label int, x array<double>").toArrow()
    y = np.asarray(tried.column(0))
    if not len(y) or y.min() == y.max():
        return model, whole, np.append(np.zeros(FEATURES), 3.0 if len(y) and y.min() else -3.0)
    x = np.asarray(tried.column(1).combine_chunks().values).reshape(-1, FEATURES)
    order = np.lexsort((*x.T, y))  # rows arrive in any order
    return model, whole, logistic(x[order], y[order])


def scorer(fitted, at: int, n: int):
    """A mapInArrow function: the first ``n`` columns and the score of the text in column ``at``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model, weights, final = fitted.value
        decoder = Decoder(model)
        for batch in batches:
            for start, stop in chunks(batch.column(at), CHUNK):
                part = batch.slice(start, stop - start)
                x = evidence(weights, decoder, part.column(at))
                score = 1 / (1 + np.exp(-np.clip(x @ final[:-1] + final[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(score)], [*part.schema.names[:n], "score"])

    return run


def score_toxicity(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    *,
    cut: float = 0.3,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from ``cut`` on).

    The character model is counted on all texts. Tokens with more than one path through the lattice of signs, spacing
    and repetition are decoded and stand beside the original; the score follows the strongest and the number of strong log odds among
    the restored text's distinct words, by their prefixes, as the labelled rows in ``labels`` show them. Ids, sources and labels are never
    features. An empty or null text has no evidence and gets the lowest score. Null ids match no label; repeated rows
    are scored alike; an empty table gives an empty result; without both labels scores are uncalibrated. Input columns
    named like an output column are replaced. ``keep`` names the columns to return besides (default: all).
    """
    docs = without(docs, OUT)
    names = docs.columns if keep is None else keep
    fitted = spark.sparkContext.broadcast(fit(spark, docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    rows, at, schema = text_rows(docs, names, text_col)
    return rows.mapInArrow(scorer(fitted, at, len(names)), f"{schema}, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_in("doc_id", 4, 2))
    scored = score_toxicity(spark, docs, labels, keep=["doc_id"])
    return scored.select("doc_id", held_in("doc_id", 4, 2).alias("held_out"), "score", "predicted")

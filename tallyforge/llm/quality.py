"""Quality classifier: learned hashed vectors of word and character n-grams, averaged per document, with a softmax."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import Words, chunks, held_in, mix64, text_rows, without

OUT = ("score", "predicted")
#: Rows that training looks at, at most: those of least hash of their id.
SAMPLE = 4000
BUCKETS = 1 << 15
CHARS = (3, 4)
#: Bytes of text that are worked on at once, about; a longer text is alone.
CHUNK = 250_000


def text_features(texts):
    """(doc, bucket) of all features of a chunk of texts: words, runs of two words, character n-grams of single words.

    A character n-gram lies within a word and the space at either end of it, so it is a subword. A word that comes again
    right after itself makes the same pair whatever the word. A text without words has no features.
    """
    import numpy as np

    words = Words(texts)
    with np.errstate(over="ignore"):
        docs, hashes = [words.doc], [words.hash]
        near = words.doc[1:] == words.doc[:-1]
        one, two = words.hash[:-1][near], words.hash[1:][near]
        docs.append(words.doc[1:][near])
        hashes.append(np.where(one == two, np.uint64(77), mix64(one * np.uint64(3) + two)))
        codes = mix64(np.arange(1000, 1256, dtype=np.uint64)).astype(np.uint32)[words.data]
        owner = np.repeat(np.arange(words.n, dtype=np.int32), np.diff(words.at))
        word = ~((words.data == 32) | ((words.data >= 9) & (words.data <= 13)))
        for n in CHARS:
            if len(codes) >= n:
                last = len(codes) - n + 1
                at = owner[:last] == owner[n - 1 :]
                for j in range(1, n - 1):
                    at &= word[j : last + j]
                at = np.flatnonzero(at)
                h = np.zeros(len(at), np.uint32)
                for j in range(n):
                    h = h * np.uint32(0x9E3779B1) + codes[at + j]
                docs.append(owner[at])
                hashes.append(h ^ (h >> np.uint32(15)))
    return docs, [(h % h.dtype.type(BUCKETS)).astype(np.int32) for h in hashes]


def counted(batches):
    """mapInArrow: (label, text) to (label, buckets, shares), the distinct features with their share of the document."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for start, stop in chunks(batch.column(1), CHUNK):
            part = batch.slice(start, stop - start)
            docs, ids = text_features(part.column(1))
            key, count = np.unique(np.concatenate(docs).astype(np.int64) * BUCKETS + np.concatenate(ids), return_counts=True)
            doc = key // BUCKETS
            total = np.bincount(doc, count, minlength=len(part))
            offsets = pa.array(np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(offsets, pa.array((key % BUCKETS).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array((count / total[doc]).astype(np.float32)))],
                ["label", "buckets", "shares"],
            )


def train(labels, buckets, shares, *, dim: int = 8, epochs: int = 8, batch: int = 32, rate: float = 0.3, seed: int = 7):
    """Stochastic gradient descent (step sizes by Adagrad) on document averages of vectors under a softmax.

    Returns what scoring needs: the logit of label 1 over label 0 of each bucket's vector, and the bias. The hidden
    layer is linear, so a document's logit is the average of its features' logits.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, dim)).astype(np.float32)
    top, bias = rng.uniform(-0.5, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_top, seen_bias = np.full((BUCKETS, 1), 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    labels = np.asarray(labels, np.int64)
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            ids = np.concatenate([buckets[r] for r in rows])
            weight = np.concatenate([shares[r] for r in rows])[:, None]
            sizes = np.array([len(buckets[r]) for r in rows])
            row = np.repeat(np.arange(len(rows)), sizes)
            hidden = np.zeros((len(rows), dim), np.float32)
            filled = np.flatnonzero(sizes)
            if len(filled):  # a document's features stand together, so its sum is one of a slice
                hidden[filled] = np.add.reduceat(vectors[ids] * weight, (np.cumsum(sizes) - sizes)[filled], axis=0)
            logit = hidden @ top + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            back = p @ top.T
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[by], prepend=-1))  # where each bucket's features begin
            uniq = ids[by[first]]
            grad = np.add.reduceat((back[row] * weight)[by], first, axis=0) if len(first) else np.zeros((0, dim), np.float32)
            g_top, g_bias = hidden.T @ p, p.sum(axis=0)
            seen[uniq] += (grad**2).mean(axis=1, keepdims=True)
            vectors[uniq] -= rate * grad / np.sqrt(seen[uniq])
            seen_top += g_top**2
            top -= rate * g_top / np.sqrt(seen_top)
            seen_bias += g_bias**2
            bias -= rate * g_bias / np.sqrt(seen_bias)
    return (vectors @ (top[:, 1] - top[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE):
    """Train on at most ``sample`` labelled rows (those of least id hash); only their features come to the driver.

    Without labelled rows every score is that of an empty text, 0.5; with one label alone the bias learns it.
    """
    import numpy as np
    import pyarrow as pa

    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__lid"))
    known = known.agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("__lid"), "__lid").limit(sample)
    rows = docs.select(F.col(id_col).alias("__did"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("__did") == F.col("__lid"))
    # of rows that share an id one is learned, the one of greatest text, so that the sample bounds what the driver receives
    one = rows.groupBy("__lid").agg(F.max(F.struct("text", "label")).alias("r")).select("r.label", "r.text")
    got = one.mapInArrow(counted, "label int, buckets array<int>, shares array<float>").toArrow()
    if not got.num_rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    lists = [got.column(c).combine_chunks() for c in (1, 2)]
    offsets = np.asarray(lists[0].offsets)
    flat = [np.asarray(x.values) for x in lists]
    parts = [[f[offsets[i] : offsets[i + 1]] for i in range(got.num_rows)] for f in flat]
    # in an order of their own, since rows arrive in any
    order = sorted(range(got.num_rows), key=lambda i: (parts[0][i].tobytes(), parts[1][i].tobytes()))
    label = got.column(0).to_pylist()
    model = train([label[i] for i in order], [parts[0][i] for i in order], [parts[1][i] for i in order])
    del got, lists, flat, parts  # what the driver received goes back at once
    pa.default_memory_pool().release_unused()
    return model


def scorer(model, at: int, n: int):
    """A mapInArrow function: the first ``n`` columns and the score of the text in column ``at``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weights, bias = model.value
        for batch in batches:
            for start, stop in chunks(batch.column(at), CHUNK):
                part = batch.slice(start, stop - start)
                docs, ids = text_features(part.column(at))
                total, count = np.zeros(len(part)), np.zeros(len(part))
                for doc, bucket in zip(docs, ids, strict=True):
                    total += np.bincount(doc, weights[bucket], minlength=len(part))
                    count += np.bincount(doc, minlength=len(part))
                score = 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(score)], [*part.schema.names[:n], "score"])

    return run


def score_quality(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    *,
    cut: float = 0.3,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from ``cut`` on).

    ``labels`` has the rows to learn from; ids, sources and labels are never features. Whole texts are scored; an empty
    or null text has no features and gets the bias alone. Null ids match no label; repeated rows are scored
    alike; an id that is labelled twice counts once, as 1 if either label is. Input columns named like an output column are replaced. ``keep``
    names the columns to return besides (default: all).
    """
    docs = without(docs, OUT)
    model = spark.sparkContext.broadcast(fit(spark, docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    names = docs.columns if keep is None else keep
    rows, at, schema = text_rows(docs, names, text_col)
    scored = rows.mapInArrow(scorer(model, at, len(names)), f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def training_rows(labels: DataFrame) -> DataFrame:
    """The label rows that may be learned from: crc32 of the id as text is not 0 modulo 5."""
    return labels.filter(~held_in("doc_id", 5, 0))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(spark, docs, training_rows(labels), keep=["doc_id"])
    return scored.select("doc_id", held_in("doc_id", 5, 0).alias("held_out"), "score", "predicted")


"""Near-duplicate classes by BagMinHash: weighted signatures, bands, verified multiset overlap, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import Words, chunks, joined, mix64, table, without

OUT = ("class_id", "class_key")
#: Members of a block, about; two blocks of a bucket are compared in one group.
BLOCK = 512
#: Members of a bucket that meet its centre in one piece of the join, about.
PIECE = 4096
#: Rounds go on while one comparison in so many makes a link; what they leave is compared in blocks.
WORTH = 20
#: Sketches of pairs at the threshold agree in less than the threshold less this with a probability of 2e-6.
MARGIN = 0.18
#: Texts whose shingles are held at once in a block, in bytes.
HELD = 8_000_000


def bag(doc, shingle):
    """(doc, shingle, count) of the distinct pairs, in order of doc."""
    import numpy as np

    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return doc[at], shingle[at], np.diff(np.append(at, len(doc)))


def bag_minhash(doc, shingle, count, n: int, m: int):
    """BagMinHash registers (n, m) of n multisets: the arrival times of the first point of each register.

    The weight axis is cut into cells (0, 1], (1, 2], (2, 4], (4, 8], ... Each cell of a shingle carries a Poisson
    process whose rate is the cell's width and whose points are a function of shingle and cell alone; a point has a
    time, a register and a place within its cell. A multiset sees the points below its weight: all those of the cells
    that it fills, and of the last cell those whose place lies below the weight. Points come in order of time, and a
    process ends once its time is past the latest register of its multiset, so the work after the first points is in
    proportion to m log m. Two multisets agree on a register with the probability of their weighted Jaccard.
    """
    import numpy as np

    registers = np.full(n * m, np.inf)
    cells = 1 + np.ceil(np.log2(count)).astype(np.int64)
    of = np.repeat(np.arange(len(doc)), cells)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell > 0, 2.0 ** (cell - 1), 0.0)
    rate = np.maximum(low, 1.0)
    share = np.minimum((count[of] - low) / rate, 1.0)
    top = np.full(n, np.inf)
    with np.errstate(over="ignore"):
        d, seed = doc[of], mix64(shingle[of] ^ mix64(cell.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
        x, step = np.zeros(len(d)), np.uint64(0)
        while len(d):
            step += np.uint64(0x9E3779B97F4A7C15)
            r = mix64(seed + step)
            x = x - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
            go = x <= top[d]
            d, seed, rate, share, x, r = d[go], seed[go], rate[go], share[go], x[go], mix64(r[go] + np.uint64(1))
            seen = (r & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < share
            slot = (r >> np.uint64(32)) % np.uint64(m)
            np.minimum.at(registers, d[seen] * m + slot[seen].astype(np.int64), x[seen])
            if len(d):
                open_docs = d[np.flatnonzero(np.append(True, d[1:] != d[:-1]))]
                top[open_docs] = registers.reshape(n, m)[open_docs].max(axis=1)
    return registers.reshape(n, m)


def lowered(texts):
    import pyarrow.compute as pc

    return pc.utf8_lower(texts)


def signature_bands(k: int, bands: int, rows: int):
    """A mapInArrow function: (id, v, text) to (id, v, bands, sketch); no bands where a text has no words.

    The sketch has one byte of each register.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start, stop in chunks(batch.column(2)):
                part = batch.slice(start, stop - start)
                n = len(part)
                doc, shingle = Words(lowered(part.column(2))).ngrams(k)
                doc, shingle, count = bag(doc, shingle)
                registers = bag_minhash(doc, shingle, count, n, bands * rows).view(np.uint64).reshape(n, bands, rows)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands))
                    for j in range(rows):
                        key = mix64(key + registers[:, :, j])
                filled = np.bincount(doc, minlength=n) > 0
                offsets = np.concatenate(([0], np.cumsum(filled * bands))).astype(np.int32)
                values = pa.array(key[filled].reshape(-1).view(np.int64))
                with np.errstate(over="ignore"):
                    sketch = mix64(registers.reshape(n, bands * rows)).astype(np.uint8)
                sketches = pa.array([x.tobytes() for x in sketch], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, sketches], ["id", "v", "bands", "sketch"])

    return run


def alike(least: float):
    """A mapInArrow function: the pairs (a, b, sketch_a, sketch_b) whose sketches agree in a share of ``least``, as (a, b)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                keep = pa.array((one == two).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([pc.filter(c, keep) for c in batch.columns[:2]], ["a", "b"])

    return run


def overlaps(k: int):
    """A mapInArrow function: (a, b, text_a, text_b) to (a, b, similarity), the weighted Jaccard of their shingles."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start, stop in chunks(batch.column(3)):
                part = batch.slice(start, stop - start)
                n = len(part)
                sides = [Words(lowered(part.column(c))).ngrams(k) for c in (2, 3)]
                doc = np.concatenate((sides[0][0], sides[1][0]))
                shingle = np.concatenate((sides[0][1], sides[1][1]))
                right = np.concatenate((np.zeros(len(sides[0][0]), np.int64), np.ones(len(sides[1][0]), np.int64)))
                order = np.lexsort((shingle, doc))
                doc, shingle, right = doc[order], shingle[order], right[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
                at = np.flatnonzero(new)
                both = np.diff(np.append(at, len(doc)))
                b = np.add.reduceat(right, at) if len(at) else both
                a = both - b
                least = np.bincount(doc[at], np.minimum(a, b), minlength=n)
                most = np.bincount(doc[at], np.maximum(a, b), minlength=n)
                similarity = pa.array(least / np.maximum(most, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), similarity], ["a", "b", "similarity"])

    return run


GROUP = ("g", "x", "y")
#: A member of a group: its bucket and that one's band, its side, itself, its component and sketch.
MEMBER = (*GROUP, "bucket", "band", "side", "v", "comp", "sketch")


def near_pairs(rows, least: float):
    """Pairs (i, j) of row numbers of a group, in pieces: what its blocks may link.

    A group has two blocks of a bucket (sides 0 and 1, each member of one meets each of the other), or one side of
    whole buckets, whose members meet each other within their bucket. Only pairs of different components whose sketches
    agree in ``least`` come out, each in the bucket of the first band that the two share.
    """
    import numpy as np

    bucket, side, band = (rows.column(c).to_numpy() for c in ("bucket", "side", "band"))
    comp = rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(band), -1)
    order = np.lexsort((side, bucket))
    bucket, side, band, comp, sketch = bucket[order], side[order], band[order], comp[order], sketch[order]
    bands = sketch.view(np.uint32)
    here = np.arange(len(band))
    end = np.searchsorted(bucket, bucket, side="right")
    if side.any():
        first = np.full(len(band), int((side == 0).sum()))
        end = np.where(side == 0, end, first)
    else:
        first = here + 1
    ends = np.cumsum(np.maximum(end - first, 0))
    at = 0
    while at < len(band):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100_000, side="right")))
        n = np.maximum(end[at:upto] - first[at:upto], 0)
        i = np.repeat(here[at:upto], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:upto], n)
        apart = comp[i] != comp[j]
        i, j = i[apart], j[apart]
        near = np.bitwise_count(np.packbits(sketch[i] == sketch[j], axis=1)).sum(axis=1) >= least * sketch.shape[1]
        i, j = i[near], j[near]
        own = (bands[i] == bands[j]).argmax(axis=1) == band[i]
        yield order[i[own]], order[j[own]]
        at = upto


def block_members(least: float):
    """An applyInArrow function: those members of a group that ``near_pairs`` pairs."""

    def run(rows):
        import numpy as np
        import pyarrow as pa

        paired = np.zeros(rows.num_rows, bool)
        for i, j in near_pairs(rows, least):
            paired[i] = paired[j] = True
        return rows.select(list(MEMBER)).filter(pa.array(paired))

    return run


def shared_shingles(column, sub, k: int, i, j):
    """Of each pair (i, j) of texts the sizes of their multisets' intersection and union.

    Each text is cut into shingles once for every two parts (``sub``) that its pairs lie in; the nth occurrence of a
    shingle is a token of its own, so multisets are sets, and what two share is counted in bit rows.
    """
    import numpy as np

    both, whole = np.zeros(len(i), np.int64), np.ones(len(i), np.int64)
    low, high = np.minimum(sub[i], sub[j]), np.maximum(sub[i], sub[j])
    for x, y in sorted(set(zip(low.tolist(), high.tolist(), strict=True))):
        on = np.flatnonzero((low == x) & (high == y))
        use = np.unique(np.concatenate((i[on], j[on])))
        texts = column.take(use)
        docs, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for start, stop in chunks(texts):
            doc, shingle, count = bag(*Words(texts.slice(start, stop - start)).ngrams(k))
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            with np.errstate(over="ignore"):
                tokens.append(mix64(np.repeat(shingle, count) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            docs.append(np.repeat(doc, count) + start)
        doc, token = np.concatenate(docs), np.concatenate(tokens)
        size = np.bincount(doc, minlength=len(use))
        _, token, often = np.unique(token, return_inverse=True, return_counts=True)
        shared = often > 1
        doc, token = doc[shared[token]], (np.cumsum(shared) - 1)[token[shared[token]]]
        order = np.argsort(token, kind="stable")
        doc, token = doc[order], token[order]
        a, b = np.searchsorted(use, i[on]), np.searchsorted(use, j[on])
        count, wide = np.zeros(len(on), np.int64), 1 << 13
        for begin in range(0, int(shared.sum()), wide):
            lo, hi = np.searchsorted(token, (begin, begin + wide))
            held = np.zeros((len(use), wide), bool)
            held[doc[lo:hi], token[lo:hi] - begin] = True
            bits = np.packbits(held, axis=1).view(np.uint64)
            for at in range(0, len(on), 8192):
                count[at : at + 8192] += np.bitwise_count(bits[a[at : at + 8192]] & bits[b[at : at + 8192]]).sum(axis=1, dtype=np.int64)
        both[on], whole[on] = count, np.maximum(size[a] + size[b] - count, 1)
    return both, whole


def block_links(k: int, threshold: float):
    """An applyInArrow function: links (a, b) that join the components which a group's verified pairs join.

    Each piece of pairs is verified on the whole texts unless earlier pieces have joined the two already; a group gives
    fewer links than it has members, however many of its pairs are alike.
    """

    def run(rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = lowered(rows.column("text").combine_chunks())
        sub = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) // HELD
        comp = rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        top = np.arange(int(comp.max()) + 1)

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = int(top[x])
            return x

        left, right = [], []
        for i, j in near_pairs(rows, threshold - MARGIN):
            roots = np.array([root(x) for x in range(len(top))]) if len(i) else top
            apart = roots[comp[i]] != roots[comp[j]]
            i, j = i[apart], j[apart]
            both, whole = shared_shingles(column, sub, k, i, j)
            good = both / whole >= threshold
            for a, b in zip(i[good].tolist(), j[good].tolist(), strict=True):
                x, y = root(comp[a]), root(comp[b])
                if x != y:
                    top[max(x, y)] = min(x, y)
                    left.append(a)
                    right.append(b)
        v = rows.column("v").combine_chunks()
        return pa.table({"a": v.take(pa.array(left, pa.int64())), "b": v.take(pa.array(right, pa.int64()))})

    return run


def all_links(spark: SparkSession, placed: DataFrame, sketches: DataFrame, texts: DataFrame, *, k: int, threshold: float) -> DataFrame:
    """Links (a, b) that join what all pairs of members (bucket, band, v, comp) of one bucket would join.

    A bucket of more than ``BLOCK`` members is dealt over blocks, by hash: large components over blocks of their own,
    the others together. Each two blocks of a bucket meet in one group, except those of the same component; small
    buckets share groups. Pairs never leave their group: a first pass over sketches tells which members have a partner
    at all, a second one verifies on these members' texts and gives links between components.
    """
    ceil = lambda n: F.ceil(n / F.lit(BLOCK))
    live = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    open_ = table(spark, placed.join(live, "bucket").select("bucket", "band", "v", "comp"), "left")
    left = open_.count()
    bins = left // 2048 + 1
    parts = open_.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    few = F.sum(F.when(F.col("m") < BLOCK, F.col("m")).otherwise(0))
    parts = table(spark, parts.join(parts.groupBy("bucket").agg(F.sum("m").alias("n"), few.alias("rest")), "bucket"), "parts", left)
    large = F.col("m") >= BLOCK
    salt = F.when(large, F.pmod(F.xxhash64("v"), ceil(F.col("m")))).otherwise(F.pmod(F.xxhash64("comp"), ceil(F.col("rest"))))
    own = F.when(large, F.col("comp"))
    block = F.when(large, F.xxhash64("comp", salt)).otherwise(salt.cast("long"))
    zero = F.lit(0).cast("long")
    hot_parts = table(spark, parts.filter(F.col("n") > BLOCK), "hot-parts", left)
    cold = open_.join(parts.filter(F.col("n") <= BLOCK).select("bucket").distinct(), "bucket")
    small = cold.select(F.pmod(F.xxhash64("bucket"), F.lit(bins)).alias("g"), zero.alias("x"), zero.alias("y"), "bucket", "band", F.lit(0).alias("side"), "v", "comp")
    hot = joined(spark, open_, hot_parts, ["bucket", "comp"], "inner").select("bucket", "band", "v", "comp", own.alias("own"), block.alias("block"))
    hot = table(spark, hot, "hot", left)
    blocks = table(spark, hot.groupBy("bucket", "block", "own").agg(F.count("*").alias("held")), "blocks", left)
    one, two = (blocks.select("bucket", F.col("block").alias(b), F.col("own").alias(o)) for b, o in (("x", "own_x"), ("y", "own_y")))
    meet = table(spark, one.join(two, "bucket").filter("x <= y AND NOT coalesce(own_x = own_y, false)").select("bucket", "x", "y"), "meet", left)
    rows = small
    for i, (c, which) in enumerate((("x", "true"), ("y", "x <> y"))):
        side = joined(spark, hot, meet.withColumn("block", F.col(c)), ["bucket", "block"], "inner").filter(which)
        rows = rows.unionByName(side.select(F.col("bucket").alias("g"), "x", "y", "bucket", "band", F.lit(i).alias("side"), "v", "comp"))
    rows = rows.join(sketches, "v").select(*MEMBER)
    schema = "g long, x long, y long, bucket long, band int, side int, v binary, comp binary, sketch binary"
    paired = table(spark, rows.groupBy(*GROUP).applyInArrow(block_members(threshold - MARGIN), schema), "paired")
    return paired.join(texts, "v").groupBy(*GROUP).applyInArrow(block_links(k, threshold), "a binary, b binary")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(v, comp) of every end of the links (a, b): comp is the least v of the connected component.

    Labels spread along links and jump to their label's label, so the number of rounds is about the logarithm of the
    longest path. Each round ends in a table in the shared folder; no group of neighbours is ever gathered.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    bound = 2 * links.count()
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select("v", F.least("v", "n").alias("comp"))
    labels = table(spark, labels, "labels", bound)
    while True:
        own = labels.select("v", "comp", F.col("comp").alias("old"))
        near = joined(spark, both, labels.withColumnRenamed("v", "b"), "b", "inner")
        near = near.select(F.col("a").alias("v"), "comp", F.lit(None).alias("old"))
        spread = own.unionByName(near).groupBy("v").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        jumped = joined(spark, spread, labels.select(F.col("v").alias("comp"), F.col("comp").alias("next")), "comp", "inner")
        jumped = jumped.select("v", "old", F.least("comp", "next").alias("comp"))
        step = table(spark, jumped, "labels", bound)
        labels = step.select("v", "comp")
        if step.filter("old <> comp").isEmpty():
            return labels


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    *,
    k: int = 5,
    threshold: float = 0.8,
    bands: int = 32,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with class_id, the least id of its near-duplicate class, and class_key, the class itself.

    Texts are linked if the weighted Jaccard of their multisets of k-word shingles (lower case, split at white space)
    is at least ``threshold``; classes are the connected components. Equal texts (by their 128-bit digests) are one
    vertex from the start, so a group of copies costs one row. With 32 bands of 4 registers a pair at 0.8 misses all
    bands with probability 5e-8.

    Rounds join what is easily joined: in each bucket that isn't one component yet, one centre of its largest component
    meets the members of the others, so a round has no more comparisons than buckets have members. The centre of the
    first round is the member whose buckets hold the most: what copies of a text have in common they have through it.
    Rounds end when they no longer pay. Then, in every bucket that isn't one component, each two members of different
    components are compared (``all_links``), so the rounds decide the time only. A comparison looks at the registers'
    sketches first: pairs that agree in less than ``threshold`` - 0.18 of 128 registers (five standard deviations; 2e-6
    of the pairs at the threshold) are not links. All others are verified on the whole texts; shingles are compared as
    64-bit hashes.

    Empty texts are copies of each other, a text of fewer than k words has one shingle. A null text is a class of its
    own; rows without text share one if they have the same id. Null ids are never the least; a class of null ids has a
    null class_id. An empty table gives an empty result. Input columns named like an output column are replaced.
    """
    docs = without(docs, OUT)
    classes = vertex_classes(spark, docs, k=k, threshold=threshold, bands=bands, rows=rows, id_col=id_col, text_col=text_col)
    # a vertex of one row and no links is its own class; only the others are looked up
    listed = table(spark, classes.filter("copies > 1 or linked").select(F.col("v").alias("__v"), "class_key", "class_id"), "classes")
    found = joined(spark, docs.withColumn("__v", vertex_of(id_col, text_col)), listed, "__v", "left")
    alone = F.col("class_key").isNull()
    class_id = F.when(alone, F.col(id_col)).otherwise(F.col("class_id"))
    return found.select(*docs.columns, class_id.alias("class_id"), F.hex(F.coalesce("class_key", "__v")).alias("class_key"))


def vertex_of(id_col: str, text_col: str) -> Column:
    """The vertex of a row: a digest of its text, or, longer by a byte, of its id if there is no text."""
    of_id = F.concat(F.lit("n"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.when(F.col(text_col).isNull(), F.unhex(F.concat(F.lit("00"), F.md5(of_id)))).otherwise(F.unhex(F.md5(text_col)))


def vertex_classes(spark: SparkSession, docs: DataFrame, *, k: int, threshold: float, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(v, copies, rep, linked, class_key, class_id) of each vertex.

    copies counts its rows, rep is their least id; linked says whether it has near-duplicates, class_key is its class
    and class_id that one's least id.
    """
    slim = docs.select(F.col(id_col).alias("id"), vertex_of(id_col, text_col).alias("v"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    signed = slim.mapInArrow(signature_bands(k, bands, rows), f"id {id_type}, v binary, bands array<long>, sketch binary")
    signed = table(spark, signed, "signatures")
    of_text = F.count("*").alias("copies"), F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    one = table(spark, signed.groupBy("v").agg(*of_text), "vertices")

    entries = one.select("v", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("met")).filter("met > 1")
    # a bucket of many members is dealt over pieces, so that no task gets it whole
    hot = table(spark, shared.filter(F.col("met") > PIECE).select("bucket", F.col("met").alias("many")), "hot-buckets")
    piece = F.pmod(F.xxhash64("v"), F.ceil(F.col("many") / PIECE)).cast("int")
    of_hot = joined(spark, entries, hot, "bucket", "inner").select("bucket", "band", "v", F.col("many").alias("met"), piece.alias("piece"))
    of_cold = joined(spark, entries, hot, "bucket", "left_anti").join(shared.filter(F.col("met") <= PIECE), "bucket")
    members = table(spark, of_hot.unionByName(of_cold.select("bucket", "band", "v", "met", F.lit(0).alias("piece"))), "members")
    bound = members.count()
    known = members.groupBy("v").agg(F.sum("met").alias("weight"))
    needed = table(spark, known.join(one.select("v", "rep", "sketch"), "v"), "needed", bound)
    known = needed.select("v", "weight")
    wanted = needed.select(F.col("v").alias("nv"), "rep")
    texts = joined(spark, slim, wanted, (F.col("v") == F.col("nv")) & F.col("id").eqNullSafe(F.col("rep")), "inner").select("v", "text")
    texts = table(spark, texts.dropDuplicates(["v"]), "texts")
    bytes_of = texts.agg(F.avg(F.length("text"))).first()[0] or 0

    def pairs_with(df: DataFrame, side: DataFrame, what: str, width: int) -> DataFrame:
        """Adds ``what`` of both ends of the pairs (a, b); b's side has few vertices and is broadcast if its bytes allow it."""
        centres = table(spark, df.select("b").distinct().join(side.withColumnRenamed("v", "b"), "b").withColumnRenamed(what, f"{what}_b"), "centres")
        full = df.join(side.select(F.col("v").alias("a"), F.col(what).alias(f"{what}_a")), "a")
        return joined(spark, full, centres, "b", "inner", width).select("a", "b", f"{what}_a", f"{what}_b")

    def labelled(links: DataFrame) -> DataFrame:
        found = components(spark, links)
        sizes = table(spark, found.groupBy("comp").agg(F.count("*").alias("size")), "sizes", 2 * links.count())
        return table(spark, joined(spark, found, sizes, "comp", "inner").select("v", "comp", "size"), "sized", 2 * links.count())

    def placed_with(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return members.withColumn("comp", F.col("v")).withColumn("size", F.lit(1).cast("long"))
        found = joined(spark, members, labels, "v", "left")
        return found.withColumn("comp", F.coalesce("comp", "v")).withColumn("size", F.coalesce("size", F.lit(1)))

    links, labels, step = None, None, 0
    while bound:
        placed = placed_with(labels)
        if step == 0:
            placed = placed.join(known, "v")
        order = -F.col("weight") if step == 0 else F.xxhash64("v", F.lit(step))
        centre = F.min(F.struct((-F.col("size")).alias("s"), order.alias("o"), F.col("v").alias("v"), F.col("comp").alias("comp")))
        centres = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("met").alias("met"), centre.alias("c"))
        centres = centres.filter("lo <> hi").select("bucket", F.col("c.v").alias("cv"), F.col("c.comp").alias("cc"), "met")
        pieces = F.when(F.col("met") > PIECE, F.ceil(F.col("met") / PIECE)).otherwise(1).cast("int")
        centres = centres.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("met")
        met = placed.join(centres, ["bucket", "piece"]).filter("comp <> cc")
        tried = table(spark, met.select(F.col("v").alias("a"), F.col("cv").alias("b")).distinct(), "tried", bound)
        sketched = pairs_with(tried, needed.select("v", "sketch"), "sketch", 200)
        near = table(spark, sketched.mapInArrow(alike(threshold - MARGIN), "a binary, b binary"), "near", bound)
        full = pairs_with(near, texts, "text", int(bytes_of) + 64)
        full = full.mapInArrow(overlaps(k), "a binary, b binary, similarity double").filter(F.col("similarity") >= threshold)
        new = table(spark, full.select("a", "b"), "links", bound)
        found = new.count()
        if found:
            links = new if links is None else links.unionByName(new)
            labels = labelled(links)
        if found * WORTH <= tried.count():
            break
        step += 1

    if bound:
        placed = placed_with(labels).select("bucket", "band", "v", "comp")
        new = table(spark, all_links(spark, placed, needed.select("v", "sketch"), texts, k=k, threshold=threshold), "links")
        if not new.isEmpty():
            labels = labelled(new if links is None else links.unionByName(new))

    alone = F.lit(False).alias("linked"), F.col("v").alias("class_key"), F.col("rep").alias("class_id")
    if labels is None:
        return one.select("v", "copies", "rep", *alone)
    ends = labels.select("v", F.col("comp").alias("class_key"))
    single = joined(spark, one.select("v", "copies", "rep"), ends, "v", "left_anti").select("v", "copies", "rep", *alone)
    linked = table(spark, one.select("v", "copies", "rep").join(ends, "v"), "linked")
    least = table(spark, linked.groupBy("class_key").agg(F.min("rep").alias("class_id")), "least")
    linked = joined(spark, linked, least, "class_key", "inner").withColumn("linked", F.lit(True))
    return single.unionByName(linked.select(*single.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of least id of each class; of several rows of that id and class, one.

    Only what goes is joined with the documents: texts that aren't their class's first, and the least id of texts that
    occur more than once. Both lists have short rows and are broadcast if their count allows it, so whole texts are
    shuffled only beyond that. Rows that share text and id are gathered to keep one of them.
    """
    classes = table(spark, vertex_classes(spark, docs, k=5, threshold=0.8, bands=32, rows=4, id_col=id_col, text_col=text_col), "vertex-classes")
    # of a class's texts the first is the one with the least id; of several such (ids that occur twice), the least vertex
    linked = classes.filter("linked")
    first = linked.groupBy("class_key").agg(F.min(F.when(F.col("rep").eqNullSafe(F.col("class_id")), F.col("v"))).alias("first"))
    gone = joined(spark, linked, table(spark, first, "first"), "class_key", "inner").select("v", "rep", (F.col("v") == F.col("first")).alias("stays"))
    copied = classes.filter("not linked and copies > 1").select("v", "rep", F.lit(True).alias("stays"))
    listed = table(spark, gone.unionByName(copied).toDF("__v", "__rep", "__stays"), "listed")
    marked = joined(spark, docs.withColumn("__v", vertex_of(id_col, text_col)), listed, "__v", "left")
    kept = marked.filter(F.col("__stays").isNull() | (F.col("__stays") & F.col(id_col).eqNullSafe(F.col("__rep"))))
    often = table(spark, docs.groupBy(F.col(id_col).alias("__often")).count().filter("count > 1").select("__often"), "repeated")
    if not often.isEmpty():
        same = F.col(id_col).eqNullSafe(F.col("__often"))
        again = joined(spark, kept, often, same, "left_semi").dropDuplicates(["__v"])
        kept = joined(spark, kept, often, same, "left_anti").unionByName(again)
    return kept.select(*docs.columns)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(spark, docs).select("doc_id", "class_id")

"""Decomposition of batch movements into buckets and slices, and the second, group-level matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.identity import slice_reference
from tallyforge.operators.aggregates import MONEY, rows, total
from tallyforge.operators.windows import canonical_parent
from tallyforge.session import stored


def partition_payments(resolved: DataFrame) -> DataFrame:
    """Sums per movement and bucket, from (movement_id, po_id, pacs008, message_id, amount).

    A payment's bucket is of its pacs008 and message, of either alone, or of itself.
    """
    pacs, msg = F.nullif(F.upper(F.trim("pacs008")), F.lit("")), F.nullif(F.upper(F.trim("message_id")), F.lit(""))
    kind = F.when(pacs.isNotNull() & msg.isNotNull(), "PAIR").when(pacs.isNotNull(), "PACS_ONLY").when(F.col("po_id").isNotNull(), "PO").otherwise("MSGID_ONLY")
    name = F.when(pacs.isNotNull() & msg.isNotNull(), F.concat_ws("/", pacs, msg)).when(pacs.isNotNull(), pacs).when(F.col("po_id").isNotNull(), F.upper("po_id")).otherwise(msg)
    keyed = resolved.withColumn("kind", kind).withColumn("bucket", name)
    return keyed.groupBy("movement_id", "kind", "bucket").agg(total().alias("amount"), rows().alias("n"))


def plan_movements(movements: DataFrame, parts: DataFrame) -> DataFrame:
    """What becomes of each movement: unresolved, whole (in its one bucket, or the heaviest of which one isn't zero), split."""
    of = parts.groupBy("movement_id").agg(
        rows().alias("buckets"),
        F.count_if(F.col("amount") != 0).cast("long").alias("nonzero"),
        F.min(F.struct((-F.abs("amount")).alias("weight"), "bucket")).alias("first"),
    )
    joined = movements.join(of, "movement_id", "left")
    outcome = F.when(F.col("buckets").isNull(), "UNRESOLVED").when((F.col("buckets") == 1) | (F.col("nonzero") <= 1), "WHOLE").otherwise("SPLIT")
    return joined.select(*movements.columns, F.coalesce("buckets", F.lit(0)).cast("long").alias("buckets"), outcome.alias("outcome"), F.when(outcome == "WHOLE", F.col("first.bucket")).alias("bucket"))


def claim_slices(parents: DataFrame, parts: DataFrame) -> DataFrame:
    """Slices of each claim group, from parents (hash, claim) and the claim's payments per bucket (claim_value, bucket, amount).

    The group's sign is that of its parents' sum; each bucket that isn't zero has one slice of exactly its payments' sum,
    which hangs off the group's first parent and has the same reference in every run.
    """
    claimed = parents.filter("claim_value <> ''")
    group = claimed.groupBy("source_id", "claim_type", "claim_value").agg(total().alias("parent_total"), rows().alias("parents"))
    first = canonical_parent(claimed).select("source_id", "claim_type", "claim_value", F.col("source_hash").alias("anchor"))
    sign = F.when(F.col("parent_total") < 0, -1).otherwise(1)
    on = group.join(first, ["source_id", "claim_type", "claim_value"]).join(parts.filter("amount <> 0"), "claim_value")
    return on.select(
        "source_id", "claim_value", "anchor", "bucket", "parents", (F.abs("amount") * sign).cast(MONEY).alias("slice_amount"), slice_reference(F.col("claim_value"), F.col("bucket")).alias("slice_ref")
    )


def second_matching(parents: DataFrame, slices: DataFrame, members: DataFrame) -> DataFrame:
    """Per bucket with slices whether any of its claim groups has parents that don't sum to their slices.

    Slices hang off the first parent of a group; both ledgers' slices count.
    """
    claimed = parents.filter("claim_value <> ''")
    keys = ["source_id", "claim_type", "claim_value"]
    sums = claimed.groupBy(*keys).agg(total().alias("parent_total"))
    anchors = canonical_parent(claimed).select(*keys, F.col("source_hash").alias("parent_hash"))
    # both are stored: if they are few, they are broadcast, and neither slices nor members are shuffled to meet them
    groups = stored(sums.join(anchors, keys).select("parent_hash", "parent_total"), "claims")
    of_slices = slices.join(groups, "parent_hash", "left_semi").groupBy("parent_hash").agg(total().alias("slice_total"))
    differing = stored(groups.join(of_slices, "parent_hash", "left").filter(F.col("parent_total") != F.coalesce("slice_total", F.lit(0))).select("parent_hash").distinct(), "differing")
    # members without a parent aren't looked up, as all of them would meet in one task
    hit = members.join(differing, "parent_hash", "left_semi").select("bucket_id", F.lit(True).alias("hit"))
    return members.select("bucket_id", F.lit(False).alias("hit")).unionByName(hit).groupBy("bucket_id").agg(F.bool_or("hit").alias("parent_mismatch"))


def split_detail(parents: DataFrame, slices: DataFrame) -> DataFrame:
    """Per first parent: parents, their sum, slices, their sum, the greatest slice, and the difference."""
    claimed = parents.filter("claim_value <> ''")
    keys = ["source_id", "claim_type", "claim_value"]
    group = claimed.groupBy(*keys).agg(total().alias("parent_total"), rows().alias("parents"))
    anchors = canonical_parent(claimed).select(*keys, F.col("source_hash").alias("parent_hash"))
    of = slices.groupBy("parent_hash").agg(total().alias("slice_total"), rows().alias("slices"), F.max(F.abs("amount")).cast(MONEY).alias("greatest"))
    on = group.join(anchors, keys).join(of, "parent_hash", "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return on.select(*keys, "parent_hash", "parents", "parent_total", zero("slices", "long"), zero("slice_total", MONEY), "greatest", (F.col("parent_total") - F.coalesce("slice_total", F.lit(0))).cast(MONEY).alias("delta"))


def stale_slices(slices: DataFrame, expected: DataFrame) -> DataFrame:
    """Slices of the parents at hand that the new decomposition no longer has; settled ones stay."""
    parents = expected.select("parent_hash").distinct()
    return slices.filter("store = 'LIVE'").join(parents, "parent_hash", "left_semi").join(expected.select("source_hash"), "source_hash", "left_anti")


def bucket_graph(members: DataFrame) -> DataFrame:
    """Edges between kinds and statuses within each bucket, with a width that grows with the logarithm of the count."""
    edges = members.groupBy("bucket_id", "kind", "status").agg(rows().alias("n"))
    return edges.withColumn("width", F.round(F.least(F.lit(7.0), F.lit(1.5) + F.log10("n") * 1.2), 6))


def graph_parts(members: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key nodes, member nodes, triples) of every bucket's graph, however many members it has.

    ``members`` is (bucket_id, source_hash, kind, amount, status), ``keys`` (source_hash, key_type, key_value). A key node
    tells how many values of its type the bucket has and how many members carry them; a member node sums the members of a
    kind and direction, by status; a triple (kind, direction, key type) is an edge between them.
    """
    direction = F.when(F.col("amount") < 0, "debit").otherwise("credit").alias("direction")
    own = members.select("bucket_id", "source_hash", "kind", direction, "amount", "status")
    on = own.join(keys, "source_hash")
    # a member counts with the first of its values, found where it met its keys, so that its hash isn't shuffled again
    first = F.row_number().over(Window.partitionBy("source_hash", "bucket_id", "key_type").orderBy("key_value")) == 1
    of_value = on.select("bucket_id", "key_type", "key_value", first.alias("first")).repartition("bucket_id").groupBy("bucket_id", "key_type", "key_value").agg(F.count_if("first").alias("n"))
    of_keys = of_value.groupBy("bucket_id", "key_type").agg(F.count("key_value").cast("long").alias("values"), F.sum("n").cast("long").alias("members"))
    count = lambda s: F.count_if(F.col("status") == s).cast("long")
    of_members = own.groupBy("bucket_id", "kind", "direction").agg(rows().alias("members"), total().alias("net"), count("PENDING").alias("pending"), count("MATCHED").alias("matched"), count("EXCLUDED").alias("excluded"))
    return of_keys, of_members, on.select("bucket_id", "kind", "direction", "key_type").distinct()

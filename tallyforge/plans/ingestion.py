"""Ingestion pipelines: ledger, statements, three-leg feeds, splits, buckets, payment statuses, run states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import identity as I
from tallyforge.functions.normalise import family, payment_order, signed
from tallyforge.operators.aggregates import MONEY, NO_KEY, bucket_state, bucket_summary, rows, total
from tallyforge.operators.joins import first_hit
from tallyforge.operators.merge import MOVE_TASKS, insert_new, upsert
from tallyforge.plans.matching import auto_match


def ledger_entries(movements: DataFrame) -> DataFrame:
    """Canonical entries of movements that have a reco_id column; rows without a side or an amount say so in ``_error``."""
    ref = F.coalesce("transaction_id", F.concat(F.lit("MID:"), F.col("movement_id").cast("string")))
    error = F.when(F.col("side").isNull(), "side").when(F.col("amount").isNull(), "amount")
    entry = movements.select(
        "flow_id", "reco_id", ref.alias("external_ref"), F.lit("ACC").alias("account"), F.lit("EUR").alias("currency"), signed(F.col("amount"), F.col("side")).cast(MONEY).alias("amount"), "value_date", F.lit("PENDING").alias("status"), error.alias("_error")
    )
    return entry.withColumn("source_hash", I.ledger_hash(F.col("flow_id"), F.col("external_ref"), F.col("account"), F.col("value_date"), F.col("value_date")))


def ledger_ingestion(live: DataFrame, settled: DataFrame, entries: DataFrame) -> DataFrame:
    """The live ledger after a run: new rows come in, pending ones get their new key, settled ones never come back.

    The amount of a row is frozen; rows without a key are retried by being in the batch again.
    """
    fresh = entries.filter("_error is null").drop("_error").join(settled.select("source_hash"), "source_hash", "left_anti")
    policy = {"reco_id": F.when(F.coalesce("old_reco_id", F.lit(NO_KEY)) == NO_KEY, F.col("new_reco_id")).otherwise(F.col("old_reco_id"))}
    return upsert(live, fresh.select(*live.columns), "source_hash", policy, [F.col("value_date")], guard=F.col("old_status") == "PENDING")


def statement_ingestion(rows_: DataFrame, lookups: list[tuple[str, DataFrame]], known: DataFrame, flow_id: int) -> DataFrame:
    """Statement rows with the key of the first lookup that has one, as entries that aren't known by their stable hash."""
    keyed = first_hit(rows_.filter("_error is null"), lookups, "reco_id")
    hashed = keyed.withColumn("source_hash", I.stable_hash(F.lit(flow_id), F.col("account"), F.col("currency"), F.col("amount"), F.col("value_date").cast("timestamp"), F.col("owner_ref")))
    return insert_new(known.select("source_hash"), hashed, "source_hash", [F.col("message_id"), F.col("place")])


def three_leg_entries(scheme: DataFrame, payments: DataFrame, returns: DataFrame, flow_id: int) -> DataFrame:
    """Legs of one key: the scheme's credit, the payment's debit, the return's credit under a reference of its own."""
    leg = lambda df, ref, amount, kind: df.select(F.lit(flow_id).alias("flow_id"), "reco_id", ref.alias("external_ref"), F.lit("EUR").alias("currency"), amount.cast(MONEY).alias("amount"), F.lit(kind).alias("event_type"), F.lit("PENDING").alias("status"))
    amount = F.abs("amount")
    return leg(scheme, F.col("po_id"), amount, "SCHEME").unionByName(leg(payments, F.col("po_id"), -amount, "PAYMENT")).unionByName(leg(returns, F.concat("po_id", F.lit("#RET")), amount, "RETURN"))


def three_leg_matching(entries: DataFrame, run: str) -> DataFrame:
    """Matched and pending rows and sums per kind of leg after an automatic match."""
    marked = auto_match(entries, run)[1]
    return marked.groupBy("event_type", "status").agg(rows().alias("n"), total().alias("net"))


def apply_split(live: DataFrame, parents: DataFrame, slices: DataFrame) -> DataFrame:
    """The live ledger with the parents withdrawn, their slices in, and slices that they no longer have out.

    A slice's amount follows the new decomposition; rows that aren't of these parents stay as they are.
    """
    kept = live.join(parents.select("source_hash"), "source_hash", "left_anti")
    stale = kept.join(parents.select(F.col("source_hash").alias("parent_hash")), "parent_hash", "left_semi").join(slices.select("source_hash"), "source_hash", "left_anti")
    return upsert(kept.join(stale.select("source_hash"), "source_hash", "left_anti"), slices, "source_hash", {"amount": "new"}, [F.col("amount")])


#: What makes a key of a member.
TRIPLE = ("source_hash", "key_type", "key_value")


def keys_of_members(keys: DataFrame) -> DataFrame:
    """(source_hash, keys): rows of a member's keys, as a push carries them, or of single keys as lists of one."""
    return keys.select("source_hash", "keys") if "keys" in keys.columns else keys.select("source_hash", F.array(F.struct(*TRIPLE[1:])).alias("keys"))


def single_keys(members: DataFrame) -> DataFrame:
    """(source_hash, key_type, key_value), a row per key."""
    return members.select("source_hash", F.inline("keys")).select(*TRIPLE)


def unknown_keys(keys: DataFrame, known: DataFrame) -> DataFrame:
    """The keys that aren't known, each once; one that lacks its hash, type or value is never known.

    Keys are shuffled by their member's hash as they come, those of a row together as lists of types and values, and are
    taken apart behind it; they compress so well that the number of tasks is kept.
    """
    tasks = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOVE_TASKS)
    listed = lambda df, is_: keys_of_members(df).select("source_hash", "keys.key_type", "keys.key_value", F.lit(is_).alias("__known"))
    both = listed(keys, False).unionByName(listed(known, True)).repartition(tasks, "source_hash")
    apart = both.select("source_hash", F.inline(F.arrays_zip("key_type", "key_value")), "__known").filter(~F.col("__known") | F.concat(*TRIPLE).isNotNull())
    return apart.groupBy(*TRIPLE).agg(F.bool_or("__known").alias("__known")).filter(~F.col("__known")).select(*TRIPLE)


def bucket_push(buckets: DataFrame, members: DataFrame, known_members: DataFrame, keys: DataFrame, known_keys: DataFrame) -> dict[str, DataFrame]:
    """All tables after a push of members, from one upsert: {members, buckets, keys, rollups, counts}.

    Buckets that members name and that weren't there are made; who is where stays, amounts follow; keys that weren't
    there come in, each once. Keys are rows of their own, or lists of a member's (column ``keys`` of type and value). ``rollups`` sums up every bucket again (sums, dates and status counts, its state, whether
    each of its currencies nets to zero), ``counts`` says how much is new and how many members' amounts changed.
    """
    merged = upsert(known_members, members, "source_hash", {"amount": "new"}, [F.col("amount")])
    new_buckets = members.select("bucket_id").distinct().join(buckets, "bucket_id", "left_anti")
    new_keys = unknown_keys(keys, known_keys)
    changed = merged.agg(F.count_if(F.col("change") == "INSERTED").cast("long").alias("a"), F.count_if(F.col("change") == "UPDATED").cast("long").alias("b"))
    of_members = changed.select(F.inline(F.array(F.struct(F.lit("members").alias("what"), F.col("a").alias("n")), F.struct(F.lit("updated").alias("what"), F.col("b").alias("n")))))
    one = lambda df, what: df.agg(rows().alias("n")).select(F.lit(what).alias("what"), "n")
    counts = one(new_buckets, "buckets").unionByName(of_members).unionByName(one(new_keys, "keys"))
    columns = [c for c in ("currency", "status", "value_date") if c in merged.columns]
    rollups = bucket_state(bucket_summary(merged)) if len(columns) == 3 else None
    return {"members": merged, "buckets": buckets.select("bucket_id").unionByName(new_buckets), "keys": single_keys(keys_of_members(known_keys)).unionByName(new_keys), "rollups": rollups, "counts": counts}


def canonical_slices(members: DataFrame, flow_id: int) -> DataFrame:
    """Members that are slices (have a parent and a reference) under the hash that their ledger rows have, others as they are.

    The hash of a push may come from another spelling of the identity; a slice's ledger row has that of its flow,
    reference, account and dates, so member and row meet under it.
    """
    slice_ = F.col("parent_hash").isNotNull() & F.col("external_ref").isNotNull()
    own = I.ledger_hash(F.lit(flow_id), F.col("external_ref"), F.col("account"), F.col("value_date"), F.col("value_date"))
    return members.withColumn("source_hash", F.when(slice_, own).otherwise(F.col("source_hash")))


def apply_buckets(buckets: DataFrame, members: DataFrame, known_members: DataFrame, keys: DataFrame, known_keys: DataFrame) -> DataFrame:
    """What a push of members adds (``bucket_push``): buckets, members and keys that weren't there, amounts that changed."""
    return bucket_push(buckets, members, known_members, keys, known_keys)["counts"]


def pushed_buckets(members: DataFrame, known_members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, rollups) after a push of members alone (``bucket_push``)."""
    none = members.sparkSession.createDataFrame([], "bucket_id string"), members.sparkSession.createDataFrame([], "source_hash string, key_type string, key_value string")
    out = bucket_push(none[0], members, known_members, none[1], none[1])
    return out["members"], out["rollups"]


def status_sync(movements: DataFrame, payments: DataFrame, returns: DataFrame) -> DataFrame:
    """(reco_id, status, n): how many payments of each status stand behind each movement, by its family.

    Payments are counted by key and status before they meet movements, so the output grows with the movements and not
    with the pairs; who belongs to a movement is its key, which payments carry.

    Bulks go by pacs008, bulk messages by message, rejects, singles and instants by payment order, returns by the
    original payment of the return. A payment order that no payment has counts under a null status.
    """
    real = movements.filter(F.col("reco_id").isNotNull() & (F.col("reco_id") != NO_KEY))
    own = real.select("reco_id", family(F.col("particulars")).alias("family"), payment_order(F.col("particulars"), F.col("ref_no")).alias("po"), F.upper(F.trim("remarks_1")).alias("pacs"), F.upper(F.try_element_at(F.split("particulars", "/"), F.lit(2))).alias("msg"))
    by = lambda kind, key, column: own.filter(F.col("family").isin(*kind)).select("reco_id", F.col(key).alias("k")).join(payments.groupBy(F.upper(column).alias("k"), "status").agg(rows().alias("n")), "k").select("reco_id", "status", "n")
    origin = own.filter("family = 'RETURN'").join(returns.select(F.col("return_po").alias("po"), "original_po"), "po").select("reco_id", F.col("original_po").alias("po_id"))
    single = own.filter(F.col("family").isin("REJECT", "SINGLE", "INSTANT") & F.col("po").isNotNull()).select("reco_id", F.col("po").alias("po_id"))
    named = origin.unionByName(single).join(payments.select("po_id", "status"), "po_id", "left").select("reco_id", "status", F.lit(1).cast("long").alias("n"))
    every = by(["BULK"], "pacs", "pacs008").unionByName(by(["BULK_MESSAGE"], "msg", "message_id")).unionByName(named)
    return every.groupBy("reco_id", "status").agg(F.sum("n").cast("long").alias("n"))


def run_state(inserted: Column, errors: Column) -> Column:
    """FAILED if nothing came in and rows failed, PARTIAL if some failed, else SUCCESS."""
    return F.when((errors > 0) & (inserted == 0), "FAILED").when(errors > 0, "PARTIAL").otherwise("SUCCESS")

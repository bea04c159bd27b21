"""The whole upsert of a batch with every movement into ledgers that are stored by the rows' hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.normalise import MONEY
from tallyforge.operators import ledger as L
from tallyforge.queries import query
from tallyforge.session import shared_folder

DEC = "DECIMAL(20,4)"
c = F.col


def row(df: DataFrame, source_hash, reco_id, amount, status: str, parent) -> DataFrame:
    return df.select(source_hash.alias("source_hash"), reco_id.alias("reco_id"), amount.cast(MONEY).alias("amount"), F.lit(status).alias("status"), parent.alias("parent_hash"))


def tables(v) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Live: movements but every third, and slices of orders divisible by 5; settled: every sixth; the batch: all of both."""
    none, m = F.lit(None).cast("string"), v.movement
    own = F.concat(F.lit("M"), c("movement_id").cast("string"))
    slices = v.lineitem.select(F.concat_ws("-", F.lit("S"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("h"), F.concat(F.lit("M"), c("l_orderkey").cast("string")).alias("parent"), "l_extendedprice", "l_orderkey").filter("l_orderkey % 5 = 0")
    live = row(m.filter("movement_id % 3 <> 0 AND movement_id % 5 <> 0"), own, F.lit("OLD"), c("amount"), "PENDING", none)
    live = live.unionByName(row(slices, c("h"), F.lit("OLD"), c("l_extendedprice") + 1, "PENDING", c("parent")))
    settled = row(m.filter("movement_id % 6 = 0 AND movement_id % 5 <> 0"), own, F.lit("OLD"), c("amount"), "MATCHED", none)
    parents = m.filter("movement_id % 5 = 0 OR movement_id % 7 = 0").select(own.alias("source_hash"), F.lit(1).alias("source_id"), F.lit("MSGID").alias("claim_type"), F.when(c("movement_id") % 2 == 0, F.expr("'C' || (movement_id div 35)")).otherwise("").alias("claim_value"))
    batch = row(m, own, F.concat(F.lit("NEW"), c("movement_id").cast("string")), c("amount") * 2, "PENDING", none).withColumn("no", F.lit(2))
    batch = batch.unionByName(row(slices, c("h"), F.lit("NEW"), c("l_extendedprice"), "PENDING", c("parent")).withColumn("no", F.lit(2)))
    return live, settled, parents, batch.unionByName(batch.withColumns({"reco_id": F.lit("EARLIER"), "no": F.lit(1)}))


def merged(v) -> tuple[DataFrame, DataFrame]:
    live, settled, parents, batch = tables(v)
    folder, name = shared_folder(v.spark, "ledger"), f"ledger_{uuid.uuid4().hex}"
    live, settled = L.stored_by_key(v.spark, live, f"{name}_live", f"{folder}/live"), L.stored_by_key(v.spark, settled, f"{name}_settled", f"{folder}/settled")
    return batch, L.ledger_upsert(live, settled, parents, batch, [c("no")])


SLICED = "SELECT o_orderkey // 35 FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"
REPLACED = f"(movement_id % 10 = 5 AND movement_id IN (SELECT l_orderkey FROM lineitem)) OR (movement_id % 2 = 0 AND (movement_id % 5 = 0 OR movement_id % 7 = 0) AND movement_id // 35 IN ({SLICED}))"
LEDGERS = f""", m AS (SELECT *, movement_id AS id, ({REPLACED}) AS gone, movement_id % 3 <> 0 AND movement_id % 5 <> 0 AS here FROM movement),
  l AS (SELECT 'M' || id AS source_hash, CASE WHEN gone THEN 'OLD' ELSE 'NEW' || id END AS reco_id, CAST(amount AS {DEC}) AS amount, CASE WHEN gone THEN 'KEPT' ELSE 'UPDATED' END AS change FROM m WHERE here
    UNION ALL SELECT 'M' || id, 'NEW' || id, CAST(amount * 2 AS {DEC}), 'INSERTED' FROM m WHERE NOT here AND NOT gone AND NOT (id % 6 = 0 AND id % 5 <> 0)
    UNION ALL SELECT 'S-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'NEW', CAST(l_extendedprice AS {DEC}), 'UPDATED' FROM lineitem WHERE l_orderkey % 5 = 0)"""
query("sink_composed_upsert", "movement", LEDGERS + " SELECT * FROM l")(lambda v: merged(v)[1].select("source_hash", "reco_id", "amount", "change"))
query(
    "sink_composed_counts",
    "movement",
    LEDGERS
    + """, n AS (SELECT count(*) FILTER (change = 'INSERTED') AS inserted, count(*) FILTER (change = 'UPDATED') AS updated FROM l)
      SELECT inserted, updated, 2 * ((SELECT count(*) FROM movement) + (SELECT count(*) FROM lineitem WHERE l_orderkey % 5 = 0)) - inserted - updated AS skipped FROM n""",
)(lambda v: L.upsert_counts(*merged(v)))

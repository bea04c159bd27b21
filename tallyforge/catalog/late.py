"""Ledger and statement rows whose lookups arrive later: several batches of a stream over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.catalog.sources import messages
from tallyforge.functions import identity as I
from tallyforge.functions.normalise import MONEY, signed
from tallyforge.queries import query
from tallyforge.session import shared_folder
from tallyforge.sources.statement import statement_rows
from tallyforge.streaming import unresolved as U

DEC = "DECIMAL(20,4)"
c = F.col
BATCHES = 4


def run(v, parts: DataFrame, waiting: U.Waiting, cut) -> int:
    """A stream of the rows in the order of their column ``at``: a batch for each number; gives the last one's.

    The rows are computed once. Those of a number arrive as files of several tasks and make one run of the stream, which
    goes on where the run before it ended; so a batch is written, and read, by as many tasks as its rows need.
    """
    staged, folder = shared_folder(v.spark, "staged"), shared_folder(v.spark, "arriving")
    parts.write.option("compression", "zstd").partitionBy("at").parquet(staged)
    rows = v.spark.read.schema(parts.schema).parquet(staged)
    last = -1
    for number in range(BATCHES):
        rows.filter(c("at") == number).drop("at").write.mode("append").option("compression", "zstd").parquet(folder)
        last = U.run_stream(v.spark, v.spark.readStream.schema(parts.drop("at").schema).parquet(folder), waiting, cut)
    return last


#: Movements come in batch movement_id % 3, an eighth of them once more in batch 3; references become known in batch 2,
#: even pacs008 in batch 0 and odd ones in batch 1; orders divisible by 5 get their bulk's key in batch 3.
def movements(v):
    m = v.movement.select("transaction_id", "flow_id", "value_date", signed(c("amount"), c("side")).cast(MONEY).alias("amount"), c("movement_id").alias("id"), "ref_no", F.nullif("remarks_1", F.lit("")).alias("pacs"))
    rows = m.withColumn("source_hash", I.ledger_hash(c("flow_id"), c("transaction_id"), F.lit("ACC"), c("value_date"), c("value_date")))
    keys = F.array(U.key("REF", c("ref_no")), U.key("PACS", c("pacs")))
    rows = rows.select(F.lit("row").alias("what"), "transaction_id", "amount", "source_hash", keys.alias("keys"), F.when(c("id") % 17 == 0, "amount").alias("_error"), (c("id") % 3).cast("int").alias("at"), "id")
    rows = rows.drop("id").unionByName(rows.filter("id % 8 = 0").withColumn("at", F.lit(3)).drop("id"))
    p = v.payment
    refs = p.select(c("transaction_ref").alias("value"), F.concat(F.lit("R"), "transaction_ref").alias("reco_id"), F.lit("REF").alias("kind"), F.lit(2).alias("at"))
    number = F.substring("pacs008", 5, 20).cast("int")
    pacs = p.select(c("pacs008").alias("value"), F.concat(F.lit("P"), "pacs008").alias("reco_id"), F.lit("PACS").alias("kind"), (number % 2).alias("at")).filter(number % 7 != 0)
    bulks = p.filter("supp_key % 5 = 0").select(F.concat(F.lit("P"), "pacs008").alias("value"), F.concat(F.lit("BULK"), (c("supp_key") % 3).cast("string")).alias("reco_id"), F.lit("BULK").alias("kind"), F.lit(3).alias("at"))
    found = refs.unionByName(pacs).unionByName(bulks).distinct().withColumn("what", F.when(c("kind") == "BULK", "bulk").otherwise("lookup"))
    return rows.unionByName(found, allowMissingColumns=True)


def split(batch: DataFrame):
    rows = batch.filter("what = 'row'").withColumn("retry_keys", c("keys"))
    return rows, batch.filter("what = 'lookup'").select("kind", "value", "reco_id"), batch.filter("what = 'bulk'").select(c("value").alias("member"), c("reco_id").alias("bulk"))


def ledger_run(v):
    waiting = U.waiting_table(v.spark, "transaction_id string, amount decimal(20,4)")
    return waiting, run(v, movements(v), waiting, split)


LATE = """, refs AS (SELECT DISTINCT transaction_ref AS k FROM payment), pacs AS (SELECT DISTINCT pacs008 AS k, CAST(substr(pacs008, 5) AS INT) AS n FROM payment WHERE CAST(substr(pacs008, 5) AS INT) % 7 <> 0),
  bulks AS (SELECT DISTINCT 'P' || pacs008 AS member, 'BULK' || (supp_key % 3) AS bulk FROM payment WHERE supp_key % 5 = 0),
  came AS (SELECT m.*, movement_id % 3 AS came_in, CASE WHEN r.k IS NOT NULL THEN greatest(movement_id % 3, 2) END AS by_ref, CASE WHEN p.k IS NOT NULL THEN greatest(movement_id % 3, p.n % 2) END AS by_pacs
    FROM movement m LEFT JOIN refs r ON r.k = m.ref_no LEFT JOIN pacs p ON p.k = m.remarks_1 WHERE movement_id % 17 <> 0),
  solved AS (SELECT *, least(coalesce(by_ref, 9), coalesce(by_pacs, 9)) AS first, CASE WHEN by_ref IS NOT NULL AND by_ref <= coalesce(by_pacs, 9) THEN 1 WHEN by_pacs IS NOT NULL THEN 2 END AS tier FROM came)"""
query(
    "plan_ledger_retry",
    "movement payment",
    LATE
    + f""" SELECT transaction_id, CAST(CASE WHEN side = 'D' THEN -abs(amount) ELSE abs(amount) END AS {DEC}) AS amount, coalesce(bulk, reco_id) AS reco_id, tier, CASE WHEN first < 9 THEN first::INT END AS resolved_in
      FROM (SELECT *, CASE tier WHEN 1 THEN 'R' || ref_no WHEN 2 THEN 'P' || remarks_1 END AS reco_id FROM solved) LEFT JOIN bulks ON member = reco_id""",
)(lambda v: (lambda w, n: w.entries(n).select("transaction_id", "amount", "reco_id", "tier", "resolved_in"))(*ledger_run(v)))
query(
    "stream_run_counters",
    "movement payment",
    LATE
    + """, steps AS (SELECT unnest([0, 1, 2, 3]) AS batch)
      SELECT batch::INT AS batch, (SELECT count(*) FROM movement WHERE movement_id % 3 = batch) + CASE WHEN batch = 3 THEN (SELECT count(*) FROM movement WHERE movement_id % 8 = 0) ELSE 0 END AS rows_in,
        (SELECT count(*) FROM movement WHERE movement_id % 3 = batch AND movement_id % 17 = 0) + CASE WHEN batch = 3 THEN (SELECT count(*) FROM movement WHERE movement_id % 8 = 0 AND movement_id % 17 = 0) ELSE 0 END AS rows_ko,
        CASE WHEN batch = 3 THEN (SELECT count(*) FROM solved WHERE movement_id % 8 = 0) ELSE 0 END AS rows_duplicate,
        (SELECT count(*) FROM solved WHERE first = batch) AS resolved, (SELECT count(*) FROM solved WHERE first = batch AND came_in < batch) AS resolved_late,
        (SELECT count(*) FROM solved WHERE came_in < batch AND first >= batch) AS retried, (SELECT count(*) FROM solved WHERE came_in <= batch AND first > batch) AS unresolved FROM steps""",
)(lambda v: ledger_run(v)[0].counters())


def statements(v):
    """Statement rows as they come, and lookups; identities and keys are made of them where a batch is cut (``statement_split``)."""
    r = statement_rows(messages(v)).withColumn("n", owner_number())
    rows = r.select(F.lit("row").alias("what"), "message_id", "place", "account", "currency", "amount", "value_date", "sub_20", "owner_ref", (c("n") % 2).alias("at"))
    n = c("p_partkey")
    first = v.part.filter("p_partkey % 8 IN (0, 1)").select(F.concat(F.lit("SCRT"), n.cast("string"), F.lit("goes on")).alias("value"), F.concat(F.lit("K"), n.cast("string")).alias("reco_id"), F.lit(2).alias("at"))
    second = v.part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("OW/"), n.cast("string")).alias("value"), F.concat(F.lit("O"), n.cast("string")).alias("reco_id"), F.lit(1).alias("at"))
    found = first.unionByName(second).select(F.lit("lookup").alias("what"), F.lit("REF").alias("kind"), "value", "reco_id", "at")
    return rows.unionByName(found, allowMissingColumns=True)


def owner_number():
    return F.regexp_extract("owner_ref", r"OW/(\d+)", 1).cast("int")


def statement_split(batch: DataFrame):
    """Rows with their identity and keys: both candidates count in a row's own batch, the first alone when it is tried again."""
    ref = F.concat_ws("#", "message_id", c("place").cast("string"))
    primary, other = U.key("REF", c("sub_20")), U.key("REF", c("owner_ref"))
    ident = I.stable_hash(F.lit(9), c("account"), c("currency"), c("amount"), c("value_date").cast("timestamp"), ref)
    rows = batch.filter("what = 'row'").select(ref.alias("external_ref"), "amount", ident.alias("source_hash"), F.array(primary, other).alias("keys"), F.array(primary).alias("retry_keys"), F.when(owner_number().isNull(), "line").alias("_error"))
    return rows, batch.filter("what = 'lookup'").select("kind", "value", "reco_id"), None


def statement_run(v) -> DataFrame:
    waiting = U.waiting_table(v.spark, "external_ref string, amount decimal(20,4)")
    last = run(v, statements(v), waiting, statement_split)
    return waiting.entries(last).select(F.substring_index("external_ref", "#", 1).alias("message_id"), "amount", "reco_id", "tier", "resolved_in")


query(
    "plan_statement_retry",
    "",
    f"""SELECT l_orderkey::VARCHAR AS message_id, CAST(CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(20,2)) AS {DEC}) AS amount,
      CASE WHEN l_partkey % 2 = 1 AND l_partkey % 3 = 0 THEN 'O' || l_partkey WHEN l_partkey % 4 <> 3 AND l_partkey % 8 IN (0, 1) THEN 'K' || l_partkey END AS reco_id,
      CASE WHEN l_partkey % 2 = 1 AND l_partkey % 3 = 0 THEN 2 WHEN l_partkey % 4 <> 3 AND l_partkey % 8 IN (0, 1) THEN 1 END AS tier,
      CASE WHEN l_partkey % 2 = 1 AND l_partkey % 3 = 0 THEN 1 WHEN l_partkey % 4 <> 3 AND l_partkey % 8 IN (0, 1) THEN 2 END AS resolved_in FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)""",
)(statement_run)

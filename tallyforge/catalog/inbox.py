"""An inbox with five feeds, one of them twice, and a file that can't be read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.catalog.records import FEED
from tallyforge.queries import query
from tallyforge.session import shared_folder
from tallyforge.sources import reader
from tallyforge.streaming import inbox as B

c = F.col


def runs(v):
    root = shared_folder(v.spark, "inbox")
    key = c("o_orderkey")
    feed = v.orders.select(
        (key % 5).alias("file"), key.alias("k"), F.when(key % 50 == 7, "x").otherwise(F.round(c("o_totalprice") * 100).cast("decimal(18,0)").cast("string")).alias("Amount"), F.concat(F.lit("ORD"), key.cast("string")).alias("Ref"), F.concat(F.lit("T"), key.cast("string")).alias("Txn"), F.lit("EUR").alias("Cur"),
        F.date_format("o_orderdate", "dd-MMM-yyyy").alias("Date"), F.lit("9:05:30").alias("Time"), F.lit("none").alias("Op"), F.when(key % 5 == 4, "fee").otherwise("cheque").alias("Type"), F.when(key % 10 == 0, "InDoubt").otherwise("Ok").alias("Status"), F.lit("note").alias("Note"),
    )
    for file in (0, 1, 2, 3, 4, 1):
        feed.filter(c("file") == file).drop("file", "k").coalesce(1).write.mode("append").csv(f"{root}/cash", sep=";", header=True)
    v.region.filter("r_regionkey = 0").select(F.expr("CAST(unhex('FFFE41') AS STRING)").alias("value")).write.mode("append").text(f"{root}/cash")
    read = lambda spark, paths: reader("delimited")(spark, paths, FEED)
    return B.run_inbox(v.spark, root, f"{root}/cash", read, F.sha2(F.concat_ws("|", "external_ref", "amount"), 256), shared_folder(v.spark, "taken"), pattern="part-*", files_at_once=3)


query(
    "stream_inbox_runs",
    "",
    """WITH f AS (SELECT o_orderkey % 5 AS file, count(*) AS n, count(*) FILTER (o_orderkey % 50 = 7 OR o_orderkey % 5 = 4) AS bad FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1),
      r AS (SELECT n AS rows_in, n - bad AS rows_ok, bad AS rows_ko, 0 AS rows_duplicate FROM f UNION ALL SELECT n, 0, bad, n - bad FROM f WHERE file = 1 UNION ALL SELECT 1, 0, 1, 0)
      SELECT rows_in, rows_ok, rows_ko, rows_duplicate, CASE WHEN rows_ko > 0 AND rows_ok = 0 THEN 'FAILED' WHEN rows_ko > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM r""",
)(lambda v: runs(v)[1].select("rows_in", "rows_ok", "rows_ko", "rows_duplicate", "status"))

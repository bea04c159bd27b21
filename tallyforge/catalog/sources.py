"""Sources and streams: files are written from the given tables, then read by the reader under test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.normalise import MONEY
from tallyforge.queries import query
from tallyforge.session import shared_folder
from tallyforge.sources import delimited, fixed_width, reader, statement, workbook
from tallyforge.streaming import incremental as S

DEC = "DECIMAL(20,4)"
c = F.col


def lines(v, df: DataFrame, name: str) -> str:
    """Writes one text column as text files; gives their folder."""
    folder = shared_folder(v.spark, name)
    df.write.text(folder)
    return folder


def cash(v) -> str:
    folder = shared_folder(v.spark, "cash")
    v.orders.select(
        F.when(c("o_orderkey") % 50 == 7, "x").otherwise(F.round(c("o_totalprice") * 100).cast("decimal(18,0)").cast("string")).alias("Amount"),
        F.concat(F.lit("ORD"), c("o_orderkey").cast("string")).alias("Reference"),
        F.lit("C1").alias("CCPAccount"),
        F.concat(F.lit("T"), c("o_orderkey").cast("string")).alias("TxnId"),
        F.date_format("o_orderdate", "dd-MMM-yyyy").alias("Date"),
        F.lit("10:20:30").alias("Time"),
        F.when(c("o_orderkey") % 10 == 0, "InDoubt").when(c("o_orderkey") % 10 == 1, "Reverse").otherwise("Ok").alias("Status"),
    ).write.csv(folder, sep=";", header=True)
    return folder


query(
    "source_delimited",
    "",
    f"""SELECT 'T' || o_orderkey AS external_ref, 'ORD' || o_orderkey AS reco_id, 'C1' AS account, CAST(CASE WHEN o_orderkey % 10 = 1 THEN 0 WHEN o_orderkey % 50 = 7 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(20,2)) END AS {DEC}) AS amount,
      CAST(o_orderdate AS DATE) + INTERVAL '10:20:30' HOUR TO SECOND AS value_date, CASE WHEN o_orderkey % 50 = 7 THEN 'amount' END AS _error FROM orders WHERE o_orderkey % 10 <> 0""".replace("INTERVAL '10:20:30' HOUR TO SECOND", "INTERVAL 10 HOUR + INTERVAL 20 MINUTE + INTERVAL 30 SECOND"),
)(lambda v: reader("csv")(v.spark, cash(v), {}))


def fixed(v) -> str:
    pad = lambda x, n: F.rpad(x, n, " ")
    body = v.orders.select(
        F.concat(
            F.lit("1"), pad(c("o_orderkey").cast("string"), 30), pad(F.lit("sent"), 30), pad(F.when(c("o_orderkey") % 4 == 0, "WITHDRAW").otherwise("DEPOSIT"), 8), pad(F.lit("P1"), 12), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("EUR"),
            F.lpad(F.replace(c("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")), 27, " "), pad(F.concat(F.lit("R"), c("o_orderkey").cast("string")), 20), F.lit("Y\u0000 "),
        ).alias("value")
    )
    ends = v.region.filter("r_regionkey < 2").select(F.when(c("r_regionkey") == 0, "0HEADER").otherwise("9TRAILER").alias("value"))
    short = v.nation.select(F.concat(F.lit("1short"), "n_name").alias("value"))
    return lines(v, body.unionByName(ends).unionByName(short), "fixed")


query(
    "source_fixed_width",
    "",
    f"""SELECT o_orderkey::VARCHAR AS counter, CASE WHEN o_orderkey % 4 = 0 THEN 'WITHDRAW' ELSE 'DEPOSIT' END AS event, CAST(o_orderdate AS DATE) AS day, CAST(CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(20,2)) AS {DEC}) AS amount, 'R' || o_orderkey AS ref, NULL::VARCHAR AS _error FROM orders
      UNION ALL SELECT 'short' || n_name, '', NULL, NULL, '', 'short' FROM nation""",
)(lambda v: reader("fixed_width")(v.spark, fixed(v), {}).select("counter", "event", "day", "amount", "ref", "_error"))


def xml(v) -> str:
    row = F.concat(F.lit("<entry><id>"), c("s_suppkey").cast("string"), F.lit("</id><name> "), "s_name", F.lit(" </name><nation>"), F.when(c("s_nationkey") % 2 == 0, c("s_nationkey").cast("string")).otherwise(""), F.lit("</nation></entry>"))
    files = v.supplier.groupBy((c("s_suppkey") % 8).alias("file")).agg(F.concat(F.lit("<feed>"), F.array_join(F.array_sort(F.collect_list(row)), "\n"), F.lit("</feed>")).alias("value"))
    folder = shared_folder(v.spark, "xml")
    files.write.partitionBy("file").text(folder)  # one document per file
    return folder


query("source_xml", "", "SELECT s_suppkey::VARCHAR AS id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey::VARCHAR END AS nation FROM supplier")(
    lambda v: reader("xml")(v.spark, xml(v), {"row_tag": "entry", "fields": {"id": "id", "name": "name", "nation": "nation"}})
)
query("source_workbook", "", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey::VARCHAR END AS s_nationkey, NULL::VARCHAR AS _error FROM supplier")(
    lambda v: workbook.workbook_rows(
        workbook.to_workbooks(v.supplier.select(c("s_suppkey").cast("string").alias("s_suppkey"), "s_name", F.when(c("s_suppkey") % 3 != 0, c("s_nationkey").cast("string")).alias("s_nationkey"))), ["s_suppkey", "s_name", "s_nationkey"]
    )
)


def messages(v) -> DataFrame:
    """A statement message per order, with a line and a detail per order line; every fourth detail is missing."""
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]

    def text_of(x):
        amount = F.replace(x["l_extendedprice"].cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(","))
        part, bank = x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")
        line = F.concat(F.lit(":61:"), F.date_format(x["l_shipdate"], "yyMMddMMdd"), F.when(x["l_partkey"] % 2 == 0, "D").otherwise("C"), amount, F.lit("NTRF"), F.lit("OW/"), part, F.lit("//BK"), bank)
        detail = F.when(x["l_partkey"] % 4 == 3, ":62M:x").otherwise(F.concat(F.lit(":86:166+00TEXT+20SCRT"), part, F.lit("\ngoes on+32NAME")))
        return F.struct(x["l_linenumber"], x["l_partkey"], x["l_suppkey"], F.concat_ws("\n", line, detail).alias("t"))

    # lines are shuffled as their numbers and written out where they are gathered
    grouped = v.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(*columns)).alias("lines"))
    body = F.array_join(F.transform(F.sort_array(F.transform("lines", text_of)), lambda x: x["t"]), "\n")
    text = F.concat(F.lit("{1:F01BANK}{4:\n:20:M\n:25:ACC"), (c("l_orderkey") % 7).cast("string"), F.lit("\n:60F:C200101EUR1,00\n"), body, F.lit("\n:62F:C200101EUR1,00\n-}"))
    return grouped.select(c("l_orderkey").cast("string").alias("message_id"), text.alias("text"))


query(
    "source_statement",
    "",
    f"""SELECT l_orderkey::VARCHAR AS message_id, 'ACC' || (l_orderkey % 7) AS account, 'EUR' AS currency, CAST(l_shipdate + CASE WHEN year(l_shipdate) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END AS DATE) AS value_date, CAST(CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(20,2)) AS {DEC}) AS amount, 'OW/' || l_partkey AS owner_ref, 'BK' || l_suppkey AS bank_ref,
      CASE WHEN l_partkey % 4 <> 3 THEN 'SCRT' || l_partkey || 'goes on' END AS sub_20 FROM lineitem""",
)(lambda v: statement.statement_rows(messages(v)).select("message_id", "account", "currency", "value_date", "amount", "owner_ref", "bank_ref", "sub_20"))


def statement_files(v) -> str:
    return lines(v, messages(v).select(c("text").alias("value")), "statements")


query("source_statement_files", "", f"SELECT count(*) AS n, CAST(sum(CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(20,2))) AS {DEC}) AS total FROM lineitem")(
    lambda v: reader("mt940")(v.spark, statement_files(v), {}).agg(F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("total"))
)


def dump(v) -> str:
    folder = shared_folder(v.spark, "dump")
    v.dump.select(c("pmsgid").alias("PMSGID"), c("srl").alias("EntitySrlNum"), c("amount").cast("string").alias("SettlementAmt"), F.lit("x").alias("other")).write.csv(folder, sep="|", header=True)
    return folder


FIELDS = {"pmsgid": ["pmsgid", "msgid"], "srl": ["entitysrlnum"], "amount": ["amount", "settlementamt", "instdamt"], "reason": ["reasoncode"]}
query("source_dump", "dump", "SELECT pmsgid, srl, amount::VARCHAR AS amount, NULL::VARCHAR AS reason FROM dump")(lambda v: delimited.read_dump(v.spark, dump(v), FIELDS))
query("source_unwrapped", "dump", "SELECT pmsgid || ';\"' || srl || '\"' AS value FROM dump")(
    lambda v: delimited.unwrapped(v.dump.select(F.concat(F.lit('"'), "pmsgid", F.lit(';""'), "srl", F.lit('"""')).alias("value")).unionByName(v.region.filter("r_regionkey = 0").select(F.lit("?column?").alias("value"))))
)
query("source_inbox", "", "SELECT 'cash' AS kind, count(*) AS n FROM orders")(
    lambda v: v.spark.read.option("pathGlobFilter", "*.csv").csv(cash(v), sep=";", header=True).select(F.col("_metadata.file_name").alias("f")).filter(c("f").endswith(".csv")).agg(F.count("*").alias("n")).select(F.lit("cash").alias("kind"), "n")
)


def multi(v) -> str:
    return lines(v, v.part.select(F.concat_ws("~^~", c("p_partkey").cast("string"), "p_name", "p_brand").alias("value")), "multi")


query("source_multi_char", "", "SELECT p_partkey::VARCHAR AS k, p_name AS name, p_brand AS brand FROM part")(lambda v: v.spark.read.csv(multi(v), sep="~^~", quote="").toDF("k", "name", "brand"))


def discovered(v) -> DataFrame:
    v.payment.select("po_id", "amount").createOrReplaceTempView("x_paymord_2024")
    v.payment_return.select(c("return_po").alias("po_id"), "amount").createOrReplaceTempView("x_return_2024")
    found = [t.name for t in v.spark.catalog.listTables() if "paymord" in t.name or "return" in t.name]
    out = None
    for name in sorted(n for n in found if n.startswith("x_")):
        part = v.spark.table(name)
        out = part if out is None else out.unionByName(part)
    for name in ("x_paymord_2024", "x_return_2024"):  # the plan is resolved, so the session's views can go
        v.spark.catalog.dropTempView(name)
    return out.groupBy().agg(F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("total"))


query("source_discovered_tables", "payment payment_return", f"SELECT count(*) AS n, CAST(sum(amount) AS {DEC}) AS total FROM (SELECT amount FROM payment UNION ALL SELECT amount FROM payment_return)")(discovered)
query("source_merged_extract", "export_rows", "SELECT file_no, count(*) AS n FROM export_rows GROUP BY 1")(lambda v: merged_extract(v))


def merged_extract(v) -> DataFrame:
    """Writes exports by family and reads them back with the family from the folder."""
    folder = shared_folder(v.spark, "extract")
    v.export_rows.select("srl", c("amount").cast("string").alias("amount"), "pmsgid", "file_no").write.partitionBy("file_no").csv(folder, sep="|", header=True)
    return v.spark.read.csv(folder, sep="|", header=True).groupBy(c("file_no").cast("int").alias("file_no")).agg(F.count("*").alias("n"))


# ---- streams
def twice(v) -> DataFrame:
    """Each event twice, as an overlap that is read again brings it."""
    once = lambda: S.event_stream(v.spark, v.sf_dir).select("at", "event_id", "user_id", "event_type")
    return once().unionByName(once())


query("stream_next_since", "ingestion_run", "SELECT source, coalesce(max(started_at) FILTER (status IN ('SUCCESS', 'PARTIAL')) - INTERVAL 2 DAY, TIMESTAMP '1900-01-01') AS since FROM ingestion_run GROUP BY 1")(lambda v: S.next_since(v.ingestion_run))
query("stream_tumbling_counts", "", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda v: S.to_table(v.spark, S.tumbling_counts(S.event_stream(v.spark, v.sf_dir)), "complete").select("start", "event_type", "n")
)
query(
    "stream_sessions",
    "",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""",
)(lambda v: S.to_table(v.spark, S.sessions(S.event_stream(v.spark, v.sf_dir)), "complete"))
query("stream_deduplicated", "", "SELECT event_id, user_id, event_type FROM events")(lambda v: S.to_table(v.spark, S.deduplicated(twice(v), ["event_id"]).select("event_id", "user_id", "event_type"), "append"))
query("stream_ingest_once", "", "SELECT event_id, user_id FROM events")(lambda v: S.ingest_once(v.spark, S.event_stream(v.spark, v.sf_dir).select("event_id", "user_id"), "event_id").select("event_id", "user_id"))

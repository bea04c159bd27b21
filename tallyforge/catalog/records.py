"""Readers of large files: files are written from the given tables and read by byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.catalog.feeds import slabs
from tallyforge.catalog.sources import messages
from tallyforge.queries import query
from tallyforge.session import shared_folder
from tallyforge.sources import reader, workbook

DEC = "DECIMAL(20,4)"
c = F.col

FEED = {
    "delimiter": ";",
    "column_map": {"amount": "Amount", "external_ref": "Txn", "reco_id": "Ref", "currency": "Cur", "operation_date": "Op", "remarks_1": "Note"},
    "datetime_fields": ["Date", "Time"],
    "datetime_format": "%d-%b-%Y %H:%M:%S",
    "operation_date_format": "%Y%m%d",
    "amount_in_cents": True,
    "direction": {"field": "Type", "keywords": {"withdraw": "debit", "cheque": "credit"}, "reversal_keyword": "reverse", "default": None},
    "skip_status": {"field": "Status", "values": ["InDoubt"]},
    "zero_amount_when": {"field": "Status", "contains": "void"},
}


def feed_files(v) -> str:
    """Cash feeds, one file for each of five groups of orders, in the order of their keys; and a file in no encoding."""
    folder = shared_folder(v.spark, "feeds")
    key = c("o_orderkey")
    kind = F.when(key % 6 == 0, "Withdraw ATM").when(key % 6 == 1, "WITHDRAW REVERSE").when(key % 6 == 2, "Cheque").when(key % 6 == 3, "reverse cheque").when(key % 6 == 4, "fee")
    v.orders.select(
        (key % 5).alias("file"),
        key.alias("k"),
        F.when(key % 50 == 7, "x").when(key % 50 == 8, "").otherwise(F.round(c("o_totalprice") * 100).cast("decimal(18,0)").cast("string")).alias("Amount"),
        F.concat(F.lit("ORD"), key.cast("string")).alias("Ref"),
        F.concat(F.lit(" T"), key.cast("string")).alias("Txn"),
        F.when(key % 3 == 0, "USD").otherwise("").alias("Cur"),
        F.when(key % 40 == 3, "soon").otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("Date"),
        F.lit("9:05:30").alias("Time"),
        F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("none").alias("Op"),
        kind.alias("Type"),
        F.when(key % 10 == 0, " indoubt ").when(key % 10 == 1, "Void").otherwise("Ok").alias("Status"),
        F.concat(F.lit("first; line\nsaid \"no\" "), key.cast("string")).alias("Note"),
    ).repartition("file").sortWithinPartitions("file", "k").drop("k").write.partitionBy("file").option("escape", '"').csv(folder, sep=";", header=True)
    v.region.filter("r_regionkey = 0").select(F.lit(9).alias("file"), F.expr("CAST(unhex('FFFE41') AS STRING)").alias("value")).write.mode("append").partitionBy("file").text(folder)
    return folder


query(
    "source_numbered_rows",
    "",
    f"""WITH rows AS (SELECT o_orderkey AS k, o_orderkey % 6 AS t, o_totalprice, o_orderdate, row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) + 1 AS no FROM orders),
    e AS (SELECT *, CASE WHEN k % 50 IN (7, 8) THEN NULL ELSE CAST(o_totalprice AS DECIMAL(20,2)) END AS n, CASE t WHEN 0 THEN 'debit' WHEN 1 THEN 'credit' WHEN 2 THEN 'credit' WHEN 3 THEN 'debit' END AS d,
          CASE WHEN k % 40 <> 3 THEN CAST(o_orderdate AS DATE) + INTERVAL 9 HOUR + INTERVAL 5 MINUTE + INTERVAL 30 SECOND END AS moment FROM rows WHERE k % 10 <> 0)
    SELECT no, 'T' || k AS external_ref, 'ORD' || k AS reco_id, CASE WHEN k % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency, d AS direction, moment AS value_date,
      CASE WHEN k % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) ELSE moment END AS operation_date, 'first; line' || chr(10) || 'said "no" ' || k AS remarks_1,
      CAST(CASE WHEN k % 10 = 1 THEN 0 WHEN d = 'debit' THEN -n ELSE n END AS {DEC}) AS amount,
      CASE WHEN k % 50 = 8 THEN 'missing amount' WHEN k % 50 = 7 THEN 'invalid amount' WHEN d IS NULL THEN 'unmapped direction' WHEN k % 40 = 3 THEN 'invalid value date' END AS _error FROM e
    UNION ALL SELECT NULL, NULL, NULL, 'EUR', NULL, NULL, NULL, NULL, NULL, 'file error: UnicodeDecodeError'""",
)(lambda v: reader("delimited")(v.spark, feed_files(v), FEED).select("no", "external_ref", "reco_id", "currency", "direction", "value_date", "operation_date", "remarks_1", "amount", "_error"))


def statement_file(v) -> str:
    """All messages of statements; each row goes on with a customer's reference, or has one among its details."""
    folder = shared_folder(v.spark, "statements")
    body = F.regexp_replace("text", r"(//BK)(\d*[02468])\n", "$1$2\nCUST$2\n")
    messages(v).select(F.regexp_replace(body, r"\+00TEXT", "+00TEXT+21ID").alias("value")).write.text(folder)
    return folder


query(
    "source_statement_records",
    "",
    f"""SELECT 'ACC' || (l_orderkey % 7) AS account, 'M' AS statement_ref, CAST(CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(20,2)) AS {DEC}) AS amount,
      'OW/' || l_partkey AS owner_ref, 'BK' || l_suppkey AS bank_ref, CASE WHEN l_suppkey % 2 = 0 THEN 'CUST' || l_suppkey END AS customer_ref,
      CASE WHEN l_suppkey % 2 = 0 THEN 'CUST' || l_suppkey WHEN l_partkey % 4 <> 3 THEN 'TEXT' END AS transaction_ref, CASE WHEN l_partkey % 4 <> 3 THEN 'ID' END AS ref_21 FROM lineitem""",
)(lambda v: reader("mt940")(v.spark, statement_file(v), {}).select("account", "statement_ref", "amount", "owner_ref", "bank_ref", "customer_ref", "transaction_ref", "ref_21"))


def slab_file(v) -> str:
    """Records of 3,269 characters without line ends: the last filler of each is written as what ends a line.

    Nearly all of it is filler, so files are packed, of at most 100,000 records as each is one task's.
    """
    folder = shared_folder(v.spark, "slabs")
    record = F.substring("value", 3270, 3268)
    slabs(v).select(F.explode(F.array(F.rpad(F.lit("0HEAD"), 3268, " "), record, record)).alias("value")).write.option("lineSep", " ").option("compression", "gzip").option("maxRecordsPerFile", 100_000).text(folder)
    return folder


query(
    "source_slab_records",
    "",
    f"""SELECT o_orderkey::VARCHAR AS counter, CAST(o_orderdate AS DATE) AS day, CAST(CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(20,2)) AS {DEC}) AS amount, 'R' || o_orderkey AS ref
      FROM orders, (SELECT unnest([1, 2]) AS i)""",
)(lambda v: reader("slabs")(v.spark, slab_file(v), {}).filter("_error is null").select("counter", "day", "amount", "ref"))


def wrapped_file(v) -> str:
    """An export in quotes of each of three groups of orders; of the third, every record goes on over a line end."""
    folder = shared_folder(v.spark, "wrapped")
    key = c("o_orderkey").cast("string")
    text = F.concat(F.lit('"'), key, F.lit(';""ORD'), key, F.lit('"";'), F.when(c("o_orderkey") % 3 == 0, "two\nlines").otherwise("one line"), F.lit('"'))
    rows = v.orders.select((c("o_orderkey") % 3).alias("file"), key.alias("k"), text.alias("value"))
    heads = rows.select("file").distinct().select("file", F.lit("").alias("k"), F.lit('"?column?"').alias("value"))
    rows.unionByName(heads).repartition("file").sortWithinPartitions("file", "k").drop("k").write.partitionBy("file").text(folder)
    return folder


query(
    "source_wrapped_records",
    "",
    """SELECT row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey::VARCHAR) + 1 AS no,
      o_orderkey || ';"ORD' || o_orderkey || '";' || CASE WHEN o_orderkey % 3 = 0 THEN 'two' || chr(10) || 'lines' ELSE 'one line' END AS value FROM orders""",
)(lambda v: reader("wrapped")(v.spark, wrapped_file(v), {}).select("no", "value"))


def typed(v):
    """Orders in workbooks whose second sheet has numbers, times and, in the column of amounts, some texts."""
    sheet = v.orders.select("o_orderkey", "o_totalprice", "o_orderdate", F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias("status"), F.when(c("o_orderkey") % 9 == 0, "n/a").when(c("o_orderkey") % 9 == 1, "1 234,5").alias("note"))
    columns = {"o_orderkey": "long", "o_totalprice": "double", "o_orderdate": "timestamp", "status": "string", "note": "decimal", "absent": "string"}
    return workbook.typed_rows(workbook.to_workbooks(sheet, sheet="orders"), columns, {"sheet": "orders", "decimal_separator": ","}).drop("row_no")


query(
    "source_typed_workbook",
    "",
    f"""SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderstatus AS status, CASE WHEN o_orderkey % 9 = 1 THEN CAST(1234.5 AS {DEC}) END AS note,
      NULL::VARCHAR AS absent, CASE WHEN o_orderkey % 9 = 0 THEN 'not of its type: note' END AS _error FROM orders""",
)(typed)

PATHS = {
    "record_xpath": "//Stmt/Ntry",
    "field_xpaths": {"amount": "Amt", "currency": ["Amt/@Ccy", "Cur"], "external_ref": "@id", "reco_id": ["./Dtls/Tx/Ref", "Alt/text()"], "value_date": "ValDt/Dt", "account": "Acct/Id"},
    "decimal_separator": ",",
}


def xml_records(v) -> str:
    """Records of a statement, one a line: nested, repeated, empty and missing elements, and a namespace's prefix."""
    folder = shared_folder(v.spark, "records")
    key = c("o_orderkey")
    k = key.cast("string")
    amount = F.when(key % 20 == 3, "").otherwise(F.replace(c("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")))
    currency = F.when(key % 2 == 0, ' Ccy="USD"').otherwise("")
    refs = F.when(key % 3 == 0, F.concat(F.lit("<Dtls><Tx/><Tx><Ref> R"), k, F.lit(" </Ref><Ref>second</Ref></Tx></Dtls>"))).when(key % 3 == 1, F.concat(F.lit("<Dtls><Tx><Ref></Ref></Tx></Dtls><Alt>A"), k, F.lit("</Alt>"))).otherwise("")
    day = F.when(key % 20 == 7, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    v.orders.select(F.concat(F.lit('<n:Ntry id="'), k, F.lit('"><n:Amt'), currency, F.lit(">"), amount, F.lit("</n:Amt><Cur>CHF</Cur>"), refs, F.lit("<ValDt><Dt>"), day, F.lit("</Dt></ValDt></n:Ntry>")).alias("value")).write.text(folder)
    return folder


query(
    "source_xml_paths",
    "",
    f"""WITH o AS (SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 20 <> 3 THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS n FROM orders)
    SELECT k::VARCHAR AS external_ref, CASE k % 3 WHEN 0 THEN 'R' || k WHEN 1 THEN 'A' || k END AS reco_id, CASE WHEN k % 2 = 0 THEN 'USD' ELSE 'CHF' END AS currency, CAST(n AS {DEC}) AS amount,
      NULL::VARCHAR AS account, CASE WHEN n >= 0 THEN 'credit' ELSE 'debit' END AS direction, CASE WHEN k % 20 <> 7 THEN CAST(o_orderdate AS TIMESTAMP) END AS value_date,
      CASE WHEN k % 20 = 3 THEN 'missing amount' WHEN k % 20 = 7 THEN 'invalid value date' END AS _error FROM o""",
)(lambda v: reader("xml_paths")(v.spark, xml_records(v), {**PATHS, "record_xpath": "//Stmt/n:Ntry"}).select("external_ref", "reco_id", "currency", "amount", "account", "direction", "value_date", "_error"))

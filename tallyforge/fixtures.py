"""Views of the given tables as inputs of ledger matching: SQL that Spark and an oracle both run.

Each view is a SELECT over ``{table}`` placeholders or over other views. Amounts are DECIMAL(20,4) before any
arithmetic; timestamps have no time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

PLAIN = "CASE WHEN l_orderkey % 11 = 0 THEN 'Not Supported' WHEN l_orderkey % 13 = 0 THEN NULL ELSE 'ORD' || l_orderkey END"
CURRENCY = "CASE WHEN l_orderkey % 10 < 8 THEN 'EUR' ELSE 'USD' END"
STATUS = "CASE WHEN l_orderkey % 4 <> 0 THEN 'PENDING' WHEN l_orderkey % 12 = 0 THEN 'FORCED' WHEN l_orderkey % 12 = 4 THEN 'MATCHED' ELSE 'EXCLUDED' END"

VIEWS = {
    # signed ledger legs: a credit per line, a debit per order that balances it except every third order
    "legs": f"""
        SELECT l_orderkey * 100 + l_linenumber AS id, CAST(l_orderkey % 5 AS INT) AS flow_id, CAST(l_suppkey % 12 AS INT) AS ingestion_run_id,
               {PLAIN} AS reco_id, 'ACC' || (l_orderkey % 7) AS account, {CURRENCY} AS currency,
               CAST(l_extendedprice AS DECIMAL(20,4)) AS amount, 'CREDIT' AS direction, l_shipdate AS value_date, l_shipdate AS operation_date,
               CASE WHEN l_returnflag = 'R' THEN 'RETURN' ELSE 'PAYMENT' END AS event_type, 'TX' || l_orderkey || '#' || l_linenumber AS external_ref,
               'file' || (l_suppkey % 4) || '.csv' AS file_name, 'REF' || l_partkey AS ref_no, 'RMK' || (l_partkey % 50) AS remarks_1,
               'PENDING' AS status, l_shipdate AS created_at, l_orderkey AS order_key
        FROM {{lineitem}}
        UNION ALL
        SELECT l_orderkey * 100, CAST(l_orderkey % 5 AS INT), CAST(min(l_suppkey) % 12 AS INT), {PLAIN}, 'ACC' || (l_orderkey % 7), {CURRENCY},
               CAST(-sum(CAST(l_extendedprice AS DECIMAL(20,4))) - CASE WHEN l_orderkey % 3 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(20,4)),
               'DEBIT', max(l_shipdate), max(l_shipdate), 'BOOKING', 'TX' || l_orderkey, 'ledger.csv', CAST(NULL AS {{text}}), 'RMK' || (l_orderkey % 50),
               'PENDING', max(l_shipdate), l_orderkey
        FROM {{lineitem}} GROUP BY l_orderkey""",
    # the same legs spread over the live and the settled ledger
    "entries": f"""
        SELECT id, flow_id, ingestion_run_id, reco_id, account, currency, amount, direction, value_date, operation_date, event_type, external_ref,
               file_name, ref_no, remarks_1, {STATUS.replace("l_orderkey", "order_key")} AS status, created_at,
               CASE WHEN order_key % 4 = 0 AND order_key % 12 <> 8 THEN value_date + INTERVAL 3 DAY END AS matched_at,
               CASE WHEN order_key % 4 = 0 THEN value_date + INTERVAL 4 DAY END AS settled_at, order_key FROM legs""",
    "live": "SELECT * FROM entries WHERE status = 'PENDING'",
    "settled": "SELECT * FROM entries WHERE status <> 'PENDING'",
    "payment": """
        SELECT l_orderkey || '-' || l_linenumber AS po_id, 'PACS' || l_suppkey AS pacs008, 'Msg' || (l_partkey % 20) AS message_id,
               'TR' || (l_orderkey % 1000) AS transaction_ref, CAST(l_extendedprice AS DECIMAL(20,4)) AS amount, l_shipdate AS created_on,
               CASE WHEN l_partkey % 7 = 0 THEN 'MULTI' WHEN l_partkey % 7 = 1 THEN 'WEB' ELSE 'SINGLE' END AS init_module,
               CASE WHEN l_returnflag = 'R' THEN 'RJCT' WHEN l_linestatus = 'O' THEN 'PDNG' ELSE 'ACCC' END AS status,
               'ORD' || l_orderkey AS reco_id, l_orderkey AS order_key, l_suppkey AS supp_key, l_partkey AS part_key
        FROM {lineitem}""",
    "payment_return": """
        SELECT 'RT' || l_orderkey || '-' || l_linenumber AS return_po, l_orderkey || '-' || l_linenumber AS original_po,
               CAST(l_extendedprice AS DECIMAL(20,4)) AS amount, l_shipdate AS created_on, 'RC' || (l_partkey % 5) AS reason
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    "payment_status": """
        SELECT reco_id, po_id, CASE WHEN order_key % 17 = 0 THEN NULL ELSE status END AS status, amount, created_on AS status_at, order_key FROM payment""",
    "movement": """
        SELECT o_orderkey AS movement_id, CAST(o_orderkey % 5 AS INT) AS flow_id, 'M' || o_orderkey AS transaction_id, CAST(o_totalprice AS DECIMAL(20,4)) AS amount,
               CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'C' END AS side, o_orderdate AS value_date,
               CASE o_orderkey % 10
                 WHEN 0 THEN 'SCTXB/O/' || o_orderkey WHEN 1 THEN 'NDGB/Msg' || (o_orderkey % 20) || '/y' WHEN 2 THEN 'NDRJ##' || o_orderkey || '-1'
                 WHEN 3 THEN 'SCTXB/NCP/O/' || o_orderkey || '-1/n' WHEN 4 THEN 'SCTXB/RCC/O/RT' || o_orderkey || '-1/n' WHEN 5 THEN 'BKRTP/TR' || (o_orderkey % 1000) || '/n'
                 WHEN 6 THEN 'NDRT##RT' || o_orderkey || '-1' WHEN 7 THEN 'plain text' WHEN 8 THEN 'REV SCRT1/A/B/REV' || o_orderkey ELSE 'SDDXB/X' || (o_orderkey - 9) || '/z' END AS particulars,
               CASE WHEN o_orderkey % 3 = 0 THEN 'TR' || (o_orderkey % 1000) END AS ref_no,
               CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'PACS' || (o_orderkey % 100) END AS remarks_1,
               CASE WHEN o_orderkey % 40 = 0 THEN 'Z6' ELSE 'W1' END AS channel, o_custkey AS cust_key
        FROM {orders}""",
    "exclusion": """
        SELECT o_orderkey * 100 AS entry_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS cancelled_at,
               'USR' || (o_custkey % 5) AS user_id, 'reason ' || (o_orderkey % 3) AS reason
        FROM {orders} WHERE o_orderstatus = 'P'""",
    "ingestion_run": """
        SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type AS source, CAST(min(event_id) AS BIGINT) AS run_id, CAST(count(*) AS BIGINT) AS rows_ok,
               CASE WHEN event_type = 'error' THEN 'FAILED' WHEN min(event_id) % 3 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, min(ts) AS started_at,
               CAST(min(user_id) % 5 AS INT) AS flow_id
        FROM {events} GROUP BY CAST(date_trunc('day', ts) AS DATE), event_type""",
    "change_log": """
        SELECT event_id, ts, 'U' || user_id AS user_id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'view' THEN 'UPDATE' WHEN 'purchase' THEN 'MATCH' WHEN 'click' THEN 'RETRY' ELSE 'FAILED' END AS action,
               value, props FROM {events}""",
    "flow": "SELECT CAST(r_regionkey AS INT) AS flow_id, r_name AS flow_name FROM {region}",
    # buckets: payments of a message and a pacs008; members: their lines
    "member": """
        SELECT 'B' || supp_key || '/' || (part_key % 20) AS bucket_id, 'H' || po_id || '/' || part_key || '/' || supp_key AS source_hash, po_id, pacs008, message_id,
               CASE WHEN order_key % 2 = 0 THEN amount ELSE CAST(-amount AS DECIMAL(20,4)) END AS amount, CASE WHEN order_key % 10 < 8 THEN 'EUR' ELSE 'USD' END AS currency,
               created_on AS value_date, CASE WHEN order_key % 3 = 0 THEN 'P' || (order_key % 40) END AS parent_hash, init_module AS kind,
               CASE WHEN order_key % 4 = 0 THEN 'MATCHED' ELSE 'PENDING' END AS status, order_key FROM payment""",
    "member_key": """
        SELECT source_hash, 'PACS008' AS key_type, pacs008 AS key_value FROM member UNION ALL
        SELECT source_hash, 'MSGID', upper(message_id) FROM member UNION ALL
        SELECT source_hash, 'PO', po_id FROM member""",
    "parent": """
        SELECT o_orderkey AS order_key, 'P' || (o_orderkey % 40) AS source_hash_base, 'P' || o_orderkey AS source_hash, CAST(o_custkey % 3 AS INT) AS source_id, 'MSGID' AS claim_type,
               CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'MSG' || (o_orderkey % 20) END AS claim_value, CAST(o_totalprice AS DECIMAL(20,4)) AS amount,
               o_orderdate AS value_date, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'EXT' || (o_orderkey % 500) END AS external_ref FROM {orders}""",
    "slice": """
        SELECT 'SL' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS source_hash, 'P' || (l_orderkey - l_orderkey % 8) AS parent_hash, 'B' || l_suppkey || '/' || (l_partkey % 20) AS bucket_id,
               CAST(l_extendedprice AS DECIMAL(20,4)) AS amount, CASE WHEN l_orderkey % 4 = 0 THEN 'SETTLED' ELSE 'LIVE' END AS store FROM {lineitem}""",
    # three cumulative exports of one feed; older ones lack columns that later ones fill
    "export_rows": """
        SELECT 1 AS file_no, l_orderkey || '-' || l_linenumber AS srl, CAST(l_extendedprice AS DECIMAL(20,4)) AS amount, CAST('' AS {text}) AS reason, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'MSG' || (l_partkey % 20) END AS pmsgid, l_partkey * 1000 + l_suppkey AS line_no FROM {lineitem} WHERE l_quantity < 20
        UNION ALL SELECT 2, l_orderkey || '-' || l_linenumber, CAST(l_extendedprice AS DECIMAL(20,4)), CASE WHEN l_partkey % 2 = 0 THEN 'R' || (l_partkey % 4) ELSE '' END, 'MSG' || (l_partkey % 20), l_partkey * 1000 + l_suppkey FROM {lineitem} WHERE l_quantity < 35
        UNION ALL SELECT 3, l_orderkey || '-' || l_linenumber, CAST(l_extendedprice AS DECIMAL(20,4)), '', CASE WHEN l_partkey % 100 = 0 THEN 'OTHER' ELSE 'MSG' || (l_partkey % 20) END, l_partkey * 1000 + l_suppkey FROM {lineitem}""",
    "link": """
        SELECT 'MSG' || CASE WHEN o_orderkey % 3 = 0 THEN '' || (o_orderkey % 400) ELSE 'X' || o_orderkey END AS pmsgid, CASE o_orderkey % 5 WHEN 0 THEN 'SCT' WHEN 1 THEN 'SDD' WHEN 2 THEN 'INST' WHEN 3 THEN 'RET' ELSE 'OTHER' END AS service, CAST(o_orderkey % 4 AS BIGINT) AS announced,
               CASE WHEN o_orderkey % 8 = 0 THEN CAST(0 AS DECIMAL(20,4)) ELSE CAST(o_totalprice AS DECIMAL(20,4)) END AS booked, o_orderkey AS link_id FROM {orders}""",
    "dump": """
        SELECT 'MSG' || CASE WHEN o_orderkey % 7 < 4 THEN '' || (o_orderkey % 400) WHEN o_orderkey % 7 < 6 THEN 'X' || o_orderkey ELSE 'Y' || o_orderkey END AS pmsgid, 'S' || o_orderkey AS srl, CAST(o_totalprice AS DECIMAL(20,4)) AS amount, o_orderkey AS dump_id FROM {orders}""",
    "particulars": "SELECT particulars, CAST(count(*) AS BIGINT) AS weight FROM movement GROUP BY particulars",
    "turns": "SELECT conv_id, turn, role, text FROM {conversations}",
}

NEEDS = {name: [v for v in VIEWS if v != name and f" {v}" in f" {sql} ".replace("\n", " ") and any(f"{k} {v}" in sql for k in ("FROM", "JOIN"))] for name, sql in VIEWS.items()}


def needed(names: list[str]) -> list[str]:
    """The views and all that they stand on, in order of definition."""
    out: list[str] = []

    def add(name: str) -> None:
        for below in NEEDS[name]:
            add(below)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def with_views(names: str, select: str) -> str:
    """SQL for the oracle: the views as common table expressions before a SELECT over them."""
    parts = [f"{n} AS ({VIEWS[n].format(text='VARCHAR', **{t: t for t in TABLES})})" for n in needed(names.split())]
    return f"WITH {', '.join(parts)} {select}" if parts else select


class Views:
    """The views and tables of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            sources = {t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in TABLES}
            parts = [f"{n} AS ({VIEWS[n].format(text='STRING', **sources)})" for n in needed([name])]
            return self.spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

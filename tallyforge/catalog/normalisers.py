"""Projections, filters, scalar normalisers and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import identity as I
from tallyforge.functions import normalise as N
from tallyforge.operators import filters as X
from tallyforge.queries import query

DEC = "DECIMAL(20,4)"
c = F.col

query(
    "filter_entries",
    "entries payment_status",
    """SELECT id, reco_id, amount, status, value_date FROM entries WHERE flow_id = 2 AND status IN ('PENDING', 'MATCHED') AND abs(amount) BETWEEN 1000 AND 60000 AND value_date >= TIMESTAMP '1993-01-01' AND value_date < TIMESTAMP '1998-01-01'
      AND (external_ref ILIKE '%tx1%' OR reco_id ILIKE '%ord2%' OR file_name ILIKE '%FILE1%') AND reco_id IN (SELECT reco_id FROM payment_status WHERE status = 'ACCC' OR status IS NULL)""",
)(
    lambda v: X.filter_entries(
        v.entries, v.payment_status, flow_id=2, statuses=["PENDING", "MATCHED"], amount_min=1000, amount_max=60000, date_from="1993-01-01", date_to="1997-12-31", texts={"external_ref": "tx1", "reco_id": "ord2", "file_name": "FILE1"}, payment_statuses=["ACCC", "?"]
    ).select("id", "reco_id", "amount", "status", "value_date")
)
query("filter_route_by_status", "live settled", "SELECT id, amount FROM settled WHERE status = 'FORCED'")(lambda v: X.stores_for(v.live, v.settled, "FORCED").filter("status = 'FORCED'").select("id", "amount"))
query("filter_status_drop", "payment_status", "SELECT reco_id, po_id, amount, status FROM payment_status WHERE status IS NULL OR lower(trim(status)) NOT IN ('rjct')")(
    lambda v: v.payment_status.filter(X.not_dropped(c("status"), ["RJCT"])).select("reco_id", "po_id", "amount", "status")
)
query("filter_text_search", "", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00000012%' OR c_mktsegment ILIKE 'auto%'")(lambda v: v.customer.filter(c("c_name").ilike("%00000012%") | c("c_mktsegment").ilike("auto%")).select("c_custkey", "c_name"))
query("scan_incremental", "movement", "SELECT movement_id, amount, value_date FROM movement WHERE flow_id IN (1, 3) AND value_date >= TIMESTAMP '1996-01-01'")(
    lambda v: X.since(v.movement, "value_date", "1996-01-01", flow_id=[1, 3]).select("movement_id", "amount", "value_date")
)
query("scan_weighted_text", "entries", "SELECT event_type AS tp, count(*) AS weight FROM entries GROUP BY 1")(lambda v: v.live.unionByName(v.settled).groupBy(c("event_type").alias("tp")).agg(F.count("*").alias("weight")))
query("scan_semi_join_extract", "movement", "SELECT m.movement_id, c.c_name, m.amount FROM movement m LEFT JOIN customer c ON c.c_custkey = m.cust_key AND c.c_acctbal > 0 WHERE m.flow_id IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA') AND m.value_date > TIMESTAMP '1995-06-01'")(
    lambda v: X.extract_for(
        v.movement.filter(c("value_date") > F.lit("1995-06-01").cast("timestamp_ntz")),
        v.region.filter("r_name <> 'ASIA'").select(c("r_regionkey").cast("int").alias("flow_id")),
        "flow_id",
        v.customer.filter("c_acctbal > 0").select(c("c_custkey").alias("cust_key"), "c_name"),
        "cust_key",
    ).select("movement_id", "c_name", "amount")
)

query("map_zero_on_match", "entries", f"SELECT id, external_ref, CAST(CASE WHEN lower(event_type) LIKE '%return%' THEN 0 ELSE amount END AS {DEC}) AS amount FROM entries")(lambda v: v.entries.select("id", "external_ref", N.zero_if(c("amount"), c("event_type"), "Return").alias("amount")))
query(
    "map_direction_by_keyword",
    "",
    """SELECT p_partkey, CASE WHEN rev THEN CASE d WHEN 'DEBIT' THEN 'CREDIT' WHEN 'CREDIT' THEN 'DEBIT' END ELSE d END AS direction FROM (SELECT p_partkey, lower(p_type) LIKE '%brass%' AS rev,
      CASE WHEN lower(p_type) LIKE '%promo%' THEN 'DEBIT' WHEN lower(p_type) LIKE '%standard%' THEN 'CREDIT' WHEN lower(p_type) LIKE '%plated%' THEN 'DEBIT' ELSE 'CREDIT' END AS d FROM part)""",
)(lambda v: v.part.select("p_partkey", N.direction_by_keyword(c("p_type"), [("promo", "DEBIT"), ("STANDARD", "CREDIT"), ("plated", "DEBIT")], "brass", "CREDIT").alias("direction")))
query("map_direction_by_code", "payment", "SELECT po_id, part_key, CASE init_module WHEN 'MULTI' THEN 'DEBIT' WHEN 'WEB' THEN 'CREDIT' ELSE CASE WHEN amount < 0 THEN 'DEBIT' ELSE 'CREDIT' END END AS direction FROM payment")(
    lambda v: v.payment.select("po_id", "part_key", N.direction_by_code(c("init_module"), {"MULTI": "DEBIT", "WEB": "CREDIT"}, c("amount")).alias("direction"))
)
query(
    "map_movement_entry",
    "movement",
    f"""SELECT movement_id, CAST(CASE WHEN side IN ('D', 'RD') THEN -abs(amount) ELSE abs(amount) END AS {DEC}) AS amount, CASE WHEN serial > 1 THEN transaction_id || '#' || serial ELSE transaction_id END AS external_ref, coalesce(NULL, 'EUR') AS currency
      FROM (SELECT *, movement_id % 3 AS serial FROM movement)""",
)(
    lambda v: v.movement.withColumn("serial", c("movement_id") % 3).select(
        "movement_id", N.signed(c("amount"), c("side")).cast(N.MONEY).alias("amount"), F.when(c("serial") > 1, F.concat_ws("#", "transaction_id", "serial")).otherwise(c("transaction_id")).alias("external_ref"), F.coalesce(F.lit(None).cast("string"), F.lit("EUR")).alias("currency")
    )
)
query("map_from_cents", "", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(round(l_extendedprice) AS BIGINT) / 100.0::DECIMAL(18,1) AS DECIMAL(20,2)) AS amount FROM lineitem".replace("/ 100.0::DECIMAL(18,1)", "* 0.01::DECIMAL(3,2)"))(
    lambda v: v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", N.from_cents(F.round("l_extendedprice").cast("long")).alias("amount"))
)
TEXT_AMOUNT = "CASE o_orderkey % 4 WHEN 0 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR), '.', ',') WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) WHEN 2 THEN ' ' || CAST(CAST(o_totalprice AS DECIMAL(20,0)) AS VARCHAR) || ',50 ' ELSE 'n/a' END"


def text_amount():
    return F.expr(TEXT_AMOUNT.replace("VARCHAR", "STRING"))


query("map_tolerant_decimal", "", f"SELECT o_orderkey, try_cast(replace(replace(x, ' ', ''), ',', '.') AS {DEC}) AS amount FROM (SELECT o_orderkey, {TEXT_AMOUNT} AS x FROM orders)")(lambda v: v.orders.select("o_orderkey", N.tolerant_decimal(text_amount()).alias("amount")))
query("map_strict_amount", "", f"SELECT o_orderkey, try_cast(x AS {DEC}) AS amount, CASE WHEN try_cast(x AS {DEC}) IS NULL THEN 'unreadable amount' END AS error FROM (SELECT o_orderkey, {TEXT_AMOUNT} AS x FROM orders)")(
    lambda v: v.orders.select("o_orderkey", *[x.alias(n) for x, n in zip(N.strict_amount(text_amount()), ("amount", "error"), strict=True)])
)
query("map_lenient_amount", "", f"SELECT o_orderkey, CAST(coalesce(try_cast(x AS {DEC}), 0) AS {DEC}) AS amount FROM (SELECT o_orderkey, {TEXT_AMOUNT} AS x FROM orders)")(lambda v: v.orders.select("o_orderkey", N.lenient_amount(text_amount()).alias("amount")))
query("map_int_date", "", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")(lambda v: v.orders.select("o_orderkey", N.int_date(F.date_format("o_orderdate", "yyyyMMdd").cast("int")).alias("day")))
query("map_short_date", "", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS day FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)")(
    lambda v: v.orders.filter("NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)").select("o_orderkey", N.short_date(F.date_format(c("o_orderdate") + F.expr("INTERVAL 20 YEAR"), "yyMMdd")).alias("day"))
)
query("map_time_ladder", "", "SELECT event_id, CASE event_id % 4 WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP WHEN 3 THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('second', ts) END AS at FROM events")(
    lambda v: v.events.select(
        "event_id",
        N.time_ladder(
            F.when(c("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(c("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(c("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "dd/MM/yyyy"))
        ).alias("at"),
    )
)
query("map_date_and_time", "", "SELECT event_id, date_trunc('second', ts) AS at FROM events")(lambda v: v.events.select("event_id", N.date_and_time(F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmmss").cast("int")).alias("at")))
query("map_entry_date", "", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) ELSE make_date(year(o_orderdate), month(o_orderdate), 1) END AS day FROM orders")(
    lambda v: v.orders.select("o_orderkey", N.entry_date(F.when(c("o_orderkey") % 5 == 0, F.lit("0230")).otherwise(F.concat(F.date_format("o_orderdate", "MM"), F.lit("01"))), F.to_date("o_orderdate")).alias("day"))
)
query("map_segments", "movement", "SELECT movement_id, CAST(len(s) AS INT) AS n, s[1] AS first, s[len(s)] AS last FROM (SELECT movement_id, CASE WHEN contains(particulars, '##') THEN string_split(particulars, '##') ELSE string_split(particulars, '/') END AS s FROM movement)")(
    lambda v: v.movement.withColumn("s", N.segments(c("particulars"))).select("movement_id", F.size("s").alias("n"), F.element_at("s", 1).alias("first"), F.element_at("s", -1).alias("last"))
)
query("map_end_to_end", "", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(md5(doc_id::VARCHAR)) ELSE left(upper(source || '-' || lang), 124) END AS e2e FROM documents")(
    lambda v: v.documents.select("doc_id", N.end_to_end(F.when(c("doc_id") % 2 == 0, F.regexp_replace(F.md5(c("doc_id").cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(F.concat_ws("-", "source", "lang"))).alias("e2e"))
)
query("map_shape_guard", "", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN TRUE ELSE FALSE END AS denied FROM customer")(
    lambda v: v.customer.select(
        "c_custkey",
        N.shaped_like_account(F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("be68"), F.lpad(c("c_custkey").cast("string"), 12, "0"))).when(c("c_custkey") % 3 == 1, F.md5(c("c_custkey").cast("string").cast("binary"))).otherwise(F.concat(F.lit("PACS"), c("c_custkey").cast("string")))).alias("denied"),
    )
)
query(
    "map_payment_order",
    "movement",
    """SELECT movement_id, CASE WHEN contains(particulars, '##') THEN s2[len(s2)] WHEN ref_no IS NOT NULL THEN ref_no ELSE nullif(trim(s1[4]), '') END AS po FROM (SELECT *, string_split(particulars, '##') AS s2, string_split(particulars, '/') AS s1 FROM movement)""",
)(lambda v: v.movement.select("movement_id", N.payment_order(c("particulars"), c("ref_no")).alias("po")))
query(
    "map_family",
    "movement",
    """SELECT movement_id, CASE WHEN f = 'NDRT' THEN 'RETURN' WHEN f = 'NDRJ' THEN 'REJECT' WHEN f = 'NDGB' THEN 'BULK_MESSAGE' WHEN f IN ('SWIFT', 'SCRT1', 'BKRTP', 'REV SCRT1') THEN 'INSTANT' WHEN f IN ('SCTXB', 'SDDXB', 'SDXBB') AND s IN ('I', 'O') THEN 'BULK'
      WHEN s IN ('RCC', 'RCP') THEN 'RETURN' WHEN s IN ('NCC', 'NCP', 'RRS') THEN 'SINGLE' ELSE 'UNKNOWN' END AS family FROM (SELECT movement_id, upper(trim(x[1])) AS f, coalesce(upper(trim(x[2])), '') AS s FROM (SELECT movement_id, CASE WHEN contains(particulars, '##') THEN string_split(particulars, '##') ELSE string_split(particulars, '/') END AS x FROM movement))""",
)(lambda v: v.movement.select("movement_id", N.family(c("particulars")).alias("family")))
query("map_reference_keys", "movement", "SELECT movement_id, unnest(list_distinct([remarks_1, CASE WHEN starts_with(remarks_1, 'PACS') THEN substring(remarks_1, 5) ELSE remarks_1 END])) AS k FROM movement")(lambda v: v.movement.select("movement_id", F.explode(N.reference_keys(c("remarks_1"), "PACS")).alias("k")))
query("map_segment_shape", "movement", "SELECT movement_id, CASE WHEN trim(x) = '' THEN 'EMPTY' WHEN regexp_full_match(x, '[0-9]+') THEN 'NUM' WHEN regexp_full_match(x, '[A-Za-z0-9]+') AND regexp_matches(x, '[0-9]') THEN 'ALNUM' ELSE 'TEXT' END AS shape FROM (SELECT movement_id, unnest(string_split(particulars, '/')) AS x FROM movement)")(
    lambda v: v.movement.select("movement_id", F.explode(F.transform(F.split("particulars", "/"), N.segment_shape)).alias("shape"))
)
query(
    "map_source_hashes",
    "entries",
    """SELECT id, amount, sha256(concat_ws('|', flow_id, coalesce(reco_id, ''), account, currency, amount, strftime(value_date, '%Y-%m-%dT%H:%M:%S+00:00'), external_ref)) AS file_hash, sha256(concat_ws('|', flow_id, account, currency, amount, strftime(value_date, '%Y-%m-%dT%H:%M:%S+00:00'), external_ref)) AS stable_hash,
      sha256(concat_ws('|', flow_id, external_ref, account, CAST(operation_date AS DATE))) AS ledger_hash FROM entries""",
)(
    lambda v: v.entries.select(
        "id",
        "amount",
        I.file_hash(c("flow_id"), c("reco_id"), c("account"), c("currency"), c("amount"), c("value_date"), c("external_ref")).alias("file_hash"),
        I.stable_hash(c("flow_id"), c("account"), c("currency"), c("amount"), c("value_date"), c("external_ref")).alias("stable_hash"),
        I.ledger_hash(c("flow_id"), c("external_ref"), c("account"), c("operation_date"), c("value_date")).alias("ledger_hash"),
    )
)
query("map_bucket_identity", "payment", "SELECT DISTINCT upper(pacs008) || '|' || upper(message_id) || '|' AS name, sha1(upper(pacs008) || '|' || upper(message_id) || '|') AS digest FROM payment")(
    lambda v: v.payment.select(I.bucket_name(c("pacs008"), c("message_id"), F.lit(None)).alias("name")).distinct().withColumn("digest", F.sha1("name"))
)
query(
    "map_bucket_uuid",
    "payment",
    f"""SELECT name, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS bucket_id
      FROM (SELECT name, sha1(from_hex('{I.NAMESPACE}') || encode(name)) AS h FROM (SELECT DISTINCT concat_ws('|', upper(coalesce(pacs008, '')), upper(coalesce(message_id, ''))) AS name FROM payment))""",
)(lambda v: v.payment.select(I.bucket_name(c("pacs008"), c("message_id")).alias("name")).distinct().withColumn("bucket_id", I.uuid5(c("name"))))
query("map_slice_reference", "slice", "SELECT source_hash, 'KEY:' || left(parent_hash, 88) || '~' || left(sha1(parent_hash), 8) || '~' || left(sha1(bucket_id), 10) AS ref FROM slice")(lambda v: v.slice.select("source_hash", I.slice_reference(c("parent_hash"), c("bucket_id")).alias("ref")))
query("map_payload_json", "change_log", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM change_log")(lambda v: v.change_log.select("event_id", F.get_json_object("props", "$.k").alias("k")))
query(
    "map_three_legs",
    "payment payment_return",
    f"""SELECT po_id AS external_ref, CAST(amount AS {DEC}) AS amount, 'CREDIT' AS direction FROM payment WHERE init_module = 'WEB' UNION ALL SELECT po_id, CAST(-amount AS {DEC}), 'DEBIT' FROM payment WHERE init_module = 'MULTI' UNION ALL SELECT original_po || '#RET', CAST(amount AS {DEC}), 'CREDIT' FROM payment_return""",
)(
    lambda v: v.payment.filter("init_module = 'WEB'").select(c("po_id").alias("external_ref"), c("amount").cast(N.MONEY).alias("amount"), F.lit("CREDIT").alias("direction"))
    .unionByName(v.payment.filter("init_module = 'MULTI'").select(c("po_id").alias("external_ref"), (-c("amount")).cast(N.MONEY).alias("amount"), F.lit("DEBIT").alias("direction")))
    .unionByName(v.payment_return.select(F.concat("original_po", F.lit("#RET")).alias("external_ref"), c("amount").cast(N.MONEY).alias("amount"), F.lit("CREDIT").alias("direction")))
)
query("map_extract_key", "movement", "SELECT movement_id, strftime(value_date, '%Y%m%d') || '-' || transaction_id || '-' || CASE WHEN movement_id < 100000 THEN lpad(movement_id::VARCHAR, 6, '0') ELSE movement_id::VARCHAR END AS reco_id FROM movement")(
    lambda v: v.movement.select("movement_id", N.extract_key(c("value_date"), c("transaction_id"), c("movement_id")).alias("reco_id"))
)

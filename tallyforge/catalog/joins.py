"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import aggregates as A
from tallyforge.operators import joins as J
from tallyforge.queries import query

c = F.col
DEC = "DECIMAL(20,4)"

query("join_key_lookup", "payment movement", "SELECT p.po_id, upper(p.pacs008) AS lookup_key, p.amount, p.part_key FROM payment p JOIN (SELECT DISTINCT upper(remarks_1) AS k FROM movement) m ON upper(p.pacs008) = m.k")(
    lambda v: J.key_lookup(v.movement, v.payment, "remarks_1", "pacs008").select("po_id", "lookup_key", "amount", "part_key")
)
RESOLVED = "SELECT {k}, min(coalesce(nullif(trim({a}), ''), nullif(trim({b}), ''))) AS resolved FROM payment GROUP BY 1"
query("join_po_to_pacs", "payment", RESOLVED.format(k="po_id", a="pacs008", b="message_id"))(lambda v: J.reference_of_payment(v.payment, v.payment, "po_id", "pacs008", "message_id"))
query("join_reference_to_message", "payment", RESOLVED.format(k="transaction_ref", a="message_id", b="pacs008"))(
    lambda v: J.reference_of_payment(v.payment, v.payment, "transaction_ref", "message_id", "pacs008")
)
HOPS = "SELECT return_po, r.original_po, pacs008, message_id FROM payment_return r {how} JOIN {p} p ON p.po_id = r.original_po"
query("join_two_hops", "payment payment_return", HOPS.format(how="", p="payment"))(lambda v: J.return_to_payment(v.payment_return, v.payment))
query("join_return_left", "payment payment_return", HOPS.format(how="LEFT", p="(SELECT * FROM payment WHERE init_module = 'SINGLE')"))(lambda v: J.return_to_payment(v.payment_return, v.payment.filter("init_module = 'SINGLE'"), "left"))
query(
    "join_fan_out",
    "payment payment_return",
    "SELECT po_id, message_id, amount, supp_key FROM payment WHERE message_id IN (SELECT message_id FROM payment WHERE po_id IN (SELECT original_po FROM payment_return))",
)(lambda v: J.fan_out(v.payment, v.payment_return.withColumnRenamed("original_po", "po_id")).select("po_id", "message_id", "amount", "supp_key"))
query(
    "join_range_fanout",
    "payment movement",
    f"""SELECT p.transaction_ref, count(*) AS n, CAST(sum(p.amount) AS {DEC}) AS total FROM payment p JOIN
      (SELECT ref_no AS transaction_ref, min(CAST(value_date AS DATE)) - 15 AS lo, max(CAST(value_date AS DATE)) + 6 AS hi FROM movement WHERE ref_no IS NOT NULL GROUP BY 1) w
      ON w.transaction_ref = p.transaction_ref AND CAST(p.created_on AS DATE) >= lo AND CAST(p.created_on AS DATE) < hi GROUP BY 1""",
)(
    lambda v: J.windowed_lookup(A.key_windows(v.movement.filter("ref_no is not null").withColumnRenamed("ref_no", "transaction_ref"), "transaction_ref", "value_date", 15, 5), v.payment, "transaction_ref", "created_on")
    .groupBy("transaction_ref")
    .agg(A.rows().alias("n"), A.total().alias("total"))
)
query(
    "join_pacs_payments",
    "payment movement",
    f"SELECT movement_id, n, total FROM movement JOIN (SELECT upper(pacs008) AS k, count(*) AS n, CAST(sum(amount) AS {DEC}) AS total FROM payment GROUP BY 1) p ON p.k = upper(remarks_1)",
)(lambda v: J.payments_behind(v.movement, v.payment, "remarks_1", "pacs008").select("movement_id", "n", "total"))
STATUSES = "SELECT movement_id, '{0}' AS field, status, n FROM (SELECT movement_id, {1} AS k FROM movement) m JOIN (SELECT upper({0}) AS k, status, count(*) AS n FROM payment GROUP BY 1, 2) p USING (k)"
query("join_status_lookups", "payment movement", " UNION ALL ".join(STATUSES.format(f, k) for f, k in (("po_id", "movement_id || '-1'"), ("pacs008", "upper(remarks_1)"), ("message_id", "upper('Msg' || movement_id % 20)"))))(
    lambda v: J.status_lookups(v.movement.select("movement_id", F.expr("movement_id || '-1'").alias("po_id"), c("remarks_1").alias("pacs008"), F.expr("'Msg' || movement_id % 20").alias("message_id")), v.payment, ["po_id", "pacs008", "message_id"])
)
query(
    "join_first_hit",
    "payment movement",
    """SELECT movement_id, coalesce(a.v, b.v) AS resolved, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 END AS tier FROM movement m
      LEFT JOIN (SELECT transaction_ref AS k, min(message_id) AS v FROM payment WHERE init_module = 'SINGLE' GROUP BY 1) a ON a.k = m.ref_no LEFT JOIN (SELECT pacs008 AS k, min(message_id) AS v FROM payment GROUP BY 1) b ON b.k = m.remarks_1""",
)(
    lambda v: J.first_hit(
        v.movement.select("movement_id", "ref_no", "remarks_1"),
        [("ref_no", v.payment.filter("init_module = 'SINGLE'").groupBy("transaction_ref").agg(F.min("message_id"))), ("remarks_1", v.payment.groupBy("pacs008").agg(F.min("message_id")))],
        "resolved",
    ).select("movement_id", "resolved", "tier")
)
query(
    "join_any_key",
    "entries",
    """SELECT lookup_key, count(*) AS hits, CAST(arg_min(store, (store, id, amount)) AS INT) AS store, arg_min(id, (store, id, amount)) AS id, arg_min(amount, (store, id, amount)) AS amount FROM
      (SELECT id, amount, CASE WHEN status = 'PENDING' THEN 0 ELSE 1 END AS store, unnest(list_distinct([reco_id, ref_no, remarks_1])) AS lookup_key FROM entries) WHERE lookup_key IN (SELECT 'RMK' || i FROM range(50) t(i) UNION SELECT 'ORD' || i FROM range(200) t(i)) GROUP BY 1""",
)(
    lambda v: J.any_key_lookup(
        v.spark.range(50).select(F.concat(F.lit("RMK"), F.col("id").cast("string")).alias("lookup_key")).unionByName(v.spark.range(200).select(F.concat(F.lit("ORD"), F.col("id").cast("string")).alias("lookup_key"))), v.entries
    )
)
query(
    "join_two_feeds",
    "payment payment_return",
    f"""SELECT coalesce(a.po_id, b.po_id) AS po_id, a.amount AS amount_1, b.amount AS amount_2, CASE WHEN a.po_id IS NOT NULL AND b.po_id IS NOT NULL THEN 'Y' ELSE 'N' END AS matched, CAST(coalesce(a.amount, 0) - coalesce(b.amount, 0) AS {DEC}) AS delta
      FROM (SELECT po_id, CAST(sum(amount) AS {DEC}) AS amount FROM payment WHERE init_module <> 'WEB' GROUP BY 1) a FULL JOIN (SELECT original_po AS po_id, CAST(sum(amount) AS {DEC}) AS amount FROM payment_return GROUP BY 1) b ON a.po_id = b.po_id""",
)(
    lambda v: J.two_feeds(
        v.payment.filter("init_module <> 'WEB'").groupBy("po_id").agg(A.total().alias("amount")), v.payment_return.withColumnRenamed("original_po", "po_id").groupBy("po_id").agg(A.total().alias("amount")), "po_id"
    )
)
query(
    "join_member_entry",
    "member live settled",
    "SELECT po_id, bucket_id, source_hash, coalesce(l.amount, s.amount) AS entry_amount, coalesce(l.status, s.status) AS entry_status FROM member m LEFT JOIN (SELECT order_key, amount, status FROM live WHERE direction = 'DEBIT') l ON l.order_key = m.order_key LEFT JOIN (SELECT order_key, amount, status FROM settled WHERE direction = 'DEBIT') s ON s.order_key = m.order_key",
)(
    lambda v: J.member_with_entry(
        v.member.select("po_id", "bucket_id", "source_hash", F.col("order_key").alias("entry_key")),
        v.live.filter("direction = 'DEBIT'").withColumn("entry_key", F.col("order_key")),
        v.settled.filter("direction = 'DEBIT'").withColumn("entry_key", F.col("order_key")),
    ).drop("entry_key")
)
query("join_status_semi", "entries payment_status", "SELECT id, reco_id, amount FROM entries WHERE reco_id IN (SELECT reco_id FROM payment_status WHERE status IN ('RJCT') OR status IS NULL)")(
    lambda v: J.with_status_in(v.entries, v.payment_status, ["RJCT", "?"]).select("id", "reco_id", "amount")
)
query("join_anti_known", "export_rows payment", "SELECT file_no, srl, amount FROM export_rows WHERE srl NOT IN (SELECT po_id FROM payment WHERE init_module = 'MULTI' UNION ALL SELECT po_id FROM payment WHERE init_module = 'WEB')")(
    lambda v: J.not_yet_known(v.export_rows, [v.payment.filter(c("init_module") == module).withColumnRenamed("po_id", "srl") for module in ("MULTI", "WEB")], "srl").select("file_no", "srl", "amount")
)
query(
    "join_reingestion_guard",
    "parent slice",
    """SELECT source_hash, amount FROM (SELECT *, CASE WHEN claim_value = '' THEN source_hash ELSE source_id || '|' || claim_type || '|' || claim_value END AS g FROM parent) p
      WHERE g IN (SELECT CASE WHEN claim_value = '' THEN source_hash ELSE source_id || '|' || claim_type || '|' || claim_value END FROM parent WHERE source_hash IN (SELECT parent_hash FROM slice WHERE amount > 50000))""",
)(lambda v: J.still_replaced(v.parent, v.slice.filter("amount > 50000")).select("source_hash", "amount"))
query("join_tuple_in", "member payment", "SELECT m.bucket_id, m.source_hash FROM member m WHERE (upper(m.pacs008), upper(m.message_id)) IN (SELECT (upper(pacs008), upper(message_id)) FROM payment WHERE init_module = 'MULTI')")(
    lambda v: v.member.join(v.payment.filter("init_module = 'MULTI'").select("pacs008", "message_id").distinct(), ["pacs008", "message_id"], "left_semi").select("bucket_id", "source_hash")
)
query(
    "join_active_exclusion",
    "entries exclusion",
    """SELECT e.id, e.amount, x.created_at AS excluded_at, x.user_id AS excluded_by, x.reason FROM entries e LEFT JOIN
      (SELECT * FROM exclusion WHERE created_at <= TIMESTAMP '1996-06-30' AND (cancelled_at IS NULL OR cancelled_at > TIMESTAMP '1996-06-30') QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY created_at DESC, user_id DESC, reason DESC) = 1) x ON x.entry_id = e.id""",
)(lambda v: J.active_at(v.entries, v.exclusion, "1996-06-30").select("id", "amount", "excluded_at", "excluded_by", "reason"))
query(
    "join_text_lookup",
    "movement",
    """WITH k AS (SELECT DISTINCT 'PACS' || i AS key FROM range(30) t(i) UNION SELECT 'MSG' || i FROM range(20) t(i) UNION SELECT 'PLAIN'),
      e AS (SELECT key, movement_id AS id, 'EXACT' AS stage FROM movement JOIN k ON upper(remarks_1) = key)
      SELECT key AS lookup_key, id, stage FROM e UNION ALL SELECT DISTINCT key, id, 'TEXT' FROM (SELECT movement_id AS id, upper(particulars) AS w FROM movement) JOIN k ON contains(w, key) WHERE key NOT IN (SELECT key FROM e)""".replace("WITH k", ", k"),
)(
    lambda v: J.text_lookup(
        v.spark.range(30).select(F.concat(F.lit("PACS"), F.col("id").cast("string")).alias("lookup_key")).unionByName(v.spark.range(20).select(F.concat(F.lit("MSG"), F.col("id").cast("string")).alias("lookup_key"))).unionByName(v.spark.range(1).select(F.lit("PLAIN").alias("lookup_key"))),
        v.movement.withColumn("id", F.col("movement_id")),
        "remarks_1",
        "particulars",
    )
)
query("join_base_reference", "entries movement", "SELECT id, split_part(external_ref, '#', 1) AS transaction_id, external_ref, amount FROM entries WHERE split_part(external_ref, '#', 1) IN (SELECT 'TX' || movement_id FROM movement)")(
    lambda v: J.base_reference(v.movement.withColumn("transaction_id", F.expr("'TX' || movement_id")), v.entries)
)
query(
    "join_resolve_target",
    "movement payment member",
    """, k AS (SELECT DISTINCT movement_id || '-1' AS lookup_key FROM movement), a AS (SELECT po_id AS lookup_key, count(DISTINCT bucket_id) AS n, min(bucket_id) AS t FROM member GROUP BY 1),
      b AS (SELECT po_id AS lookup_key, count(DISTINCT reco_id) AS n, min(reco_id) AS t FROM payment GROUP BY 1)
      SELECT lookup_key, CASE WHEN a.n > 0 THEN 1 WHEN b.n > 0 THEN 2 END AS tier, CASE WHEN a.n = 1 THEN a.t WHEN a.n IS NULL AND b.n = 1 THEN b.t END AS target,
      CASE WHEN coalesce(a.n, b.n) IS NULL THEN 'NONE' WHEN coalesce(a.n, b.n) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS outcome FROM k LEFT JOIN a USING (lookup_key) LEFT JOIN b USING (lookup_key)""",
)(
    lambda v: J.resolve_target(
        v.movement.select(F.expr("movement_id || '-1'").alias("lookup_key")), [v.member.select("po_id", "bucket_id"), v.payment.select("po_id", "reco_id")]
    )
)
query(
    "join_candidate_rates",
    "movement payment",
    """SELECT pair, count(*) AS rows, count(*) FILTER (hit) AS matched FROM (SELECT 'remarks_1=pacs008' AS pair, upper(remarks_1) IN (SELECT upper(pacs008) FROM payment) AS hit FROM movement UNION ALL SELECT 'ref_no=transaction_ref', coalesce(ref_no IN (SELECT transaction_ref FROM payment), FALSE) FROM movement) GROUP BY 1""",
)(lambda v: J.candidate_rates(v.movement.withColumn("row_id", F.col("movement_id")), v.payment, [("remarks_1", "pacs008"), ("ref_no", "transaction_ref")]))
query("join_dimensions", "ingestion_run flow", "SELECT flow_name, source, sum(rows_ok)::BIGINT AS rows_ok FROM ingestion_run JOIN flow USING (flow_id) GROUP BY 1, 2")(
    lambda v: v.ingestion_run.join(v.flow, "flow_id").groupBy("flow_name", "source").agg(F.sum("rows_ok").alias("rows_ok"))
)
query("join_file_semi", "payment payment_return", "SELECT po_id, amount FROM payment WHERE po_id IN (SELECT original_po FROM payment_return)")(
    lambda v: v.payment.join(v.payment_return.select(F.col("original_po").alias("po_id")).distinct(), "po_id", "left_semi").select("po_id", "amount")
)
BULK = "SELECT DISTINCT 'ORD' || order_key AS member_key, 'BULK' || (order_key % 20) AS bulk_key FROM payment WHERE init_module = 'MULTI'"
query("join_rekey_bulks", "entries payment", f"SELECT id, amount, CASE WHEN status = 'PENDING' THEN coalesce(bulk_key, reco_id) ELSE reco_id END AS reco_id, bulk_key IS NOT NULL AND status = 'PENDING' AS rekeyed FROM entries LEFT JOIN ({BULK}) ON member_key = reco_id")(
    lambda v: J.rekey_bulks(v.entries, v.payment.filter("init_module = 'MULTI'").select(F.expr("'ORD' || order_key").alias("member_key"), F.expr("'BULK' || (order_key % 20)").alias("bulk_key"))).select("id", "amount", "reco_id", "rekeyed")
)
query("join_known_keys", "movement entries", "SELECT DISTINCT 'ORD' || movement_id AS reco_id FROM movement WHERE 'ORD' || movement_id IN (SELECT reco_id FROM entries)")(
    lambda v: v.movement.select(F.expr("'ORD' || movement_id").alias("reco_id")).distinct().join(v.entries.select("reco_id"), "reco_id", "left_semi")
)

query("set_union_all", "live settled", f"SELECT flow_id, count(*) AS n, CAST(sum(amount) AS {DEC}) AS total FROM (SELECT * FROM live UNION ALL SELECT * FROM settled) GROUP BY 1")(
    lambda v: v.live.unionByName(v.settled).groupBy("flow_id").agg(A.rows().alias("n"), A.total().alias("total"))
)
query("set_union_distinct", "payment", "SELECT message_id FROM payment WHERE init_module = 'WEB' UNION SELECT message_id FROM payment WHERE init_module = 'MULTI'")(
    lambda v: v.payment.filter("init_module = 'WEB'").select("message_id").union(v.payment.filter("init_module = 'MULTI'").select("message_id")).distinct()
)
query("set_difference", "slice parent", "SELECT parent_hash FROM slice EXCEPT SELECT source_hash FROM parent WHERE amount > 100000")(lambda v: v.slice.select("parent_hash").subtract(v.parent.filter("amount > 100000").select("source_hash")))
query("set_distinct", "entries", "SELECT DISTINCT account, currency FROM entries")(lambda v: v.entries.select("account", "currency").distinct())
query("set_intersection", "payment movement", "SELECT pacs008 AS k FROM payment INTERSECT SELECT remarks_1 FROM movement")(lambda v: v.payment.select(F.col("pacs008").alias("k")).intersect(v.movement.select("remarks_1")))

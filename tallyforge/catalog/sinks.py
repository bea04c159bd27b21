"""Sinks: inserts, upserts, moves, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import merge as G
from tallyforge.queries import query

DEC = "DECIMAL(20,4)"
c = F.col
LASTROW = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY file_no DESC, line_no DESC, amount DESC) = 1"


def arrival():
    return [c("file_no"), c("line_no"), c("amount")]


def staged(v):
    return v.export_rows.filter("file_no >= 2")


def target(v):
    return v.export_rows.filter("file_no = 1").groupBy("srl").agg(F.max(F.struct("line_no", "amount", "pmsgid", "reason")).alias("x")).select("srl", "x.amount", "x.pmsgid", "x.reason", "x.line_no").withColumn("file_no", F.lit(1))


TARGET = "SELECT srl, arg_max(amount, (line_no, amount)) AS amount, arg_max(pmsgid, (line_no, amount)) AS pmsgid, arg_max(reason, (line_no, amount)) AS reason, max(line_no) AS line_no, 1 AS file_no FROM export_rows WHERE file_no = 1 GROUP BY 1"
STAGED = f"SELECT * FROM export_rows WHERE file_no >= 2 {LASTROW.format(k='srl')}"

query("sink_insert_new", "export_rows", "SELECT srl, file_no, amount FROM export_rows WHERE file_no >= 2 AND srl NOT IN (SELECT srl FROM export_rows WHERE file_no = 1) QUALIFY row_number() OVER (PARTITION BY srl ORDER BY file_no, line_no, amount) = 1")(
    lambda v: G.insert_new(target(v), staged(v), "srl", arrival()).select("srl", "file_no", "amount")
)
UPSERT = f"""SELECT coalesce(t.srl, s.srl) AS srl, CASE WHEN t.srl IS NULL THEN s.amount WHEN s.srl IS NOT NULL AND t.line_no % 2 = 0 THEN s.amount ELSE t.amount END AS amount, CASE WHEN t.srl IS NULL THEN s.pmsgid WHEN s.srl IS NOT NULL AND t.line_no % 2 = 0 THEN coalesce(nullif(s.pmsgid, ''), t.pmsgid) ELSE t.pmsgid END AS pmsgid,
  CASE WHEN t.srl IS NULL THEN 'INSERTED' WHEN s.srl IS NULL THEN 'KEPT' WHEN t.line_no % 2 = 0 AND (s.amount IS DISTINCT FROM t.amount OR coalesce(nullif(s.pmsgid, ''), t.pmsgid) IS DISTINCT FROM t.pmsgid) THEN 'UPDATED' ELSE 'UNCHANGED' END AS change FROM ({TARGET}) t FULL JOIN ({STAGED}) s ON s.srl = t.srl"""


def merged(v):
    policy = {"amount": "new", "pmsgid": F.coalesce(F.nullif(c("new_pmsgid"), F.lit("")), c("old_pmsgid"))}
    return G.upsert(target(v), staged(v), "srl", policy, arrival(), guard=c("old_line_no") % 2 == 0)


query("sink_upsert", "export_rows", UPSERT)(lambda v: merged(v).select("srl", "amount", "pmsgid", "change"))
query("sink_upsert_counts", "export_rows", f"SELECT change, count(*) AS n FROM ({UPSERT}) GROUP BY 1")(lambda v: G.changes(merged(v)))
query("sink_key_accrual", "member_key", "SELECT DISTINCT source_hash, key_type, key_value FROM member_key WHERE (source_hash, key_type, key_value) NOT IN (SELECT (source_hash, key_type, key_value) FROM member_key WHERE key_type = 'PO')".replace("SELECT (source_hash, key_type, key_value)", "SELECT source_hash, key_type, key_value"))(
    lambda v: v.member_key.dropDuplicates(["source_hash", "key_type", "key_value"]).join(v.member_key.filter("key_type = 'PO'"), ["source_hash", "key_type", "key_value"], "left_anti")
)
query("sink_bucket_create", "member", "SELECT DISTINCT bucket_id FROM member WHERE bucket_id NOT IN (SELECT bucket_id FROM member WHERE kind = 'MULTI')")(lambda v: v.member.select("bucket_id").distinct().join(v.member.filter("kind = 'MULTI'").select("bucket_id"), "bucket_id", "left_anti"))
STATUS = "SELECT po_id, arg_max(status, (coalesce(status, ''), amount)) AS status, max(amount) AS amount FROM payment_status {w} GROUP BY 1"


def statuses(v, where):
    return v.payment_status.filter(where).groupBy("po_id").agg(F.max_by("status", F.struct(F.coalesce("status", F.lit("")), "amount")).alias("status"), F.max("amount").alias("amount"))


query(
    "sink_status_change_only",
    "payment_status",
    f"""SELECT coalesce(t.po_id, s.po_id) AS po_id, CASE WHEN t.po_id IS NULL THEN 'INSERTED' WHEN s.po_id IS NULL THEN 'KEPT' WHEN s.status IS DISTINCT FROM t.status OR s.amount IS DISTINCT FROM t.amount THEN 'UPDATED' ELSE 'UNCHANGED' END AS change
      FROM ({STATUS.format(w='WHERE order_key % 3 <> 0')}) t FULL JOIN (SELECT po_id, CASE WHEN hash_even THEN 'DONE' ELSE status END AS status, amount FROM (SELECT *, length(po_id) % 2 = 0 AS hash_even FROM ({STATUS.format(w='WHERE order_key % 5 <> 0')}))) s ON s.po_id = t.po_id""",
)(
    lambda v: G.upsert(
        statuses(v, "order_key % 3 <> 0"), statuses(v, "order_key % 5 <> 0").withColumn("status", F.when(F.length("po_id") % 2 == 0, "DONE").otherwise(c("status"))), "po_id", {"status": "new", "amount": "new"}, [c("po_id")]
    ).select("po_id", "change")
)
query("sink_settle", "live settled", "SELECT id, amount, external_ref FROM settled UNION ALL SELECT id, amount, external_ref FROM live WHERE flow_id = 1 AND external_ref NOT IN (SELECT external_ref FROM settled)")(
    lambda v: G.settle(v.live, v.settled, c("flow_id") == 1, "external_ref")[1].select("id", "amount", "external_ref")
)
query("sink_unsettle", "settled live", f"SELECT id, amount, 'PENDING' AS status FROM settled WHERE status = 'EXCLUDED' UNION ALL SELECT id, amount, status FROM live")(
    lambda v: (lambda out: out[1].select("id", "amount", F.when(c("status") == "EXCLUDED", "PENDING").otherwise(c("status")).alias("status")))(G.settle(v.settled, v.live, c("status") == "EXCLUDED", "id"))
)
query("sink_reset_flow", "entries payment_status", "SELECT reco_id, po_id FROM payment_status WHERE reco_id IN (SELECT reco_id FROM entries WHERE flow_id <> 3)")(
    lambda v: G.reset({"entries": v.entries, "status": v.payment_status.select("reco_id", "po_id")}, 3, {"status": ("entries", "reco_id")})["status"]
)
query(
    "sink_export_entries",
    "live payment_status",
    """SELECT id, CAST(amount AS VARCHAR) AS amount, strftime(value_date, '%Y-%m-%d') AS day, coalesce(p, '') AS payments FROM live LEFT JOIN (SELECT reco_id, string_agg(n || ' ' || s, ' · ' ORDER BY n DESC, s) AS p FROM (SELECT reco_id, coalesce(status, '?') AS s, count(*) AS n FROM payment_status GROUP BY 1, 2) GROUP BY 1) USING (reco_id)""",
)(lambda v: export(v))


def export(v):
    from tallyforge.operators.aggregates import status_histogram
    from tallyforge.operators.stores import joined_by_key

    return joined_by_key(v.live, status_histogram(v.payment_status).select("reco_id", "statuses")).select("id", c("amount").cast("string").alias("amount"), F.date_format("value_date", "yyyy-MM-dd").alias("day"), F.coalesce("statuses", F.lit("")).alias("payments"))

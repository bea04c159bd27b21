"""Operation types, configured legs, payloads, graphs of buckets, proposals of unsupported flows, lists and extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.catalog.plans import CONTROL, HIT, MS
from tallyforge.functions import normalise as N
from tallyforge.operators import stores as T
from tallyforge.plans import buckets as B
from tallyforge.plans import legs as G
from tallyforge.plans import reattribution as R
from tallyforge.queries import query
from tallyforge.session import shared_folder

DEC = "DECIMAL(20,4)"
c = F.col

FACTS = """CASE init_module WHEN 'WEB' THEN 'wero' WHEN 'MULTI' THEN CASE WHEN part_key % 2 = 0 THEN 'WeroEMC' ELSE 'other' END END AS module,
  CASE part_key % 5 WHEN 0 THEN 'x ncp y' WHEN 1 THEN 'NCC' WHEN 2 THEN '' END AS source, CASE WHEN order_key % 4 = 0 THEN 'emc' END AS payment_type, CASE WHEN supp_key % 6 = 0 THEN 'MATCH' ELSE '' END AS vop"""
TYPED = """CASE WHEN module = 'wero' THEN 'P2P' WHEN module = 'WeroEMC' THEN 'EMC' WHEN source = 'x ncp y' THEN 'P2P' WHEN source = 'NCC' THEN 'EMC' WHEN payment_type = 'emc' OR vop <> '' THEN 'EMC' ELSE 'UNKNOWN' END"""
def facts(v):
    """Payments with what tells of their operation."""
    kind = F.when(c("init_module") == "WEB", "wero").when((c("init_module") == "MULTI") & (c("part_key") % 2 == 0), "WeroEMC").when(c("init_module") == "MULTI", "other")
    n = c("part_key") % 5
    source = F.when(n == 0, "x ncp y").when(n == 1, "NCC").when(n == 2, "")
    return v.payment.select("*", kind.alias("module"), source.alias("source"), F.when(c("order_key") % 4 == 0, "emc").alias("payment_type"), F.when(c("supp_key") % 6 == 0, "MATCH").otherwise("").alias("vop"))


query("map_operation_chain", "payment", f"SELECT po_id, part_key, {TYPED} AS kind FROM (SELECT *, {FACTS} FROM payment)")(
    lambda v: facts(v).select("po_id", "part_key", N.operation_type_of(c("module"), c("source"), c("payment_type"), c("vop")).alias("kind"))
)


def feeds(v):
    alone = lambda n, far: F.when(c("order_key") % n == 0, -c("order_key") - far).otherwise(c("order_key")).alias("order_key")
    left = v.payment.groupBy(alone(3, 0)).agg(F.sum("amount").cast("decimal(20,4)").alias("amount"))
    right = facts(v).groupBy(alone(5, 1_000_000_000)).agg(F.sum("amount").cast("decimal(20,4)").alias("amount"), *[F.max(x).alias(x) for x in ("module", "source", "payment_type", "vop")])
    return G.marked_feeds(left, right, "order_key", F.lit("2024-01-05"), F.lit("10:00"))


query(
    "join_marked_feeds",
    "payment",
    f""", l AS (SELECT CASE WHEN order_key % 3 = 0 THEN -order_key ELSE order_key END AS k, sum(amount) AS a FROM payment GROUP BY 1), r AS (SELECT CASE WHEN order_key % 5 = 0 THEN -order_key - 1000000000 ELSE order_key END AS k, sum(amount) AS b, max(module) AS module, max(source) AS source, max(payment_type) AS payment_type, max(vop) AS vop FROM (SELECT *, {FACTS} FROM payment) GROUP BY 1)
      SELECT coalesce(l.k, r.k) AS order_key, CASE WHEN l.k = r.k THEN 'Y' ELSE 'N' END AS matched, CAST(coalesce(a, 0) - coalesce(b, 0) AS {DEC}) AS delta, CASE WHEN l.k = r.k THEN '2024-01-05' END AS mark_off_day, CASE WHEN l.k = r.k THEN '10:00' END AS mark_off_time, {TYPED} AS operation_type FROM l FULL JOIN r ON l.k = r.k""",
)(lambda v: feeds(v).select("order_key", "matched", "delta", "mark_off_day", "mark_off_time", "operation_type"))

#: A feed whose columns have names of their own; statuses and modules come as people type them.
SCHEME = {"scheme_ref": "ref", "scheme_amount": "paid", "scheme_status": "state", "scheme_statuses": [" accc ", "PDNG"], "payment_ref": "e2e", "payment_day": "created_on", "payment_modules": ["MULTI", " WEB "], "return_amount": "amount", "unknown": "ignored"}
SINCE = "1995-06-01"


def configured(v):
    p = v.payment.withColumn("e2e", F.concat(F.lit("w-"), c("order_key").cast("string")))
    scheme = p.select(c("e2e").alias("ref"), c("amount").alias("paid"), F.lower("status").alias("state"), c("created_on").alias("day"))
    return G.configured_entries(scheme, p, v.payment_return, SCHEME, F.lit(SINCE).cast("timestamp_ntz"), 7)


query(
    "plan_configured_legs",
    "payment payment_return",
    f""", p AS (SELECT *, 'W-' || order_key AS k FROM payment)
      SELECT k AS reco_id, 'w-' || order_key AS external_ref, abs(amount) AS amount, 'SCHEME' AS event_type FROM p WHERE status IN ('ACCC', 'PDNG') AND created_on >= TIMESTAMP '{SINCE}'
      UNION ALL SELECT k, po_id, -abs(amount), 'PAYMENT' FROM p WHERE init_module IN ('MULTI', 'WEB') AND created_on >= TIMESTAMP '{SINCE}'
      UNION ALL SELECT k, return_po || '#RET', abs(r.amount), 'RETURN' FROM payment_return r JOIN p ON p.po_id = r.original_po WHERE init_module IN ('MULTI', 'WEB') AND p.created_on >= TIMESTAMP '{SINCE}'""",
)(lambda v: configured(v).select("reco_id", "external_ref", "amount", "event_type"))
query(
    "map_payload_to_json",
    "movement",
    """SELECT movement_id, '{"movement_id":' || movement_id || ',"amount":"' || amount || '","value_date":"' || strftime(value_date, '%Y-%m-%dT%H:%M:%S') || '","ref_no":' || CASE WHEN ref_no IS NULL THEN 'null' ELSE '"' || ref_no || '"' END || ',"side":"' || side || '"}' AS payload FROM movement""",
)(lambda v: v.movement.select("movement_id", N.payload_json(v.movement, ["movement_id", "amount", "value_date", "ref_no", "side"]).alias("payload")))


def graph(v, part: int):
    return B.graph_parts(v.member, v.member_key)[part]


WAY = "CASE WHEN amount < 0 THEN 'debit' ELSE 'credit' END"
query("plan_graph_keys", "member member_key", "SELECT bucket_id, key_type, count(DISTINCT key_value) AS values, count(DISTINCT source_hash) AS members FROM member JOIN member_key USING (source_hash) GROUP BY 1, 2")(lambda v: graph(v, 0))
query(
    "plan_graph_members",
    "member",
    f"SELECT bucket_id, kind, {WAY} AS direction, count(*) AS members, CAST(sum(amount) AS {DEC}) AS net, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'MATCHED') AS matched, count(*) FILTER (status = 'EXCLUDED') AS excluded FROM member GROUP BY 1, 2, 3",
)(lambda v: graph(v, 1))
query("plan_graph_triples", "member member_key", f"SELECT DISTINCT bucket_id, kind, {WAY} AS direction, key_type FROM member JOIN member_key USING (source_hash)")(lambda v: graph(v, 2))


def proposals(v):
    m = v.entries.filter("direction = 'DEBIT'").select(F.expr(HIT).alias("pmsgid"), "status", "flow_id")
    live = m.filter("status in ('PENDING', 'MATCHED')")
    return R.proposal_status(R.conservation_control(v.link, v.dump), live, m.filter("status = 'FORCED'"), v.link.filter("link_id % 2 = 0"), v.dump.filter("dump_id % 3 = 0"), live.filter("flow_id = 2"))


query(
    "plan_proposal_flows",
    "link dump entries",
    f""", m AS (SELECT x.*, e.flow_id FROM ({MS}) x JOIN (SELECT order_key, flow_id FROM entries WHERE direction = 'DEBIT') e USING (order_key)), h AS (SELECT pmsgid, count(*) AS n, bool_and(status = 'PENDING') AS p, bool_or(flow_id = 2) AS f FROM m WHERE status IN ('PENDING', 'MATCHED') GROUP BY 1)
      SELECT c.link_id, CASE WHEN found = 0 THEN 'NO_DUMP_ROWS' WHEN h.n > 1 THEN 'ENTRY_AMBIGUOUS' WHEN h.n IS NULL AND s THEN 'EMARGED' WHEN h.n IS NULL AND k AND NOT t THEN 'ALREADY_COMMITTED' WHEN h.f THEN 'FLOW_UNSUPPORTED' WHEN h.n IS NULL AND k THEN 'TO_REPLAY' WHEN h.n IS NULL THEN 'ENTRY_NOT_FOUND'
      WHEN NOT h.p THEN 'ENTRY_NOT_PENDING' WHEN NOT t THEN 'NO_TARGET' WHEN k THEN 'TO_RECOMMIT' ELSE 'PROPOSED' END AS status FROM (SELECT *, pmsgid IN (SELECT pmsgid FROM m WHERE status = 'FORCED') AS s, pmsgid IN (SELECT pmsgid FROM link WHERE link_id % 2 = 0) AS k, pmsgid IN (SELECT pmsgid FROM dump WHERE dump_id % 3 = 0) AS t FROM ({CONTROL})) c LEFT JOIN h USING (pmsgid)""",
)(lambda v: proposals(v).select("link_id", "status"))
query("page_match_groups", "entries", "SELECT flow_id, reco_id, created_at FROM (SELECT flow_id, reco_id, max(matched_at) AS created_at FROM entries WHERE status = 'MATCHED' AND reco_id IS NOT NULL GROUP BY 1, 2) WHERE flow_id = 1 ORDER BY created_at DESC, reco_id DESC LIMIT 100")(
    lambda v: T.listed(v.entries.filter("status = 'MATCHED' AND reco_id IS NOT NULL").groupBy("flow_id", "reco_id").agg(F.max("matched_at").alias("created_at")), {"flow_id": 1}, "created_at", "reco_id")
)
query("page_runs", "ingestion_run", "SELECT run_id, source, status, started_at FROM ingestion_run WHERE status = 'SUCCESS' ORDER BY started_at DESC, run_id DESC LIMIT 100 OFFSET 5")(
    lambda v: T.listed(v.ingestion_run, {"flow_id": None, "status": "SUCCESS"}, "started_at", "run_id", 5).select("run_id", "source", "status", "started_at")
)
query("page_user_actions", "change_log", "SELECT event_id, ts, user_id, action FROM change_log WHERE action = 'UPDATE' AND user_id = (SELECT min(user_id) FROM change_log WHERE action = 'UPDATE') ORDER BY ts DESC, event_id DESC LIMIT 100")(
    lambda v: T.listed(v.change_log.join(F.broadcast(v.change_log.filter("action = 'UPDATE'").agg(F.min("user_id").alias("user_id"))), "user_id"), {"action": "UPDATE"}, "ts", "event_id").select("event_id", "ts", "user_id", "action")
)
query("page_kept_runs", "ingestion_run", "SELECT run_id, started_at FROM ingestion_run ORDER BY started_at DESC, run_id DESC LIMIT 50")(lambda v: T.kept_runs(v.ingestion_run).select("run_id", "started_at"))
query(
    "sink_family_extract",
    "dump",
    "SELECT 'event' || (dump_id % 5) || CASE dump_id % 4 WHEN 0 THEN '_o' WHEN 1 THEN '_o' WHEN 2 THEN '_i' ELSE '' END AS family, count(*) AS rows, count(DISTINCT srl) AS keys FROM dump GROUP BY 1",
)(
    lambda v: T.write_by_family(
        v.dump.select(N.export_family(F.expr("'Event' || (dump_id % 5) || CASE dump_id % 4 WHEN 0 THEN '_O.csv' WHEN 1 THEN '_0.CSV' WHEN 2 THEN '_i.csv' ELSE '.csv' END")).alias("family"), c("srl").alias("key"), "pmsgid", F.concat(F.lit('a "b"; c\n'), c("pmsgid")).alias("note")), shared_folder(v.spark, "extract"), "key"
    )
)

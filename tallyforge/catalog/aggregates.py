"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import aggregates as A
from tallyforge.queries import query

DEC = "DECIMAL(20,4)"
c = F.col
MATCHABLE = "status = 'PENDING' AND reco_id IS NOT NULL AND reco_id <> 'Not Supported'"
GROUPS = f"SELECT flow_id, reco_id, currency, CAST(sum(amount) AS {DEC}) AS total, count(*) AS n FROM entries WHERE {MATCHABLE} GROUP BY ALL"
KPIS = f"""SELECT flow_id, status, count(*) AS n, CAST(sum(amount) AS {DEC}) AS net, CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS {DEC}) AS credit,
  CAST(coalesce(sum(amount) FILTER (amount < 0), 0) AS {DEC}) AS debit FROM entries"""

query("agg_balanced_groups", "entries", f"SELECT * FROM ({GROUPS}) WHERE total = 0")(lambda v: A.balanced_groups(v.entries))
query("agg_pending_groups", "entries", GROUPS)(lambda v: A.pending_groups(v.entries))
query("agg_flow_kpis", "entries", f"{KPIS} GROUP BY flow_id, status")(lambda v: A.flow_kpis(v.live.unionByName(v.settled)))
query("agg_kpis_at_run", "entries", f"{KPIS} WHERE ingestion_run_id <= 5 GROUP BY flow_id, status")(lambda v: A.kpis_at_run(v.entries, 5))
query("agg_oldest_pending", "live", "SELECT flow_id, min(value_date) AS oldest FROM live GROUP BY flow_id")(lambda v: A.oldest_pending(v.live))
query(
    "agg_daily_ingestion",
    "ingestion_run",
    "SELECT flow_id, CAST(day(r.day) AS INT) AS dom, CAST(sum(rows_ok) AS BIGINT) AS rows_ok, count(*) FILTER (status = 'FAILED') AS failed FROM ingestion_run r WHERE year(r.day) = 2024 AND month(r.day) = 1 GROUP BY ALL",
)(lambda v: A.daily_ingestion(v.ingestion_run, 2024, 1))
query(
    "agg_dashboard",
    "flow entries",
    f"""SELECT f.flow_id, flow_name, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status IN ('MATCHED', 'FORCED')) AS matched, count(*) FILTER (status = 'EXCLUDED') AS excluded,
      count(*) FILTER (created_at >= TIMESTAMP '1996-01-01') AS fresh, CAST(coalesce(sum(amount) FILTER (status = 'PENDING'), 0) AS {DEC}) AS pending_net FROM flow f LEFT JOIN entries e ON e.flow_id = f.flow_id GROUP BY ALL""",
)(lambda v: A.dashboard(v.flow, v.entries, "1996-01-01"))

SUMMARY = f"""SELECT bucket_id, CAST(count(*) AS BIGINT) AS member_count, CAST(sum(amount) AS {DEC}) AS net, CAST(coalesce(sum(amount) FILTER (amount < 0), 0) AS {DEC}) AS debit, CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS {DEC}) AS credit,
  count(DISTINCT currency) AS currencies, any_value(unb) AS unbalanced, min(value_date) AS first_date, max(value_date) AS last_date, CAST(count(*) FILTER (status = 'PENDING') AS BIGINT) AS pending, CAST(count(*) FILTER (status = 'MATCHED') AS BIGINT) AS matched
  FROM member JOIN (SELECT bucket_id, count(*) FILTER (s <> 0) AS unb FROM (SELECT bucket_id, currency, sum(amount) AS s FROM member GROUP BY ALL) GROUP BY bucket_id) USING (bucket_id) GROUP BY bucket_id"""
query("agg_bucket_summary", "member", SUMMARY)(lambda v: A.bucket_summary(v.member))
query("agg_bucket_state", "member", f"SELECT *, CASE WHEN pending = 0 AND matched > 0 THEN 'matched' ELSE 'pending' END AS state, unbalanced = 0 AS is_balanced FROM ({SUMMARY})")(lambda v: A.bucket_state(A.bucket_summary(v.member)))
query(
    "agg_row_changes",
    "",
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'INSERT' WHEN o_orderkey % 10 = 1 THEN 'DELETE' ELSE 'UPDATE' END AS action,
      CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS old_status, CASE WHEN o_orderkey % 10 <> 1 THEN CASE WHEN o_orderkey % 10 = 2 THEN 'X' ELSE o_orderstatus END END AS new_status FROM orders WHERE o_orderkey % 10 < 3""",
)(
    lambda v: A.row_changes(
        v.orders.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
        v.orders.filter("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("id"), F.when(F.expr("o_orderkey % 10 = 2"), F.lit("X")).otherwise(F.col("o_orderstatus")).alias("status")),
        "id",
        ["status"],
    )
)
query(
    "agg_status_histogram",
    "payment_status",
    """SELECT reco_id, string_agg(n || ' ' || status, ' · ' ORDER BY n DESC, status) AS statuses, CAST(sum(n) AS BIGINT) AS payments, min(lo) AS first_at, max(hi) AS last_at
      FROM (SELECT reco_id, coalesce(status, '?') AS status, count(*) AS n, min(status_at) AS lo, max(status_at) AS hi FROM payment_status GROUP BY 1, 2) GROUP BY reco_id""",
)(lambda v: A.status_histogram(v.payment_status))
query("agg_status_options", "payment_status", "SELECT coalesce(status, '?') AS status, count(*) AS n FROM payment_status GROUP BY 1")(lambda v: A.status_options(v.payment_status))
query("agg_bucket_flags", "member", "SELECT bucket_id, bool_and(parent_hash IS NOT NULL) AS synthetic_only, bool_or(parent_hash IS NOT NULL) AS any_slice FROM member GROUP BY 1")(lambda v: A.bucket_flags(v.member))
query("agg_parent_totals", "parent", f"SELECT source_id, claim_type, claim_value, CAST(sum(amount) AS {DEC}) AS total, count(*) AS n FROM parent WHERE claim_value <> '' GROUP BY ALL")(
    lambda v: v.parent.filter("claim_value <> ''").groupBy("source_id", "claim_type", "claim_value").agg(A.total().alias("total"), A.rows().alias("n"))
)
HUBS = "SELECT key_type, key_value, count(DISTINCT source_hash) AS members FROM member_key GROUP BY 1, 2 HAVING count(DISTINCT source_hash) >= 2"
query("agg_hub_keys", "member_key", HUBS)(lambda v: A.hub_keys(v.member_key))
query(
    "agg_hub_signatures",
    "member member_key",
    f"""SELECT coalesce(signature, '') AS signature, count(*) AS members, CAST(sum(amount) AS {DEC}) AS net FROM member LEFT JOIN
      (SELECT source_hash, array_to_string(list_sort(list(DISTINCT key_type || '=' || key_value)), '|') AS signature FROM member_key JOIN ({HUBS}) USING (key_type, key_value) GROUP BY source_hash) USING (source_hash) GROUP BY 1""",
)(lambda v: A.hub_signatures(v.member, v.member_key))
query("agg_members_by_kind", "member", f"SELECT kind, CASE WHEN amount < 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction, count(*) AS n, CAST(sum(amount) AS {DEC}) AS net, count(*) FILTER (status = 'PENDING') AS pending FROM member GROUP BY 1, 2")(
    lambda v: A.members_by_kind(v.member)
)
query("agg_key_types", "member_key", "SELECT key_type, count(DISTINCT key_value) AS key_values, count(*) AS links FROM member_key GROUP BY 1")(lambda v: A.key_types(v.member_key))
query("agg_key_values", "member_key", "SELECT key_value, count(DISTINCT source_hash) AS members FROM member_key WHERE key_type = 'MSGID' GROUP BY 1")(lambda v: A.key_values(v.member_key, "MSGID"))
query(
    "agg_casing_conflicts",
    "payment",
    "SELECT upper(m) AS folded, string_agg(DISTINCT m, ',' ORDER BY m) AS spellings, count(DISTINCT m) AS n_spellings, count(*) AS n FROM (SELECT CASE WHEN supp_key % 3 = 0 THEN upper(message_id) ELSE message_id END AS m FROM payment) GROUP BY 1 HAVING count(DISTINCT m) > 1",
)(lambda v: A.casing_conflicts(v.payment.withColumn("m", F.expr("CASE WHEN supp_key % 3 = 0 THEN upper(message_id) ELSE message_id END")), "m"))
query("agg_bulk_groups", "payment", "SELECT message_id, count(DISTINCT po_id) AS members, bool_or(init_module = 'MULTI') AS multiline FROM payment GROUP BY 1 HAVING count(DISTINCT po_id) >= 2 OR bool_or(init_module = 'MULTI')")(lambda v: A.bulk_groups(v.payment))
query("agg_key_windows", "payment", "SELECT pacs008, CAST(min(CAST(created_on AS DATE)) - 15 AS DATE) AS date_from, CAST(max(CAST(created_on AS DATE)) + 6 AS DATE) AS date_to FROM payment GROUP BY 1")(
    lambda v: A.key_windows(v.payment, "pacs008", "created_on", 15, 5)
)
query("agg_feed_statistics", "export_rows", "SELECT file_no, count(*) AS rows, count(nullif(pmsgid, '')) AS with_key, count(DISTINCT nullif(pmsgid, '')) AS keys FROM export_rows GROUP BY 1")(lambda v: A.feed_statistics(v.export_rows, "file_no", "pmsgid"))
query(
    "agg_match_rates",
    "payment payment_return",
    "SELECT status, count(DISTINCT po_id) AS keys, count(DISTINCT CASE WHEN h IS NOT NULL THEN po_id END) AS matched, round(100.0::DOUBLE * count(DISTINCT CASE WHEN h IS NOT NULL THEN po_id END) / nullif(count(DISTINCT po_id), 0), 2) AS pct FROM payment LEFT JOIN (SELECT DISTINCT original_po AS h FROM payment_return) ON h = po_id GROUP BY 1",
)(lambda v: A.match_rates(v.payment, v.payment_return.withColumnRenamed("original_po", "po_id"), "po_id", "status"))
#: A basket for every order: its legs; of every seventh with an id that is nowhere, of every ninth with the next order's
#: booking as well, of every eleventh with ids twice.
BASKETS = """SELECT order_key AS basket_id, id FROM entries UNION ALL SELECT o_orderkey, o_orderkey * 100 + 99 FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, (o_orderkey + 1) * 100 FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT order_key, id FROM entries WHERE order_key % 11 = 0"""
BASKET_SQL = f""", b AS (SELECT DISTINCT basket_id, id FROM ({BASKETS})),
  j AS (SELECT basket_id, count(*) AS n, count(live.id) AS found, count(DISTINCT flow_id) AS flows, count(DISTINCT currency) AS currencies, CAST(coalesce(sum(amount), 0) AS {DEC}) AS total,
        coalesce(string_agg(b.id::VARCHAR, ',' ORDER BY b.id) FILTER (live.id IS NULL), '') AS missing, CASE WHEN min(reco_id) = max(reco_id) THEN min(reco_id) END AS reco_id
        FROM b LEFT JOIN live ON live.id = b.id GROUP BY 1),
  r AS (SELECT *, CASE WHEN found < n THEN 'NOT_FOUND' WHEN flows <> 1 THEN 'FLOWS' WHEN currencies <> 1 THEN 'CURRENCIES' WHEN total <> 0 THEN 'NOT_BALANCED' END AS why FROM j),
  f AS (SELECT b.id, min(basket_id) AS first FROM b JOIN r USING (basket_id) WHERE why IS NULL GROUP BY 1),
  q AS (SELECT r.*, coalesce(why, CASE WHEN basket_id IN (SELECT basket_id FROM b JOIN f USING (id) WHERE basket_id <> first) THEN 'TAKEN' END) AS refusal FROM r)"""


def baskets(v):
    legs = v.entries.select(c("order_key").alias("basket_id"), "id")
    key = c("o_orderkey")
    lost = v.orders.filter(key % 7 == 0).select(key, key * 100 + 99)
    foreign = v.orders.filter(key % 9 == 0).select(key, (key + 1) * 100)
    return legs.union(lost).union(foreign).union(legs.filter("basket_id % 11 = 0"))


query("agg_basket_check", "entries live", BASKET_SQL + " SELECT basket_id, n, flows, currencies, total, missing, reco_id, refusal, refusal IS NULL AS may_match FROM q")(
    lambda v: A.basket_check(v.live, baskets(v)).select("basket_id", "n", "flows", "currencies", "total", "missing", "reco_id", "refusal", "may_match")
)
query("agg_snapshot_counts", "entries", "SELECT status, count(*) AS n FROM entries GROUP BY 1")(lambda v: v.entries.groupBy("status").agg(A.rows().alias("n")))
query("agg_search_groups", "entries", f"SELECT reco_id, currency, CAST(sum(amount) AS {DEC}) AS total, count(*) AS n, sum(amount) = 0 AS is_balanced FROM entries WHERE reco_id LIKE 'ORD1%' GROUP BY 1, 2")(
    lambda v: v.entries.filter(F.col("reco_id").startswith("ORD1")).groupBy("reco_id", "currency").agg(A.total().alias("total"), A.rows().alias("n")).withColumn("is_balanced", F.col("total") == 0)
)

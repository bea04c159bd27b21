"""Composite pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import aggregates as A
from tallyforge.plans import buckets as B
from tallyforge.plans import keys as K
from tallyforge.plans import matching as M
from tallyforge.plans import reattribution as R
from tallyforge.catalog.aggregates import BASKET_SQL, baskets
from tallyforge.queries import query

DEC = "DECIMAL(20,4)"
c = F.col
GROUPS = "SELECT flow_id, reco_id, currency FROM live WHERE reco_id IS NOT NULL AND reco_id <> 'Not Supported' GROUP BY ALL HAVING sum(amount) = 0"

query(
    "plan_auto_match",
    "live",
    f"SELECT id, amount, external_ref, CASE WHEN (flow_id, reco_id, currency) IN ({GROUPS}) THEN 'MATCHED' ELSE status END AS status, CASE WHEN (flow_id, reco_id, currency) IN ({GROUPS}) THEN sha256(concat_ws('|', 'run', flow_id, reco_id, currency)) END AS match_group FROM live",
)(lambda v: M.auto_match(v.live, "run")[1].select("id", "amount", "external_ref", "status", "match_group"))
query(
    "plan_run_counters",
    "live",
    f"""SELECT (SELECT count(*) FROM ({GROUPS})) AS groups, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) AS pending, CAST(coalesce(sum(amount) FILTER (hit), 0) AS {DEC}) AS matched_net FROM (SELECT amount, coalesce((flow_id, reco_id, currency) IN ({GROUPS}), FALSE) AS hit FROM live)""",
)(lambda v: M.run_counters(v.live))
query(
    "plan_force_match",
    "entries live",
    BASKET_SQL + " SELECT id, amount, CASE WHEN id IN (SELECT b.id FROM b JOIN q USING (basket_id) WHERE refusal IS NULL) THEN 'FORCED' ELSE status END AS status FROM live",
)(lambda v: M.force_match(v.live, baskets(v))[1].select("id", "amount", "status"))
query("plan_exclude", "live settled exclusion", "SELECT id, amount, CASE WHEN status = 'PENDING' THEN 'EXCLUDED' ELSE status END AS status FROM (SELECT * FROM settled UNION ALL SELECT * FROM live WHERE id IN (SELECT entry_id FROM exclusion WHERE cancelled_at IS NULL))")(
    lambda v: M.exclude(v.live, v.settled, v.exclusion)[1].select("id", "amount", "status")
)
T = "TIMESTAMP '1996-01-01'"
query(
    "plan_snapshot",
    "live settled exclusion",
    f"""SELECT id, flow_id, reco_id, amount, value_date, external_ref, state FROM (
      SELECT *, CASE WHEN id IN (SELECT entry_id FROM exclusion WHERE created_at <= {T} AND (cancelled_at IS NULL OR cancelled_at > {T})) THEN 'EXCLUDED' ELSE 'PENDING' END AS state FROM live WHERE created_at <= {T}
      UNION ALL SELECT *, CASE WHEN settled_at <= {T} THEN status ELSE 'PENDING' END FROM settled WHERE created_at <= {T})""",
)(lambda v: M.snapshot(v.live, v.settled, v.exclusion, "1996-01-01"))
query("plan_daily_activity", "change_log", "SELECT l.user_id, u.user_name, action, count(*) AS n FROM change_log l LEFT JOIN (SELECT 'U' || (2 * c_custkey) AS user_id, c_name AS user_name FROM customer) u USING (user_id) WHERE CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY ALL")(
    lambda v: M.daily_activity(v.change_log, v.customer.select(F.expr("'U' || (2 * c_custkey)").alias("user_id"), c("c_name").alias("user_name")), "2024-01-05")
)
query("plan_identifier_index", "entries member", """SELECT DISTINCT reco_id, field, upper(value) AS value FROM (SELECT reco_id, 'reco_id' AS field, reco_id AS value FROM entries UNION ALL SELECT reco_id, 'external_ref', external_ref FROM entries UNION ALL SELECT reco_id, 'ref_no', ref_no FROM entries UNION ALL SELECT reco_id, 'remarks_1', remarks_1 FROM entries
      UNION ALL SELECT 'ORD' || order_key, 'po_id', po_id FROM member UNION ALL SELECT 'ORD' || order_key, 'bucket_id', bucket_id FROM member) WHERE value IS NOT NULL AND reco_id IS NOT NULL""")(lambda v: M.identifier_index(v.entries, v.member))
query("plan_deep_search", "entries", "SELECT id, reco_id, amount, status FROM entries WHERE reco_id IN (SELECT reco_id FROM entries WHERE remarks_1 = 'RMK7' AND reco_id IS NOT NULL) ORDER BY value_date, id, amount, external_ref LIMIT 2000")(
    lambda v: M.deep_search(M.identifiers(v.entries, v.member), v.entries, "rmk7")
)
query("plan_merge_chains", "", "SELECT o_orderkey AS node, CAST(min(o_orderkey) OVER (PARTITION BY (o_orderkey - 1) // 7) AS BIGINT) AS root FROM orders QUALIFY count(*) OVER (PARTITION BY (o_orderkey - 1) // 7) = 7 OR FALSE")(
    lambda v: M.merge_chains(
        v.spark,
        # chains of seven orders, closed to a ring
        v.orders.select(c("o_orderkey").alias("old"), F.when((c("o_orderkey") - 1) % 7 == 6, c("o_orderkey") - 6).otherwise(c("o_orderkey") + 1).alias("new"))
        .withColumn("chain", F.expr("(old - 1) div 7"))
        .join(v.orders.groupBy(F.expr("(o_orderkey - 1) div 7").alias("chain")).count().filter("count = 7"), "chain", "left_semi"),
    )
)

# ---- keys of movements
SEG = "CASE WHEN contains(particulars, '##') THEN string_split(particulars, '##') ELSE string_split(particulars, '/') END"
BULKMAP = "SELECT CASE WHEN order_key % 2 = 0 THEN transaction_ref ELSE 'no ' || transaction_ref END AS k, min(message_id) AS v FROM payment GROUP BY 1"
query(
    "plan_settlement_keys",
    "movement payment payment_return",
    f""", s AS (SELECT *, {SEG} AS seg FROM movement), t AS (SELECT *, upper(trim(seg[1])) AS f, coalesce(upper(trim(seg[2])), '') AS g, len(seg) AS n, nullif(trim(seg[4]), '') AS p4, CASE WHEN contains(particulars, '##') THEN nullif(trim(seg[len(seg)]), '') ELSE nullif(trim(seg[4]), '') END AS rpo, nullif(trim(ref_no), '') AS ref FROM s),
      j AS (SELECT t.*, r.v AS vr, p.v AS vp, x.v AS vx, b.v AS vb FROM t LEFT JOIN (SELECT return_po AS k, min(original_po) AS v FROM payment_return GROUP BY 1) r ON r.k = rpo LEFT JOIN (SELECT po_id AS k, min(reco_id) AS v FROM payment GROUP BY 1) p ON p.k = p4
      LEFT JOIN (SELECT 'X' || order_key AS k, min(reco_id) AS v FROM payment GROUP BY 1) x ON x.k = seg[2] LEFT JOIN ({BULKMAP}) b ON b.k = ref)
      SELECT movement_id, CASE rule WHEN 'channel' THEN ref WHEN 'no_segments' THEN 'Not Supported' WHEN 'return' THEN vr WHEN 'instant' THEN coalesce(vb, ref) WHEN 'instant_reversal' THEN seg[4] WHEN 'instant_single' THEN NULL WHEN 'bulk' THEN nullif(trim(remarks_1), '') WHEN 'bulk_return' THEN vr WHEN 'bulk_single' THEN vp
      WHEN 'other_return' THEN vr WHEN 'other_single' THEN vp ELSE coalesce(vx, 'Not Supported') END AS reco_id, rule FROM (SELECT *, CASE WHEN channel IN ('Z6', 'Z9') THEN 'channel' WHEN particulars IS NULL OR n <= 1 THEN 'no_segments' WHEN f = 'NDRT' THEN 'return'
      WHEN f IN ('SWIFT', 'SCRT1', 'BKRTP', 'REV SCRT1') AND ref IS NOT NULL THEN 'instant' WHEN f = 'REV SCRT1' AND n > 3 THEN 'instant_reversal' WHEN f IN ('SWIFT', 'SCRT1', 'BKRTP', 'REV SCRT1') AND g IN ('NCC', 'NCP', 'RRS') THEN 'instant_single'
      WHEN f IN ('SCTXB', 'SDDXB', 'SDXBB') AND g IN ('I', 'O') THEN 'bulk' WHEN f IN ('SCTXB', 'SDDXB', 'SDXBB') AND g IN ('RCC', 'RCP') THEN 'bulk_return' WHEN f IN ('SCTXB', 'SDDXB', 'SDXBB') AND g IN ('NCC', 'NCP', 'RRS') AND n >= 4 THEN 'bulk_single' WHEN f IN ('SCTXB', 'SDDXB', 'SDXBB') THEN 'bulk_other'
      WHEN g IN ('RCC', 'RCP') THEN 'other_return' WHEN g IN ('NCC', 'NCP', 'RRS') AND n >= 4 THEN 'other_single' ELSE 'other' END AS rule FROM j)""",
)(
    lambda v: K.settlement_keys(
        v.movement,
        v.payment.groupBy("po_id").agg(F.min("reco_id")),
        v.payment.groupBy(F.expr("'X' || order_key")).agg(F.min("reco_id")),
        v.payment_return.groupBy("return_po").agg(F.min("original_po")),
        v.payment.groupBy(F.expr("CASE WHEN order_key % 2 = 0 THEN transaction_ref ELSE 'no ' || transaction_ref END")).agg(F.min("message_id")),
    ).select("movement_id", "reco_id", "rule")
)

# ---- buckets
RESOLVED = "SELECT order_key AS movement_id, po_id, CASE WHEN supp_key % 9 = 0 THEN '' ELSE pacs008 END AS pacs008, CASE WHEN part_key % 11 = 0 THEN NULL ELSE message_id END AS message_id, amount FROM payment"
PARTS = f"""SELECT movement_id, kind, bucket, CAST(sum(amount) AS {DEC}) AS amount, count(*) AS n FROM (SELECT *, CASE WHEN p IS NOT NULL AND m IS NOT NULL THEN 'PAIR' WHEN p IS NOT NULL THEN 'PACS_ONLY' ELSE 'PO' END AS kind,
  CASE WHEN p IS NOT NULL AND m IS NOT NULL THEN p || '/' || m WHEN p IS NOT NULL THEN p ELSE upper(po_id) END AS bucket FROM (SELECT *, nullif(upper(pacs008), '') AS p, upper(message_id) AS m FROM ({RESOLVED}))) GROUP BY ALL"""


def resolved(v):
    return v.payment.select(
        c("order_key").alias("movement_id"), "po_id", F.expr("CASE WHEN supp_key % 9 = 0 THEN '' ELSE pacs008 END").alias("pacs008"), F.expr("CASE WHEN part_key % 11 = 0 THEN NULL ELSE message_id END").alias("message_id"), "amount"
    )


query("plan_partition_payments", "payment", PARTS)(lambda v: B.partition_payments(resolved(v)))
query(
    "plan_movements",
    "movement payment",
    f""", p AS ({PARTS}), a AS (SELECT movement_id, count(*) AS buckets, count(*) FILTER (amount <> 0) AS nz, arg_min(bucket, (-abs(amount), bucket)) AS b FROM p GROUP BY 1)
      SELECT m.movement_id, coalesce(buckets, 0) AS buckets, CASE WHEN buckets IS NULL THEN 'UNRESOLVED' WHEN buckets = 1 OR nz <= 1 THEN 'WHOLE' ELSE 'SPLIT' END AS outcome, CASE WHEN buckets = 1 OR nz <= 1 THEN b END AS bucket FROM movement m LEFT JOIN a USING (movement_id)""",
)(lambda v: B.plan_movements(v.movement, B.partition_payments(resolved(v))).select("movement_id", "buckets", "outcome", "bucket"))
ANCHOR = "SELECT source_id, claim_type, claim_value, source_hash AS anchor FROM parent WHERE claim_value <> '' QUALIFY row_number() OVER (PARTITION BY source_id, claim_type, claim_value ORDER BY value_date, external_ref NULLS LAST, source_hash) = 1"
CLAIMS = f"SELECT source_id, claim_type, claim_value, CAST(sum(amount) AS {DEC}) AS parent_total, count(*) AS parents FROM parent WHERE claim_value <> '' GROUP BY ALL"
query(
    "plan_claim_slices",
    "parent payment",
    f"""SELECT g.source_id, g.claim_value, anchor, bucket, parents, CAST(abs(s) * CASE WHEN parent_total < 0 THEN -1 ELSE 1 END AS {DEC}) AS slice_amount, 'KEY:' || left(g.claim_value, 88) || '~' || left(sha1(g.claim_value), 8) || '~' || left(sha1(bucket), 10) AS slice_ref
      FROM ({CLAIMS}) g JOIN ({ANCHOR}) a USING (source_id, claim_type, claim_value) JOIN (SELECT upper(message_id) AS claim_value, pacs008 AS bucket, sum(amount) AS s FROM payment GROUP BY 1, 2 HAVING sum(amount) <> 0) p ON p.claim_value = g.claim_value""",
)(lambda v: B.claim_slices(v.parent, v.payment.groupBy(F.upper("message_id").alias("claim_value"), c("pacs008").alias("bucket")).agg(A.total().alias("amount"))))
query(
    "plan_second_matching",
    "parent slice member",
    f"""SELECT bucket_id, bool_or(coalesce(differs, FALSE)) AS parent_mismatch FROM (SELECT bucket_id, parent_hash FROM member) m LEFT JOIN (SELECT anchor, parent_total <> coalesce(t, 0) AS differs FROM ({CLAIMS}) JOIN ({ANCHOR}) USING (source_id, claim_type, claim_value)
      LEFT JOIN (SELECT parent_hash, sum(amount) AS t FROM slice GROUP BY 1) s ON s.parent_hash = anchor) d ON d.anchor = m.parent_hash GROUP BY 1""",
)(lambda v: B.second_matching(v.parent, v.slice, v.member))
query(
    "plan_split_detail",
    "parent slice",
    f"""SELECT source_id, claim_type, claim_value, anchor AS parent_hash, parents, parent_total, coalesce(n, 0) AS slices, CAST(coalesce(t, 0) AS {DEC}) AS slice_total, greatest, CAST(parent_total - coalesce(t, 0) AS {DEC}) AS delta FROM ({CLAIMS}) JOIN ({ANCHOR}) USING (source_id, claim_type, claim_value)
      LEFT JOIN (SELECT parent_hash, sum(amount) AS t, count(*) AS n, CAST(max(abs(amount)) AS {DEC}) AS greatest FROM slice GROUP BY 1) s ON s.parent_hash = anchor""",
)(lambda v: B.split_detail(v.parent, v.slice))
query("plan_stale_slices", "slice", "SELECT source_hash, parent_hash FROM slice WHERE store = 'LIVE' AND parent_hash IN (SELECT parent_hash FROM slice WHERE amount > 30000) AND source_hash NOT IN (SELECT source_hash FROM slice WHERE amount > 30000)")(
    lambda v: B.stale_slices(v.slice, v.slice.filter("amount > 30000")).select("source_hash", "parent_hash")
)
query("plan_bucket_graph", "member", "SELECT bucket_id, kind, status, count(*) AS n, round(least(7.0::DOUBLE, 1.5::DOUBLE + log10(count(*)) * 1.2::DOUBLE), 6) AS width FROM member GROUP BY 1, 2, 3")(lambda v: B.bucket_graph(v.member))

# ---- reattribution, orphans, patterns
CONTROL = f"""SELECT link_id, l.pmsgid, announced, booked, coalesce(found, 0) AS found, CAST(coalesce(dumped, 0) AS {DEC}) AS dumped, CASE WHEN n > 1 THEN 'DUPLICATE_MOVEMENT' WHEN found IS NULL THEN 'NOT_FOUND' WHEN booked = 0 AND dumped <> 0 THEN 'NOT_SETTLED'
  WHEN found <> announced THEN 'COUNT_MISMATCH' WHEN dumped <> round(booked, 2) THEN 'AMOUNT_MISMATCH' ELSE 'OK' END AS verdict FROM (SELECT *, count(*) OVER (PARTITION BY pmsgid) AS n FROM link) l LEFT JOIN (SELECT pmsgid, count(*) AS found, round(sum(amount), 2) AS dumped FROM dump GROUP BY 1) d ON d.pmsgid = l.pmsgid"""
query("plan_conservation_control", "link dump", CONTROL)(lambda v: R.conservation_control(v.link, v.dump))
query("plan_control_summary", "link dump", f"SELECT verdict, count(*) AS n FROM ({CONTROL}) GROUP BY 1")(lambda v: R.conservation_control(v.link, v.dump).groupBy("verdict").agg(A.rows().alias("n")))
query(
    "plan_group_slices",
    "payment",
    f"SELECT message_id AS pmsgid, pacs008 AS target, CAST(sum(amount) AS {DEC}) AS amount, count(DISTINCT po_id) AS payments, CASE WHEN count(DISTINCT po_id) <= 50 THEN string_agg(DISTINCT po_id, ',' ORDER BY po_id) END AS po_list FROM payment GROUP BY 1, 2",
)(lambda v: R.group_slices(v.payment.select(c("message_id").alias("pmsgid"), c("pacs008").alias("target"), "po_id", "amount")))
HIT = "'MSG' || CASE WHEN order_key % 8 < 2 THEN order_key - order_key % 2 ELSE order_key END"
MS = f"SELECT {HIT} AS pmsgid, status, order_key FROM entries WHERE direction = 'DEBIT'"
query(
    "plan_proposal_status",
    "link dump entries",
    f""", m AS ({MS}), h AS (SELECT pmsgid, count(*) AS n, bool_and(status = 'PENDING') AS p FROM m WHERE status IN ('PENDING', 'MATCHED') GROUP BY 1)
      SELECT c.link_id, c.verdict, CASE WHEN found = 0 THEN 'NO_DUMP_ROWS' WHEN h.n > 1 THEN 'ENTRY_AMBIGUOUS' WHEN h.n IS NULL AND s THEN 'EMARGED' WHEN h.n IS NULL AND k AND NOT t THEN 'ALREADY_COMMITTED' WHEN h.n IS NULL AND k THEN 'TO_REPLAY' WHEN h.n IS NULL THEN 'ENTRY_NOT_FOUND'
      WHEN NOT h.p THEN 'ENTRY_NOT_PENDING' WHEN NOT t THEN 'NO_TARGET' WHEN k THEN 'TO_RECOMMIT' ELSE 'PROPOSED' END AS status FROM (SELECT *, pmsgid IN (SELECT pmsgid FROM m WHERE status = 'FORCED') AS s, pmsgid IN (SELECT pmsgid FROM link WHERE link_id % 2 = 0) AS k, pmsgid IN (SELECT pmsgid FROM dump WHERE dump_id % 3 = 0) AS t FROM ({CONTROL})) c LEFT JOIN h USING (pmsgid)""",
)(
    lambda v: (
        lambda m: R.proposal_status(
            R.conservation_control(v.link, v.dump), m.filter("status in ('PENDING', 'MATCHED')"), m.filter("status = 'FORCED'"), v.link.filter("link_id % 2 = 0"), v.dump.filter("dump_id % 3 = 0")
        )
    )(v.entries.filter("direction = 'DEBIT'").select(F.expr(HIT).alias("pmsgid"), "status", "order_key")).select("link_id", "verdict", "status")
)
MIXED = "SELECT pmsgid, CASE WHEN dump_id % 3 = 0 THEN -amount WHEN dump_id % 101 = 0 THEN 0 ELSE amount END AS amount FROM dump"
BOOKED = "CASE WHEN link_id % 2 = 0 THEN -booked ELSE booked END * (link_id % 9)"
query(
    "plan_slice_guard",
    "link dump",
    f"""SELECT link_id, pmsgid, booked, sign, sliced, refusal, refusal IS NULL AS may_commit FROM (SELECT link_id, l.pmsgid, booked, CASE WHEN booked < 0 THEN -1 ELSE 1 END AS sign, CAST(coalesce(s, 0) AS {DEC}) AS sliced,
      CASE WHEN s IS NULL THEN 'NO_SLICE' WHEN z THEN 'ZERO_SLICE' WHEN s > abs(booked) THEN 'EXCEEDS_BOOKING' END AS refusal
      FROM (SELECT link_id, pmsgid, CAST({BOOKED} AS {DEC}) AS booked FROM link) l LEFT JOIN (SELECT pmsgid, sum(abs(amount)) AS s, bool_or(amount = 0) AS z FROM ({MIXED}) GROUP BY 1) d ON d.pmsgid = l.pmsgid)""",
)(
    lambda v: R.slice_guard(
        v.dump.withColumn("amount", F.when(c("dump_id") % 3 == 0, -c("amount")).when(c("dump_id") % 101 == 0, 0).otherwise(c("amount")).cast(A.MONEY)), v.link.withColumn("booked", F.expr(BOOKED).cast(A.MONEY))
    )
)
PF = "concat_ws(' ', particulars, CASE WHEN movement_id % 6 = 0 THEN 'ref 9' || lpad(movement_id::VARCHAR, 7, '0') END, CASE WHEN movement_id % 12 = 0 THEN 'PF1234567' END)"
query(
    "plan_orphans",
    "movement entries",
    f""", m AS (SELECT movement_id, {PF} AS p, CASE WHEN movement_id % 5 = 0 THEN 'A##ORD' || movement_id END AS ref FROM movement),
      r AS (SELECT movement_id, nullif(trim(string_split(ref, '##')[-1]), '') AS r1, nullif(regexp_extract(p, '^[^/]*/(?:NCC|NCP|RRS|RCC|RCP)/[IO]/([^/]{{4,}})', 1, 'i'), '') AS r2, list_distinct(regexp_extract_all(p, '\\b(?:PF|P|S)([0-9]{{6,}})\\b', 0)) AS r3, list_distinct(regexp_extract_all(p, '\\b[0-9]{{6,}}\\b', 0)) AS r4 FROM m),
      k AS (SELECT movement_id, CASE WHEN r1 IS NOT NULL THEN [r1] WHEN r2 IS NOT NULL THEN [r2] WHEN len(r3) > 0 THEN r3 ELSE r4 END AS ks FROM r)
      SELECT movement_id, array_to_string(list_sort(ks), ',') AS keys, CASE WHEN len(ks) = 0 THEN 'NO_KEY' WHEN len(ks) > 1 THEN 'KEY_AMBIGUOUS' WHEN ks[1] IN (SELECT reco_id FROM entries WHERE reco_id IS NOT NULL) THEN 'RESOLVED' ELSE 'KEY_UNKNOWN' END AS outcome FROM k""",
)(lambda v: found_orphans(v).withColumn("keys", F.array_join(F.array_sort(F.split("keys", ",")), ",")))


def found_orphans(v):
    serial = F.concat(F.lit("ref 9"), F.lpad(c("movement_id").cast("string"), 7, "0"))
    text = F.concat_ws(" ", "particulars", F.when(c("movement_id") % 6 == 0, serial), F.when(c("movement_id") % 12 == 0, F.lit("PF1234567")))
    ref = F.when(c("movement_id") % 5 == 0, F.concat(F.lit("A##ORD"), c("movement_id").cast("string")))
    return R.orphans(v.movement.withColumn("particulars", text).withColumn("ref_no", ref), v.entries.filter("reco_id is not null").select(c("reco_id").alias("key")))


SEGMENTED = """WITH u AS (SELECT url, count(*) AS weight FROM pages GROUP BY 1), s AS (SELECT url, weight, string_split(url, '/') AS seg FROM u), p AS (SELECT url, weight, len(seg) AS n, unnest(range(len(seg))) AS place, unnest(seg) AS value FROM s),
      d AS (SELECT n, place, count(DISTINCT value) AS k FROM p GROUP BY 1, 2), t AS (SELECT url, any_value(weight) AS weight, string_agg(CASE WHEN k <= 25 OR (n > 1 AND place = 0) THEN CASE WHEN value = '' THEN '∅' ELSE value END ELSE '<' || CASE WHEN trim(value) = '' THEN 'EMPTY' WHEN regexp_full_match(value, '[0-9]+') THEN 'NUM' WHEN regexp_full_match(value, '[A-Za-z0-9]+') AND regexp_matches(value, '[0-9]') THEN 'ALNUM' ELSE 'TEXT' END || '>' END, ' / ' ORDER BY place) AS pattern
      FROM p JOIN d USING (n, place) GROUP BY url)"""
query(
    "plan_mine_patterns",
    "",
    f"""{SEGMENTED} SELECT pattern, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS texts, min(url) AS example FROM t GROUP BY 1""",
)(lambda v: R.mine_patterns(v.pages.groupBy("url").agg(A.rows().alias("weight")), "url", "weight"))
query(
    "plan_place_values",
    "",
    f"""{SEGMENTED}, v AS (SELECT pattern, place, value, sum(p.weight) AS w FROM p JOIN d USING (n, place) JOIN t USING (url) WHERE NOT (k <= 25 OR (n > 1 AND place = 0)) GROUP BY 1, 2, 3)
      SELECT pattern, CAST(place AS INT) AS place, count(*) AS "values", string_agg(value, ' | ' ORDER BY r) FILTER (r <= 3) AS samples
      FROM (SELECT *, row_number() OVER (PARTITION BY pattern, place ORDER BY w DESC, value) AS r FROM v) GROUP BY 1, 2""",
)(lambda v: R.place_values(v.pages.groupBy("url").agg(A.rows().alias("weight")), "url", "weight", top=3))
query(
    "plan_operational_list",
    "live payment_status",
    """SELECT e.id, e.amount, e.value_date, coalesce(n, 0) AS payments, first_at, last_at FROM (SELECT * FROM live ORDER BY value_date DESC, id DESC, amount DESC, external_ref DESC LIMIT 200) e LEFT JOIN (SELECT reco_id, count(*) AS n, min(status_at) AS first_at, max(status_at) AS last_at FROM payment_status GROUP BY 1) s USING (reco_id)""",
)(
    lambda v: v.live.orderBy(c("value_date").desc(), c("id").desc(), c("amount").desc(), c("external_ref").desc()).limit(200)
    .join(v.payment_status.groupBy("reco_id").agg(A.rows().alias("n"), F.min("status_at").alias("first_at"), F.max("status_at").alias("last_at")), "reco_id", "left")
    .select("id", "amount", "value_date", F.coalesce("n", F.lit(0)).cast("long").alias("payments"), "first_at", "last_at")
)

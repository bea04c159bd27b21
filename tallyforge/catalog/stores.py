"""Stores: parents, slices and bulk keys, look-ups over both stores, traces, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.normalise import MONEY
from tallyforge.operators import stores as T
from tallyforge.operators.windows import canonical_parent, page
from tallyforge.plans import matching as M
from tallyforge.plans import reattribution as R
from tallyforge.plans import splits as P
from tallyforge.queries import query
from tallyforge.session import shared_folder

DEC = "DECIMAL(20,4)"
c = F.col


def money(column):
    return column.cast(MONEY)


# ---- writes
query(
    "sink_parent_upsert",
    "parent",
    f"""SELECT source_hash, CAST(CASE WHEN s THEN amount ELSE amount + 1 END AS {DEC}) AS amount, claim_value, t AND order_key % 2 = 0 AS parent_emarged,
      CASE WHEN NOT t THEN 'INSERTED' WHEN NOT s THEN 'KEPT' ELSE 'UPDATED' END AS change
      FROM (SELECT *, order_key % 3 <> 0 AS t, order_key % 5 <> 0 AS s FROM parent) WHERE t OR s""",
)(
    lambda v: T.upsert_parents(
        v.parent.filter("order_key % 3 <> 0").withColumn("amount", money(c("amount") + 1)).withColumn("parent_emarged", c("order_key") % 2 == 0),
        v.parent.filter("order_key % 5 <> 0").withColumn("parent_emarged", F.lit(False)),
        [c("order_key")],
    ).select("source_hash", "amount", "claim_value", "parent_emarged", "change")
)


def slice_rows(v, store: str) -> DataFrame:
    status = F.when(F.length("source_hash") % 2 == 0, "PENDING").otherwise("MATCHED")
    once = v.slice.filter(c("store") == store).groupBy("source_hash", "parent_hash", "bucket_id").agg(F.max("amount").alias("amount"))
    out = once.withColumn("reco_id", c("bucket_id")).withColumn("direction", F.lit("CREDIT"))
    return out.withColumn("payload", F.lit("old")).withColumn("ingestion_run_id", F.lit(1)).withColumn("status", status).drop("bucket_id")


def sliced(v) -> DataFrame:
    live = slice_rows(v, "LIVE").filter("length(reco_id) % 2 = 0")
    run = F.when(F.length("source_hash") % 3 != 0, 2)
    staged = slice_rows(v, "LIVE").unionByName(slice_rows(v, "SETTLED")).withColumn("amount", money(c("amount") * 2)).withColumn("payload", F.lit("new"))
    staged = staged.withColumn("ingestion_run_id", run).withColumn("status", F.lit("PENDING"))
    return T.upsert_slices(live, staged, slice_rows(v, "SETTLED"), [c("amount")])


query(
    "sink_slice_upsert",
    "slice",
    f"""SELECT source_hash, CAST(CASE WHEN t AND NOT p THEN amount ELSE amount * 2 END AS {DEC}) AS amount, CASE WHEN t AND NOT p THEN 'old' ELSE 'new' END AS payload,
      CASE WHEN t AND NOT p THEN 1 WHEN length(source_hash) % 3 <> 0 THEN 2 WHEN t THEN 1 END AS ingestion_run_id, CASE WHEN NOT t THEN 'INSERTED' WHEN p THEN 'UPDATED' ELSE 'UNCHANGED' END AS change
      FROM (SELECT *, length(bucket_id) % 2 = 0 AS t, length(source_hash) % 2 = 0 AS p FROM (SELECT source_hash, parent_hash, bucket_id, max(amount) AS amount FROM slice WHERE store = 'LIVE' GROUP BY 1, 2, 3))""",
)(lambda v: sliced(v).select("source_hash", "amount", "payload", "ingestion_run_id", "change"))


def bulk_rows(v) -> DataFrame:
    return v.payment.groupBy("po_id").agg(F.min("reco_id").alias("reco_id"), F.min("init_module").alias("init_module"), F.count("*").cast("long").alias("member_count"))


query(
    "sink_bulk_keys",
    "payment",
    """SELECT po_id, CASE WHEN length(po_id) % 2 = 0 AND length(reco_id) % 3 <> 0 THEN 'OLD' ELSE m END AS init_module, n AS member_count,
      CASE WHEN length(po_id) % 2 <> 0 THEN 'INSERTED' WHEN length(reco_id) % 3 = 0 THEN 'UPDATED' ELSE 'UNCHANGED' END AS change
      FROM (SELECT po_id, min(reco_id) AS reco_id, min(init_module) AS m, count(*) AS n FROM payment GROUP BY 1)""",
)(
    lambda v: T.upsert_bulk_keys(
        bulk_rows(v).filter("length(po_id) % 2 = 0").withColumn("init_module", F.lit("OLD")).withColumn("member_count", c("member_count") + F.when(F.length("reco_id") % 3 == 0, 1).otherwise(0)),
        bulk_rows(v),
        [c("po_id")],
    ).select("po_id", "init_module", "member_count", "change")
)
query(
    "sink_trace_collisions",
    "export_rows",
    f"""SELECT srl, count(*) AS n, arg_max(amount, (file_no, line_no, amount)) AS kept, CAST(sum(amount) - arg_max(amount, (file_no, line_no, amount)) AS {DEC}) AS lost
      FROM export_rows GROUP BY 1 HAVING count(*) > 1""",
)(lambda v: T.traced_collisions(v.export_rows, "srl", [c("file_no"), c("line_no")]))
REWRITTEN = "SELECT id, CASE WHEN id % 3 = 0 THEN 'NEW' ELSE reco_id END AS reco_id, amount FROM entries"
query(
    "sink_trace_rewrites",
    "entries",
    f"""SELECT n.id, n.reco_id AS new_reco_id, o.reco_id AS old_reco_id, o.status <> 'PENDING' AS skipped, count(*) AS n FROM ({REWRITTEN}) n JOIN entries o ON o.id = n.id
      WHERE n.reco_id IS DISTINCT FROM o.reco_id GROUP BY ALL""",
)(
    lambda v: T.traced_rewrites(v.entries, v.entries.withColumn("reco_id", F.when(c("id") % 3 == 0, "NEW").otherwise(c("reco_id"))), "id")
    .groupBy("id", "new_reco_id", "old_reco_id", "skipped")
    .agg(F.count("*").alias("n"))
)

# ---- look-ups and pages
query(
    "page_entries_of_keys",
    "live settled",
    """, k AS (SELECT DISTINCT reco_id FROM settled WHERE flow_id = 1 AND reco_id IS NOT NULL)
      SELECT id, amount, 'live' AS store FROM live WHERE reco_id IN (FROM k) UNION ALL SELECT id, amount, 'settled' FROM settled WHERE reco_id IN (FROM k)""",
)(lambda v: T.entries_of_keys(v.live, v.settled, v.settled.filter("flow_id = 1")).select("id", "amount", "store"))
UNNAMED = "CASE WHEN id % 7 = 0 THEN NULL ELSE external_ref END"
query(
    "page_movements_to_sync",
    "live settled",
    f"""SELECT 'pending' AS scope, id, amount FROM live WHERE {UNNAMED} IS NOT NULL UNION ALL SELECT 'all', id, amount FROM live WHERE {UNNAMED} IS NOT NULL
      UNION ALL SELECT 'all', id, amount FROM settled WHERE {UNNAMED} IS NOT NULL""",
)(
    lambda v: (lambda a, b: T.movements_to_sync(a, b, "pending").select(F.lit("pending").alias("scope"), "id", "amount").unionByName(T.movements_to_sync(a, b, "all").select(F.lit("all").alias("scope"), "id", "amount")))(
        v.live.withColumn("external_ref", F.expr(UNNAMED)), v.settled.withColumn("external_ref", F.expr(UNNAMED))
    )
)
query(
    "page_exclusion_marks",
    "entries exclusion",
    """SELECT id, amount, x.reason, x.reason IS NULL AND status = 'PENDING' AS may_exclude, x.reason IS NOT NULL AS may_cancel FROM entries LEFT JOIN
      (SELECT entry_id, arg_max(reason, (created_at, reason)) AS reason FROM exclusion WHERE cancelled_at IS NULL GROUP BY 1) x ON x.entry_id = id""",
)(lambda v: T.marked_exclusions(v.entries, v.exclusion).select("id", "amount", "reason", "may_exclude", "may_cancel"))
T96 = "TIMESTAMP '1996-01-01'"
SNAPSHOT = f"""SELECT id, flow_id, reco_id, amount, value_date, external_ref, state FROM (
      SELECT *, CASE WHEN id IN (SELECT entry_id FROM exclusion WHERE created_at <= {T96} AND (cancelled_at IS NULL OR cancelled_at > {T96})) THEN 'EXCLUDED' ELSE 'PENDING' END AS state FROM live WHERE created_at <= {T96}
      UNION ALL SELECT *, CASE WHEN settled_at <= {T96} THEN status ELSE 'PENDING' END FROM settled WHERE created_at <= {T96})"""


def snapshot(v) -> DataFrame:
    return M.snapshot(v.live, v.settled, v.exclusion, "1996-01-01")


query("page_snapshot", "live settled exclusion", f"SELECT id, amount, state FROM ({SNAPSHOT}) ORDER BY value_date DESC, id DESC, amount DESC, external_ref DESC OFFSET 50 LIMIT 100")(
    lambda v: page(snapshot(v), [c("value_date").desc(), c("id").desc(), c("amount").desc(), c("external_ref").desc()], 50, 100).select("id", "amount", "state")
)
SLICES = "SELECT source_hash, parent_hash, CASE WHEN length(source_hash) % 5 = 0 THEN 0 ELSE amount END AS amount FROM slice"
query("page_ordered_slices", "slice", f"SELECT source_hash, parent_hash, row_number() OVER (PARTITION BY parent_hash ORDER BY abs(amount) DESC, source_hash)::INT AS place FROM ({SLICES}) WHERE amount <> 0")(
    lambda v: T.ordered_slices(v.slice.withColumn("amount", F.when(F.length("source_hash") % 5 == 0, 0).otherwise(c("amount"))), "parent_hash", "source_hash").select("source_hash", "parent_hash", "place")
)

# ---- reports
query(
    "agg_bucket_report",
    "member member_key",
    f""", k AS (SELECT DISTINCT * FROM member_key), l AS (SELECT m.bucket_id, key_type, key_value, count(*) AS n FROM (SELECT DISTINCT bucket_id, source_hash FROM member) m JOIN k USING (source_hash) GROUP BY ALL),
      t AS (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY n DESC, key_type, key_value) AS place FROM l QUALIFY place <= 3)
      SELECT bucket_id, count(*) AS members, CAST(sum(amount) AS {DEC}) AS net, min(amount) AS least, max(amount) AS greatest, count(DISTINCT kind) AS kinds, any_value(top_keys) AS top_keys FROM member
      LEFT JOIN (SELECT bucket_id, string_agg(key_type || ':' || key_value || ' ' || n, ', ' ORDER BY place) AS top_keys FROM t GROUP BY 1) USING (bucket_id) GROUP BY 1""",
)(lambda v: T.bucket_report(v.member, v.member_key))
query(
    "agg_traced_key",
    "member member_key",
    """SELECT bucket_id, count(*) AS members, CAST(sum(hit) AS BIGINT) AS carrying FROM (SELECT bucket_id, CASE WHEN source_hash IN (SELECT source_hash FROM member_key WHERE key_type = 'MSGID' AND key_value = 'MSG7') THEN 1 ELSE 0 END AS hit FROM member)
      GROUP BY 1 HAVING sum(hit) > 0""",
)(lambda v: T.traced_key(v.member, v.member_key, "MSGID", F.lit("MSG7")))
query("agg_key_sharing", "member_key", "SELECT key_type, members, count(*) AS key_values FROM (SELECT key_type, key_value, count(*) AS members FROM (SELECT DISTINCT * FROM member_key) GROUP BY 1, 2) GROUP BY 1, 2")(
    lambda v: T.key_sharing(v.member_key)
)
RUNS = "SELECT event_id % 50 AS run_id, CASE WHEN event_id % 2 = 0 THEN 'ANALYZE' ELSE 'COMMIT' END AS kind, CASE event_id % 3 WHEN 0 THEN 'PROPOSED' WHEN 1 THEN 'APPLIED' ELSE 'FAILED' END AS status FROM change_log"
query(
    "agg_run_summary",
    "change_log",
    f"""SELECT run_id, kind, count(*) AS movements, count(*) FILTER (kind = 'ANALYZE' AND status = 'PROPOSED') AS actionable, count(*) FILTER (kind = 'COMMIT' AND status = 'APPLIED') AS applied,
      count(*) FILTER (kind = 'COMMIT' AND status = 'FAILED') AS failed FROM ({RUNS}) GROUP BY 1, 2""",
)(
    lambda v: T.run_summary(
        v.change_log.select(F.expr("event_id % 50").alias("run_id"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'ANALYZE' ELSE 'COMMIT' END").alias("kind"), F.expr("CASE event_id % 3 WHEN 0 THEN 'PROPOSED' WHEN 1 THEN 'APPLIED' ELSE 'FAILED' END").alias("status")),
        ["PROPOSED"],
    )
)
query(
    "agg_merged_state",
    "member",
    """SELECT bucket_id, CASE WHEN length(bucket_id) % 4 = 0 THEN 'merged' WHEN count(*) FILTER (status = 'PENDING') = 0 AND count(*) FILTER (status = 'MATCHED') > 0 THEN 'matched' ELSE 'pending' END AS state FROM member GROUP BY 1""",
)(lambda v: merged_state(v))


def merged_state(v) -> DataFrame:
    from tallyforge.operators.aggregates import bucket_state, bucket_summary

    return bucket_state(bucket_summary(v.member).withColumn("merged", F.length("bucket_id") % 4 == 0)).select("bucket_id", "state")


# ---- exports
MOMENT = "coalesce(strftime({0}, '%Y-%m-%d %H:%M:%S'), '')"
query(
    "sink_export_full",
    "entries payment_status flow",
    f"""SELECT coalesce(flow_name, '#' || flow_id) AS "Flow", reco_id AS "Key", account AS "Account", currency AS "Currency", amount::VARCHAR AS "Amount", direction AS "Direction", {MOMENT.format('value_date')} AS "Value date",
      {MOMENT.format('operation_date')} AS "Operation date", event_type AS "Event type", id::VARCHAR AS "Transaction ID", external_ref AS "External ref", file_name AS "File name", 'P' || id AS "Particulars", ref_no AS "Ref no", remarks_1 AS "Remarks 1",
      status AS "Status", {MOMENT.format('matched_at')} AS "Matched at", coalesce(p, '') AS "Payments", CASE WHEN p IS NULL THEN '' WHEN lo = hi THEN {MOMENT.format('lo')} ELSE {MOMENT.format('lo')} || ' → ' || {MOMENT.format('hi')} END AS "Payment time"
      FROM entries LEFT JOIN (SELECT reco_id, string_agg(n || ' ' || s, ' · ' ORDER BY n DESC, s) AS p, min(lo) AS lo, max(hi) AS hi FROM (SELECT reco_id, coalesce(status, '?') AS s, count(*) AS n, min(status_at) AS lo, max(status_at) AS hi FROM payment_status GROUP BY 1, 2) GROUP BY 1) USING (reco_id)
      LEFT JOIN (SELECT * FROM flow WHERE flow_id <> 3) USING (flow_id)""",
)(lambda v: T.export_table(v.entries.withColumn("particulars", F.concat(F.lit("P"), c("id").cast("string"))), v.payment_status, v.flow.filter("flow_id <> 3")))


def written(df: DataFrame, name: str) -> DataFrame:
    """Written as CSV with a header, and read back with the types that it had."""
    folder = shared_folder(df.sparkSession, name)
    df.write.csv(folder, header=True)
    return df.sparkSession.read.schema(df.schema).csv(folder, header=True)


query("sink_snapshot_summary", "live settled exclusion", f"SELECT flow_id, state, count(*) AS n, CAST(sum(amount) AS {DEC}) AS net FROM ({SNAPSHOT}) GROUP BY 1, 2")(lambda v: written(T.snapshot_sheets(snapshot(v))[0], "summary"))
query("sink_snapshot_entries", "live settled exclusion", f"SELECT id, amount, state FROM ({SNAPSHOT})")(lambda v: written(T.snapshot_sheets(snapshot(v))[1], "snapshot").select("id", "amount", "state"))
query(
    "sink_control_table",
    "link dump",
    """SELECT link_id, found, CASE WHEN n > 1 THEN 'DUPLICATE_MOVEMENT' WHEN found = 0 THEN 'NOT_FOUND' WHEN booked = 0 AND dumped <> 0 THEN 'NOT_SETTLED' WHEN found <> announced THEN 'COUNT_MISMATCH' WHEN dumped <> round(booked, 2) THEN 'AMOUNT_MISMATCH' ELSE 'OK' END AS verdict
      FROM (SELECT l.*, coalesce(f, 0) AS found, coalesce(s, 0) AS dumped, count(*) OVER (PARTITION BY l.pmsgid) AS n FROM link l LEFT JOIN (SELECT pmsgid, count(*) AS f, round(sum(amount), 2) AS s FROM dump GROUP BY 1) d ON d.pmsgid = l.pmsgid)""",
)(lambda v: written(R.conservation_control(v.link, v.dump), "control").select("link_id", "found", "verdict"))

# ---- splits
CLAIM = ["source_id", "claim_type", "claim_value"]


def split_tables(v) -> tuple[DataFrame, ...]:
    parents = v.parent.withColumn("parent_emarged", F.lit(False))
    stored = parents.filter("order_key % 4 = 0").withColumn("amount", money(c("amount") + 1))
    staged = parents.filter("order_key % 3 <> 0 AND claim_value <> ''")
    entry = lambda df, hash_, amount, parent: df.select(hash_.alias("source_hash"), F.lit("K").alias("reco_id"), money(amount).alias("amount"), F.lit("CREDIT").alias("direction"), parent.alias("parent_hash"), F.lit("x").alias("payload"), F.lit(1).alias("ingestion_run_id"), F.lit("PENDING").alias("status"))
    claims = staged.select(*CLAIM).distinct().withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    name = F.concat_ws("|", c("source_id").cast("string"), "claim_value", c("i").cast("string"))
    anchors = canonical_parent(stored.unionByName(staged)).select(*CLAIM, c("source_hash").alias("anchor"))
    nothing = F.lit(None).cast("string")
    movements = entry(v.parent.filter("order_key % 2 = 0"), c("source_hash"), c("amount"), nothing)
    live = movements.unionByName(entry(claims.filter("i > 1").join(anchors, CLAIM), name, c("i") * 10 + 1, c("anchor")))
    settled = entry(claims.filter("i = 1 AND source_id = 0"), name, c("i") * 10, nothing).unionByName(entry(v.parent.filter("order_key % 10 = 1"), c("source_hash"), c("amount"), nothing))
    pushed = claims.filter("i < 4")
    slices = pushed.select(*CLAIM, name.alias("source_hash"), F.lit("K").alias("reco_id"), money(c("i") * 10).alias("amount"), F.lit("CREDIT").alias("direction"), F.lit("y").alias("payload"), F.lit(2).alias("ingestion_run_id"), F.lit("PENDING").alias("status"))
    return stored, staged, live, settled, slices


query(
    "plan_split_groups",
    "parent",
    """, s AS (SELECT * FROM parent WHERE order_key % 3 <> 0 AND claim_value <> ''), g AS (SELECT DISTINCT source_id, claim_value FROM s)
      SELECT 'parents_inserted' AS what, count(*) AS n FROM s WHERE order_key % 4 <> 0 UNION ALL SELECT 'parents_updated', count(*) FROM s WHERE order_key % 4 = 0 UNION ALL SELECT 'slices_inserted', count(*) FROM g WHERE source_id <> 0
      UNION ALL SELECT 'slices_updated', 2 * count(*) FROM g UNION ALL SELECT 'slices_skipped', count(*) FROM g WHERE source_id = 0 UNION ALL SELECT 'movements_withdrawn', count(*) FROM s WHERE order_key % 2 = 0
      UNION ALL SELECT 'parents_settled', count(*) FROM s WHERE order_key % 10 = 1 UNION ALL SELECT 'slices_reaped', count(*) FROM g""",
)(lambda v: P.split_groups(*split_tables(v))["counts"])
query(
    "plan_split_ledger",
    "parent",
    f""", s AS (SELECT * FROM parent WHERE order_key % 3 <> 0 AND claim_value <> ''), g AS (SELECT DISTINCT source_id, claim_value FROM s)
      SELECT source_hash, amount FROM parent WHERE order_key % 2 = 0 AND source_hash NOT IN (SELECT source_hash FROM s)
      UNION ALL SELECT source_id || '|' || claim_value || '|' || i, CAST(i * 10 AS {DEC}) FROM g, (SELECT unnest([1, 2, 3]) AS i) WHERE i > 1 OR source_id <> 0""",
)(lambda v: P.split_groups(*split_tables(v))["live"].select("source_hash", "amount"))

# ---- search
CHAIN = "split_part(bucket_id, '/', 2)"
FOUND = "SELECT DISTINCT bucket_id FROM member WHERE po_id IN (SELECT min(po_id) FROM member)"


def expansion(v) -> DataFrame:
    hits = v.member.join(v.member.agg(F.min("po_id").alias("po_id")), "po_id").select(F.lit(None).cast("string").alias("reco_id"), "bucket_id").distinct()
    hits = hits.unionByName(v.payment_status.agg(F.max("reco_id").alias("reco_id")).select("reco_id", F.lit(None).cast("string").alias("bucket_id")))
    chain = F.split("bucket_id", "/")[1]
    merges = v.member.select(c("bucket_id").alias("node"), chain.alias("root")).distinct()
    got = P.search_expansion(hits, merges, v.member, v.entries, v.payment_status)
    buckets = got["buckets"].select(F.lit("bucket").alias("what"), c("bucket_id").alias("name"), c("members").alias("n"), "net")
    groups = got["groups"].select(F.lit("group"), "reco_id", "n", "net")
    return buckets.union(groups).union(got["payments"].select(F.lit("payment"), "po_id", F.lit(1).cast("long"), money(c("amount"))))


query(
    "plan_search_expansion",
    "member entries payment_status",
    f""", h AS ({FOUND}), b AS (SELECT DISTINCT bucket_id FROM member WHERE {CHAIN} IN (SELECT {CHAIN} FROM h)), k AS (SELECT max(reco_id) AS reco_id FROM payment_status)
      SELECT 'bucket' AS what, bucket_id AS name, count(*) AS n, CAST(sum(amount) AS {DEC}) AS net FROM member WHERE bucket_id IN (FROM b) GROUP BY 2
      UNION ALL SELECT 'group', reco_id, n, net FROM (SELECT flow_id, reco_id, currency, count(*) AS n, CAST(sum(amount) AS {DEC}) AS net FROM entries WHERE reco_id IN (FROM k) GROUP BY 1, 2, 3)
      UNION ALL SELECT 'payment', po_id, 1, amount FROM payment_status WHERE reco_id IN (FROM k)""",
)(expansion)
query(
    "plan_signed_slices",
    "link dump",
    f"""SELECT link_id, dump_id, CAST(CASE WHEN booked < 0 THEN -abs(amount) ELSE abs(amount) END AS {DEC}) AS amount FROM (SELECT link_id, pmsgid, CASE WHEN link_id % 2 = 0 THEN -booked * 200 ELSE booked * 200 END AS booked FROM link) l
      JOIN (SELECT pmsgid, dump_id, CASE WHEN dump_id % 3 = 0 THEN -amount ELSE amount END AS amount FROM dump) d USING (pmsgid) JOIN (SELECT pmsgid, sum(abs(amount)) AS s, bool_or(amount = 0) AS z FROM dump GROUP BY 1) t USING (pmsgid) WHERE NOT z AND s <= abs(booked)""",
)(lambda v: (lambda slices, booked: R.signed_slices(slices, R.slice_guard(slices, booked)).select("link_id", "dump_id", "amount"))(
    v.dump.withColumn("amount", F.when(c("dump_id") % 3 == 0, -c("amount")).otherwise(c("amount"))), v.link.withColumn("booked", money(F.when(c("link_id") % 2 == 0, -c("booked") * 200).otherwise(c("booked") * 200)))
))
query(
    "plan_committed_orphans",
    "movement",
    f"""SELECT movement_id, CASE WHEN movement_id % 3 = 1 AND movement_id % 4 <> 0 AND (movement_id % 5 = 0 OR movement_id % 5 = 1) THEN 'K' || movement_id ELSE CASE movement_id % 5 WHEN 0 THEN 'Not Supported' WHEN 1 THEN NULL ELSE 'OWN' END END AS reco_id,
      CASE WHEN movement_id % 3 = 1 AND movement_id % 4 <> 0 AND (movement_id % 5 = 0 OR movement_id % 5 = 1) THEN 'RESOLVED' ELSE 'KEPT' END AS change FROM movement""",
)(
    lambda v: R.committed_orphans(
        v.movement.select("movement_id", F.expr("CASE movement_id % 5 WHEN 0 THEN 'Not Supported' WHEN 1 THEN NULL ELSE 'OWN' END").alias("reco_id"), F.when(c("movement_id") % 4 == 0, "MATCHED").otherwise("PENDING").alias("status")),
        v.movement.select("movement_id", F.concat(F.lit("K"), c("movement_id").cast("string")).alias("keys"), F.when(c("movement_id") % 3 == 1, "RESOLVED").otherwise("NO_KEY").alias("outcome")),
    ).select("movement_id", "reco_id", "change")
)

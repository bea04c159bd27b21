"""Ingestion pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.catalog.sources import messages
from tallyforge.functions.normalise import MONEY
from tallyforge.operators import aggregates as A
from tallyforge.plans import ingestion as G
from tallyforge.queries import query
from tallyforge.sources.statement import statement_rows

DEC = "DECIMAL(20,4)"
c = F.col

KEYED = "SELECT *, CASE WHEN movement_id % 11 = 0 THEN 'Not Supported' WHEN movement_id % 13 = 0 THEN NULL ELSE 'ORD' || movement_id END AS reco_id FROM movement"
HASH = "sha256(concat_ws('|', flow_id, transaction_id, 'ACC', CAST(value_date AS DATE)))"


def keyed(v):
    return v.movement.withColumn("reco_id", F.expr("CASE WHEN movement_id % 11 = 0 THEN 'Not Supported' WHEN movement_id % 13 = 0 THEN NULL ELSE 'ORD' || movement_id END"))


def ledger(v):
    entries = G.ledger_entries(keyed(v))
    before = G.ledger_entries(keyed(v).withColumn("reco_id", F.when(c("movement_id") % 2 == 0, "Not Supported").otherwise("OLD")).filter("movement_id % 3 <> 0")).drop("_error")
    return G.ledger_ingestion(before.filter("flow_id <> 4"), before.filter("flow_id = 4"), entries).select("external_ref", "reco_id", "amount", "change")


query(
    "plan_ledger_ingestion",
    "movement",
    f"""SELECT transaction_id AS external_ref, CASE WHEN movement_id % 3 <> 0 AND movement_id % 2 = 1 THEN 'OLD' ELSE reco_id END AS reco_id, CAST(CASE WHEN side = 'D' THEN -abs(amount) ELSE abs(amount) END AS {DEC}) AS amount,
      CASE WHEN movement_id % 3 = 0 THEN 'INSERTED' WHEN movement_id % 2 = 1 OR reco_id = 'Not Supported' THEN 'UNCHANGED' ELSE 'UPDATED' END AS change FROM ({KEYED}) WHERE NOT (flow_id = 4 AND movement_id % 3 <> 0)""",
)(ledger)
query(
    "plan_statement_ingestion",
    "payment",
    f"""SELECT count(*) AS n, count(reco_id) AS resolved, CAST(sum(amount) AS {DEC}) AS total FROM (SELECT DISTINCT ON (account, amount, value_date, owner_ref) 'ACC' || (l_orderkey % 7) AS account, CAST(CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(20,2)) AS {DEC}) AS amount, strftime(l_shipdate, '%m%d%y') AS value_date, 'OW/' || l_partkey AS owner_ref,
      CASE WHEN l_partkey % 4 <> 3 AND l_partkey % 8 = 0 THEN 'K' WHEN l_partkey % 3 = 0 THEN 'O' END AS reco_id FROM lineitem)""",
)(
    lambda v: G.statement_ingestion(
        statement_rows(messages(v)),
        [
            ("sub_20", v.part.filter("p_partkey % 8 = 0").select(F.expr("'SCRT' || p_partkey || 'goes on'"), F.lit("K").alias("k"))),
            ("owner_ref", v.part.filter("p_partkey % 3 = 0").select(F.expr("'OW/' || p_partkey"), F.lit("O").alias("k"))),
        ],
        v.part.select(F.lit("none").alias("source_hash")),
        9,
    ).agg(A.rows().alias("n"), F.count("reco_id").cast("long").alias("resolved"), A.total().alias("total"))
)
#: Legs of all lines; a leg that its order lacks has a key of its own, so that it stays pending.
LEG_KEYS = {
    "SCHEME": "CASE WHEN order_key % 3 <> 0 THEN 'W' || order_key ELSE 'S' || po_id END",
    "PAYMENT": "CASE WHEN part_key % 50 <> 0 THEN 'W' || order_key ELSE 'P' || po_id END",
    "RETURN": "CASE WHEN order_key % 6 = 0 THEN 'W' || order_key ELSE 'R' || po_id END",
}


def three_legs(v):
    leg = {kind: v.payment.select(F.expr(key).alias("reco_id"), "po_id", "amount") for kind, key in LEG_KEYS.items()}
    return G.three_leg_matching(G.three_leg_entries(leg["SCHEME"], leg["PAYMENT"], leg["RETURN"], 7), "run")


query(
    "plan_three_legs",
    "payment",
    f""", e AS (SELECT {LEG_KEYS["SCHEME"]} AS reco_id, 'SCHEME' AS event_type, amount FROM payment UNION ALL SELECT {LEG_KEYS["PAYMENT"]}, 'PAYMENT', -amount FROM payment UNION ALL SELECT {LEG_KEYS["RETURN"]}, 'RETURN', amount FROM payment)
      SELECT event_type, CASE WHEN reco_id IN (SELECT reco_id FROM e GROUP BY 1 HAVING sum(amount) = 0) THEN 'MATCHED' ELSE 'PENDING' END AS status, count(*) AS n, CAST(sum(amount) AS {DEC}) AS net FROM e GROUP BY 1, 2""",
)(three_legs)


def split_ledger(v):
    live = v.member.groupBy("source_hash").agg(F.max(F.struct("amount", "parent_hash")).alias("x")).select("source_hash", "x.amount", "x.parent_hash")
    parents = v.member.filter("parent_hash is not null").select(c("parent_hash").alias("source_hash")).distinct()
    slices = live.filter("parent_hash is not null AND length(source_hash) % 2 = 0").withColumn("amount", (c("amount") * 2).cast(MONEY))
    return G.apply_split(live, parents, slices).select("source_hash", "amount", "change")


query(
    "plan_apply_split",
    "member",
    f""", l AS (SELECT source_hash, arg_max(amount, (amount, parent_hash)) AS amount, arg_max(parent_hash, (amount, parent_hash)) AS parent_hash FROM (SELECT source_hash, amount, coalesce(parent_hash, '') AS parent_hash FROM member) GROUP BY 1)
      SELECT source_hash, CAST(CASE WHEN parent_hash <> '' THEN amount * 2 ELSE amount END AS {DEC}) AS amount, CASE WHEN parent_hash <> '' THEN 'UPDATED' ELSE 'KEPT' END AS change FROM l WHERE parent_hash = '' OR length(source_hash) % 2 = 0""",
)(split_ledger)


#: Keys of a member by type, as the view of single keys has them.
MEMBER_KEYS = {"PACS008": "pacs008", "MSGID": "upper(message_id)", "PO": "po_id"}


def pushed(v):
    """A push whose members carry their keys; the length is a part of what is gathered, so members and old ones are gathered once."""
    best = F.max(F.struct("amount", "bucket_id", F.length("source_hash").alias("length"))).alias("x")
    members = v.member.select("source_hash", "bucket_id", "amount").groupBy("source_hash").agg(best)
    old = members.filter("x.length % 3 <> 0").select("source_hash", "x.bucket_id", F.when(c("x.length") % 3 == 1, c("x.amount") + 1).otherwise(c("x.amount")).cast(MONEY).alias("amount"))
    carried = lambda *types: v.member.select("source_hash", F.array(*[F.struct(F.lit(t).alias("key_type"), F.expr(MEMBER_KEYS[t]).alias("key_value")) for t in types]).alias("keys"))
    return G.apply_buckets(v.member.filter("kind <> 'MULTI'").select("bucket_id").distinct(), members.select("source_hash", "x.bucket_id", "x.amount"), old, carried(*MEMBER_KEYS), carried("PACS008", "MSGID"))


query(
    "plan_apply_buckets",
    "member member_key",
    """, m AS (SELECT source_hash, arg_max(bucket_id, (amount, bucket_id)) AS bucket_id FROM member GROUP BY 1)
      SELECT 'buckets' AS what, count(DISTINCT bucket_id) AS n FROM m WHERE bucket_id NOT IN (SELECT bucket_id FROM member WHERE kind <> 'MULTI') UNION ALL SELECT 'members', count(*) FROM m WHERE length(source_hash) % 3 = 0
      UNION ALL SELECT 'updated', count(*) FROM m WHERE length(source_hash) % 3 = 1 UNION ALL SELECT 'keys', count(*) FROM (SELECT DISTINCT * FROM member_key WHERE key_type = 'PO')""",
)(pushed)


def rolled_up(v):
    first = lambda name: F.max(name).alias(name)
    members = v.member.groupBy("source_hash").agg(*map(first, ("bucket_id", "amount", "currency", "status", "value_date")))
    old = members.filter("length(source_hash) % 3 <> 0").withColumn("amount", (c("amount") + 1).cast(MONEY))
    rollups = G.pushed_buckets(members.filter("length(bucket_id) % 4 <> 0"), old)[1]
    return rollups.select("bucket_id", "member_count", "net", "pending", "state", "is_balanced")


query(
    "plan_bucket_rollups",
    "member",
    f""", h AS (SELECT source_hash, max(bucket_id) AS bucket_id, max(amount) AS amount, max(currency) AS currency, max(status) AS status, length(max(bucket_id)) % 4 <> 0 AS staged FROM member GROUP BY 1),
      n AS (SELECT bucket_id, currency, sum(CASE WHEN staged THEN amount ELSE amount + 1 END) AS net, count(*) AS n, count(*) FILTER (status = 'PENDING') AS p, count(*) FILTER (status = 'MATCHED') AS m
      FROM h WHERE staged OR length(source_hash) % 3 <> 0 GROUP BY 1, 2)
      SELECT bucket_id, CAST(sum(n) AS BIGINT) AS member_count, CAST(sum(net) AS {DEC}) AS net, CAST(sum(p) AS BIGINT) AS pending, CASE WHEN sum(p) = 0 AND sum(m) > 0 THEN 'matched' ELSE 'pending' END AS state,
      bool_and(net = 0) AS is_balanced FROM n GROUP BY 1""",
)(rolled_up)
query(
    "plan_status_sync",
    "movement payment payment_return",
    f""", x AS (SELECT *, CASE WHEN contains(particulars, '##') THEN string_split(particulars, '##') ELSE string_split(particulars, '/') END AS s, string_split(particulars, '/') AS sl, string_split(particulars, '##') AS sh FROM ({KEYED}) WHERE reco_id IS NOT NULL AND reco_id <> 'Not Supported'),
      y AS (SELECT reco_id, upper(trim(remarks_1)) AS pacs, upper(sl[2]) AS msg, CASE WHEN contains(particulars, '##') THEN sh[len(sh)] WHEN ref_no IS NOT NULL THEN ref_no ELSE nullif(trim(sl[4]), '') END AS po, upper(trim(s[1])) AS f, coalesce(upper(trim(s[2])), '') AS g FROM x),
      z AS (SELECT *, CASE WHEN f = 'NDRT' THEN 'RETURN' WHEN f = 'NDRJ' THEN 'REJECT' WHEN f = 'NDGB' THEN 'BULK_MESSAGE' WHEN f IN ('SWIFT', 'SCRT1', 'BKRTP', 'REV SCRT1') THEN 'INSTANT' WHEN f IN ('SCTXB', 'SDDXB', 'SDXBB') AND g IN ('I', 'O') THEN 'BULK' WHEN g IN ('RCC', 'RCP') THEN 'RETURN' WHEN g IN ('NCC', 'NCP', 'RRS') THEN 'SINGLE' ELSE 'UNKNOWN' END AS fam FROM y),
      n AS (SELECT z.reco_id, r.original_po AS po_id FROM z JOIN payment_return r ON r.return_po = z.po WHERE fam = 'RETURN' UNION ALL SELECT reco_id, po FROM z WHERE fam IN ('REJECT', 'SINGLE', 'INSTANT') AND po IS NOT NULL)
      SELECT reco_id, status, CAST(sum(n) AS BIGINT) AS n FROM (SELECT z.reco_id, p.status, p.n FROM z JOIN (SELECT upper(pacs008) AS k, status, count(*) AS n FROM payment GROUP BY 1, 2) p ON p.k = z.pacs WHERE fam = 'BULK'
      UNION ALL SELECT z.reco_id, p.status, p.n FROM z JOIN (SELECT upper(message_id) AS k, status, count(*) AS n FROM payment GROUP BY 1, 2) p ON p.k = z.msg WHERE fam = 'BULK_MESSAGE'
      UNION ALL SELECT n.reco_id, p.status, 1 FROM n LEFT JOIN payment p ON p.po_id = n.po_id) GROUP BY 1, 2""",
)(lambda v: G.status_sync(keyed(v), v.payment, v.payment_return))
query("plan_run_state", "ingestion_run", "SELECT run_id, source, CASE WHEN e > 0 AND rows_ok % 5 = 0 THEN 'FAILED' WHEN e > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS state FROM (SELECT *, rows_ok % 2 AS e FROM ingestion_run)")(
    lambda v: v.ingestion_run.withColumn("e", c("rows_ok") % 2).select("run_id", "source", G.run_state(F.when(c("rows_ok") % 5 == 0, 0).otherwise(c("rows_ok")), c("e")).alias("state"))
)

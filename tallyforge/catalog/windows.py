"""Rows of groups, pairing, gap filling, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import aggregates as A
from tallyforge.operators import windows as W
from tallyforge.queries import query

DEC = "DECIMAL(20,4)"


def arrival():
    return [F.col("file_no"), F.col("line_no"), F.col("amount")]



query("window_canonical_parent", "parent", "SELECT source_id, claim_value, source_hash, amount FROM parent WHERE claim_value <> '' QUALIFY row_number() OVER (PARTITION BY source_id, claim_type, claim_value ORDER BY value_date, external_ref NULLS LAST, source_hash) = 1")(
    lambda v: W.canonical_parent(v.parent).select("source_id", "claim_value", "source_hash", "amount")
)
query("window_first_currency", "member", "SELECT bucket_id, arg_min(currency, source_hash) AS currency FROM member GROUP BY 1")(lambda v: v.member.groupBy("bucket_id").agg(F.min_by("currency", "source_hash").alias("currency")))
query("window_last_success", "ingestion_run", "SELECT flow_id, source, max(started_at) AS started_at, arg_max(run_id, (started_at, run_id)) AS run_id FROM ingestion_run WHERE status IN ('SUCCESS', 'PARTIAL') GROUP BY 1, 2")(
    lambda v: v.ingestion_run.filter(F.col("status").isin("SUCCESS", "PARTIAL")).groupBy("flow_id", "source").agg(F.max("started_at").alias("started_at"), F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
)
KEEP = "SELECT srl, file_no, amount FROM export_rows QUALIFY row_number() OVER (PARTITION BY srl ORDER BY file_no {d}, line_no {d}, amount {d}) = 1"
query("window_keep_first", "export_rows", KEEP.format(d="ASC"))(lambda v: W.keep_in_batch(v.export_rows, "srl", arrival()).select("srl", "file_no", "amount"))
query("window_keep_last", "export_rows", KEEP.format(d="DESC"))(lambda v: W.keep_in_batch(v.export_rows, "srl", arrival(), last=True).select("srl", "file_no", "amount"))
query("window_active_exclusion", "exclusion", "SELECT entry_id, created_at, user_id, reason FROM exclusion WHERE cancelled_at IS NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY created_at DESC, user_id DESC, reason DESC) = 1")(lambda v: W.latest_active(v.exclusion))
query(
    "window_tag_pairs",
    "turns",
    "SELECT conv_id, turn, text, CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS detail FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'",
)(lambda v: W.paired_tags(v.turns, "conv_id", "turn", "role", "user", "assistant"))
LAST = "arg_max({c}, (file_no, line_no, amount)) FILTER ({c} <> '') AS {c}"
query("window_filled_export", "export_rows", f"SELECT srl, {LAST.format(c='pmsgid')}, {LAST.format(c='reason')}, count(*) AS versions FROM export_rows GROUP BY 1")(lambda v: W.filled_export(v.export_rows, "srl", arrival(), ["pmsgid", "reason"]))
query(
    "window_export_conflicts",
    "export_rows",
    """SELECT srl, old, new, file_no FROM (SELECT srl, file_no, nullif(pmsgid, '') AS new, last_value(nullif(pmsgid, '') IGNORE NULLS) OVER (PARTITION BY srl ORDER BY file_no, line_no, amount ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM export_rows) WHERE new <> old""",
)(lambda v: W.export_conflicts(v.export_rows, "srl", arrival(), "pmsgid"))
query("window_content_dedup", "", "SELECT sha256(text) AS content, min(doc_id) AS first_id, count(*) - 1 AS duplicates FROM documents GROUP BY 1")(
    lambda v: v.documents.groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("first_id"), (F.count("*") - 1).cast("long").alias("duplicates"))
)
query("window_recent_runs", "ingestion_run", "SELECT flow_id, run_id, started_at, rows_ok FROM ingestion_run QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY started_at DESC, run_id DESC) <= 10")(lambda v: W.recent_runs(v.ingestion_run, 10).select("flow_id", "run_id", "started_at", "rows_ok"))
query(
    "window_heaviest_bucket",
    "slice",
    f"SELECT parent_hash, bucket_id, amount FROM (SELECT parent_hash, bucket_id, CAST(sum(amount) AS {DEC}) AS amount FROM slice GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY parent_hash ORDER BY abs(amount) DESC, bucket_id) = 1",
)(lambda v: W.heaviest(v.slice.groupBy("parent_hash", "bucket_id").agg(A.total().alias("amount")), "parent_hash", "amount", "bucket_id"))



def newest():
    return [F.col("value_date").desc(), F.col("id").desc(), F.col("amount").desc(), F.col("external_ref").desc()]


query("page_entries", "entries", "SELECT id, value_date, amount, status FROM entries ORDER BY value_date DESC, id DESC, amount DESC, external_ref DESC LIMIT 50 OFFSET 100")(
    lambda v: W.page(v.live.unionByName(v.settled), newest(), 100, 50).select("id", "value_date", "amount", "status")
)
query("page_buckets", "member", "SELECT bucket_id, max(value_date) AS last_date, count(*) AS n FROM member GROUP BY 1 ORDER BY last_date DESC NULLS LAST, bucket_id LIMIT 40 OFFSET 20")(
    lambda v: W.page(v.member.groupBy("bucket_id").agg(F.max("value_date").alias("last_date"), A.rows().alias("n")), [F.col("last_date").desc_nulls_last(), F.col("bucket_id")], 20, 40)
)
query("page_members", "member", "SELECT source_hash, value_date, amount FROM member WHERE kind = 'MULTI' AND status = 'PENDING' ORDER BY value_date, source_hash, amount LIMIT 400")(
    lambda v: W.page(v.member.filter("kind = 'MULTI' AND status = 'PENDING'"), [F.col("value_date"), F.col("source_hash"), F.col("amount")], 0, 400).select("source_hash", "value_date", "amount")
)
query("page_children", "slice", "SELECT parent_hash, source_hash, amount FROM slice WHERE parent_hash = 'P8' ORDER BY abs(amount) DESC, source_hash LIMIT 100")(
    lambda v: W.page(v.slice.filter("parent_hash = 'P8'"), [F.abs("amount").desc(), F.col("source_hash")], 0, 100).select("parent_hash", "source_hash", "amount")
)
query("page_change_log", "change_log", "SELECT event_id, ts, user_id, action FROM change_log WHERE action = 'MATCH' ORDER BY ts DESC, event_id DESC LIMIT 100")(
    lambda v: W.page(v.change_log.filter("action = 'MATCH'"), [F.col("ts").desc(), F.col("event_id").desc()], 0, 100).select("event_id", "ts", "user_id", "action")
)
query("top_key_values", "member_key", "SELECT key_type, key_value, n FROM (SELECT key_type, key_value, count(*) AS n FROM member_key GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY key_type ORDER BY n DESC, key_value) <= 5")(
    lambda v: W.ranked(v.member_key.groupBy("key_type", "key_value").agg(A.rows().alias("n")), ["key_type"], [F.col("n").desc(), F.col("key_value")], 5)
)
query(
    "window_once_across_files",
    "export_rows",
    """SELECT arg_min(file_no, o) AS file_no, arg_min(line_no, o) AS line_no, arg_min(amount, o) AS amount, count(*) - 1 AS duplicates
      FROM (SELECT *, (file_no, line_no, amount) AS o, CASE WHEN line_no % 5 = 0 THEN '' ELSE srl END AS k FROM export_rows)
      GROUP BY nullif(k, ''), CASE WHEN k = '' THEN (pmsgid, reason, amount) END""",
)(
    lambda v: W.once_across_files(
        v.export_rows.withColumn("k", F.when(F.col("line_no") % 5 == 0, "").otherwise(F.col("srl"))),
        "k",
        ["pmsgid", "reason", "amount"],
        ["file_no", "line_no", "amount"],
    ).select("file_no", "line_no", "amount", "duplicates")
)

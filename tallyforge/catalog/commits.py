"""Reattributions of all orders, committed, half of them taken back, committed again and replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.normalise import MONEY
from tallyforge.plans import commit as C
from tallyforge.queries import query
from tallyforge.session import stored

DEC = "DECIMAL(20,4)"
c = F.col


def bookings(v) -> DataFrame:
    """A booking for every order but some that aren't there, are busy, or no longer name their message."""
    k = c("o_orderkey")
    sign = F.when(k % 2 == 0, -1).otherwise(1)
    amount = F.when(k % 20 == 9, F.lit(1)).otherwise(F.col("o_totalprice") * 3)
    return v.orders.filter(k % 20 != 7).select(
        F.concat(F.lit("P"), k.cast("string")).alias("source_hash"), F.lit(1).alias("flow_id"), F.lit("ACC").alias("account"), F.lit("EUR").alias("currency"), F.when(k % 2 == 0, "debit").otherwise("credit").alias("direction"),
        c("o_orderdate").alias("value_date"), F.concat(F.lit("SCT/RCP/msg"), F.when(k % 20 == 5, "").otherwise(k.cast("string"))).alias("particulars"), F.lit(None).cast("string").alias("reco_id"), (sign * amount).cast(MONEY).alias("amount"),
        F.when(k % 20 == 3, "EXCLUDED").otherwise("PENDING").alias("status"), F.lit(None).cast("string").alias("parent_hash"),
    )


def items(v) -> DataFrame:
    """Slices: the lines of each order, by supplier; some of zero, some for targets that nothing carries."""
    return v.lineitem.select(
        F.concat(F.lit("MSG"), c("l_orderkey").cast("string")).alias("claim"), F.concat(F.lit("P"), c("l_orderkey").cast("string")).alias("source_hash"),
        F.concat(F.lit("T"), c("l_suppkey").cast("string")).alias("target"), F.when((c("l_orderkey") % 20 == 11) & (c("l_linenumber") == 1), 0).otherwise(c("l_extendedprice")).cast(MONEY).alias("amount"),
    )


def committed(v) -> dict[str, DataFrame]:
    live = bookings(v)
    none = v.spark.createDataFrame([], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in live.schema.fields))
    log = none.withColumn("claim", F.lit(None).cast("string")).select("source_hash", "claim", *C.LEDGER[1:])
    targets = v.supplier.filter("s_suppkey % 7 <> 0").select(F.lit(1).alias("flow_id"), F.concat(F.lit("T"), c("s_suppkey").cast("string")).alias("target"))
    asked = stored(items(v), "items")
    done, out = {"live": live, "log": log}, {}
    for step in ("first", "again", "replay"):
        after = C.commit(done["live"], none, done["log"], targets, asked)
        # what the next step reads is stored; results stand on stored verdicts, and the last tables are read once
        keep = lambda df, name: stored(df, f"{step}-{name}") if step != "replay" and name != "results" else df  # noqa: B023, E731
        done = {name: keep(after[name].drop("change"), name) for name in ("live", "log", "results")}
        out[step] = done
        if step == "first":  # every second claim is taken back, then committed anew
            back = C.restore(done["live"], none, done["log"], asked.filter("int(substring(claim, 4)) % 2 = 0").select("claim"))
            done = {name: stored(back[name], f"back-{name}") for name in ("live", "log")}
            out["back"] = done
    return out


JUDGED = f"""WITH i AS (SELECT l_orderkey AS k, l_suppkey AS s, CAST(CASE WHEN l_orderkey % 20 = 11 AND l_linenumber = 1 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(20,4)) END AS {DEC}) AS a FROM lineitem),
  b AS (SELECT o_orderkey AS k, CAST((CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) * (CASE WHEN o_orderkey % 20 = 9 THEN 1 ELSE CAST(o_totalprice * 3 AS DECIMAL(20,4)) END) AS {DEC}) AS amount, CASE WHEN o_orderkey % 20 = 3 THEN 'EXCLUDED' ELSE 'PENDING' END AS status FROM orders WHERE o_orderkey % 20 <> 7),
  t AS (SELECT k, sum(a) AS sliced, count(DISTINCT s) AS slices, bool_or(a = 0) AS zero, bool_or(s % 7 = 0) AS lost FROM i GROUP BY 1),
  j AS (SELECT t.*, b.amount, CASE WHEN b.k IS NULL THEN 'NOT_FOUND' WHEN status <> 'PENDING' THEN 'NOT_PENDING' WHEN t.k % 20 = 5 THEN 'CLAIM_GONE' WHEN lost THEN 'UNKNOWN_TARGET' WHEN zero THEN 'ZERO_SLICE' WHEN sliced > abs(b.amount) THEN 'EXCEEDS_BOOKING' END AS why FROM t LEFT JOIN b USING (k))"""
query(
    "plan_commit_replay",
    "",
    JUDGED
    + f""" SELECT 'P' || k AS source, NULL AS reco_id, amount, status FROM b WHERE k NOT IN (SELECT k FROM j WHERE why IS NULL)
      UNION ALL SELECT 'P' || k, 'T' || s, CAST(CASE WHEN amount < 0 THEN -sum(a) ELSE sum(a) END AS {DEC}), 'PENDING' FROM i JOIN j USING (k) WHERE why IS NULL GROUP BY k, s, amount""",
)(lambda v: committed(v)["replay"]["live"].select(F.coalesce("parent_hash", "source_hash").alias("source"), "reco_id", "amount", "status"))
query(
    "plan_commit_results",
    "",
    JUDGED + " SELECT step, 'MSG' || k AS claim, CASE step WHEN 'first' THEN FALSE WHEN 'again' THEN k % 2 = 1 AND why IS NULL ELSE why IS NULL END AS replay, why AS refusal FROM j, (SELECT unnest(['first', 'again', 'replay']) AS step)",
)(lambda v: (lambda out: out["first"]["results"].select(F.lit("first").alias("step"), "claim", "replay", "refusal").union(out["again"]["results"].select(F.lit("again"), "claim", "replay", "refusal")).union(out["replay"]["results"].select(F.lit("replay"), "claim", "replay", "refusal")))(committed(v)))

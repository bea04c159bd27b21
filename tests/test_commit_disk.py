"""A batch of reattributions shuffles each item once, and of the ledger only what it asks for and what changes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F
from test_commit import SCHEMA, items, ledger, row, run

from tallyforge.plans import commit as C


def test_items_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        live = spark.createDataFrame([row(f"b{i}", -100, f"RCP/m{i}") for i in range(40)] + [row(f"z{i}", 1) for i in range(400)], SCHEMA)
        log = spark.createDataFrame([], "source_hash string, claim string, " + SCHEMA.removeprefix("source_hash string, "))
        targets = spark.createDataFrame([(1, f"T{i}") for i in range(5)], "flow_id int, target string")
        asked = items(spark, *[(f"m{i}", f"b{i}", f"T{i % 6}", 7) for i in range(40)])
        judged = C.judge(live, log, targets, asked)
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(claim#") == 0 and plan.count("hashpartitioning(source_hash#") == 3  # items, live, log
        got = {r["claim"]: (r["refusal"], r["slices"], r["sliced"], [tuple(x) for x in r["aims"]]) for r in judged.collect()}
        assert got == {f"m{i}": ("UNKNOWN_TARGET" if i % 6 == 5 else None, 1, Decimal(7), [(f"T{i % 6}", Decimal(7))]) for i in range(40)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_settled_slices_and_others_of_a_booking(spark):
    """A settled slice isn't inserted; live slices of the booking go unless they are targets; others stay."""
    none = spark.createDataFrame([], SCHEMA)
    log = spark.createDataFrame([], "source_hash string, claim string, " + SCHEMA.removeprefix("source_hash string, "))
    targets = spark.createDataFrame([(1, f"T{i}") for i in range(5)], "flow_id int, target string")
    one = run(C.commit, spark.createDataFrame([row("b1", 100, "m1"), row("b2", 50, "m2")], SCHEMA), none, log, targets, items(spark, ("m1", "b1", "T1", 60), ("m1", "b1", "T2", 40), ("m2", "b2", "T1", 50)))
    settled = one["live"].filter("reco_id = 'T1' AND parent_hash = 'b1'").drop("change")
    live = one["live"].drop("change").join(settled.select("source_hash"), "source_hash", "left_anti").select(*C.LEDGER)
    two = run(C.commit, live, settled, one["log"], targets, items(spark, ("m1", "b1", "T1", 60), ("m1", "b1", "T3", 5)))
    assert ledger(two["live"]) == [("T1", 50.0, "credit", "PENDING", "b2"), ("T3", 5.0, "credit", "PENDING", "b1")]
    assert {r["change"] for r in two["live"].collect()} == {"KEPT", "INSERTED"}
    want = [r[0] for r in spark.range(1).select(C.slice_hash(F.lit("m1"), F.lit("T3"))).collect()]
    assert [r["source_hash"] for r in two["live"].filter("reco_id = 'T3'").collect()] == want


def test_only_what_is_read_again_is_stored(spark, sf, monkeypatch):
    from tallyforge.catalog import commits
    from tallyforge.fixtures import Views

    names, kept = [], commits.stored
    monkeypatch.setattr(commits, "stored", lambda *args: (names.append(args[-1]), kept(*args))[1])
    out = commits.committed(Views(spark, sf))
    assert sorted(names) == ["again-live", "again-log", "back-live", "back-log", "first-live", "first-log", "items"]
    assert out["replay"]["live"].count() > 0 and out["first"]["results"].count() == out["replay"]["results"].count() > 0

"""Reattributions: refusals, signs, stale and settled slices, replays from the log, and the way back."""

from decimal import Decimal

import pytest

from tallyforge.plans import commit as C

SCHEMA = "source_hash string, flow_id int, account string, currency string, direction string, value_date date, particulars string, reco_id string, amount decimal(20,4), status string, parent_hash string"


def row(h, amount, particulars="RCP/m1", status="PENDING", reco=None, parent=None, flow=1):
    return (h, flow, "A", "EUR", "debit" if amount < 0 else "credit", None, particulars, reco, Decimal(amount), status, parent)


@pytest.fixture
def tables(spark):
    live = spark.createDataFrame([row("b1", -100), row("b2", 50, "RCP/m2"), row("b3", 50, "RCP/m3", "FORCED"), row("b4", 9, "other"), row("x", 1, "none", reco="T9")], SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    log = spark.createDataFrame([], "source_hash string, claim string, " + SCHEMA.removeprefix("source_hash string, "))
    targets = spark.createDataFrame([(1, "T1"), (1, "T2"), (1, "T3"), (2, "T4")], "flow_id int, target string")
    return live, none, log, targets


def items(spark, *listed):
    return spark.createDataFrame([(c, h, t, Decimal(a)) for c, h, t, a in listed], "claim string, source_hash string, target string, amount decimal(20,4)")


def run(step, *args):
    """A step's tables, each kept as rows, as a store would."""
    return {name: df.sparkSession.createDataFrame(df.collect(), df.schema) for name, df in step(*args).items()}


def ledger(df):
    return sorted((r["reco_id"], float(r["amount"]), r["direction"], r["status"], r["parent_hash"]) for r in df.filter("parent_hash is not null").collect())


def refusals(out):
    return {(r["claim"], r["source_hash"]): r["refusal"] for r in out["results"].collect()}


def test_each_refusal(spark, tables):
    live, none, log, targets = tables
    asked = items(spark, ("m1", "b1", None, 1), ("m9", "gone", "T1", 1), ("m3", "b3", "T1", 1), ("m4", "b4", "T1", 1), ("m2", "b2", "T4", 1), ("M1", "b1", "T1", 0), ("M1", "b1", "T2", 5))
    out = run(C.commit, live, none, log, targets, asked)
    assert refusals(out) == {("m1", "b1"): "NO_TARGET", ("m9", "gone"): "NOT_FOUND", ("m3", "b3"): "NOT_PENDING", ("m4", "b4"): "CLAIM_GONE", ("m2", "b2"): "UNKNOWN_TARGET", ("M1", "b1"): "ZERO_SLICE"}
    assert out["log"].isEmpty() and sorted(r["source_hash"] for r in out["live"].collect()) == ["b1", "b2", "b3", "b4", "x"]
    assert refusals(run(C.commit, live, none, log, targets, items(spark, ("m2", "b2", "T1", 30), ("m2", "b2", "T2", -20.01)))) == {("m2", "b2"): "EXCEEDS_BOOKING"}
    both = items(spark, ("rcp/m1", "b1", "T1", 5), ("m1", "b1", "T1", 5))
    assert refusals(run(C.commit, live, none, log, targets, both)) == {("rcp/m1", "b1"): "TAKEN", ("m1", "b1"): None}


def test_commit_replay_and_restore(spark, tables):
    live, none, log, targets = tables
    asked = items(spark, ("m1", "b1", "T1", 60), ("m1", "b1", "T2", -30), ("m1", "b1", "T2", 10), ("m2", "b2", "T1", 50))
    one = run(C.commit, live, none, log, targets, asked)
    want = [("T1", -60.0, "debit", "PENDING", "b1"), ("T1", 50.0, "credit", "PENDING", "b2"), ("T2", -40.0, "debit", "PENDING", "b1")]
    assert ledger(one["live"]) == want and sorted(r["source_hash"] for r in one["log"].collect()) == ["b1", "b2"]
    two = run(C.commit, one["live"].drop("change"), none, one["log"], targets, asked)
    assert ledger(two["live"]) == want and {r["replay"] for r in two["results"].collect()} == {True}
    assert two["live"].filter("change IN ('INSERTED', 'UPDATED')").isEmpty() and sorted(map(str, two["log"].collect())) == sorted(map(str, one["log"].collect()))
    back = run(C.restore, one["live"].drop("change"), none, one["log"], spark.createDataFrame([("M1",)], "claim string"))
    assert ledger(back["live"]) == want[1:2] and back["live"].filter("source_hash = 'b1' AND amount = -100").count() == 1 and back["refused"].isEmpty()
    three = run(C.commit, back["live"], none, back["log"], targets, asked)
    assert ledger(three["live"]) == want
    # other targets: what is no target any more goes, what is settled stays settled and doesn't come again
    settled = one["live"].filter("reco_id = 'T1' AND parent_hash = 'b1'").drop("change").replace("PENDING", "MATCHED", ["status"])
    open_ = one["live"].drop("change").join(settled.select("source_hash"), "source_hash", "left_anti").select(*C.LEDGER)
    four = run(C.commit, open_, settled, one["log"], targets, items(spark, ("m1", "b1", "T1", 1), ("m1", "b1", "T3", 2)))
    assert ledger(four["live"]) == [("T1", 50.0, "credit", "PENDING", "b2"), ("T3", -2.0, "debit", "PENDING", "b1")]
    held = run(C.restore, four["live"].drop("change"), settled, four["log"], spark.createDataFrame([("m1",), ("m2",)], "claim string"))
    assert [(r["claim"], r["source_hash"]) for r in held["refused"].collect()] == [("m1", "b1")] and ledger(held["live"]) == [("T3", -2.0, "debit", "PENDING", "b1")]
    other = run(C.commit, one["live"].drop("change"), none, one["log"], targets, items(spark, ("RCP/m", "b1", "T1", 1)))
    assert refusals(other) == {("RCP/m", "b1"): "OTHER_CLAIM"}

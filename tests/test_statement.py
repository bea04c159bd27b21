"""Statement messages: each row is a message of its own, whose tags are paired without a shuffle."""

from __future__ import annotations

from tallyforge.sources.statement import statement_rows

ONE = "{1:F01}{4:\n:20: M1 \n:25:ACC0\n:60F:C200101EUR1,00\n:61:2001020103D5,5NTRFOW/1//BK2\nCUST\n:86:166+00A+20B\n x+20C+26/OCMT/USD7,1\n:62F:C200101GBP1,00\n-}"
TWO = "{1:F01}{4: \r\n:25:0ACC1\r\n:61:200102C7,NTRFOW/x/y//\r\n:62M:x\r\n:86:orphan\r\n:61:bad\r\n:86:plain\r\n-}rest:61:no"


def test_messages_of_one_id_stay_apart(spark):
    rows = statement_rows(spark.createDataFrame([("m", ONE), ("m", TWO), ("n", None), ("o", ":25:A")], "message_id string, text string")).collect()
    got = {(r["account"], r["place"]): r for r in rows}
    assert sorted(got) == [("0ACC1", 1), ("0ACC1", 4), ("ACC0", 3)] and len(rows) == 3
    a, b, bad = got["ACC0", 3], got["0ACC1", 1], got["0ACC1", 4]
    assert (a["currency"], a["statement_ref"], a["owner_ref"], a["bank_ref"], str(a["amount"]), a["customer_ref"], a["sub_20"], a["gvc"], a["ocmt"], a["_error"]) == ("EUR", "M1", "OW/1", "BK2", "-5.5000", "CUST", "C", "166", "USD7,1", None)
    assert (b["currency"], b["statement_ref"], b["owner_ref"], b["bank_ref"], str(b["amount"]), b["sub_20"], b["gvc"]) == (None, None, "OW/x/y", None, "7.0000", None, None)
    assert (bad["amount"], bad["sub_20"], bad["_error"]) == (None, None, "line")


def test_no_shuffle(spark):
    plan = statement_rows(spark.createDataFrame([("m", ONE)], "message_id string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

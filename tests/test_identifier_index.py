"""The index of identifiers shuffles rows by key, not each identifier of a row."""

from __future__ import annotations

from tallyforge.operators.aggregates import NO_KEY
from tallyforge.plans import matching as M


def test_rows_are_shuffled_before_they_are_taken_apart(spark):
    entries = spark.createDataFrame([("K1", "x1", "r", None), ("K1", "x2", "R", "m"), (NO_KEY, "x3", None, "m"), (NO_KEY, "x4", None, "M"), (None, "x5", "r", "m"), ("K1", "x1", "r", None)], "reco_id string, external_ref string, ref_no string, remarks_1 string")
    members = spark.createDataFrame([(1, "p1", "b"), (1, "p2", "b"), (None, "p3", "b")], "order_key long, po_id string, bucket_id string")
    index = M.identifier_index(entries, members)
    want = {("K1", "reco_id", "K1"), ("K1", "external_ref", "X1"), ("K1", "external_ref", "X2"), ("K1", "ref_no", "R"), ("K1", "remarks_1", "M"), (NO_KEY, "reco_id", NO_KEY.upper()), (NO_KEY, "external_ref", "X3"), (NO_KEY, "external_ref", "X4"), (NO_KEY, "remarks_1", "M"), ("ORD1", "po_id", "P1"), ("ORD1", "po_id", "P2"), ("ORD1", "bucket_id", "B")}
    got = [tuple(r) for r in index.select("reco_id", "field", "value").collect()]
    assert set(got) == want and len(got) == len(want)
    shuffled = [x for x in index._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert sum("hashpartitioning(reco_id#" in x and "value#" not in x for x in shuffled) == 2 and sum("value#" in x for x in shuffled) == 1

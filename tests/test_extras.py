"""Operation types, configurations of legs, original amounts, payloads, pushes of members and hashes of slices."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import identity as I
from tallyforge.functions import normalise as N
from tallyforge.plans import legs
from tallyforge.plans.ingestion import bucket_push, canonical_slices


def test_operation_types_by_the_first_source_that_tells(spark):
    data = [("wero", "NCC", None, None, "P2P"), ("WeroEmc", "NCP", None, None, "EMC"), ("x", "a ncp b", "EMC", "v", "P2P"), (None, "ncc", None, None, "EMC"), ("", "", "emc", None, "EMC"), ("", None, "x", "ok", "EMC"), (None, None, None, "", "UNKNOWN"), (None,) * 4 + ("UNKNOWN",)]
    df = spark.createDataFrame(data, "m string, s string, t string, v string, want string")
    assert df.filter(N.operation_type_of(*[F.col(c) for c in "mstv"]) != F.col("want")).isEmpty()


def test_legs_configurations():
    cfg = legs.legs_config({"payment_modules": [" A ", "", None], "scheme_statuses": ["ok ", " OK"], "return_day": " std.Day ", "other": 1})
    assert (cfg["payment_modules"], cfg["scheme_statuses"], cfg["return_day"], "other" in cfg) == (["A"], ["OK"], "std.Day", False)
    for bad in ({"payment_modules": [" "]}, {"scheme_ref": "a; drop"}, {"payment_day": ""}, {"scheme_statuses": ["x"], "scheme_status": None}):
        with pytest.raises(ValueError):
            legs.legs_config(bad)


def test_returns_take_their_own_columns_where_named(spark):
    day = datetime.datetime(2024, 1, 2)
    scheme = spark.createDataFrame([("E1", Decimal(5), "Ok", day), ("E2", Decimal(6), "no", day), ("E3", Decimal(7), "OK", datetime.datetime(2023, 1, 1))], "e2e_ref string, amount decimal(20,4), status string, day timestamp_ntz")
    payments = spark.createDataFrame([("p1", "e1", Decimal(5), "S", "WERO", day), ("p2", "e9", Decimal(8), "S", "OTHER", day)], "po_id string, e2e_ref string, amount decimal(20,4), status string, init_module string, payment_date timestamp_ntz")
    returns = spark.createDataFrame([("r1", " p1 ", Decimal(3), "T"), ("r2", "p2", Decimal(3), "T")], "return_po string, original_po string, amount decimal(20,4), status string")
    got = lambda cfg: [[(r["reco_id"], r["po_id"], float(r["amount"]), r["status"]) for r in df.collect()] for df in legs.three_legs(scheme, payments, returns, cfg, F.lit("2024-01-01").cast("timestamp_ntz"))]
    assert got({"scheme_statuses": ["ok"]}) == [[("E1", "E1", 5.0, "Ok")], [("E1", "p1", 5.0, "S")], [("E1", "r1", 5.0, "S")]]
    assert got({"return_amount": "amount", "return_status": "status"})[2] == [("E1", "r1", 3.0, "T")] and got({"returns_enabled": False})[2] == []


def test_original_amounts_and_payloads(spark):
    df = spark.createDataFrame([("x/OCMT/USD12,5/y", Decimal("1.5"), datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.date(2024, 1, 2), 'q"é')], "t string, a decimal(20,4), at timestamp_ntz, day date, s string")
    assert df.select(N.original_amount(F.col("t"))).first()[0] == "USD12,5" and df.select(N.original_amount(F.col("s"))).first()[0] is None
    both = df.unionByName(df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
    got = [json.loads(r[0]) for r in both.select(N.payload_json(both, ["a", "at", "day", "s"])).collect()]
    assert got == [{"a": "1.5000", "at": "2024-01-02T03:04:05", "day": "2024-01-02", "s": 'q"é'}, {"a": None, "at": None, "day": None, "s": None}]


def test_a_push_of_members(spark):
    schema = "source_hash string, bucket_id string, amount decimal(20,4), currency string, status string, value_date date"
    member = lambda h, b, a: (h, b, Decimal(a), "EUR", "PENDING", None)
    known = spark.createDataFrame([member("a", "B1", 5), member("b", "B1", -5)], schema)
    pushed = spark.createDataFrame([member("a", "B9", 7), member("c", "B2", 1), member("c", "B2", 1)], schema)
    keys = spark.createDataFrame([("a", "PO", "x"), ("a", "PO", "x"), ("c", "PO", "y")], "source_hash string, key_type string, key_value string")
    out = bucket_push(spark.createDataFrame([("B1",)], "bucket_id string"), pushed, known, keys, keys.limit(1))
    assert {r["what"]: r["n"] for r in out["counts"].collect()} == {"buckets": 2, "members": 1, "updated": 1, "keys": 1}
    assert sorted((r["source_hash"], r["bucket_id"], int(r["amount"])) for r in out["members"].collect()) == [("a", "B1", 7), ("b", "B1", -5), ("c", "B2", 1)]
    assert sorted((r["bucket_id"], float(r["net"])) for r in out["rollups"].collect()) == [("B1", 2.0), ("B2", 1.0)] and out["keys"].count() == 2


def test_slices_go_by_the_hash_of_their_ledger_row(spark):
    df = spark.createDataFrame([("wire", "p", "R1", "A", datetime.date(2024, 1, 2)), ("own", None, "R1", "A", None), ("bare", "p", None, "A", None)], "source_hash string, parent_hash string, external_ref string, account string, value_date date")
    got = [r["source_hash"] for r in canonical_slices(df, 3).collect()]
    want = df.limit(1).select(I.ledger_hash(F.lit(3), F.col("external_ref"), F.col("account"), F.col("value_date"), F.col("value_date"))).first()[0]
    assert got == [want, "own", "bare"]

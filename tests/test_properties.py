"""Properties that no SQL of the same shape can hide: idempotence, conservation, order, exactness, ids."""

import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyforge.functions import identity as I
from tallyforge.functions import normalise as N
from tallyforge.operators import aggregates as A
from tallyforge.operators import merge as G
from tallyforge.operators import windows as W
from tallyforge.plans import buckets as B
from tallyforge.plans import keys as K
from tallyforge.plans import matching as M
from tallyforge.plans import reattribution as R
from tallyforge.sources import delimited, fixed_width, reader, statement, workbook


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_uuid5_equals_pythons(spark):
    names = ["PACS1|MSG2", "é|ü", "", "x" * 300]
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", I.uuid5(F.col("n"))).collect()}
    assert got == {n: str(uuid.uuid5(uuid.UUID(hex=I.NAMESPACE), n)) for n in names}


def test_upsert_twice_changes_nothing(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, amount int, note string")
    batch = spark.createDataFrame([("b", 5, None), ("c", 7, "z"), ("b", 6, "w")], "k string, amount int, note string")
    once = G.upsert(target, batch, "k", {"amount": "new", "note": "new_or_old"}, [F.col("amount")])
    assert rows(once) == [("a", 1, "x", "KEPT"), ("b", 6, "w", "UPDATED"), ("c", 7, "z", "INSERTED")]
    again = G.upsert(once.drop("change"), batch, "k", {"amount": "new", "note": "new_or_old"}, [F.col("amount")])
    assert {r["change"] for r in again.collect()} == {"KEPT", "UNCHANGED"}


def test_settling_keeps_the_multiset(spark):
    live = spark.createDataFrame([(i, i % 3, Decimal(i)) for i in range(30)], "id int, flow_id int, amount decimal(20,4)")
    settled = spark.createDataFrame([(100, 0, Decimal(1))], live.schema)
    a, b, gone = G.settle(live, settled, F.col("flow_id") == 1, "id")
    assert rows(a.unionByName(b)) == rows(live.unionByName(settled)) and gone.isEmpty()


def test_null_and_sentinel_keys_never_match(spark):
    data = [("PENDING", None, "0"), ("PENDING", A.NO_KEY, "0"), ("PENDING", "K", "10.10"), ("PENDING", "K", "-10.10"), ("PENDING", "L", "0.01"), ("MATCHED", "M", "0")]
    df = spark.createDataFrame([(1, k, "EUR", Decimal(x), s) for s, k, x in data], "flow_id int, reco_id string, currency string, amount decimal(20,4), status string")
    assert [r["reco_id"] for r in A.balanced_groups(df).collect()] == ["K"]
    assert A.balanced_groups(df.limit(0)).isEmpty()


def test_order_of_rows_is_irrelevant(spark):
    rng = random.Random(3)
    data = [(f"s{i % 9}", 1 + i % 3, i, f"v{rng.randint(0, 3)}" if i % 4 else "") for i in range(90)]
    frames = [spark.createDataFrame(d, "srl string, file_no int, line_no int, pmsgid string") for d in (data, data[::-1])]
    order = [F.col("file_no"), F.col("line_no")]
    for f in (lambda d: W.filled_export(d, "srl", order, ["pmsgid"]), lambda d: W.keep_in_batch(d, "srl", order, last=True), lambda d: W.export_conflicts(d, "srl", order, "pmsgid")):
        assert rows(f(frames[0])) == rows(f(frames[1]))


@pytest.mark.parametrize("seed", range(5))
def test_slices_are_exact(spark, seed):
    rng = random.Random(seed)
    parents = [(f"h{i}", 1, "MSGID", f"C{i % 3}", Decimal(-rng.randint(1, 10**6)) / 100, f"2024-01-{1 + i:02d}", None) for i in range(9)]
    parts = [(f"C{i % 3}", f"b{i % 4}", Decimal(rng.randint(1, 10**6)) / 100) for i in range(12)]
    p = spark.createDataFrame(parents, "source_hash string, source_id int, claim_type string, claim_value string, amount decimal(20,4), value_date string, external_ref string")
    q = spark.createDataFrame(parts, "claim_value string, bucket string, amount decimal(20,4)").groupBy("claim_value", "bucket").agg(A.total().alias("amount"))
    slices = B.claim_slices(p, q)
    got = {r[0]: r[1] for r in slices.groupBy("claim_value").agg(F.sum("slice_amount")).collect()}
    want = {}
    for key, _, amount in parts:
        want[key] = want.get(key, Decimal(0)) - amount
    assert got == want
    assert {r["anchor"] for r in slices.collect()} == {"h0", "h1", "h2"}


def test_case_variants_are_one_bucket(spark):
    df = spark.createDataFrame([(1, "p1", "Pacs1", "msgA", Decimal(1)), (1, "p2", "PACS1", "MSGa", Decimal(2))], "movement_id int, po_id string, pacs008 string, message_id string, amount decimal(20,4)")
    assert B.partition_payments(df).count() == 1


def test_one_row_per_branch_of_the_key_cascade(spark):
    cases = [
        ("channel", "x/y", "R1", None, "Z6", "R1"),
        ("no_segments", "plain", None, None, "W", A.NO_KEY),
        ("return", "NDRT##RT1", None, None, "W", "via return"),
        ("instant", "SWIFT/a", "R1", None, "W", "bulk of R1"),
        ("instant_reversal", "REV SCRT1/a/b/c4", None, None, "W", "c4"),
        ("instant_single", "BKRTP/NCP/x", None, None, "W", None),
        ("bulk", "SCTXB/O/x", None, " rmk ", "W", "rmk"),
        ("bulk_return", "SCTXB/RCC/O/RT1/n", None, None, "W", "via return"),
        ("bulk_single", "SDDXB/NCC/I/PO1", None, None, "W", "via payment"),
        ("bulk_other", "SCTXB/REF1/z", None, None, "W", "via reversal"),
        ("other_return", "XX/RCP/O/none", None, None, "W", None),
        ("other_single", "XX/RRS/O/PO1", None, None, "W", "via payment"),
        ("other", "XX/what", None, None, "W", A.NO_KEY),
    ]
    df = spark.createDataFrame([(r, p, ref, m, ch) for r, p, ref, m, ch, _ in cases], "want string, particulars string, ref_no string, remarks_1 string, channel string")
    table = lambda k, v: spark.createDataFrame([(k, v)], "k string, v string")
    got = {r["want"]: (r["rule"], r["reco_id"]) for r in K.settlement_keys(df, table("PO1", "via payment"), table("REF1", "via reversal"), table("RT1", "via return"), table("R1", "bulk of R1")).collect()}
    assert got == {r: (r, want) for r, *_, want in cases}


def test_control_precedence(spark):
    links = spark.createDataFrame([(1, "a", 1, "5"), (2, "b", 1, "0"), (3, "c", 2, "5"), (4, "d", 1, "9"), (5, "e", 1, "5"), (6, "f", 1, "5"), (7, "f", 1, "5")], "link_id int, pmsgid string, announced long, b string").withColumn("booked", F.col("b").cast("decimal(20,4)"))
    dumps = spark.createDataFrame([(k, Decimal(5)) for k in "bcdef"], "pmsgid string, amount decimal(20,4)")
    got = [r["verdict"] for r in R.conservation_control(links, dumps).orderBy("link_id").collect()]
    assert got == ["NOT_FOUND", "NOT_SETTLED", "COUNT_MISMATCH", "AMOUNT_MISMATCH", "OK", "DUPLICATE_MOVEMENT", "DUPLICATE_MOVEMENT"]


def test_orphan_rules_do_not_mix(spark):
    data = [("A##K9", "ref 1234567", "K9"), (None, "X/NCC/I/ABCD1/9999999", "ABCD1"), (None, "see PF123456 and 7654321", "PF123456"), (None, "a 1234567 b 7654321", "1234567,7654321"), (None, "nothing 123", "")]
    df = spark.createDataFrame(data, "ref_no string, particulars string, want string")
    assert all(r[0] == r[1] for r in df.select("want", F.array_join(R.orphan_keys(F.col("ref_no"), F.col("particulars")), ",")).collect())


def test_tolerant_decimals(spark):
    data = [("1.234,56", "1234.5600"), ("1,234.56", "1234.5600"), ("12,5", "12.5000"), (" 1 000 ", "1000.0000"), ("x", None), (None, None)]
    df = spark.createDataFrame(data, "t string, want string")
    assert all(r[0] == r[1] for r in df.select("want", N.tolerant_decimal(F.col("t")).cast("string")).collect())


def test_subfields_last_value_wins(spark):
    df = spark.createDataFrame([("166+20A\nB+20C+30x+y",), ("plain",)], "t string")
    assert [r[0] for r in df.select(N.subfields(F.col("t"))).collect()] == [{"_gvc": "166", "20": "C", "30": "x+y"}, {"_raw": "plain"}]


def test_statement_pairs_within_messages(spark):
    text = "{1:F01X}{4:\n:25:AC\n:60F:C240101EUR1,\n:61:2401020103RD12,5NTRFown/a//bank\n:61:240105C1,NTRFx\n:86:166+20SCRT9\ngoes\n:86:lost\n:62F:x\n-}"
    got = statement.statement_rows(spark.createDataFrame([("m", text), ("n", "{1:F01}{4:\n:86:orphan\n-}")], "message_id string, text string")).orderBy("place").collect()
    assert [(str(r["amount"]), r["owner_ref"], r["bank_ref"], r["sub_20"], str(r["entry_date"])) for r in got] == [("-12.5000", "own/a", "bank", None, "2024-01-03"), ("1.0000", "x", None, "SCRT9goes", "2024-01-05")]


def test_fixed_width_errors_stay_rows(spark):
    good = "1" + "C1".ljust(30) + "s".ljust(30) + "WITHDRAW" + "P".ljust(12) + "20240105EUR" + "1 234,50".rjust(27) + "R1".ljust(20) + "Y"
    got = fixed_width.fixed_width_rows(spark.createDataFrame([("0head",), (good + "\x00",), (good.replace("234,50", "xx4,50"),), ("1short",), ("9end",)], "value string")).collect()
    assert [(r["_error"], None if r["amount"] is None else str(r["amount"])) for r in got] == [(None, "-1234.5000"), ("amount", None), ("short", None)]


def test_workbook_round_trip(spark):
    df = spark.createDataFrame([Row(a="x<&>", b=None), Row(a=None, b=None), Row(a="2", b="é")])
    out = workbook.workbook_rows(workbook.to_workbooks(df.coalesce(1)), ["a", "b", "missing"])
    assert rows(out) == rows(spark.createDataFrame([("x<&>", None, None, None), ("2", "é", None, None)], out.schema))
    bad = workbook.workbook_rows(spark.createDataFrame([(bytearray(b"no zip"),)], "content binary"), ["a"])
    assert bad.first()["_error"].startswith("unreadable")


def test_wrapped_export(spark):
    df = spark.createDataFrame([("?column?",), ('"a;""b"""',), ("plain",)], "value string")
    assert [r[0] for r in delimited.unwrapped(df).collect()] == ['a;"b"', "plain"]


def test_unknown_reader():
    with pytest.raises(ValueError):
        reader("nope")


def test_merge_chains_with_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (9, 5)], "old long, new long")
    assert rows(M.merge_chains(spark, links)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 4)]


def test_slices_count_by_magnitude(spark):
    """Slices of +100 and -90 don't fit a booking of 10, and what may be committed has the booking's sign."""
    from tallyforge.plans import reattribution as R

    money = "decimal(20,4)"
    slices = spark.createDataFrame([("a", "100"), ("a", "-90"), ("b", "4"), ("b", "5"), ("c", "0"), ("d", "-3")], "pmsgid string, amount string").withColumn("amount", F.col("amount").cast(money))
    booked = spark.createDataFrame([(1, "a", "10"), (2, "b", "-9"), (3, "c", "5"), (4, "d", "3"), (5, "e", "1")], "link_id int, pmsgid string, booked string").withColumn("booked", F.col("booked").cast(money))
    guard = R.slice_guard(slices, booked)
    assert {r["pmsgid"]: (r["refusal"], r["may_commit"]) for r in guard.collect()} == {"a": ("EXCEEDS_BOOKING", False), "b": (None, True), "c": ("ZERO_SLICE", False), "d": (None, True), "e": ("NO_SLICE", False)}
    assert sorted((r["pmsgid"], int(r["amount"])) for r in R.signed_slices(slices, guard).collect()) == [("b", -5), ("b", -4), ("d", 3)]


def test_keys_inside_words_are_found(spark):
    """Substrings count, glued to letters or with signs of their own; a key with an exact hit isn't sought in texts."""
    from tallyforge.operators import joins as J

    keys = spark.createDataFrame([("MSG12",), ("a_b/c.d",), ("x",), ("known",), ("",)], "lookup_key string")
    rows = spark.createDataFrame([(1, "q", "refmsg12end"), (2, "KNOWN", "nothing"), (3, "q", "see A_B/C.D now known"), (4, None, None), (5, "q", "")], "id int, e string, t string")
    got = sorted((r["lookup_key"], r["id"], r["stage"]) for r in J.text_lookup(keys, rows, "e", "t").collect())
    assert got == [("A_B/C.D", 3, "TEXT"), ("KNOWN", 2, "EXACT"), ("MSG12", 1, "TEXT")]


def test_feed_config_refuses_what_is_no_name():
    from tallyforge.functions.normalise import feed_config

    defaults = {"table": "std.Feed", "column": None, "limit": 3}
    assert feed_config(defaults, {"column": " ref ", "other": 1}, ["table", "column"], ["table"]) == {"table": "std.Feed", "column": "ref", "limit": 3}
    for bad in ({"table": "x; drop"}, {"table": ""}, {"column": "a.b.c"}):
        with pytest.raises(ValueError):
            feed_config(defaults, bad, ["table", "column"], ["table"])

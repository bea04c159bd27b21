"""Rows that wait for their lookups: resolved once, retried with new lookups only, the same after a batch that runs again."""

import pytest
from pyspark.sql import functions as F

from tallyforge.streaming import unresolved as U

ROW = f"name string, amount int, source_hash string, keys array<{U.KEY}>, retry_keys array<{U.KEY}>, _error string"


def rows(spark, *listed):
    data = []
    for name, amount, keys, *rest in listed:
        pairs = [tuple(k.split(":")) if k else ("A", None) for k in keys]
        data.append((name, amount, "h" + name, pairs, pairs if not rest else [tuple(k.split(":")) for k in rest[0]], rest[1] if len(rest) > 1 else None))
    return spark.createDataFrame(data, ROW)


def lookups(spark, *listed):
    return spark.createDataFrame([(*k.split(":"), v) for k, v in listed], U.LOOKUP)


def state(waiting, number):
    return sorted(tuple(r) for r in waiting.entries(number).select("name", "amount", F.coalesce("reco_id", F.lit("-")), F.coalesce("tier", F.lit(0)), F.coalesce("resolved_in", F.lit(-9))).collect())


@pytest.fixture
def waiting(spark):
    return U.waiting_table(spark, "name string, amount int")


def test_a_key_two_batches_later_resolves_its_row_once(spark, waiting):
    none = lookups(spark)
    waiting.step(0, rows(spark, ("a", 1, ["A:1", "B:1"]), ("b", 2, ["A:2"]), ("c", 3, [""]), ("bad", 4, ["A:1"], [], "broken")), none)
    assert state(waiting, 0) == [("a", 1, "-", 0, -9), ("b", 2, "-", 0, -9), ("c", 3, "-", 0, -9)]
    waiting.step(1, rows(spark, ("d", 5, ["A:9"])), lookups(spark, ("B:7", "X")))
    second = lookups(spark, ("B:1", "by B"), ("A:9", "nine"))
    for _ in range(2):  # a batch that runs again does the same again
        counters = waiting.step(2, rows(spark), second)
        assert counters == {"rows_in": 0, "rows_ko": 0, "rows_duplicate": 0, "resolved": 2, "retried": 4, "resolved_late": 2, "unresolved": 2}
        assert state(waiting, 2) == [("a", 1, "by B", 2, 2), ("b", 2, "-", 0, -9), ("c", 3, "-", 0, -9), ("d", 5, "nine", 1, 2)]
    # a better key that comes later changes nothing, nor does a row that comes again
    counters = waiting.step(3, rows(spark, ("a", 99, ["A:1"]), ("b", 7, ["A:5"]), ("b", 8, ["A:5"])), lookups(spark, ("A:1", "late"), ("A:5", "five")))
    assert counters["rows_duplicate"] == 3 and counters["resolved"] == 1
    assert state(waiting, 3)[0] == ("a", 1, "by B", 2, 2) and state(waiting, 3)[1][2:] == ("five", 1, 3)
    assert [(r["batch"], r["rows_in"], r["rows_ko"], r["unresolved"]) for r in waiting.counters().orderBy("batch").collect()] == [(0, 4, 1, 3), (1, 1, 0, 4), (2, 0, 0, 2), (3, 3, 0, 1)]


def test_retries_use_their_own_keys_and_new_rows_meet_old_lookups(spark, waiting):
    waiting.step(0, rows(spark, ("a", 1, ["A:1", "B:1"], ["A:1"])), lookups(spark, ("A:7", "seven"), ("A:7", "eight")))
    waiting.step(1, rows(spark, ("e", 2, ["A:7"])), lookups(spark, ("B:1", "not for retries"), ("A:7", "other")))
    assert state(waiting, 1) == [("a", 1, "-", 0, -9), ("e", 2, "eight", 1, 1)]
    waiting.step(2, rows(spark), lookups(spark, ("A:1", "one")))
    assert state(waiting, 2)[0] == ("a", 1, "one", 1, 2)


def test_settled_rows_stay_away_and_bulks_rename_both_sides(spark, waiting):
    settled = spark.createDataFrame([("hgone",)], "source_hash string")
    bulks = spark.createDataFrame([("po1", "BULK"), ("po1", "CULK")], U.BULK)
    counters = waiting.step(0, rows(spark, ("gone", 1, ["A:1"]), ("in", 2, ["A:1"])), lookups(spark, ("A:1", "po1")), settled=settled)
    assert counters["rows_duplicate"] == 1 and state(waiting, 0) == [("in", 2, "po1", 1, 0)]
    waiting.step(1, rows(spark, ("out", -2, ["A:1"])), lookups(spark), bulks)
    assert [(r[0], r[2]) for r in state(waiting, 1)] == [("in", "BULK"), ("out", "BULK")]
    assert [(r[0], r[2]) for r in state(waiting, 0)] == [("in", "po1")]


def test_many_rows_of_one_key(spark, waiting):
    many = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("name"), F.lit(1).alias("amount"), F.concat(F.lit("h"), "id").alias("source_hash"), F.array(U.key("A", F.lit(1))).alias("keys"), F.array(U.key("A", F.lit(1))).alias("retry_keys"), F.lit(None).cast("string").alias("_error"))
    assert waiting.step(0, many, lookups(spark))["unresolved"] == 3000
    assert waiting.step(1, many.limit(0), lookups(spark, ("A:1", "all")))["resolved_late"] == 3000


def test_a_batch_arrives_in_several_files(spark, waiting):
    from types import SimpleNamespace

    from tallyforge.catalog import late

    parts = rows(spark, *[(f"n{i}", i, ["A:1"]) for i in range(40)]).withColumn("at", F.col("amount") % 4).repartition(4)
    files = []

    def cut(batch):
        files.append(batch.select(F.input_file_name()).distinct().count())
        return batch, lookups(spark), None

    assert late.run(SimpleNamespace(spark=spark), parts, waiting, cut) == 3
    assert len(files) == 4 and min(files) > 1
    assert [r["rows_in"] for r in waiting.counters().orderBy("batch").collect()] == [10, 10, 10, 10]

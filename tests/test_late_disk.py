"""Waiting rows cost little disk: one write a batch, one shuffle of what is new or waits, and short identities."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.streaming import unresolved as U

ROWS = 4000


def batch(spark, first, n):
    i = F.col("id").cast("string")
    keys = F.array(U.key("A", F.concat(F.lit("a"), i)), U.key("B", F.concat(F.lit("b"), i)))
    return spark.range(first, first + n).select(F.concat(F.lit("n"), i).alias("name"), F.lit(1).alias("amount"), F.sha2(i, 256).alias("source_hash"), keys.alias("keys"), F.slice(keys, 1, 1).alias("retry_keys"), F.lit(None).cast("string").alias("_error"))


def lookups(spark, kind, every):
    return spark.range(0, 2 * ROWS, every).select(F.lit(kind).alias("kind"), F.concat(F.lit(kind.lower()), F.col("id")).alias("value"), F.concat(F.lit(kind), F.col("id")).alias("reco_id"))


def written(folder, name):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(f"{folder.removeprefix('file://')}/{name}") for f in files if f.endswith(".parquet"))


@pytest.fixture
def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    seen = set()

    def since() -> int:
        listed = store.stageList(None, False, False, none, None)
        new = {listed.apply(i).stageId(): listed.apply(i).shuffleWriteRecords() for i in range(listed.size()) if listed.apply(i).stageId() not in seen}
        seen.update(new)
        return sum(new.values())

    return since


@pytest.mark.parametrize("few", [True, False])
def test_batches_write_and_shuffle_little(spark, shuffled, monkeypatch, few):
    if not few:
        monkeypatch.setattr(U, "BROADCAST_BYTES", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        waiting = U.waiting_table(spark, "name string, amount int")
        shuffled()
        none = spark.createDataFrame([], U.LOOKUP)
        waiting.step(0, batch(spark, 0, ROWS), none)
        one = waiting.step(1, batch(spark, ROWS - 10, ROWS + 10), lookups(spark, "B", 2))
        two = waiting.step(2, batch(spark, 0, 0), lookups(spark, "A", 5))
        three = waiting.step(3, batch(spark, 0, 0), none)
        moved = shuffled()
        # the ten that come again are new rows, whose second candidate counts
        assert (one["resolved"], one["retried"], one["resolved_late"], one["rows_duplicate"], one["unresolved"]) == (ROWS // 2 + 5, ROWS, 5, 10, 2 * ROWS - ROWS // 2 - 5)
        left = {f"n{i}" for i in range(2 * ROWS) if i < ROWS - 10 or i % 2}
        late = {f"n{i}" for i in range(0, 2 * ROWS, 5)} & left
        assert two["resolved"] == two["resolved_late"] == len(late) and three["unresolved"] == len(left - late)
        end = {r["name"]: (r["reco_id"], r["tier"], r["resolved_in"]) for r in waiting.entries(3).collect()}
        assert end == {f"n{i}": (None, None, None) if f"n{i}" in left - late else (f"A{i}", 1, 2) if f"n{i}" in late else (f"B{i}", 2, 1) for i in range(2 * ROWS)}
        assert waiting.unresolved_rows(3).filter("source_hash = sha2('1', 256)").count() == 1 and waiting.resolved_rows(3).filter("source_hash = sha2('5', 256)").count() == 1
        if few:
            rows = ROWS + (ROWS + 10) + ROWS  # new ones, twice, and those that wait when others come
            keys = 3 * (ROWS + 2 * ROWS // 5)  # made distinct, and joined with those before
            assert moved < rows + keys + 100  # a batch without new rows shuffles none
            assert sum(written(waiting.folder, n) for n in ("rows", "tried", "staged", "resolved", "unresolved")) < 24 * ROWS * 34
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_identities_are_kept_whole(spark):
    texts = ["ab12", "AB12", "abc", "", "hé", None, "00", "0" * 64]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", U.packed("t").alias("p")).select("t", U.unpacked("p").alias("u"), "p").collect()
    assert all(r["t"] == r["u"] for r in got) and len({bytes(r["p"]) for r in got if r["p"] is not None}) == 7

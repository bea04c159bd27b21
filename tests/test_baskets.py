"""Forced matches of baskets: each refusal, and nothing changes for a refused basket."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.plans.matching import force_match


def test_refusals(spark):
    live = spark.createDataFrame(
        [(i, f, c, Decimal(a), s, r) for i, f, c, a, s, r in [(1, 1, "EUR", "5", "PENDING", "A"), (2, 1, "EUR", "-5", "PENDING", "B"), (3, 1, "EUR", "5", "EXCLUDED", "A"), (4, 2, "EUR", "-5", "PENDING", "A"), (5, 1, "USD", "-5", "PENDING", "A"), (6, 1, "EUR", "7", "PENDING", None), (7, 1, "EUR", "-7", "PENDING", "C"), (8, 1, "EUR", "0", "PENDING", "C")]],
        "id long, flow_id int, currency string, amount decimal(20,4), status string, reco_id string",
    )
    asked = {"good": [1, 2, 2, 1], "lost": [1, 2, 99, 98], "busy": [3, 2], "flows": [1, 4], "money": [1, 5], "sum": [1, 6], "none": [97], "twin": [1, 2, 8], "own": [6, 7]}
    baskets = spark.createDataFrame([(b, i) for b, ids in asked.items() for i in ids], "basket_id string, id long")
    groups, marked = force_match(live, baskets)
    got = {r["basket_id"]: r for r in groups.collect()}
    assert {b: r["refusal"] for b, r in got.items()} == {"good": None, "lost": "NOT_FOUND", "busy": "NOT_PENDING", "flows": "FLOWS", "money": "CURRENCIES", "sum": "NOT_BALANCED", "none": "NOT_FOUND", "twin": "TAKEN", "own": None}
    assert (got["lost"]["missing"], got["busy"]["not_pending"], got["good"]["n"]) == ("98,99", "3", 2)
    assert (got["good"]["reco_id"], got["own"]["reco_id"]) == (None, "C")
    assert {r["id"] for r in marked.filter("status = 'FORCED'").collect()} == {1, 2, 6, 7} and marked.count() == 8
    assert {r["match_group"] for r in marked.filter("id IN (1, 2)").collect()} == {got["good"]["match_group"]}
    groups, marked = force_match(live, baskets.limit(0))
    assert groups.isEmpty() and marked.filter("status = 'FORCED'").isEmpty()


def test_rows_of_baskets_are_computed_once(spark):
    live = spark.range(20).select("id", F.lit(1).alias("flow_id"), F.lit("EUR").alias("currency"), F.lit(0).cast("decimal(20,4)").alias("amount"), F.lit("PENDING").alias("status"), F.lit("A").alias("reco_id"))
    calls = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda i: calls.add(1) or i, "long").asNondeterministic()
    baskets = spark.range(10).select((F.col("id") % 3).alias("basket_id"), seen("id").alias("id"))
    groups, marked = force_match(live, baskets)
    assert groups.filter("may_match").count() == 3 and marked.filter("status = 'FORCED'").count() == 10
    assert calls.value == 10


def test_hashes_of_members_are_shuffled_once(spark, sf):
    """Exchanges of the plans by what they are hashed by: a member's rows go by its hash once a side, then by their bucket."""
    import re

    from tallyforge import queries as registry

    for name, most in (("plan_graph_keys", 3), ("agg_bucket_report", 5)):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange\b", plan)) <= most, plan


def test_hubs_of_null_and_single_members(spark):
    from tallyforge.operators.aggregates import hub_signatures

    members = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "source_hash string, n int").select("source_hash", F.col("n").cast("decimal(20,4)").alias("amount"))
    keys = spark.createDataFrame([("a", "T", "x"), ("b", "T", "x"), ("c", "T", "y"), ("c", "T", "y"), (None, "T", "y"), ("a", "T", "z")], "source_hash string, key_type string, key_value string")
    for least in (2, 1):
        got = {r["signature"]: (r["members"], int(r["net"])) for r in hub_signatures(members, keys, least).collect()}
        assert got == ({"T=x": (2, 3), "": (1, 4)} if least == 2 else {"T=x|T=z": (1, 1), "T=x": (1, 2), "T=y": (1, 4)})


def test_rates_count_keys_without_expanding_rows(spark):
    from tallyforge.operators.aggregates import match_rates

    left = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", None), (None, "a")], "status string, k string")
    df = match_rates(left, spark.createDataFrame([("a",), ("a",), (None,)], "k string"), "k", "status")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([("s", 2, 1, 50.0), ("t", 0, 0, None), (None, 1, 1, 100.0)], key=repr)
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()

"""The stored index: five exact paths, parts only on demand, few folders read, pages that cover all payments."""

import random

from pyspark.sql import functions as F

from tallyforge.plans import search as X


def index(spark, tmp_path, live, statuses=(), keys=(), bulks=(), lots=()):
    entries = spark.createDataFrame(live, "id long, reco_id string, external_ref string, ref_no string, remarks_1 string")
    table = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    found = X.identifiers({"live": entries}, table(statuses, "po_id string, reco_id string"), table(keys, "lot_id string, key_type string, key_value string"), table(bulks, "po_id string, reco_id string"), table(lots, "lot_id string"))
    X.write_index(found, str(tmp_path / "index"))
    return str(tmp_path / "index")


def look(spark, folder, *queries):
    return sorted((tuple(r) for r in X.search(spark, folder, spark.createDataFrame(list(queries), "text string, broad boolean")).collect()), key=repr)


def test_exact_paths_come_first_and_parts_on_demand(spark, tmp_path):
    live = [(1, "K1", "REF-77", "K1", None), (2, None, "K1", "xx", "yy"), (3, "K3", "a_b%c", "A_B%C", "ref-77")]
    folder = index(spark, tmp_path, live, [("K1", "S"), ("K1", "S")], [("L1", "MSGID", "K1"), ("L2", "PO", "ref-7")], [("K1", "B")], [("K1",)])
    exact = [("K1", "bulk_key", "po_id", "B", None, False), ("K1", "live", "external_ref", None, None, False), ("K1", "live", "reco_id", "K1", None, False), ("K1", "lot", "id", None, "K1", False), ("K1", "lot_key", "key MSGID", None, "L1", False), ("K1", "status", "po_id", "S", None, False)]
    assert look(spark, folder, (" K1 ", True), ("", True), (None, True), ("K1", False)) == exact
    assert look(spark, folder, ("f-7", False), ("nothing", True)) == []
    assert look(spark, folder, ("F-7", True)) == [("F-7", "live", "external_ref", "K1", None, True), ("F-7", "live", "remarks_1", "K3", None, True), ("F-7", "lot_key", "key PO", None, "L2", True)]
    assert look(spark, folder, ("_b%", True)) == [("_b%", "live", "external_ref", "K3", None, True)]  # signs aren't wildcards; a row counts once
    assert look(spark, folder, ("f", True)) == look(spark, folder, ("F", True), )[:0] + [("f", "live", "external_ref", "K1", None, True), ("f", "live", "remarks_1", "K3", None, True), ("f", "lot_key", "key PO", None, "L2", True)]


def test_parts_against_plain_comparison(spark, tmp_path):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abAB-/1") for _ in range(n))
    live = [(i, f"R{i % 9}", word(8), word(5), word(3)) for i in range(300)]
    folder = index(spark, tmp_path, live)
    texts = sorted({word(r.choice([1, 2, 3, 4, 5])) for _ in range(60)})
    got = {x for x in look(spark, folder, *[(t, True) for t in texts])}
    want = set()
    for t in texts:
        rows = [(row, [f for f in row[1:] if f == t]) for row in live]
        if any(m for _, m in rows):
            want |= {(t, "live", X.ENTRY_FIELDS[row[1:].index(t)], row[1], None, False) for row, m in rows if m}
        else:
            want |= {(t, "live", next(n for n, f in zip(X.ENTRY_FIELDS, row[1:], strict=True) if t.upper() in f.upper()), row[1], None, True) for row in live if any(t.upper() in f.upper() for f in row[1:])}
    assert got == want


def test_one_search_reads_few_folders(spark, tmp_path):
    folder = index(spark, tmp_path, [(i, f"K{i}", f"REF{i}", f"N{i}", f"M{i}") for i in range(2000)])
    values = spark.read.parquet(f"{folder}/values")
    text = "REF77"
    plan = values.filter((F.col("value") == text) & (F.col("bucket") == X.bucket_of(F.lit(text)))).select("value")
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert len(files(plan)) * 8 < len(files(values)) and plan.count() == 1


def test_pages_cover_all_payments(spark):
    statuses = spark.range(2500).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("po_id"), F.when(F.col("id") % 3 == 0, "B").otherwise("A").alias("reco_id"))
    keys = spark.createDataFrame([("A",), ("B",), ("B",)], "reco_id string")
    seen, after = [], None
    while page := X.payment_page(statuses, keys, after).select("reco_id", "po_id").collect():
        seen += [tuple(r) for r in page]
        after = tuple(page[-1])
    assert seen == sorted(tuple(r) for r in statuses.select("reco_id", "po_id").collect()) and len(seen) == 2500


def test_common_runs_do_not_pair_texts_with_values(spark, tmp_path):
    folder = index(spark, tmp_path, [(i, f"K{i}", f"TX{100000 + i}#1", None, None) for i in range(2000)])
    texts = [(f"tx{100000 + i}#2", True) for i in range(1000)] + [("X100007#", True)]
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    def stages():
        listed = store.stageList(None, False, False, none, None)
        return {listed.apply(i).stageId(): listed.apply(i).shuffleWriteRecords() for i in range(listed.size())}
    before = set(stages())
    assert look(spark, folder, *texts) == [("X100007#", "live", "external_ref", "K7", None, True)]
    assert sum(n for stage, n in stages().items() if stage not in before) < 40000  # texts times values are 2,000,000


def test_groups_are_summed_before_they_meet_the_texts(spark):
    entries = spark.createDataFrame([("none", "EUR", 1), ("none", "EUR", -1), ("K", "USD", 2)], "reco_id string, currency string, amount int").withColumn("amount", F.col("amount").cast("decimal(20,4)"))
    matches = spark.createDataFrame([("a", "none", None), ("b", "none", None), ("b", None, "K")], "text string, reco_id string, lot_id string")
    found = X.found_groups(entries, matches)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("sum(")  # the sum is below the join
    assert sorted(map(tuple, found.select("text", "reco_id", "currency", "n", F.col("net").cast("int"), "is_balanced").collect())) == [("a", "none", "EUR", 2, 0, True), ("b", "K", "USD", 1, 2, False), ("b", "none", "EUR", 2, 0, True)]

"""Weighted texts, tables by name, and workbooks in files."""

import os

import pytest

from tallyforge.sources import reader, texts


def test_weights_of_each_kind_of_source(spark, tmp_path):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    one = spark.createDataFrame([("a",), ("a",), (" ",), ("",), (None,), (" a",)], "transaction_particulars string")
    assert rows(texts.weighted_from_ledgers([one, one.limit(2)])) == [(" a", 1), ("a", 4)]
    (tmp_path / "x.csv").write_text('k,TransactionParticulars\n1, a \n2,a\n3,"b\nc"\n4,\n')
    assert rows(texts.weighted_from_csv(spark, str(tmp_path / "x.csv"))) == [("a", 2), ("b\nc", 1)]
    (tmp_path / "y.txt").write_text("a\n\n  \n a\na\n")
    assert rows(texts.weighted_from_lines(spark, str(tmp_path / "y.txt"))) == [(" a", 1), ("a", 2)]
    (tmp_path / "z.csv").write_text("k\n1\n")
    with pytest.raises(ValueError, match="none of"):
        texts.weighted_from_csv(spark, str(tmp_path / "z.csv"))


def test_tables_by_parts_of_their_names(spark):
    try:
        for name, sql in (("q9_PAYMORD_1", "SELECT 'a' AS po, 1 AS amount"), ("q9_x_return", "SELECT 'b' AS PO"), ("q9_else", "SELECT 'c' AS po")):
            spark.sql(sql).createOrReplaceTempView(name)
        names = texts.tables_like(spark, ["paymord", "Return"], "Q9_")
        assert [n.lower() for n in names] == ["q9_paymord_1", "q9_x_return"]
        got = texts.union_of_tables(spark, names, {"po": "string", "amount": "long"}).collect()
        assert [(r["po"], r["amount"]) for r in got] == [("a", 1), ("b", None)]
        assert texts.union_of_tables(spark, [], {"po": "string"}).columns == ["table_name", "po"]
    finally:
        for name in ("q9_PAYMORD_1", "q9_x_return", "q9_else"):
            spark.catalog.dropTempView(name)


def test_workbooks_in_files(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "concat('n', id) AS name").coalesce(1)
    files = texts.write_workbooks(df, str(tmp_path / "books"), most=10, sheet="s").collect()
    assert sorted(r["rows"] for r in files) == [5, 10, 10] and sorted(os.listdir(tmp_path / "books")) == sorted(r["file"] for r in files)
    back = reader("workbook")(spark, str(tmp_path / "books"), {"sheet": "s", "columns": {"id": "long", "name": "string"}})
    assert sorted((r["id"], r["name"]) for r in back.collect()) == [(i, f"n{i}") for i in range(25)]

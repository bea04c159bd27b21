"""An inbox: files once, bad ones aside, paths that leave it refused."""

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.sources.records import split_records
from tallyforge.streaming import inbox as B


def read(spark, paths):
    rows = split_records(spark, paths, "quoted", columns=["k", "v"], header=True)
    return rows.drop("start").withColumn("_error", F.coalesce("_error", F.when(F.col("v").try_cast("int").isNull(), "no number")))


def test_files_come_in_once_and_bad_ones_stop_nothing(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    box = os.path.join(root, "cash")
    os.makedirs(box)
    put = lambda name, body: open(os.path.join(box, name), "wb").write(body)  # noqa: E731, SIM115
    put("a.csv", b"k,v\nx,1\ny,2\n")
    put("b.csv", b"k,v\nx,1\nz,q\nw,3\n")
    put("bad.csv", b"\xff\xfe\n")
    put("c.csv", b"k,v\nx,?\n")
    put("none.csv", b"")
    put(".hidden.csv", b"k,v\nh,1\n")
    put("other.txt", b"k,v\no,1\n")
    run = lambda: B.run_inbox(spark, root, box, read, F.concat_ws("|", "k", "v"), out, pattern="*.csv", files_at_once=2)
    entries, runs = run()
    got = {r["file"]: (r["rows_in"], r["rows_ok"], r["rows_ko"], r["rows_duplicate"], r["status"], r["error"]) for r in runs.collect()}
    one = {("a.csv", 2, 2, 0, 0, "SUCCESS"), ("b.csv", 3, 1, 1, 1, "PARTIAL")}, {("a.csv", 2, 1, 0, 1, "SUCCESS"), ("b.csv", 3, 2, 1, 0, "PARTIAL")}
    assert {(f, *got[f][:5]) for f in ("a.csv", "b.csv")} in one  # the first batch that has the row x takes it
    assert got["bad.csv"] == (1, 0, 1, 0, "FAILED", "file error: UnicodeDecodeError") and got["c.csv"][4:] == ("FAILED", "no number") and got["none.csv"] == (0, 0, 0, 0, "SUCCESS", None)
    assert sorted(os.listdir(out + "/processed")) == ["a.csv", "b.csv", "none.csv"] and sorted(os.listdir(out + "/error")) == ["bad.csv", "c.csv"]
    assert sorted(os.listdir(box)) == [".hidden.csv", "other.txt"] and sorted(r["k"] for r in entries.collect()) == ["w", "x", "y"]
    put("d.csv", b"k,v\ny,2\nn,9\n")
    entries, runs = run()
    assert entries.count() == 4 and [tuple(r)[:5] for r in runs.filter("file = 'd.csv'").collect()] == [("d.csv", 2, 1, 0, 1)]


def test_listing_refuses_what_leaves_the_inbox(tmp_path):
    root, away = tmp_path / "in", tmp_path / "away"
    root.mkdir()
    away.mkdir()
    (away / "x.csv").write_text("k\n")
    assert B.listing(str(root), str(root / "new")) == [] and (root / "new").is_dir()
    for name in ("b.csv", "a.csv", ".c.csv", "d.txt"):
        (root / "new" / name).write_text("k\n")
    (root / "new" / "sub.csv").mkdir()
    assert [x.rsplit("/", 1)[-1] for x in B.listing(f"file://{root}", f"file://{root}/new", "*.csv")] == ["a.csv", "b.csv"]
    (root / "link").symlink_to(away)
    (root / "new" / "e.csv").symlink_to(away / "x.csv")
    for folder in (str(root / ".." / "away"), str(away), str(root / "link"), str(root / "new"), str(tmp_path / "in2")):
        with pytest.raises(ValueError, match="outside"):
            B.listing(str(root), folder)

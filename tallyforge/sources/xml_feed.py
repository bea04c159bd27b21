"""XML feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.normalise import clean
from tallyforge.sources.delimited import ENTRY_TEXTS, delimited_entries
from tallyforge.sources.records import split_records


def read_xml(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """One row per ``row_tag`` element; ``fields`` maps names to columns of it, read as text, empty as null."""
    fields = config["fields"]
    schema = ", ".join(f"`{source}` string" for source in dict.fromkeys(fields.values()))
    raw = spark.read.format("xml").option("rowTag", config["row_tag"]).schema(schema).load(path)
    return raw.select(*[clean(F.col(source)).alias(name) for name, source in fields.items()])


def steps(path: str) -> list[str]:
    """The steps of a path below a record: child elements, at the end perhaps an attribute or text(); no prefixes."""
    out = [x.split(":")[-1] if not x.startswith("@") else "@" + x[1:].split(":")[-1] for x in path.strip().split("/") if x not in ("", ".", "text()")]
    if any("@" in x for x in out[:-1]) or any(set(x) & set("[]()*|") for x in out):
        raise ValueError(f"a path is steps of elements and may end in an attribute: {path!r}")
    return out


def path_tree(paths: Sequence[list[str]]) -> dict:
    """The elements that paths go through; ``""`` marks those whose text is asked for."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path:
            at = at.setdefault(step, {})
        if not path[-1].startswith("@"):
            at[""] = {}
    return tree


def tree_schema(tree: dict) -> str:
    """Fields of an element: every child may come several times, so each is an array."""
    fields = []
    for name, below in tree.items():
        if name == "":
            fields.append("`_VALUE`: string")
        elif name.startswith("@"):
            fields.append(f"`_{name[1:]}`: string")
        else:
            fields.append(f"`{name}`: array<{'string' if set(below) == {''} else f'struct<{tree_schema(below)}>'}>")
    return ", ".join(fields)


def hits(path: list[str], tree: dict) -> Column:
    """All texts that a path leads to, in the order of the document."""
    first, *rest = path
    if first.startswith("@"):
        return F.array(F.col(f"`_{first[1:]}`"))
    at, found = tree[first], F.col(f"`{first}`")

    def child(name: str):
        return lambda x: F.coalesce(x[name], F.array())

    for step in rest:
        if step.startswith("@"):
            name = f"_{step[1:]}"
            return F.transform(found, lambda x: x[name])
        found, at = F.flatten(F.transform(found, child(step))), at[step]
    return found if set(at) == {""} else F.transform(found, lambda x: x["_VALUE"])


def read_xml_paths(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """(file, no, fields, _error) of records by paths: ``field_xpaths`` maps names to a path or to several, of which the first hit wins.

    The record is the element that ``record_xpath`` ends in, wherever it stands; a large file is cut at records and read
    by several tasks, and ``_error`` tells of records that aren't well-formed and of files that can't be read. Of several
    elements on a path the first counts, even if it is empty; texts are trimmed, empty ones and missing paths are null.
    Paths are steps of elements from the record, which may end in an attribute (``Amt/@Ccy``); prefixes of names don't
    count.
    """
    listed = {name: [steps(p) for p in ([given] if isinstance(given, str) else given)] for name, given in config["field_xpaths"].items()}
    tree = path_tree([p for paths in listed.values() for p in paths])
    tag = steps(config["record_xpath"])[-1]
    schema = spark.createDataFrame([], f"record struct<{tree_schema(tree)}, `_bad`: string>").schema["record"].dataType
    options = {k: config[k] for k in ("encoding", "glob", "range_bytes") if k in config}
    raw = split_records(spark, path, "element", tag=tag, **options)
    parsed = F.from_xml("value", schema.simpleString(), {"ignoreNamespace": "true", "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    raw = raw.withColumn("__record", parsed).select("file", "no", "_error", "__record.*")
    value = lambda paths: F.coalesce(*[clean(F.try_element_at(hits(p, tree), F.lit(1))) for p in paths])
    unread = F.when(F.col("_bad").isNotNull(), "not well-formed")
    return raw.select("file", "no", *[value(paths).alias(name) for name, paths in listed.items()], F.coalesce("_error", unread).alias("_error"))


def read_xml_entries(spark: SparkSession, path: str, config: Mapping) -> DataFrame:
    """Canonical entries of XML records (``delimited_entries``), whose fields are read by paths."""
    raw = read_xml_paths(spark, path, config)
    names = (*ENTRY_TEXTS, "amount", "value_date", "operation_date")
    full = raw.withColumns({k: F.lit(None).cast("string") for k in names if k not in raw.columns})
    return delimited_entries(full, {**config, "column_map": {k: k for k in names}})

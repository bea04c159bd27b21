"""URL filters: listed rules first, then a path-template tree per host with smoothed labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import BROADCAST_BYTES, joined, table, without
from tallyforge.llm.decontaminate import LOWER, UPPER

OUT = ("host", "path", "rule", "verdict", "template", "purity")
#: The listed rules: (host/path prefix, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Pieces that the rows of one node are dealt over where its side is too large to broadcast.
SALTS = 16
#: A url of more rows than this is joined apart from the others.
MANY = 1000
#: Segments that look like identifiers.
VARIABLE = r"^[0-9]+(\.[a-z]+)?$|[0-9]{4,}|^[0-9a-fA-F-]{24,}$"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or above it and whose path begins the url's; else null."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def salted(rows: DataFrame, slim: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join with a slim side that is repeated for each of ``SALTS`` salts, so that the rows of one key go to many tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return rows.join(slim.withColumn("__salt", salts), [*keys, "__salt"], how).drop("__salt")


def templates(spark: SparkSession, urls: DataFrame, depth: int, branches: int) -> DataFrame:
    """(host, path, n, seen, bad, template, levels) of distinct (host, path): a tree of segments per host, level by level.

    A node (host and generalised prefix) gets a wildcard ``*`` if it has more than ``branches`` different segments below
    or if at least half of its rows have a segment that looks like an identifier. Below ``depth`` levels a segment is a
    wildcard by its look alone. ``levels`` lists the template's prefixes, one for each level of the tree that it has and
    the whole template.
    """
    given = ("host", "path", "n", "seen", "bad")
    rows = urls.withColumn("parts", F.filter(F.split("path", "/"), lambda x: x != "")).withColumn("template", F.lit(""))
    rows = rows.withColumn("levels", F.array().cast("array<string>"))
    done = None
    for level in range(1, depth + 1):
        rows = table(spark, rows, "templates")
        ended = rows.filter(F.size("parts") < level)
        done = ended if done is None else done.unionByName(ended)
        rows = rows.filter(F.size("parts") >= level).withColumn("part", F.element_at("parts", F.lit(level)))
        if rows.isEmpty():
            break
        below = rows.groupBy("host", "template", "part").agg(F.sum("n").alias("n"))
        looks = F.sum(F.when(F.col("part").rlike(VARIABLE), F.col("n")).otherwise(0))
        nodes = below.groupBy("host", "template").agg(((F.count("*") > branches) | (2 * looks >= F.sum("n"))).alias("varies"))
        nodes = table(spark, nodes.filter("varies"), "nodes")
        few = nodes.count() * 100 <= BROADCAST_BYTES
        rows = rows.join(F.broadcast(nodes), ["host", "template"], "left") if few else salted(rows, nodes, ["host", "template"], "left")
        step = F.when(F.coalesce("varies", F.lit(False)), F.lit("/*")).otherwise(F.concat(F.lit("/"), "part"))
        rows = rows.withColumn("template", F.concat("template", step)).drop("varies", "part")
        rows = rows.withColumn("levels", F.concat("levels", F.array("template")))
    else:
        look = F.transform(F.slice("parts", depth + 1, F.greatest(F.size("parts") - depth, F.lit(0))), lambda x: F.when(x.rlike(VARIABLE), F.lit("/*")).otherwise(F.concat(F.lit("/"), x)))
        rows = rows.withColumn("template", F.concat("template", F.array_join(look, "")))
        done = rows if done is None else done.unionByName(rows)
    return done.select(*given, "template", F.array_distinct(F.concat("levels", F.array("template"))).alias("levels"))


def purities(spark: SparkSession, leaves: DataFrame, smooth: float, alike: float) -> DataFrame:
    """(host, template, purity) from leaves (host, template, levels, seen, bad): merged branches, then smoothing.

    The sums of a branch are those of all templates below it. A branch whose share is within ``alike`` standard errors
    of its parent's, or that has no labels, is merged into its parent, and so on upwards; a template is judged with all
    that end in the same branch as it. Leaves are one row a template, so all of this is small beside the rows.
    """
    root = F.concat(F.array(F.lit("")), F.filter("levels", lambda x: x != ""))
    leaves = leaves.withColumn("levels", root)
    branch = leaves.select("host", "seen", "bad", F.posexplode("levels").alias("depth", "node"), F.col("levels").alias("all"))
    above = F.when(F.col("depth") > 0, F.element_at("all", F.greatest("depth", F.lit(1))))
    sums = branch.groupBy("host", "node").agg(F.sum("seen").alias("b_seen"), F.sum("bad").alias("b_bad"), F.min(above).alias("above"))
    sums = table(spark, sums, "branches")
    parent = sums.select("host", F.col("node").alias("above"), (F.col("b_bad") / F.greatest("b_seen", F.lit(1))).alias("pooled"))
    pairs = sums.join(parent, ["host", "above"])
    error = F.sqrt(F.col("pooled") * (1 - F.col("pooled")) / F.greatest("b_seen", F.lit(1)))
    apart = (F.col("b_seen") > 0) & (F.abs(F.col("b_bad") / F.greatest("b_seen", F.lit(1)) - F.col("pooled")) > F.lit(alike) * error)
    split = table(spark, pairs.filter(apart).select("host", "node", F.lit(True).alias("apart")), "apart")
    ways = leaves.select("host", "template", "seen", "bad", F.posexplode("levels").alias("depth", "node")).join(split, ["host", "node"], "left")
    group = F.max(F.when(F.col("apart") | (F.col("depth") == 0), F.struct("depth", "node")))["node"]
    placed = ways.groupBy("host", "template").agg(F.first("seen").alias("seen"), F.first("bad").alias("bad"), group.alias("branch"))
    placed = table(spark, placed, "placed")
    merged = placed.groupBy("host", "branch").agg(F.sum("seen").alias("g_seen"), F.sum("bad").alias("g_bad"))
    seen, bad = placed.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = bad / seen if seen else 0.0
    across = placed.groupBy("template").agg(((F.sum("bad") + smooth * overall) / (F.sum("seen") + smooth)).alias("prior"))
    purity = (F.col("g_bad") + smooth * F.col("prior")) / (F.col("g_seen") + smooth)
    return placed.join(merged, ["host", "branch"]).join(across, "template").select("host", "template", purity.alias("purity"))


def judge_urls(
    spark: SparkSession,
    pages: DataFrame,
    *,
    rules: Sequence[tuple[str, str]] = RULES,
    labels: Column | None = None,
    depth: int = 12,
    branches: int = 12,
    smooth: float = 5.0,
    alike: float = 2.0,
    cut: float = 0.5,
    url_col: str = "url",
) -> DataFrame:
    """``pages`` with host, path, rule (or null), verdict, template and purity.

    The longest fitting rule decides. Other urls are judged by their template: per host, a tree of path segments whose
    varying levels are wildcards. Labelled rows (by default those that a rule decided: 1 for block; else ``labels``, a
    column of 1, 0 or null) give each branch of the tree a share of blocked rows, and branches like their parent are
    merged into it (``purities``). A branch's share is smoothed with ``smooth`` rows of the same template's share over
    all hosts, that with as many rows of the overall share; templates of ``cut`` or more are blocked. Without any label
    everything else is allowed.

    Rows are counted by distinct (host, path) first; the tree is built on those slim rows, and what it says of a path
    meets the rows again at the end. Nodes are broadcast up to a size and else joined over salts, urls of many rows are
    joined apart from the others: no task gets a host or a url whole.
    A null url, or one without ``://``, has an empty host and path and is judged by that template. Repeated rows are judged
    alike; an empty table gives an empty result. Input columns named like an output column are replaced.
    """
    pages = without(pages, [c for c in OUT if c != url_col])
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    rows = parsed.withColumn("rule", rule).withColumn("__says", says)
    label = labels if labels is not None else F.when(F.col("__says") == "block", 1).when(F.col("__says") == "allow", 0)
    counts = F.count("*").alias("n"), F.count(label).alias("seen"), F.coalesce(F.sum(label), F.lit(0)).alias("bad")
    urls = rows.groupBy("host", "path").agg(*counts)
    found = table(spark, templates(spark, urls, depth, branches), "url-templates")

    sums = F.sum("seen").alias("seen"), F.sum("bad").alias("bad")
    leaves = table(spark, found.groupBy("host", "template", "levels").agg(*sums), "leaves")
    shares = table(spark, purities(spark, leaves, smooth, alike), "purity")
    of_path = found.select("host", "path", "n", "template")
    few = shares.count() * 200 <= BROADCAST_BYTES
    judged = of_path.join(F.broadcast(shares), ["host", "template"]) if few else salted(of_path, shares, ["host", "template"], "inner")
    judged = table(spark, judged, "judged-paths")

    often = table(spark, judged.filter(F.col("n") > MANY), "often")
    if often.isEmpty():
        full = rows.join(judged.drop("n"), ["host", "path"])
    else:
        rare = joined(spark, rows, often.select("host", "path"), ["host", "path"], "left_anti", 200)
        rare = rare.join(judged.filter(F.col("n") <= MANY).drop("n"), ["host", "path"])
        full = rare.unionByName(joined(spark, rows, often.drop("n"), ["host", "path"], "inner", 300))
    verdict = F.coalesce("__says", F.when(F.col("purity") >= cut, F.lit("block")).otherwise(F.lit("allow")))
    return full.select(*pages.columns, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(spark, pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")

"""Writes as pure functions of a target and a staged batch: insert, upsert, move; the caller swaps versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.windows import keep_in_batch

#: Least number of tasks over which moving rows meet the keys that are there.
MOVE_TASKS = 200


def insert_new(target: DataFrame, staged: DataFrame, key: str, order: Sequence[Column], stores: Sequence[DataFrame] = ()) -> DataFrame:
    """The rows to append: first of each key in the batch whose key is neither in the target nor in the other stores.

    Known keys count once: a key that is a constant leaves the join no key to hash by, and every row would meet all of them.
    """
    known = reduce(lambda a, b: a.unionByName(b), [s.select(key) for s in (target, *stores)]).distinct()
    return keep_in_batch(staged, key, list(order)).join(known, key, "left_anti")


def upsert(target: DataFrame, staged: DataFrame, key: str, policy: Mapping[str, Column | str], order: Sequence[Column], guard: Column | None = None) -> DataFrame:
    """The new target with a column ``change``: INSERTED, UPDATED, UNCHANGED (in both) or KEPT (not staged).

    The batch keeps the last row of each key. ``policy`` names the columns that an update may change, with ``new``
    (take the staged value), ``new_or_old`` (unless it is null), or an expression over ``old_x`` and ``new_x``; all others
    are frozen. ``guard`` over the same names says which rows may change. A row counts as updated only if a value
    differs, so a repeated batch changes nothing.
    """
    new = keep_in_batch(staged, key, list(order), last=True).select(F.col(key).alias("__new"), *[F.col(c).alias(f"new_{c}") for c in target.columns if c != key])
    old = target.select(F.col(key).alias("__old"), *[F.col(c).alias(f"old_{c}") for c in target.columns if c != key])
    both = old.join(new, F.col("__old") == F.col("__new"), "full_outer")
    in_old, in_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    open_ = in_old & in_new & (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False)))
    out, differs = [F.coalesce("__old", "__new").alias(key)], F.lit(False)
    for c in target.columns:
        if c == key:
            continue
        rule = policy.get(c)
        value = F.col(f"old_{c}")
        if rule is not None:
            named = {"new": F.col(f"new_{c}"), "new_or_old": F.coalesce(f"new_{c}", f"old_{c}")}
            value = named[rule] if isinstance(rule, str) else rule
            differs = differs | ~value.eqNullSafe(F.col(f"old_{c}"))
        out.append(F.when(~in_old, F.col(f"new_{c}")).when(open_, value).otherwise(F.col(f"old_{c}")).alias(c))
    change = F.when(~in_old, "INSERTED").when(open_ & differs, "UPDATED").when(in_new, "UNCHANGED").otherwise("KEPT")
    return both.select(*out, change.alias("change"))


def changes(merged: DataFrame) -> DataFrame:
    """How many rows an upsert inserted, updated, left or kept."""
    return merged.groupBy("change").agg(F.count("*").cast("long").alias("n"))


def settle(live: DataFrame, settled: DataFrame, which: Column, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves live rows into the settled ledger: (live, settled, rows whose key had been settled before and so vanish)."""
    # keys compress so well that few tasks would be left to sort them all: their number is kept
    tasks = max(int(live.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOVE_TASKS)
    moving = live.filter(F.coalesce(which, F.lit(False)))
    known = settled.select(key).repartition(tasks, key)
    return live.filter(~F.coalesce(which, F.lit(False))), settled.unionByName(moving.join(known, key, "left_anti")), moving.join(known, key, "left_semi")


def reset(tables: Mapping[str, DataFrame], flow_id: int, dependents: Mapping[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Tables without a flow's rows; dependents (table, key) lose the rows that nothing refers to any more."""
    out = {name: df.filter(F.col("flow_id") != flow_id) if "flow_id" in df.columns else df for name, df in tables.items()}
    for name, (of, key) in dependents.items():
        out[name] = out[name].join(out[of].select(key).distinct(), key, "left_semi")
    return out

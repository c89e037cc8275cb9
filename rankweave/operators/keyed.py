"""Joins and first-per-key that stay whole and balanced when one key is hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this many rows is hot. At most (rows / HOT_ROWS) keys can be.
HOT_ROWS = 200_000
#: A broadcast side never has more rows than this.
BROADCAST_ROWS = 100_000


def missing(c: Column | str) -> Column:
    """True where a string is null or empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality on all pairs; still a hash or merge join."""
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in pairs))


def attach(rows: DataFrame, state: DataFrame, keys: list[str], n: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with the one ``state`` row of their key.

    ``state[n]`` is the number of rows of the key and ``total`` the number of
    all rows. Keys with ``hot_rows`` rows or more can number total/hot_rows at
    most, so their state is broadcast and their rows never move; all other
    rows meet their state in a shuffle in which no key has more than
    ``hot_rows`` rows. Null keys equal null keys. State columns that are not
    keys are added; none may clash with a column of ``rows``.
    """
    at_least = max(hot_rows, -(-total // BROADCAST_ROWS))
    names = {k: f"__{i}_{k}" for i, k in enumerate(keys)}
    side = state.withColumnsRenamed(names)
    cold = side.where(F.col(n) < at_least)
    pairs = [(k, names[k]) for k in keys]
    out = rows.join(cold, same(rows, cold, pairs))
    if total >= at_least:
        hot = side.where(F.col(n) >= at_least)
        hot_keys = F.broadcast(hot.select(*names.values()))
        calm = rows.join(hot_keys, same(rows, hot_keys, pairs), "left_anti")
        out = calm.join(cold, same(calm, cold, pairs)).unionByName(rows.join(F.broadcast(hot), same(rows, hot, pairs)))
    return out.drop(*names.values())


def meet(rows: DataFrame, few: DataFrame, key: str, hot_rows: int = HOT_ROWS, salts: int = 64, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of ``rows`` with all rows that ``few`` has of their key, whatever key is hot in ``rows``.

    ``few`` is broadcast if a count finds it small. Otherwise keys with
    ``hot_rows`` rows or more are spread over ``salts`` tasks, to each of which
    their rows of ``few`` go, and all other keys meet in a plain shuffle.
    """
    if few.count() <= broadcast_rows:
        return rows.join(F.broadcast(few), key)
    hot = rows.groupBy(key).count().where(F.col("count") >= hot_rows).select(key)  # rows / hot_rows at most
    calm = rows.join(F.broadcast(hot), key, "left_anti").join(few, key)
    salted = rows.join(F.broadcast(hot), key, "left_semi").withColumn("__salt", F.floor(F.rand(7) * salts).cast("int"))
    every = few.join(F.broadcast(hot), key, "left_semi").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return calm.unionByName(salted.join(every, [key, "__salt"]).drop("__salt"))


def newest(df: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """The row with the greatest ``at`` of each key, ties broken by the other columns.

    A plain aggregate with map-side combine, so a key that repeats a million
    times sends one row per task. A null ``at`` is older than any other. The
    tie rule makes the result the same on every run.
    """
    rest = [c for c in columns if c not in keys and c != at]
    picked = df.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("__newest"))
    return picked.select(*keys, F.col(f"__newest.{at}").alias(at), *(F.col("__newest")[c].alias(c) for c in rest))

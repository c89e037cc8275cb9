"""The N best rows of every group by simultaneous bisection of per-group cutoffs.

Score columns and identifier are packed into one order-preserving code that no
two rows of a group share. Every round counts, for all open groups at once, the
rows above each midpoint of the group's interval and narrows the interval, until
the rows at or above the group's cutoff number exactly N. No group is ever
sorted or brought to one task: a round sends at most ``midpoints + 1`` counts
per group and task, whatever the group's size.
"""

from __future__ import annotations

from decimal import Decimal
from math import ceil, log2, prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.keyed import HOT_ROWS, attach
from rankweave.session import checkpointed


#: Codes are kept below this, so that every sum of theirs fits 38 digits.
MAX_CODE = 10**37


def _code(rows: DataFrame, order: list[tuple[str, bool]]) -> tuple[Column, str, int, int]:
    """The code, its type, the number of codes, and how many columns of ``order`` fit it.

    ``order``: column and whether greater is better; null is worst.
    """
    aggs = [f(F.col(c)).alias(f"{n}_{i}") for i, (c, _) in enumerate(order) for n, f in (("lo", F.min), ("hi", F.max))]
    got = rows.agg(*aggs).first()
    bounds = [(got[f"lo_{i}"] or 0, got[f"hi_{i}"] or 0) for i in range(len(order))]
    fit = next((k for k in range(len(order), 0, -1) if prod(hi - lo + 2 for lo, hi in bounds[:k]) < MAX_CODE), 1)
    size = prod(hi - lo + 2 for lo, hi in bounds[:fit])
    kind = "bigint" if size < 2**62 else "decimal(38,0)"
    num = lambda n: F.lit(Decimal(n)).cast(kind)
    code = num(0)
    for (c, up), (lo, hi) in zip(order[:fit], bounds):
        step = F.col(c).cast(kind) - num(lo - 1) if up else num(hi + 1) - F.col(c).cast(kind)
        code = (code * num(hi - lo + 2) + F.coalesce(step, num(0))).cast(kind)
    return code, kind, size, fit


def top_n(
    df: DataFrame, group: list[str], order: list[tuple[str, bool]], n: int | Column, midpoints: int = 63, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The rows of ``df`` among the first ``n`` of their group; all columns kept, in no order.

    ``order`` lists integer columns, each with whether a greater value is
    better; the last should identify the row within its group. Null is worse
    than any value in either direction.

    Defined cases: a group of at most ``n`` rows is kept whole; null is a group
    value of its own; rows that agree in every order column can't be told
    apart, so where such rows straddle the cutoff all of them are kept; ``n`` of
    0 or less and an empty table give no rows; other columns pass through.
    Columns that span more bits than a code holds are taken in turn: rows that
    tie at a cutoff in the first ones are cut again by the others. ``n`` may be
    a column that is the same throughout a group.

    Rows are written once to the shared folder, and what made them runs once;
    codes are computed where they are used. Two joins attach intervals and
    cutoffs (hot groups by broadcast, see ``attach``). Of the rows still in
    doubt after the first round group and code are written again; they shrink
    each round.
    """
    if isinstance(n, int) and n <= 0:
        return df.limit(0)
    base = checkpointed(df)
    code, kind, size, fit = _code(base, order)
    base = base.withColumn("__code", code)
    fan = midpoints + 1
    window = Window.partitionBy(*group)  # at most fan rows each
    from_top = window.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    if kind == "bigint":
        width, bucket = F.expr(f"(__hi - __lo) div {fan} + 1"), F.expr("(__code - __lo) div __w")
    else:
        width = F.expr(f"cast(floor((__hi - __lo) / {fan}) as {kind}) + cast(1 as {kind})")
        bucket = F.expr("floor((__code - __lo) / __w)")

    def narrowed(active: DataFrame) -> DataFrame:
        """One row per group: ``__cut`` where it is exact, else the interval still in doubt.

        ``__n`` is the number of rows that the group has in ``active``, ``__size`` in all.
        """
        counts = (
            active.withColumn("__w", width).withColumn("__b", bucket.cast("int"))
            .groupBy(*group, "__need", "__size", "__b")
            .agg(F.count("*").alias("__c"), F.min("__code").alias("__lo"), F.max("__code").alias("__hi"))
            .withColumn("__above", F.sum("__c").over(from_top))
            .withColumn("__n", F.sum("__c").over(window))
        )
        crossing = counts.where("(__above >= __need and __above - __c < __need) or (__n < __need and __above = __n)")
        return crossing.select(
            *group,
            F.expr("if(__above <= __need or __lo = __hi, __lo, null)").alias("__cut"),
            "__lo", "__hi", "__n", F.expr("__above > __need").alias("__tie"),
            F.coalesce("__size", "__n").alias("__size"),
            F.expr("__need - __above + __c").alias("__need"),
        )

    names = [*group, "__code"] + [c for c in base.columns if c == "__left"]
    bounds = {"__lo": F.lit(0).cast(kind), "__hi": F.lit(Decimal(size)).cast(kind), "__need": (n if isinstance(n, Column) else F.lit(n)).cast("long"), "__size": F.lit(None).cast("long")}
    active, cuts, total = base.select(*names).withColumns(bounds).drop("__left"), None, 0
    names = [*group, "__code"]
    for _ in range(ceil(log2(max(2, size)) / log2(fan)) + 3):
        state = checkpointed(narrowed(active))
        exact = state.where("__cut is not null").select(*group, "__cut", F.col("__size").alias("__n"), "__tie", F.col("__need").alias("__rest"))
        cuts = exact if cuts is None else cuts.unionByName(exact)
        open_ = state.where("__cut is null").drop("__cut", "__tie")
        rows, still = state.agg(F.sum("__n"), F.count_if(F.col("__cut").isNull())).first()
        total = max(total, rows or 0)
        if not still:
            break
        active = checkpointed(attach(active.select(*names), open_, group, "__n", rows, hot_rows).where("__code between __lo and __hi").drop("__n"))
    else:
        raise AssertionError("each round divides every open interval, so all close within the bound")
    kept = attach(base, cuts, group, "__n", total, hot_rows).where("__code >= __cut")
    if fit == len(order):
        return kept.select(*df.columns)
    kept = checkpointed(kept)
    tied = F.col("__tie") & (F.col("__code") == F.col("__cut"))
    again = kept.where(tied).select(*[c for c in df.columns if c != "__left"], F.col("__rest").alias("__left"))
    cut = top_n(again, group, order[fit:], F.col("__left"), midpoints, hot_rows)
    return kept.where(~tied).select(*df.columns).unionByName(cut, allowMissingColumns=True).select(*df.columns)

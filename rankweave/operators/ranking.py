"""Six leaderboards from one table of records, with ranks that need no single-task sort."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.operators.keyed import missing
from rankweave.session import checkpointed

#: Thresholds and quotas of the boards.
MIN_WINS, MIN_LOSSES, MAX_WINS, QUOTA, SENIOR_AGE = 10, 10, 384, 50, 60
BOARDS = ("best", "worst", "secondary", "secondaryWorst", "thirdary", "thirdaryWorst")


def locale(name: str) -> Column:
    """A name in the order of a dictionary rather than of code points."""
    return F.collate(F.col(name), "UNICODE")


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with its 1-based place in ``order``, which must be total.

    Rows are range-partitioned and sorted where they lie; the only thing
    gathered is one count per partition. The sorted rows are written first, so
    counts and places come from the same partitions.
    """
    ordered = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part")
        .withColumn(rank, (F.col("__before") + within + 1).cast("long")).drop("__part", "__id", "__before")
    )


def with_scores(stats: DataFrame, as_of_year: int, quality: str = "qualityWins") -> DataFrame:
    """Records with both scores, the senior flag and empty strings turned to null; rows without wins or losses are left out."""
    birth = F.regexp_extract(F.coalesce("birthDate", F.lit("")), r"^\s*(\d+)", 1).try_cast("long")
    blank = lambda c: F.when(~missing(c), F.col(c))
    return stats.where("wins is not null and losses is not null and total is not null").withColumns({
        "secondaryScore": F.col(quality),
        "thirdaryScore": F.when(F.col("losses") == 0, F.col("wins").cast("double")).otherwise(F.try_divide(F.col("wins").cast("double"), F.col("losses").cast("double"))),
        "isSenior": F.coalesce((F.lit(as_of_year) - F.nullif(birth, F.lit(0))) > SENIOR_AGE, F.lit(False)),
        "weightClass": blank("weightClass"), "imageUrl": blank("imageUrl"), "birthDate": blank("birthDate"), "kos": F.coalesce("kos", F.lit(0).cast("long")),
    })


def _desc(*cs: str) -> list[Column]:
    return [-F.col(c) for c in cs]


def quota_walk(df: DataFrame, order: list[Column], counts: Column, quota: int) -> DataFrame:
    """Rows in order until ``quota`` rows that count are taken; others met on the way are kept.

    The place of the last counting row is found by a top-``quota`` of those
    rows; all rows up to it are then a filter. Fewer than ``quota`` counting
    rows keep everything. ``order`` must be total and without nulls.
    """
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    keyed = df.withColumn("__key", key)
    top = keyed.where(counts).select("__key").orderBy("__key").limit(quota)
    last = top.agg(F.struct(F.max("__key").alias("key"), F.count("*").alias("n")).alias("last")).scalar()
    return keyed.where((last["n"] < quota) | (F.col("__key") <= last["key"])).drop("__key")


def _orders(collated: bool, tie: str) -> dict[str, list[Column]]:
    name = locale("name") if collated else F.col("name")
    end = [F.coalesce(name, F.lit("")), F.coalesce(F.col(tie), F.lit(0)) if tie != "name" else F.coalesce("name", F.lit(""))]
    unbeaten = F.when(F.col("losses") == 0, 0).otherwise(1)
    draws = F.coalesce("draws", F.lit(0).cast("long"))
    return {
        "best": [*_desc("wins"), draws, *_desc("kos"), *end],
        "worst": [*_desc("losses"), draws, *end],
        "secondary": [*_desc("secondaryScore"), unbeaten, *_desc("kos"), *end],
        "secondaryWorst": [F.col("secondaryScore"), F.col("kos"), *end],
        "thirdary": [*_desc("thirdaryScore"), *_desc("kos"), *end],
        "thirdaryWorst": [F.col("thirdaryScore"), F.col("kos"), *end],
    }


def _fit(name: str, min_wins: int = MIN_WINS, min_losses: int = MIN_LOSSES, max_wins: int = MAX_WINS) -> Column:
    """Whether a record qualifies for a board."""
    image, score = F.col("imageUrl").isNotNull(), {"s": F.col("secondaryScore") > 0, "t": F.col("thirdaryScore") > 0}
    if name == "best":
        return (F.col("losses") == 0) & (F.col("wins") >= min_wins) & image
    if name == "worst":
        return (F.col("wins") == 0) & (F.col("losses") >= min_losses)
    fit = (F.col("wins") != 0) & image & score[name[0]]
    return fit & (F.col("wins") <= max_wins) if name[0] == "t" else fit


def board(
    scored: DataFrame, name: str, previous: DataFrame | None = None, *, tie: str = "name", collated: bool = True, min_wins: int = MIN_WINS,
    min_losses: int = MIN_LOSSES, max_wins: int = MAX_WINS, quota: int = QUOTA,
) -> DataFrame:
    """One leaderboard of ``with_scores`` records, ranked; ``section`` 1 marks seniors appended after a bottom list.

    Ties that the board's own keys leave are broken by name and ``tie``, so
    every run agrees. With ``previous``, rows ``(name, rank)`` of the last run's
    board, best and worst carry ``previousRank``.

    Defined cases: records with a null in a key column of the board don't
    qualify, but missing draws count as none; an empty table gives no rows.
    """
    order = _orders(collated, tie)[name]
    rows = scored.where(_fit(name, min_wins, min_losses, max_wins))
    rows = rows.withColumn("section", F.lit(0))
    if name in ("secondary", "thirdary"):
        rows = quota_walk(rows, order, ~F.col("isSenior"), quota)
    elif name in ("secondaryWorst", "thirdaryWorst"):
        seniors = rows.where("isSenior").withColumn("section", F.lit(1))
        rows = rows.where("not isSenior").orderBy(*order).limit(quota).unionByName(seniors)
        order = [F.col("section"), *order]
    ranked = global_rank(rows, order)
    if previous is not None and name in ("best", "worst"):
        last = previous.groupBy("name").agg(F.max("rank").alias("previousRank"))
        ranked = ranked.drop("previousRank").join(last, "name", "left")
    return ranked.withColumn("board", F.lit(name))


def previous_ranks(previous: DataFrame, name: str) -> DataFrame:
    """``(name, rank)`` of a stored board ``(board, name, rank, imageUrl)``; in the best board only entries with an image take a place."""
    rows = previous.where(F.col("board") == name)
    if name == "best":
        rows = global_rank(rows.where(~missing("imageUrl")).withColumnRenamed("rank", "stored_rank"), [F.col("stored_rank"), F.col("name")])
    return rows.select("name", "rank")


def boards(scored: DataFrame, previous: DataFrame | None = None, **options) -> DataFrame:
    """All six boards in one long table; ``previous`` is the last run's ``(board, name, rank, imageUrl)``.

    Records that qualify for any board are written once to the shared folder, so
    that what made them, a parse of all pages perhaps, doesn't run once per board.
    """
    limits = {k: options[k] for k in ("min_wins", "min_losses", "max_wins") if k in options}
    scored, out = checkpointed(scored.where(reduce(or_, (_fit(name, **limits) for name in BOARDS)))), None
    for name in BOARDS:
        before = previous_ranks(previous, name) if previous is not None and name in ("best", "worst") else None
        one = board(scored, name, before, **options)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def rank_change(current: DataFrame, rank: str = "rank", previous: str = "previousRank") -> Column:
    """Places gained since the last run; 0 without a previous place."""
    return F.coalesce(F.when(F.col(previous) != 0, F.col(previous) - F.col(rank)), F.lit(0)).cast("long")

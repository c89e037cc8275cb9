"""Filtered and sorted views of a stored board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.country import country_flag, normalize_country
from rankweave.functions.text import display_name, initials, ko_percent
from rankweave.operators.ranking import global_rank, locale, rank_change

# Weight classes from light to heavy.
WEIGHTS = (
    "atomweight", "strawweight", "flyweight", "super flyweight", "bantamweight", "super bantamweight", "featherweight", "super featherweight",
    "lightweight", "super lightweight", "welterweight", "super welterweight", "middleweight", "super middleweight", "light heavyweight",
    "cruiserweight", "heavyweight", "super heavyweight",
)


def weight_ordinal(c: Column) -> Column:
    """1 to 18 from light to heavy; 999 for others and for none."""
    pairs = [F.lit(x) for i, w in enumerate(WEIGHTS, 1) for x in (w, i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(c)), F.lit(999))


def view_order(board: str, sort_by: str, collated: bool = True) -> list[Column]:
    """The order shown, which isn't always the order stored: only the best board heeds ``sort_by``, the others have one order."""
    name = locale("name") if collated else F.col("name")
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    tie = [F.coalesce(F.col("name"), F.lit("")), F.coalesce(F.col("stored_rank"), F.lit(0))]
    if board == "worst":
        return [num("losses").desc(), num("draws"), name, *tie]
    if board in ("secondary", "thirdary"):
        return [num(f"{board}Score").desc(), num("kos").desc(), *tie]
    if board in ("secondaryWorst", "thirdaryWorst"):
        return [num(f"{board[:-5]}Score"), num("kos"), *tie]
    if sort_by == "kos":
        return [num("kos").desc(), *tie]
    if sort_by == "weight":
        return [weight_ordinal(F.col("weightClass")), num("wins").desc(), *tie]
    return [num("wins").desc(), num("draws"), num("kos").desc(), name, *tie]


def view(boards: DataFrame, board: str = "best", gender: str = "all", search: str = "", sort_by: str = "wins", collated: bool = True) -> DataFrame:
    """One board as shown: filtered, searched, sorted, ranked anew, with display name, initials, flag, percentages and rank change.

    A missing gender shows only under ``all``. The search is literal and
    ignores case; an empty search finds all. A missing board is empty. Rank
    change compares with the place in this view.
    """
    rows = boards.where(F.col("board") == board).withColumnRenamed("rank", "stored_rank")
    if gender != "all":
        rows = rows.where(F.col("gender") == gender)
    if search:
        rows = rows.where(F.contains(F.lower(display_name(F.col("name"))), F.lit(search.lower())))
    rows = global_rank(rows, view_order(board, sort_by, collated))
    return rows.withColumns({
        "displayName": display_name(F.col("name")), "initials": initials(F.col("name")), "koPct": ko_percent(F.col("kos"), F.col("wins")),
        "flag": country_flag(normalize_country(F.col("nationality"))), "weightOrdinal": weight_ordinal(F.col("weightClass")), "rankChange": rank_change(rows) if "previousRank" in rows.columns else F.lit(0).cast("long"),
    })

"""Entities found in a category graph of edges ``(parent, child, kind)``, by joins of bounded depth.

Every level reads the edges again, so they should be a table or checkpointed,
not a plan that is costly to run. What is expanded is at category level and
mostly small enough to be sent to the edges; a category with a large part of all
pages is never brought to one task (see ``keyed.meet``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.keyed import meet

# What no entity's title begins with, and what excludes or marks a category.
NOT_PAGES = ("Category:", "List of", "Draft:", "User:", "Template:", "Portal:", "Wikipedia:", "Module:", "File:", "Talk:", "Help:", "MediaWiki:")
DEEP = ("by state", "by populated place", "by descent")
EXTRA_EXCLUDES = (
    " male mixed martial artists", " female mixed martial artists", " by nationality", "Lists of", "Olympic", "Asian Games", "Pan American",
    "Commonwealth", "by populated place",
)


def is_entity_page(title: Column) -> Column:
    """False for titles of other kinds of page."""
    return ~reduce(lambda a, b: a | b, (title.startswith(p) for p in NOT_PAGES))


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(p)) for p in parts))


def is_extra_country(category: Column) -> Column:
    """Country categories that are neither split by gender nor about places and games."""
    return ~_any(category, EXTRA_EXCLUDES)


def _expand(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(root, title)`` of every way from a root to a page, repeats included; ``roots`` is ``(root, at, deep)``.

    Two joins at category level, the second only for deep roots, and one with
    the pages, for all roots at once.
    """
    below = edges.where((F.col("kind") == "subcat") & ~F.contains("child", F.lit("Lists of"))).select(F.col("parent").alias("at"), "child")
    pages = edges.where((F.col("kind") == "page") & is_entity_page(F.col("child"))).select(F.col("parent").alias("at"), F.col("child").alias("title"))
    subs = meet(below, roots, "at").where(~F.col("deep") | _any(F.col("child"), DEEP)).select("root", F.col("child").alias("at"), "deep")
    last = meet(below, subs.where("deep"), "at").select("root", F.col("child").alias("at"))
    at = roots.select("root", "at").unionByName(subs.select("root", "at")).unionByName(last)
    return meet(pages, at, "at").select("root", "title")


def category_pages(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(root, title)``: pages of a category and of its direct subcategories but lists; ``roots`` is ``(root, at)``.

    One level, as wide as the graph is. Repeated edges count once; a root that
    has no edge has no pages.
    """
    return _expand(roots.withColumn("deep", F.lit(False)), edges).distinct()


def category_pages_deep(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(root, title)``: direct pages, and those of ``category_pages`` of the subcategories by state, place or descent."""
    return _expand(roots.withColumn("deep", F.lit(True)), edges).distinct()


def _below(edges: DataFrame, top: str) -> DataFrame:
    return edges.where((F.col("parent") == f"{top} by nationality") & (F.col("kind") == "subcat")).select(F.col("child").alias("at"))


def country_pages(gender_category: str, edges: DataFrame) -> DataFrame:
    """``(root, title)`` under every country of ``<category> by nationality``."""
    return category_pages(_below(edges, gender_category).withColumn("root", F.lit(gender_category)), edges)


def all_pages(edges: DataFrame, male: str = "Category:Male mixed martial artists", female: str = "Category:Female mixed martial artists", everyone: str = "Category:Mixed martial artists") -> DataFrame:
    """``(title, gender)`` of every entity once: female wins over male, male over pages of further countries."""
    roots = [
        _below(edges, female).select(F.lit(0).alias("root"), "at", F.lit(False).alias("deep")),
        _below(edges, male).select(F.lit(1).alias("root"), "at", F.lit(False).alias("deep")),
        _below(edges, everyone).where(is_extra_country(F.col("at"))).select(F.lit(2).alias("root"), "at", F.lit(True).alias("deep")),
    ]
    first = _expand(reduce(DataFrame.unionByName, roots), edges).groupBy("title").agg(F.min("root").alias("first"))
    return first.select("title", F.when(F.col("first") == 0, "female").otherwise("male").alias("gender"))


def attach_gender(records: DataFrame, pages: DataFrame, name: str = "name") -> DataFrame:
    """``records`` with the gender of their page; null for a name that wasn't discovered. ``pages`` has each title once."""
    known = pages.select(F.col("title").alias(name), "gender")
    return records.drop("gender").join(known, name, "left")

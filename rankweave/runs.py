"""The two runs end to end: discover, fetch, parse, rank and store; search, match, merge, store and report what is new."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import page_url, search_name
from rankweave.functions.wikitext import records
from rankweave.operators import discovery, news, ranking
from rankweave.session import checkpointed
from rankweave.sources import api, snapshots
from rankweave.sources.tables import CATEGORY_EDGE, NEWS_ENTRY

MALE, FEMALE, EVERYONE = (f"Category:{x} martial artists" for x in ("Male mixed", "Female mixed", "Mixed"))
#: Levels of categories below a root that discovery looks at: countries, their subcategories, and those of the deep ones.
LEVELS = 4


def cutoff(as_of: datetime, days: int = 30) -> str:
    """The moment ``days`` before ``as_of``, as news dates are written."""
    return (as_of - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{as_of.microsecond // 1000:03d}Z"


def crawl(spark: SparkSession, roots: list[str], options: dict[str, str], concurrency: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(edges, errors)`` of the graph below the roots, level by level; a category is asked for once."""
    at, edges, errors, asked = spark.createDataFrame([(r,) for r in roots], "v string"), [], [], None
    for _ in range(LEVELS):
        got = checkpointed(api.fetch(at, "v", "members", options, concurrency))
        edges.append(got.where("error is null").select(*CATEGORY_EDGE.fieldNames()))
        errors.append(got.where("error is not null"))
        asked = at if asked is None else asked.unionByName(at)
        at = checkpointed(edges[-1].where("kind = 'subcat'").select(F.col("child").alias("v")).distinct().join(asked, "v", "left_anti"))
        if at.isEmpty():
            break
    return reduce(DataFrame.unionByName, edges), reduce(DataFrame.unionByName, errors)


def stats_of(pages: DataFrame, discovered: DataFrame, as_of: datetime) -> DataFrame:
    """Records of fetched ``(pageid, title, wikitext)`` pages, with gender and address; ``discovered`` is ``(title, gender)``."""
    named = records(pages.where("wikitext is not null").select(F.col("title").alias("name"), "wikitext"), "wikitext").drop("wikitext")
    return discovery.attach_gender(named, discovered).withColumns({"wikipediaUrl": page_url(F.col("name")), "lastUpdated": F.lit(as_of).cast("timestamp")})


def report(requested: DataFrame, stats: DataFrame, boards: DataFrame, top: int = 10) -> DataFrame:
    """``(what, place, name, n)``: how many titles were asked for and read, rows of each board, and its first ``top`` names."""
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("name"), "n")
    sizes = boards.groupBy("board").agg(F.count("*").alias("n")).select(F.col("board").alias("what"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("name"), "n")
    firsts = boards.where(F.col("rank") <= top).select(F.col("board").alias("what"), F.col("rank").alias("place"), "name", F.lit(None).cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [count(requested, "requested"), count(stats, "read"), sizes, firsts])


def rankings_run(
    spark: SparkSession, root: str, run_id: str, as_of: datetime, options: dict[str, str], concurrency: int = 5,
    roots: tuple[str, str, str] = (MALE, FEMALE, EVERYONE), **limits,
) -> DataFrame | None:
    """One ranking run from the web interface to a stored snapshot; its report, or nothing if nothing was discovered.

    Ranks of the last stored run become previous ranks of best and worst.
    Titles and pages stay distributed throughout; ``options`` go to the readers
    and ``limits`` to ``ranking.board``.
    """
    male, female, everyone = roots
    edges, _ = crawl(spark, [f"{x} by nationality" for x in roots], options, concurrency)
    pages = checkpointed(discovery.all_pages(checkpointed(edges), male, female, everyone))
    if pages.isEmpty():
        return None
    fetched = checkpointed(api.fetch(pages, "title", "contents", options, concurrency))
    stats = checkpointed(stats_of(fetched, pages, as_of))
    previous = snapshots.read_boards(spark, root)
    ranked = checkpointed(ranking.boards(ranking.with_scores(stats, as_of.year), previous, **limits))
    snapshots.write_boards(ranked, root, run_id)
    return report(pages, stats, snapshots.read_boards(spark, root))


def news_run(
    spark: SparkSession, boards_root: str, root: str, run_id: str, as_of: datetime, options: dict[str, str], days: int = 30,
    send: Callable[[DataFrame], None] | None = None,
) -> bool:
    """One news run: the watch list is searched, articles are matched and merged with the last snapshot, which is stored; tells whether it wrote.

    Without an ``apikey`` an empty run is stored, and one that found no article
    stores nothing. ``send`` gets the digest of what the run before didn't have.
    """
    if not options.get("apikey"):
        return snapshots.write_news(spark.createDataFrame([], NEWS_ENTRY), root, run_id, allow_empty=True)
    watched = checkpointed(news.watch_list(snapshots.load_board(spark, boards_root, "thirdary")))
    asked = watched.select(search_name(F.col("name")).alias("asked"), F.col("name"), F.col("rank").alias("__rank"))
    found = checkpointed(api.fetch(asked, "asked", "articles", {**options, "from": cutoff(as_of, days)[:10]}, 1))
    if found.where("error is null").isEmpty():
        return False
    ranked = found.where("error is null").withColumnRenamed("fighter", "asked").join(F.broadcast(asked), "asked").withColumnRenamed("name", "fighter").drop("asked")
    order = [F.col("__rank"), F.col("article_ord")]
    new = news.link_articles(ranked, watched, order).withColumn("seq", F.lit(0))
    before = snapshots.read_news(spark, root)
    merged = checkpointed(news.rolling_merge(new, before.withColumn("seq", F.lit(0)), cutoff(as_of, days)).orderBy(*news.newest_first()))
    wrote = snapshots.write_news(merged.drop("seq"), root, run_id)
    if wrote and send:
        send(news.digest_lines(news.new_since(merged.drop("seq"), before)))
    return wrote

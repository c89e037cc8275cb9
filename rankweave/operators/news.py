"""News items linked to ranked names, merged into a rolling window, compared with the last run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.text import search_name
from rankweave.operators.keyed import missing


def first_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should be total; all columns kept.

    An aggregate that combines on the map side, so a hot key sends one row per
    task. Null is a key of its own. Ties beyond ``order`` fall to the least row.
    """
    if not df.columns:
        return df
    row = F.struct(*(F.col(c) for c in df.columns))
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), row.alias("row"))
    picked = df.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min(place).alias("__p"))
    return picked.select("__p.row.*")


def watch_list(board: DataFrame, size: int = 50) -> DataFrame:
    """``(name, rank)`` of the first ``size`` non-seniors of a ranked board, ranked anew."""
    top = board.where("not isSenior").orderBy("rank").limit(size).agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("w"))
    return top.select(F.posexplode("w").alias("p", "x")).select("x.name", (F.col("p") + 1).cast("long").alias("rank"))


#: A watch list longer than this isn't carried by every row of news.
MAX_WATCHED = 10_000


def match_names(articles: DataFrame, watched: DataFrame) -> DataFrame:
    """``articles`` that mention a watched name, with ``boxerName``: the name they were fetched for if mentioned, else the best ranked.

    ``articles`` has title, description and fighter. Names compare in lower
    case without a closing parenthesis. Articles that mention nobody are
    dropped. The list, bounded by its making and checked, is one array that is
    filtered per article: no row is multiplied. Null texts count as empty.
    """
    clean = F.lower(search_name(F.col("name")))
    names = watched.orderBy("rank").limit(MAX_WATCHED + 1).agg(F.sort_array(F.collect_list(F.struct("rank", "name", clean.alias("clean")))).alias("__w"))
    names = names.select(F.when(F.size("__w") > MAX_WATCHED, F.raise_error(F.lit("the watch list is too long"))).otherwise(F.col("__w")).alias("__w"))
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    own = F.lower(search_name(F.coalesce("fighter", F.lit(""))))
    hit = F.get(F.filter("__w", lambda w: F.contains(F.col("__text"), w["clean"])), F.lit(0))["name"]
    rows = articles.withColumns({"__text": text, "__w": names.scalar()})
    name = F.when((F.coalesce("fighter", F.lit("")) != "") & F.contains(F.col("__text"), own), F.col("fighter")).otherwise(hit)
    return rows.withColumn("boxerName", name).where("boxerName is not null").drop("__text", "__w")


def link_articles(articles: DataFrame, watched: DataFrame, order: list[Column]) -> DataFrame:
    """News entries of articles: those without url dropped, matched, then the first of each url.

    Matching comes first, so a copy that mentions nobody doesn't use up its url.
    """
    matched = match_names(articles.where(~missing("url")), watched)
    source = F.coalesce(F.when(~missing(F.col("source")), F.col("source")), F.lit("News"))
    first = first_per_key(matched, [F.col("url")], order)
    return first.select("boxerName", F.coalesce("title", F.lit("")).alias("headline"), "url", source.alias("source"), "publishedAt")


def rolling_merge(new: DataFrame, existing: DataFrame, cutoff: str, order: str = "seq") -> DataFrame:
    """New entries before existing ones, expired ones left out, then the first of each key; ``order`` is each side's sequence.

    The key is the url, or headline and source run together where there is
    none. Entries expire by comparing ``publishedAt`` with ``cutoff`` as text;
    those without a date stay. Expired copies don't use up their key.
    """
    rows = new.withColumn("__side", F.lit(0)).unionByName(existing.withColumn("__side", F.lit(1)))
    live = rows.where(missing("publishedAt") | (F.col("publishedAt") >= F.lit(cutoff)))
    bare = F.concat(F.coalesce("headline", F.lit("")), F.coalesce("source", F.lit("")))
    key = F.when(missing("url"), bare).otherwise(F.col("url"))
    return first_per_key(live, [key], [F.col("__side"), F.col(order)]).drop("__side")


def newest_first() -> list[Column]:
    """The order of merged news: latest text of ``publishedAt`` first, without a date last, then url and headline."""
    return [F.coalesce("publishedAt", F.lit("")).desc(), F.coalesce("url", F.lit("")), F.coalesce("headline", F.lit(""))]


def new_since(current: DataFrame, previous: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``current`` whose key isn't in ``previous``; a missing key equals a missing key."""
    seen = previous.select(F.col(key).alias("__seen")).distinct()
    return current.join(seen, current[key].eqNullSafe(seen["__seen"]), "left_anti")


def headline_distinct(news: DataFrame, order: list[Column]) -> DataFrame:
    """The first entry of each headline and source run together."""
    return first_per_key(news, [F.concat(F.coalesce("headline", F.lit("")), F.coalesce("source", F.lit("")))], order)


def digest_lines(news: DataFrame) -> DataFrame:
    """``news`` with ``line``, one line of a digest: "- headline [source, date] url"; the date is ? where missing or unreadable."""
    date = F.coalesce(F.date_format(F.try_to_timestamp("publishedAt"), "yyyy-MM-dd"), F.lit("?"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return news.withColumn("line", F.concat(F.lit("- "), blank("headline"), F.lit(" ["), blank("source"), F.lit(", "), date, F.lit("] "), blank("url")))

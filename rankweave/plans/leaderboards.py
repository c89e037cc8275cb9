"""Queries of the leaderboard engine over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave import runs
from rankweave.functions import country, text
from rankweave.functions.wikitext import image_url, infobox, quality_wins, records, strip_markup, weight_class
from rankweave.operators import discovery, news, ranking, views
from rankweave.operators.keyed import missing
from rankweave.session import checkpointed, spread
from rankweave.sources.snapshots import document_parts, read_document
from rankweave.sources.tables import table

#: The year that ages are counted to, and the time of the news run, 30 days before which news expires.
AS_OF, RUN_AT = 2023, datetime(2023, 2, 14)
#: Values of the SQL, stated apart from the operators': classes in the order tried, classes from light to heavy.
_CLASSES_SQL = (
    "Super heavyweight|Light heavyweight|Super middleweight|Super featherweight|Light welterweight|Light middleweight|Featherweight|Cruiserweight|"
    "Middleweight|Welterweight|Lightweight|Heavyweight|Bantamweight|Strawweight|Flyweight|Atomweight"
).split("|")
_WEIGHTS_SQL = (
    "atomweight|strawweight|flyweight|super flyweight|bantamweight|super bantamweight|featherweight|super featherweight|lightweight|super lightweight|"
    "welterweight|super welterweight|middleweight|super middleweight|light heavyweight|cruiserweight|heavyweight|super heavyweight"
).split("|")
_ORDINAL_SQL = "case lower(weightclass) " + " ".join(f"when '{w}' then {i}" for i, w in enumerate(_WEIGHTS_SQL, 1)) + " else 999 end"

Query = Callable[[SparkSession, str], DataFrame]


_RANKED = ["rec_id", "name", "total", "wins", "kos", "losses", "draws", "nationality", "gender", "imageurl", "weightclass", "secondaryscore", "birthdate"]


def _scored(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Records once each, with scores; only the columns asked for are read and compared."""
    rows = table(spark, d, "fighter_records").select(*_RANKED, *more).distinct()
    names = {"weightclass": "weightClass", "imageurl": "imageUrl", "birthdate": "birthDate", "lastupdated": "lastUpdated", "wikipediaurl": "wikipediaUrl", "secondaryscore": "qualityWins", "previousrank": "previousRank"}
    return ranking.with_scores(rows.withColumnsRenamed(names), AS_OF)


_SCORED_SQL = f"""
with r as (select distinct {', '.join(_RANKED)} from fighter_records),
s as (select rec_id, name, wins, kos, losses, coalesce(draws, 0) as draws, nullif(gender, '') as gender, nullif(imageurl, '') as image, nullif(weightclass, '') as weightclass,
  secondaryscore as s2, case when losses = 0 then cast(wins as double) else cast(wins as double) / losses end as s3,
  coalesce({AS_OF} - nullif(try_cast(birthdate as int), 0) > 60, false) as senior, icu_sort_key(name, 'root') as k
  from r where wins is not null and losses is not null and total is not null)
"""

_BOARD_SQL = {  # rows that qualify, their order
    "best": ("losses = 0 and wins >= 10 and image is not null", "wins desc, draws, kos desc, k, rec_id"),
    "worst": ("wins = 0 and losses >= 10", "losses desc, draws, k, rec_id"),
    "secondary": ("wins <> 0 and image is not null and s2 > 0", "s2 desc, (losses <> 0), kos desc, k, rec_id"),
    "secondaryWorst": ("wins <> 0 and image is not null and s2 > 0", "s2, kos, k, rec_id"),
    "thirdary": ("wins <> 0 and wins <= 384 and image is not null and s3 > 0", "s3 desc, kos desc, k, rec_id"),
    "thirdaryWorst": ("wins <> 0 and wins <= 384 and image is not null and s3 > 0", "s3, kos, k, rec_id"),
}


def _kept_sql(name: str) -> str:
    fit, order = _BOARD_SQL[name]
    if name in ("best", "worst"):
        return f"select *, 0 as section from s where {fit}"
    if name in ("secondary", "thirdary"):
        return f"""select * exclude (taken), 0 as section from (select *, coalesce(sum(case when senior then 0 else 1 end) over (order by {order} rows between unbounded preceding and 1 preceding), 0) as taken
          from s where {fit}) where taken < 50"""
    return f"select *, 0 as section from (select * from s where {fit} and not senior order by {order} limit 50) union all select *, 1 as section from s where {fit} and senior"


def _board_query(name: str) -> tuple[Query, str]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = ranking.board(_scored(spark, d), name, tie="rec_id")
        return out.select("rec_id", "name", "wins", "losses", "kos", F.col("section").cast("long").alias("section"), "rank")

    order = _BOARD_SQL[name][1]
    sql = f"{_SCORED_SQL}, kept as ({_kept_sql(name)}) select rec_id, name, wins, losses, kos, cast(section as bigint) as section, row_number() over (order by section, {order}) as rank from kept"
    return query, sql


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Both scores and the senior flag of every record."""
    return _scored(spark, d).select("rec_id", F.col("secondaryScore").alias("s2"), F.round("thirdaryScore", 9).alias("s3"), "isSenior")


def _snapshot_board(spark: SparkSession, d: str, name: str, last: bool, previous: DataFrame | None = None) -> DataFrame:
    """A board of one whole snapshot; every fighter counts as pictured."""
    rows = table(spark, d, "ranking_snapshots")
    pick = rows.agg((F.max if last else F.min)("snapshot_id").alias("snapshot_id"))
    rows = rows.join(F.broadcast(pick), "snapshot_id")
    state = F.max(F.struct("lastupdated", "name", "wins", "kos", "losses", "draws")).alias("x")
    rows = rows.groupBy("fighter_id").agg(state).select("fighter_id", "x.*")
    scored = rows.select("fighter_id", "name", "wins", "kos", "losses", "draws", F.lit("x").alias("imageUrl"))
    return ranking.board(scored, name, previous, tie="fighter_id", min_wins=5, min_losses=5)


def _movement(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        first = _snapshot_board(spark, d, name, False).select("board", "name", "rank", "imageUrl")
        now = _snapshot_board(spark, d, name, True, ranking.previous_ranks(first, name))
        return now.select("fighter_id", "name", "rank", "previousRank", ranking.rank_change(now).alias("change"))

    return query


def _movement_sql(name: str) -> str:
    fit, order = {"best": ("losses = 0 and wins >= 5", "wins desc, coalesce(draws, 0), kos desc"), "worst": ("wins = 0 and losses >= 5", "losses desc, coalesce(draws, 0)")}[name]
    return f"""
with u as (select *, row_number() over (partition by snapshot_id, fighter_id order by lastupdated desc) as rn from ranking_snapshots),
b as (select snapshot_id, fighter_id, name, row_number() over (partition by snapshot_id order by {order}, icu_sort_key(name, 'root'), fighter_id) as rank
  from u where rn = 1 and {fit}),
p as (select name, max(rank) as prev from b where snapshot_id = (select min(snapshot_id) from ranking_snapshots) group by name)
select fighter_id, b.name, rank, prev as "previousRank", coalesce(prev - rank, 0) as change
from b left join p on b.name = p.name where snapshot_id = (select max(snapshot_id) from ranking_snapshots)
"""


def gender_attach(spark: SparkSession, d: str) -> DataFrame:
    """The discovered gender of every record's name, if it was discovered."""
    names = table(spark, d, "fighter_records").select("name").distinct()
    return discovery.attach_gender(names, discovery.all_pages(_edges(spark, d)))


def boards_long(spark: SparkSession, d: str) -> DataFrame:
    """All six boards as one table."""
    return ranking.boards(_scored(spark, d), tie="rec_id").select("board", "rec_id", F.col("section").cast("long").alias("section"), "rank")


def _boards_sql(columns: str) -> str:
    return _SCORED_SQL + ", " + ", ".join(f"b_{n} as ({_kept_sql(n)})" for n in _BOARD_SQL) + ", boards as (" + " union all ".join(
        f"select '{n}' as board, {columns}, row_number() over (order by section, {_BOARD_SQL[n][1]}) as rank from b_{n}" for n in _BOARD_SQL
    ) + ")"


def run_report(spark: SparkSession, d: str) -> DataFrame:
    """What a run says at its end: names asked for and read, size of each board, its first ten."""
    scored = checkpointed(_scored(spark, d))
    return runs.report(table(spark, d, "fighter_records"), scored, ranking.boards(scored, tie="rec_id"))


def _view_query(board: str, sort_by: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        stored = ranking.board(_scored(spark, d, "previousrank"), board, tie="rec_id")
        return views.view(stored, board, sort_by=sort_by).select("rec_id", "displayName", "koPct", "flag", "rankChange", "stored_rank", "rank")

    return query


_VIEW_ORDERS = {
    ("best", "wins"): "wins desc, draws, kos desc, k", ("best", "kos"): "kos desc", ("best", "weight"): f"{_ORDINAL_SQL}, wins desc", ("worst", "wins"): "losses desc, draws, k",
    ("secondary", "wins"): "s2 desc, kos desc", ("secondaryWorst", "wins"): "s2, kos", ("thirdary", "wins"): "s3 desc, kos desc", ("thirdaryWorst", "wins"): "s3, kos",
}


def _view_order_sql(board: str, sort_by: str) -> str:
    scored = _SCORED_SQL.replace("select distinct ", "select distinct previousrank, ").replace("select rec_id, name,", "select rec_id, previousrank, name,")
    return f"""{scored}, b as (select *, row_number() over (order by section, {_BOARD_SQL[board][1]}) as stored_rank from ({_kept_sql(board)})),
v as (select *, row_number() over (order by {_VIEW_ORDERS[board, sort_by]}, name, stored_rank) as rank from b), c as ({_countries_sql()})
select v.rec_id, regexp_replace(v.name, '\\s*\\((?:mixed )?martial artist\\)$', '') as "displayName", case when wins > 0 then cast(round(kos / wins * 100, 0) as bigint) else 0 end as "koPct", flag,
  case when coalesce(previousrank, 0) = 0 then 0 else previousrank - rank end as "rankChange", stored_rank, rank from v join c on c.rec_id = v.rec_id"""


def board_view(spark: SparkSession, d: str) -> DataFrame:
    """Women of the best board whose name holds an "a", by weight, as shown."""
    stored = ranking.board(_scored(spark, d), "best", tie="rec_id")
    shown = views.view(stored, "best", gender="female", search="a", sort_by="weight")
    return shown.select("rec_id", "displayName", "initials", "koPct", F.col("weightOrdinal").cast("long").alias("weightOrdinal"), "stored_rank", "rank")


def _view_sql() -> str:
    fit, order = _BOARD_SQL["best"]
    shown = r"regexp_replace(name, '\s*\((?:mixed )?martial artist\)$', '')"
    return f"""{_SCORED_SQL},
b as (select *, row_number() over (order by {order}) as stored_rank, {_ORDINAL_SQL} as w, {shown} as shown from s where {fit}),
v as (select * from b where gender = 'female' and contains(lower(shown), 'a'))
select rec_id, shown as "displayName", upper(array_to_string(list_transform(string_split(shown, ' '), lambda x: x[1:1]), '')[1:2]) as initials,
  case when wins > 0 then cast(round(kos / wins * 100, 0) as bigint) else 0 end as "koPct", cast(w as bigint) as "weightOrdinal", stored_rank,
  row_number() over (order by w, wins desc, name, stored_rank) as rank from v"""


def name_facts(spark: SparkSession, d: str) -> DataFrame:
    """Display name, search name, initials, article address and knock-out percentage of every record."""
    n = F.col("name")
    return table(spark, d, "fighter_records").select(
        "rec_id", text.display_name(n).alias("shown"), text.search_name(n).alias("searched"), text.initials(n).alias("initials"),
        text.page_url(n).alias("url"), text.ko_percent(F.col("kos"), F.col("wins")).alias("ko_pct"), views.weight_ordinal(F.col("weightclass")).cast("long").alias("weight_ord"),
    )


def _names_sql() -> str:
    url = "url_encode(replace(name, ' ', '_'))"
    for a, b in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        url = f"replace({url}, '{a}', '{b}')"
    return rf"""
with x as (select *, regexp_replace(name, '\s*\((?:mixed )?martial artist\)$', '') as shown from fighter_records)
select rec_id, shown, trim(regexp_replace(name, '\s*\([^)]*\)\s*$', '')) as searched,
  upper(array_to_string(list_transform(string_split(shown, ' '), lambda w: w[1:1]), '')[1:2]) as initials, 'https://en.wikipedia.org/wiki/' || {url} as url,
  case when wins > 0 then cast(round(kos / wins * 100, 0) as bigint) else 0 end as ko_pct, cast({_ORDINAL_SQL} as bigint) as weight_ord from x"""


# ---- category graph, drawn from the discovery categories ----

#: What the drawn graph adds so that every rule of discovery has rows it applies to.
_PREFIXED = [*discovery.NOT_PAGES, "Lists", "category:"]
_EXCLUDED = [" male mixed martial artists", " female mixed martial artists", " by nationality", " Lists of", " Olympic", " Asian Games", " Pan American", " Commonwealth", " by populated place"]


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph: roots to categories, pages, subcategories (direct, by state, lists) with pages, categories to be left out."""
    pick = lambda values, m: F.element_at(F.array(*map(F.lit, values)), (F.pmod("entry_id", F.lit(m)) + 1).cast("int"))
    r = table(spark, d, "category_records").select("entry_id", "category", "name", "gender", F.when(~missing("weightclass"), F.col("weightclass")).alias("w"))
    title = F.concat(F.coalesce(F.when(F.pmod("entry_id", F.lit(40)) < len(_PREFIXED), pick([*_PREFIXED, *[""] * (40 - len(_PREFIXED))], 40)), F.lit("")), "name")
    r = r.withColumns({
        "title": title, "root": F.concat(F.lit("Category:"), F.initcap("gender"), F.lit(" mixed martial artists by nationality")), "state": F.concat("category", F.lit(" by state")),
        "coaches": F.concat("category", F.lit(" coaches")), "lists": F.concat(F.lit("Lists of "), "category"), "out": F.concat("category", pick(_EXCLUDED, 9)),
    })
    top = F.lit("Category:Mixed martial artists by nationality")
    edge = lambda parent, child, kind: F.struct(parent.alias("parent"), child.alias("child"), F.lit(kind).alias("kind"))
    when = lambda cond, *edges: F.when(cond, F.array(*edges)).otherwise(F.array().cast("array<struct<parent:string,child:string,kind:string>>"))
    c, has, known = F.col("category"), F.col("w").isNotNull(), F.col("gender").isin("male", "female")
    weight = F.concat("state", F.lit(" "), "w")
    every = F.concat(
        F.array(edge(top, c, "subcat")), when(known & has, edge(F.col("root"), c, "subcat")), when(~has, edge(c, F.col("title"), "page")),
        when(has, edge(c, F.col("state"), "subcat"), edge(F.col("state"), weight, "subcat"), edge(weight, F.col("title"), "page")),
        when(F.pmod("entry_id", F.lit(5)) == 0, edge(c, F.col("coaches"), "subcat"), edge(F.col("coaches"), F.concat(F.col("title"), F.lit(" (coach)")), "page")),
        when(F.pmod("entry_id", F.lit(7)) == 0, edge(c, F.col("lists"), "subcat"), edge(F.col("lists"), F.concat(F.lit("Listed "), "name"), "page")),
        when(F.pmod("entry_id", F.lit(11)) == 0, edge(top, F.col("out"), "subcat"), edge(F.col("out"), F.concat(F.lit("Left out "), "name"), "page")),
    )
    return checkpointed(r.select(F.explode(every).alias("e")).select("e.*").distinct())


_EDGES_SQL = """
with r as (select *, 'Category:' || upper(gender[1:1]) || gender[2:] || ' mixed martial artists by nationality' as root, category || ' by state' as state,
  coalesce(['Category:', 'List of', 'Draft:', 'User:', 'Template:', 'Portal:', 'Wikipedia:', 'Module:', 'File:', 'Talk:', 'Help:', 'MediaWiki:', 'Lists', 'category:'][entry_id % 40 + 1], '') || name as title,
  category || [' male mixed martial artists', ' female mixed martial artists', ' by nationality', ' Lists of', ' Olympic', ' Asian Games', ' Pan American', ' Commonwealth', ' by populated place'][entry_id % 9 + 1] as excluded
  from (select entry_id, category, name, gender, nullif(weightclass, '') as w from category_records)),
e as (
  select distinct root as parent, category as child, 'subcat' as kind from r where gender in ('male', 'female') and w is not null
  union select 'Category:Mixed martial artists by nationality', category, 'subcat' from r
  union select category, title, 'page' from r where w is null
  union select category, state, 'subcat' from r where w is not null
  union select state, state || ' ' || w, 'subcat' from r where w is not null
  union select state || ' ' || w, title, 'page' from r where w is not null
  union select category, category || ' coaches', 'subcat' from r where entry_id % 5 = 0
  union select category || ' coaches', title || ' (coach)', 'page' from r where entry_id % 5 = 0
  union select category, 'Lists of ' || category, 'subcat' from r where entry_id % 7 = 0
  union select 'Lists of ' || category, 'Listed ' || name, 'page' from r where entry_id % 7 = 0
  union select 'Category:Mixed martial artists by nationality', excluded, 'subcat' from r where entry_id % 11 = 0
  union select excluded, 'Left out ' || name, 'page' from r where entry_id % 11 = 0),
p as (select * from e where kind = 'page' and not regexp_matches(child, '^(Category:|List of|Draft:|User:|Template:|Portal:|Wikipedia:|Module:|File:|Talk:|Help:|MediaWiki:)')),
c as (select * from e where kind = 'subcat')
"""
_FLAT_SQL = "select x.{root} as root, p.child as title from {at} x join p on p.parent = x.{at_col} union select x.{root}, p.child from {at} x join c on c.parent = x.{at_col} join p on p.parent = c.child where not contains(c.child, 'Lists of')"


def _countries(edges: DataFrame) -> DataFrame:
    top = edges.where("parent = 'Category:Mixed martial artists by nationality' and kind = 'subcat'")
    return top.where(discovery.is_extra_country(F.col("child"))).select(F.col("child").alias("root"), F.col("child").alias("at"))


def category_expand(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every country category and its direct subcategories."""
    e = _edges(spark, d)
    return discovery.category_pages(_countries(e), e)


def category_deep(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every country category and, a level deeper, of its subcategories by state."""
    e = _edges(spark, d)
    return discovery.category_pages_deep(_countries(e), e)


def country_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages under the countries of the women's root."""
    return discovery.country_pages("Category:Female mixed martial artists", _edges(spark, d)).select("title")


def priority_union(spark: SparkSession, d: str) -> DataFrame:
    """Every discovered page once, with the gender of the root that takes precedence."""
    return discovery.all_pages(_edges(spark, d))


_TOP_SQL = """, t as (select child from c where parent = 'Category:Mixed martial artists by nationality' and not regexp_matches(child,
  '( male mixed martial artists| female mixed martial artists| by nationality|Lists of|Olympic|Asian Games|Pan American|Commonwealth|by populated place)'))"""
_DEEP_SQL = """, s as (select t.child as root, c.child as at from t join c on c.parent = t.child where not contains(c.child, 'Lists of') and regexp_matches(c.child, '(by state|by populated place|by descent)')),
deep as (select t.child as root, p.child as title from t join p on p.parent = t.child
  union select s.root, p.child from s join p on p.parent = s.at
  union select s.root, p.child from s join c on c.parent = s.at join p on p.parent = c.child where not contains(c.child, 'Lists of'))"""


def _gender_sql(g: str) -> str:
    return f"""(select p.child as title from c x join p on p.parent = x.child where x.parent = 'Category:{g} mixed martial artists by nationality'
  union select p.child from c x join c y on y.parent = x.child join p on p.parent = y.child where x.parent = 'Category:{g} mixed martial artists by nationality' and not contains(y.child, 'Lists of'))"""


# ---- markup ----

def wiki_records(spark: SparkSession, d: str) -> DataFrame:
    """Records read from every document that has an infobox: totals, nationality, class, image, year, quality wins."""
    return records(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "text").select("doc_id", "total", "wins", "kos", "losses", "draws", "nationality", "weightClass", "imageUrl", "birthDate", "qualityWins")


def wiki_quality_wins(spark: SparkSession, d: str) -> DataFrame:
    """Wins over opponents that have a page, counted in the record table of every document."""
    return table(spark, d, "documents").select("doc_id", quality_wins(F.col("text")).alias("quality_wins"))


#: White space as the web counts it, for use inside a class.
_WS_SQL = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_QUALITY_SQL = r"""
with t as (select doc_id, regexp_extract(text, '(?i)={2,}[@]*(?:Professional[@]+)?(?:Mixed martial arts[@]+)?record[@]*={2,}') as head, text from documents),
b as (select doc_id, case when head = '' then '' else text[strpos(text, head) + length(head):] end as body from t),
e as (select doc_id, body, regexp_extract(body, '\n={2,}[@]*[A-Z]') as stop from b),
r as (select doc_id, unnest(string_split(case when stop = '' then body else body[1:strpos(body, stop) - 1] end, chr(10) || '|-')) as row from e),
k as (select doc_id, row, list_filter(list_transform(string_split(row, chr(10) || '|'), lambda c: regexp_replace(c, '^[@]+|[@]+$', '', 'g')), lambda c: c <> '') as cells from r)
select doc_id, count(*) filter (where regexp_matches(row, '(?i)(^|[^A-Za-z0-9_])Win([^A-Za-z0-9_]|$)') and regexp_matches(coalesce(cells[3], ''), '\[\[.+?\]\]')) as quality_wins from k group by doc_id
""".replace("@", _WS_SQL)


def plain_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document without its markup."""
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", strip_markup(F.col("text")).alias("plain"))



def _stripped_sql(c: str, squeeze_ends: bool = True) -> str:
    for pattern, to in (
        (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1"), ("''''''", ""), ("''''", ""), (r"\{\{[^}]*\}\}", ""), (r"<ref[^>]*/>", ""), (r"<ref[^>]*>(?:.|\n)*?</ref>", ""), (r"<[^>]+>", ""), ("&nbsp;", " "),
        (f"[{_WS_SQL}]+", " "),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c})"


def infobox_classes(spark: SparkSession, d: str) -> DataFrame:
    """The weight class read from the raw parameter of every infobox."""
    return table(spark, d, "infobox").select("pageid", weight_class(F.col("weightclass")).alias("weight_class")).distinct()


def _class_sql() -> str:
    c = "raw"
    for pattern, to in ((r"<[^>]+>", " "), (r"\{\{[^}]*\}\}", " "), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1"), ("''''''", ""), ("''''", ""), ("&nbsp;", " "), (f"[{_WS_SQL}]+", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    found = " ".join(
        f"when strpos(n, '{w.lower()}') > 0 and (strpos(n, '{w.lower()}') = 1 or n[strpos(n, '{w.lower()}') - 1] = ' ') and n[strpos(n, '{w.lower()}') + {len(w)}] in ('', ' ') then '{w}'" for w in _CLASSES_SQL
    )
    return rf"""
with i as (select pageid, weightclass, list_filter(list_transform(string_split(regexp_replace(regexp_replace(weightclass, '^\{{\{{plainlist[{_WS_SQL}]*\|?', ''), '\}}\}}$', ''), '*'),
  lambda x: regexp_replace(x, '^[{_WS_SQL}]+|[{_WS_SQL}]+$', '', 'g')), lambda x: x <> '') as items from infobox),
r as (select pageid, case when contains(weightclass, '{{{{plainlist') then coalesce(items[1], '') else weightclass end as raw from i),
t as (select pageid, trim({c}) as t from r), n as (select pageid, t, regexp_replace(lower(t), '[-–]', ' ', 'g') as n from t)
select distinct pageid, case when t is null then null {found}
  when regexp_matches(t, '(?i)^\d+(\.\d+)?\s*(kg|lbs?)\s') or regexp_matches(t, '(?i)^\d+(\.\d+)?\s*(kg|lbs?)\.?\s*$') then '' else array_to_string(string_split(t, ' ')[1:2], ' ') end as weight_class from n"""


def infobox_images(spark: SparkSession, d: str) -> DataFrame:
    """The image address of every infobox, its parameter written in all the ways that count: bare, linked, with options, unwanted."""
    image, k = F.coalesce("image", F.lit("")), F.pmod("pageid", F.lit(8))
    forms = [image, F.concat(F.lit("[[File:"), image, F.lit("|thumb|x]]")), F.concat(F.lit("File:"), image, F.lit("|220px")), F.concat(F.lit("[[image:"), image, F.lit("]]")),
             F.concat(F.lit("Boxbelt "), image), F.concat(F.lit("<!-- "), image, F.lit(" -->")), F.concat(image, F.lit(" (left).PNG?x")), F.concat(F.lit("Medal "), image)]
    raw = F.get(F.array(*forms), k.cast("int"))
    return table(spark, d, "infobox").select("pageid", image_url(raw).alias("url")).distinct()


_IMAGES_SQL = r"""
with x as (select distinct pageid, pageid % 8 as k, coalesce(image, '') as i from infobox),
y as (select pageid, case k when 6 then trim(i || ' (left).PNG') when 7 then '' when 5 then '' when 4 then '' else i end as i, k from x),
z as (select pageid, case when k = 6 then y.i else regexp_extract(y.i, '(?i).+\.(?:jpg|jpeg|png|gif|svg|webp)$') end as n from y)
select pageid, case when n = '' or regexp_matches(n, '(?i)Med[\s_]*\d*\.png|Generic_belt_icon\.svg|Olympic[\s_]*rings\.svg|Boxbelt|Medal[\s_]|Ribbon[\s_]|File-icon') then ''
  else 'https://en.wikipedia.org/wiki/Special:FilePath/' || replace(replace(url_encode(replace(n, ' ', '_')), '%28', '('), '%29', ')') end as url from z
"""


def infobox_spans(spark: SparkSession, d: str) -> DataFrame:
    """Length and share of braces of the balanced infobox of every document, if it has one."""
    box = infobox(F.col("text"))
    return table(spark, d, "documents").select("doc_id", box.alias("box")).where("box is not null").select(
        "doc_id", F.length("box").cast("long").alias("n_chars"), F.regexp_count("box", F.lit(r"\{\{")).cast("long").alias("opened")
    )


# Balanced templates as nested as the tables have them; the operator follows any depth.
_BOX_SQL = r"""
with boxed as (select doc_id, text, coalesce(""" + ", ".join(
    rf"nullif(regexp_extract(case when contains(text, '{{{{Infobox {kind}') then text[strpos(text, '{{{{Infobox {kind}'):] else '' end, '^\{{\{{(?:[^{{}}]|\{{\{{(?:[^{{}}]|\{{\{{[^{{}}]*\}}\}})*\}}\}})*\}}\}}'), '')"
    for kind in ("martial artist", "person", "officeholder", "military")
) + r""") as box from documents)
"""


#: White space within a line.
_BLANK = r"[ \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _param_sql(key: str) -> str:
    return rf"nullif(regexp_extract(box, '(?:^|\n)\|?{_BLANK}*{key}{_BLANK}*={_BLANK}*([^\n]*)', 1), '')"


def _records_sql() -> str:
    seen = lambda *keys: "(" + " or ".join(rf"regexp_matches(box, '(?:^|[\n|]){_BLANK}*{k}{_BLANK}*=')" for k in keys) + ")"
    num = lambda k: rf"coalesce(try_cast(regexp_extract(box, '(?:^|[\n|]){_BLANK}*{k}{_BLANK}*={_BLANK}*(\d+)', 1) as bigint), 0)"
    won, lost = ("mma_kowin", "mma_subwin", "mma_decwin"), ("mma_koloss", "mma_subloss", "mma_decloss", "mma_dqloss")
    ws = _WS_SQL
    plain = lambda c: _stripped_sql(c)
    place = plain(_param_sql("birth_place"))
    return f"""{_BOX_SQL.rstrip()},
v as (select doc_id, text, box, case when {seen(*won, 'ko', 'win_by_ko')} then {" + ".join(map(num, won))} end as wins, case when {seen(*lost, 'mma_draw')} then {" + ".join(map(num, lost))} end as losses,
  case when {seen(*won)} then {num('mma_kowin')} else 0 end as kos, {num('mma_draw')} as draws, {num('(?:no_contests|nc)')} as nc,
  try_cast(nullif(regexp_extract(box, '(?:^|[\\n|]){_BLANK}*total{_BLANK}*={_BLANK}*(\\d+)', 1), '') as bigint) as told,
  coalesce(nullif({plain(_param_sql("nationality"))}, ''), trim(list_filter(string_split({place}, ','), lambda x: trim(x) <> '')[-1]), '') as nationality,
  coalesce({_param_sql("weight_class")}, '') as weightclass, coalesce(regexp_extract({_param_sql("birth_date")}, '(\\d{{4}})', 1), '') as year,
  coalesce({_param_sql("image")}, '') as image from boxed where box is not null),
q as ({_QUALITY_SQL}), infobox as (select doc_id as pageid, weightclass from v), c as ({_class_sql()})
select v.doc_id, coalesce(told, wins + losses + draws + nc) as total, wins, kos, losses, draws, nationality, coalesce(weight_class, '') as "weightClass",
  case when image = '' then '' else 'https://en.wikipedia.org/wiki/Special:FilePath/' || url_encode(replace(image, ' ', '_')) end as "imageUrl", year as "birthDate", quality_wins as "qualityWins"
from v join c on c.pageid = v.doc_id join q on q.doc_id = v.doc_id where wins is not null and losses is not null"""


_RECORDS_SQL = _records_sql()


# ---- countries ----

def countries(spark: SparkSession, d: str) -> DataFrame:
    """Country key, name and flag of every record."""
    key = country.normalize_country(F.col("nationality"))
    rows = table(spark, d, "fighter_records").select("rec_id", "nationality", key.alias("country"))
    return rows.select("rec_id", "country", country.country_flag(F.col("country")).alias("flag"), country.country_name(F.col("nationality"), F.col("country")).alias("name")).distinct()


def _countries_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    names = "[" + ", ".join(map(q, country.COUNTRIES)) + "]"
    case = lambda pairs: " ".join(f"when {q(k)} then {q(v)}" for k, v in pairs.items())
    ws = _WS_SQL
    trim = lambda c: f"regexp_replace({c}, '^[{ws}]+|[{ws}]+$', '', 'g')"
    first = trim(f"regexp_split_to_array({trim(f'''regexp_replace(nationality, '(?i)\\{{\\{{plainlist(?:.|\\n)*', '')''')}, '[{ws}]*/[{ws}]*|[{ws}]+&[{ws}]+')[1]")
    key = f"lower({trim(f'''regexp_replace({first}, '(?i)-(?:{country.ENDINGS})$', '')''')})"
    return f"""
with k as (select distinct rec_id, nationality, {key} as key from fighter_records),
f as (select rec_id, nationality, case when coalesce(nationality, '') = '' then '' else coalesce(case when list_contains({names}, key) then key end,
  case key {case(country.ALIASES)} end, case key {case(country.DEMONYMS)} end,
  case when key <> '' then list_filter({names}, lambda n: contains(n, key) or contains(key, n))[1] end, key) end as country from k)
select distinct rec_id, country, coalesce(case country {case(country.FLAG_OF)} end, '') as flag,
  case when country = '' then coalesce(nationality, '') else array_to_string(list_transform(regexp_extract_all(country, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: upper(w[1:1]) || w[2:]), '') end as name from f"""


# ---- news ----

def _watched(spark: SparkSession, d: str) -> DataFrame:
    return news.watch_list(ranking.board(_scored(spark, d), "thirdary", tie="rec_id"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_entry").select(
        "delivery_id", F.col("boxername").alias("fighter"), F.col("headline").alias("title"),
        F.when(F.pmod("delivery_id", F.lit(5)) == 0, F.concat(F.lit("With "), "boxername")).alias("description"), "url", "source", F.col("publishedat").alias("publishedAt")
    )


def watch_list(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty of the ratio board that are no seniors."""
    return _watched(spark, d)


_FIT3, _ORDER3 = _BOARD_SQL["thirdary"]
_WATCH_SQL = f"{_SCORED_SQL}, w as (select name, row_number() over (order by {_ORDER3}) as rank from s where {_FIT3} and not senior qualify rank <= 50)"


def mention_match(spark: SparkSession, d: str) -> DataFrame:
    """News linked to the ranked name it mentions, the first copy of each url."""
    return news.link_articles(_articles(spark, d), _watched(spark, d), [F.col("delivery_id")])


_CLEAN = r"trim(lower(regexp_replace({}, '\s*\([^)]*\)\s*$', '')))"
_MATCH_SQL = f"""{_WATCH_SQL},
a as (select *, lower(coalesce(headline, '') || ' ' || coalesce(case when delivery_id % 5 = 0 then 'With ' || boxername end, '')) as hay from news_entry where coalesce(url, '') <> ''),
o as (select delivery_id, arg_min(w.name, w.rank) as other from a join w on contains(a.hay, {_CLEAN.format('w.name')}) group by delivery_id),
m as (select a.*, case when coalesce(boxername, '') <> '' and contains(hay, {_CLEAN.format('boxername')}) then boxername else other end as hit from a left join o using (delivery_id)),
f as (select *, row_number() over (partition by url order by delivery_id) as n from m where hit is not null)
select hit as "boxerName", coalesce(headline, '') as headline, url, coalesce(nullif(source, ''), 'News') as source, publishedat as "publishedAt" from f where n = 1"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_entry").select(F.col("delivery_id").alias("seq"), "batch", F.col("boxername").alias("boxerName"), "headline", "url", "source", F.col("publishedat").alias("publishedAt"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return news.rolling_merge(e.where("batch > 0"), e.where("batch <= 0 or batch is null"), runs.cutoff(RUN_AT))


def rolling_merge(spark: SparkSession, d: str) -> DataFrame:
    """Later batches merged into the first: expired entries dropped, the first copy of each kept, newest first."""
    return ranking.global_rank(_merged(spark, d), [*news.newest_first(), F.col("seq")], "place").select("seq", "place")


_MERGED_SQL = f"""
with l as (select *, case when coalesce(url, '') = '' then coalesce(headline, '') || coalesce(source, '') else url end as key, case when batch > 0 then 0 else 1 end as side
  from news_entry where coalesce(publishedat, '') = '' or publishedat >= strftime(timestamp '2023-02-14' - interval 30 day, '%Y-%m-%dT%H:%M:%S.000Z')),
m as (select * from (select *, row_number() over (partition by key order by side, delivery_id) as n from l) where n = 1)
"""


def first_headlines(spark: SparkSession, d: str) -> DataFrame:
    """The newest merged headline of each name."""
    first = news.first_per_key(ranking.global_rank(_merged(spark, d), [*news.newest_first(), F.col("seq")], "place"), [F.col("boxerName")], [F.col("place")])
    return first.select("boxerName", "headline")


def new_since(spark: SparkSession, d: str) -> DataFrame:
    """Entries of later batches whose url the first batch lacks; a missing url equals a missing url."""
    e = _entries(spark, d)
    return news.new_since(e.where("batch > 0"), e.where("batch = 0")).select("seq", "url")


def headline_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each headline and source."""
    return news.headline_distinct(_entries(spark, d), [F.col("seq")]).select("seq", "headline", "source")


def digest(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the digest of what is new."""
    e = _entries(spark, d)
    return news.digest_lines(news.new_since(e.where("batch > 0"), e.where("batch = 0"))).select("seq", "line")


_NEW_SQL = "select * from news_entry a where batch > 0 and not exists (select 1 from news_entry b where b.batch = 0 and b.url is not distinct from a.url)"


# ---- completion, nested values, export ----

def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """Every requested title with the record of the page returned for it, if any."""
    asked = table(spark, d, "fighter_records").select(F.col("name").alias("title")).distinct()
    got = table(spark, d, "infobox").groupBy("title").agg(F.max_by(F.struct("pageid", "wins", "losses"), "pageid").alias("p"))
    return asked.join(got, "title", "left").select("title", "p.pageid", "p.wins", "p.losses")


def json_unnest(spark: SparkSession, d: str) -> DataFrame:
    """Object entries of a JSON text as rows."""
    entries = F.from_json("props", "map<string, string>")
    return table(spark, d, "events").select("event_id", F.explode(entries).alias("key", "value"))


def boards_document(spark: SparkSession, d: str) -> DataFrame:
    """All six boards as the one document that readers get, in parts, read back place by place."""
    parts = document_parts(ranking.boards(_scored(spark, d, "wikipediaurl", "lastupdated"), tie="rec_id"), f"{AS_OF}-01-01T00:00:00.000Z")
    entry = "struct<name: string, wins: bigint, losses: bigint, secondaryScore: bigint, isSenior: boolean, wikipediaUrl: string>"
    return read_document(parts, entry).select("board", "rank", "r.*")


_BOARDS = {"best": "best_board", "worst": "worst_board", "secondary": "quality_board", "secondaryWorst": "quality_worst_board", "thirdary": "ratio_board", "thirdaryWorst": "ratio_worst_board"}
QUERIES: dict[str, Query] = {q: _board_query(b)[0] for b, q in _BOARDS.items()}
QUERIES |= {
    f.__name__: f for f in (
        scores, gender_attach, boards_long, run_report, board_view, name_facts, category_expand, category_deep, country_pages, priority_union, wiki_records, wiki_quality_wins, plain_text, infobox_classes,
        infobox_images, infobox_spans, countries, watch_list, mention_match, rolling_merge, first_headlines, new_since, headline_distinct, digest, fill_missing, json_unnest, boards_document,
    )
}
SQL: dict[str, str] = {q: _board_query(b)[1] for b, q in _BOARDS.items()}
SQL |= {
    "scores": f'{_SCORED_SQL} select rec_id, s2, round(s3, 9) as s3, senior as "isSenior" from s',
    "gender_attach": f"{_EDGES_SQL}{_TOP_SQL}{_DEEP_SQL}, f as {_gender_sql('Female')}, m as {_gender_sql('Male')}, g as (select title, case when title in (select title from f) then 'female' else 'male' end as gender from (select title from f union select title from m union select title from deep)) select n.name, g.gender from (select distinct name from fighter_records) n left join g on g.title = n.name",
    "boards_long": f"{_boards_sql('rec_id, cast(section as bigint) as section')} select * from boards",
    "run_report": f"""{_boards_sql('name')} select 'requested' as what, 0 as place, null as name, count(*) as n from fighter_records union all select 'read', 0, null, count(*) from s
union all select board, 0, null, count(*) from boards group by board union all select board, rank, name, null from boards where rank <= 10""",
    "boards_document": f"""{_boards_sql('s.name, s.wins, s.losses, s2, senior, wikipediaurl').replace('select distinct ', 'select distinct wikipediaurl, ').replace('select rec_id, name,', 'select rec_id, wikipediaurl, name,').replace('s.name, s.wins, s.losses', 'name, wins, losses')}
select board, rank, name, wins, losses, case when board like 'secondary%' then s2 end as "secondaryScore", case when board not in ('best', 'worst') then senior end as "isSenior", wikipediaurl as "wikipediaUrl" from boards""",
    "board_view": _view_sql(),
    "name_facts": _names_sql(),
    "category_expand": f"{_EDGES_SQL}{_TOP_SQL} " + _FLAT_SQL.format(root="child", at="t", at_col="child"),
    "category_deep": f"{_EDGES_SQL}{_TOP_SQL}{_DEEP_SQL} select * from deep",
    "country_pages": f"{_EDGES_SQL} select title from {_gender_sql('Female')}",
    "priority_union": f"{_EDGES_SQL}{_TOP_SQL}{_DEEP_SQL}, f as {_gender_sql('Female')}, m as {_gender_sql('Male')} select title, case when title in (select title from f) then 'female' else 'male' end as gender from (select title from f union select title from m union select title from deep)",
    "wiki_quality_wins": _QUALITY_SQL,
    "infobox_spans": f"{_BOX_SQL} select doc_id, cast(length(box) as bigint) as n_chars, cast(len(regexp_extract_all(box, '\\{{\\{{')) as bigint) as opened from boxed where box is not null",
    "wiki_records": _RECORDS_SQL,
    "plain_text": f"select doc_id, {_stripped_sql('text')} as plain from documents",
    "infobox_classes": _class_sql(),
    "infobox_images": _IMAGES_SQL,
    "countries": _countries_sql(),
    "watch_list": f"{_WATCH_SQL} select name, rank from w",
    "mention_match": _MATCH_SQL,
    "rolling_merge": f"{_MERGED_SQL} select delivery_id as seq, row_number() over (order by coalesce(publishedat, '') desc, coalesce(url, ''), coalesce(headline, ''), delivery_id) as place from m",
    "first_headlines": f"""{_MERGED_SQL} select boxername as "boxerName", headline from (select *, row_number() over (partition by boxername order by coalesce(publishedat, '') desc, coalesce(url, ''), coalesce(headline, ''), delivery_id) as k from m) where k = 1""",
    "new_since": f"select delivery_id as seq, url from ({_NEW_SQL})",
    "headline_distinct": "select delivery_id as seq, headline, source from (select *, row_number() over (partition by coalesce(headline, '') || coalesce(source, '') order by delivery_id) as n from news_entry) where n = 1",
    "digest": f"""select delivery_id as seq, '- ' || coalesce(headline, '') || ' [' || coalesce(source, '') || ', ' || coalesce(strftime(try_cast(publishedat as timestamptz), '%Y-%m-%d'), '?') || '] ' || coalesce(url, '') as line from ({_NEW_SQL})""",
    "fill_missing": "with g as (select title, arg_max(struct_pack(pageid, wins, losses), pageid) as p from infobox group by title) select a.title, p.pageid, p.wins, p.losses from (select distinct name as title from fighter_records) a left join g on a.title = g.title",
    "json_unnest": "select event_id, key, value from (select event_id, unnest(json_keys(props)) as key, props from events), lateral (select json_extract_string(props, '$.' || key) as value)",
}
for _board, _sort in _VIEW_ORDERS:
    _name = f"view_{_board}_{_sort}" if _board == "best" else f"view_{_board}"
    QUERIES[_name], SQL[_name] = _view_query(_board, _sort), _view_order_sql(_board, _sort)
for _board, _name in (("best", "board_movement"), ("worst", "worst_movement")):
    QUERIES[_name], SQL[_name] = _movement(_board), _movement_sql(_board)

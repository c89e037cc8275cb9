"""Queries of the general problems of large tables: repeated messages, packed values, snapshot differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.multivalue import MAX_NAMES, split_values
from rankweave.operators.snapshot_diff import snapshot_changes
from rankweave.sources.tables import table
from rankweave.streaming.dedup import surplus_deliveries

COMPARED = ["wins", "kos", "losses", "draws", "previousrank", "weightclass"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Surplus deliveries of messages that arrived more than once."""
    return surplus_deliveries(table(spark, d, "news_entry"), "batch").select(F.col("id").alias("delivery_id"))


_FIELDS = (("category_records", "entry_id", "nationality"), ("infobox", "pageid", "weightclass"))
#: Marks that only the grammar can read: quotes, brackets, markup, entities, bullets.
_MARKS = "[\"'“”‘’«»„()\\[\\]{}<>&*#]"


def _values(spark: SparkSession, d: str, min_values: int, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """Values of both fields, with their flags; ``where`` picks rows by their field."""
    names = [r["country"] for r in table(spark, d, "country_dim").select("country").limit(MAX_NAMES + 1).collect()]
    parts = []
    for src, key, field in _FIELDS:
        rows = table(spark, d, src)
        rows = rows if where is None else rows.where(where(F.col(field)))
        parts.append(split_values(rows, key, field, names, min_values).select(F.lit(src).alias("src"), "row_key", "pos", "item", "error"))
    return parts[0].unionByName(parts[1]).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of the fields that hold two or more."""
    return _values(spark, d, 2).select("src", "row_key", "pos", "item")


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every value that the grammar flagged, of fields with any number of values."""
    return _values(spark, d, 1).where("error is not null")


def p4_plain(spark: SparkSession, d: str) -> DataFrame:
    """Values of the fields that hold neither quotes, brackets nor markup, nor the word "and"."""
    return _values(spark, d, 2, lambda c: ~c.rlike(f"{_MARKS}|(?i)and")).select("src", "row_key", "pos", "item")


def p4_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The first value of every plain field once a quote is put before it that never closes: read as a character, and flagged."""
    parts = []
    for src, key, field in _FIELDS:
        rows = table(spark, d, src).where(~F.col(field).rlike(f"{_MARKS}|(?i)and")).select(key, F.concat(F.lit('"'), field).alias("damaged"))
        parts.append(split_values(rows, key, "damaged").where("error = 'malformed_quote'").select(F.lit(src).alias("src"), "row_key", "pos", "item"))
    return parts[0].unionByName(parts[1]).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Fighters added, removed or changed from each snapshot to the next one delivered."""
    return snapshot_changes(table(spark, d, "ranking_snapshots"), "snapshot_id", "fighter_id", "lastupdated", COMPARED)


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_flags, p4_plain, p4_quotes, p5_found)}

_ITEMS = r"list_filter(list_transform(regexp_split_to_array({}, '[,;/|•·\n\r]'), lambda x: trim(regexp_replace(x, '[\s\x{{a0}}]+', ' ', 'g'))), lambda x: x <> '')"
_SPLIT = rf"""
with f as (select distinct 'category_records' as src, entry_id as row_key, nationality as field from category_records union select 'infobox', pageid, weightclass from infobox),
s as (select src, row_key, {_ITEMS.format("field")} as items, {_ITEMS.format("""'"' || field""")} as damaged
  from f where not regexp_matches(field, '{_MARKS.replace("'", "''")}|(?i)and'))
"""

SQL = {
    "p3_found": """
with k as (select delivery_id, received_at, coalesce(url, '') = '' as bare,
  case when coalesce(url, '') = '' then coalesce(headline, '') else url end as k1,
  case when coalesce(url, '') = '' then coalesce(source, '') else '' end as k2 from news_entry)
select delivery_id from (select delivery_id, row_number() over (partition by bare, k1, k2 order by received_at, delivery_id) as n from k) where n > 1
""",
    "p4_plain": f"{_SPLIT} select distinct src, row_key, pos, items[pos] as item from (select src, row_key, items, unnest(range(1, len(items) + 1)) as pos from s where len(items) > 1)",
    "p4_quotes": f"{_SPLIT} select distinct src, row_key, 1 as pos, damaged[1] as item from s",
    "p5_found": """
with r as (select * from (select *, row_number() over (partition by snapshot_id, fighter_id order by lastupdated desc) as rn from ranking_snapshots) where rn = 1),
s as (select snapshot_id, lag(snapshot_id) over (order by snapshot_id) as prev from (select distinct snapshot_id from r)),
a as (select s.snapshot_id as step, r.* from s join r using (snapshot_id) where prev is not null),
b as (select s.snapshot_id as step, r.* from s join r on r.snapshot_id = s.prev)
select cast(coalesce(a.step, b.step) as bigint) as snapshot_id, coalesce(a.fighter_id, b.fighter_id) as fighter_id,
  case when b.step is null then 'added' when a.step is null then 'removed' else 'changed' end as change_kind
from a full join b on a.step = b.step and a.fighter_id = b.fighter_id
where a.step is null or b.step is null or a.wins is distinct from b.wins or a.kos is distinct from b.kos or a.losses is distinct from b.losses
  or a.draws is distinct from b.draws or a.previousrank is distinct from b.previousrank or a.weightclass is distinct from b.weightclass
""",
}

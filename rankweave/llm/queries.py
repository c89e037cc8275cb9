"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.canon import map_to_list
from rankweave.llm.leakage import leaked_passages
from rankweave.llm.lookalike import consistent_text, look_alike_classes, look_alike_links, look_alike_pairs
from rankweave.llm.packing import ledger, pack_texts, token_counts
from rankweave.llm.topn import top_n
from rankweave.operators.keyed import missing, newest
from rankweave.sources.tables import table


def _typed(spark: SparkSession, d: str) -> DataFrame:
    lists = {
        "nationality": table(spark, d, "country_dim").select("ord", "country"),
        "weightclass": table(spark, d, "weight_dim").select("ord", "weight_class"),
    }
    return map_to_list(table(spark, d, "fighter_records"), "rec_id", lists, table(spark, d, "alias_dim"), places=("nationality",))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value that is not an entry as it stands, and the entry meant."""
    return _typed(spark, d).where("not is_entry").select("rec_id", "field", "canon_ord").distinct()


def p1_misses(spark: SparkSession, d: str) -> DataFrame:
    """The report of values that mean no entry, each with the number of rows."""
    return _typed(spark, d).where("canon_ord = 0").groupBy("field", "value").agg(F.count("*").alias("n_rows"))


def p1_listed(spark: SparkSession, d: str) -> DataFrame:
    """Values written like an entry or alias but for case and blanks around it, and the entry they were mapped to."""
    lists = table(spark, d, "alias_dim").select("field", "alias").unionByName(
        table(spark, d, "country_dim").select(F.lit("nationality").alias("field"), F.col("country").alias("alias"))
    ).unionByName(table(spark, d, "weight_dim").select(F.lit("weightclass").alias("field"), F.col("weight_class").alias("alias")))
    known = lists.select("field", F.lower("alias").alias("low")).distinct()
    rows = _typed(spark, d).withColumn("low", F.lower(F.trim("value"))).join(F.broadcast(known), ["field", "low"], "left_semi")
    return rows.select("rec_id", "field", "canon_ord").distinct()


def p1_wordless(spark: SparkSession, d: str) -> DataFrame:
    """Values of digits, signs and weight units only: how often each was mapped to an entry or reported as a miss."""
    rows = _typed(spark, d).where(F.col("value").rlike(r"(?i)^([^\p{L}]|kg|lbs?|pounds?)+$"))
    return rows.groupBy("field", "value").agg(F.count_if(F.col("canon_ord") == 0).alias("missed"), F.count_if(F.col("canon_ord") != 0).alias("mapped"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The first three entries of every category, weight class and gender."""
    names = ["entry_id", "lastupdated", "wins", "kos", "losses", "category", "weightclass", "gender"]
    rows = newest(table(spark, d, "category_records").select(*names), ["entry_id"], "lastupdated", names)
    rows = rows.where(F.col("wins").isNotNull() & ~missing("weightclass") & ~missing("gender"))
    order = [("wins", True), ("kos", True), ("losses", False), ("entry_id", False)]
    return top_n(rows, ["category", "weightclass", "gender"], order, 3).select("entry_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of every text or piece of text, 2,048 tokens to a container."""
    return pack_texts(table(spark, d, "documents"), "doc_id", "text", "source", 2048)


def p6_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Texts placed, and how often a container is overfull, holds copies or a source twice, or loses tokens."""
    docs = table(spark, d, "documents")
    return ledger(pack_texts(docs, "doc_id", "text", "source", 2048, labels=True), token_counts(docs, "doc_id", "text"), "doc_id", 2048)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text", 12)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document that holds twelve words in a row of an item, with the item."""
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans of words to remove from each document."""
    return _leaks(spark, d).distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same and are not stored as the same characters."""
    return look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document's class of texts that look the same."""
    return look_alike_classes(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_links(spark: SparkSession, d: str) -> DataFrame:
    """Each class of texts that look the same with the first text of every other way it is stored."""
    return look_alike_links(table(spark, d, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its one consistent form."""
    return consistent_text(table(spark, d, "documents").select("doc_id", "text"), "text", "form").select("doc_id", "form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_misses, p1_listed, p1_wordless, p2_found, p6_containers, p6_ledger, p7_found, p7_spans, p8_found, p8_classes, p8_links, p8_forms)}


_LISTED = """
with k as (select field, lower(alias) as low, canon_ord as ord, 1 as kind from alias_dim
  union all select 'nationality', lower(country), ord, 0 from country_dim union all select 'weightclass', lower(weight_class), ord, 0 from weight_dim),
o as (select field, low, arg_min(ord, kind) as ord from k group by field, low),
v as (select rec_id, 'nationality' as field, lower(trim(nationality, ' ')) as low from fighter_records union all select rec_id, 'weightclass', lower(trim(weightclass, ' ')) from fighter_records)
select distinct rec_id, field, cast(ord as bigint) as canon_ord from v join o using (field, low)
"""
_WORDLESS = r"""
with v as (select 'nationality' as field, nationality as value from fighter_records union all select 'weightclass', weightclass from fighter_records)
select field, value, count(*) as missed, 0 as mapped from v where value <> '' and regexp_matches(value, '(?i)^([^\pL]|kg|lbs?|pounds?)+$') group by field, value
"""

_P2 = """
with latest as (select * from (select *, row_number() over (partition by entry_id order by lastupdated desc) as rn from category_records) where rn = 1)
select entry_id from (
  select entry_id, row_number() over (partition by category, weightclass, gender order by wins desc, kos desc, losses asc, entry_id asc) as k
  from latest where wins is not null and coalesce(weightclass, '') <> '' and coalesce(gender, '') <> '')
where k <= 3
"""

_P6 = """
select 'texts' as what, count(*) as n from documents
union all select unnest(['overfull', 'copies together', 'sources together', 'tokens lost']), 0
"""

_P7_CTE = r"""
with d as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g')), '[\pL\pN]+') as w from documents),
e as (select item_id, regexp_extract_all(lower(text), '[\pL\pN]+') as w from eval_items),
dp as (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12),
ep as (select item_id, w, unnest(range(1, len(w) - 10)) as k from e where len(w) >= 12),
ph as (select distinct item_id, array_to_string(w[k:k+11], ' ') as p from ep),
hit as (select distinct doc_id, item_id, k - 1 as first from (select doc_id, k, array_to_string(w[k:k+11], ' ') as p from dp) join ph using (p))
"""
_P7 = f"{_P7_CTE} select distinct doc_id, item_id from hit"
_SPANS = f"""{_P7_CTE},
gap as (select *, case when first <= lag(first) over (partition by doc_id, item_id order by first) + 12 then 0 else 1 end as fresh from hit),
run as (select *, sum(fresh) over (partition by doc_id, item_id order by first) as nr from gap)
select doc_id, item_id, min(first) as first_word, max(first) + 12 as end_word from run group by doc_id, item_id, nr
"""


# Fixed values of the SQL, stated apart from the operator's: what stands for what in the tables' scripts. Accents are the database's own composition.
_FROM = "АВЕЅІЈКМНОРСТУХЬаеѕіјорсухԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονёЁїЇѐЀ\u2010\u2011\u2212\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_TO = "ABESIJKMHOPCTYXbaesijopcyxdhABEZHIKMNOPTYXovëËïÏèÈ---" + " " * 15
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_FORMS = rf"""
with f as (select doc_id, text, nfc_normalize(translate(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
  '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{206F}}\x{{FE00}}-\x{{FE0F}}\x{{FEFF}}]', '', 'g'),
  '{_FROM}{_WIDE[0].replace("'", "''")}', '{_TO}{_WIDE[1].replace("'", "''")}')) as form from documents)
"""
_P8 = f"{_FORMS} select x.doc_id as doc_a, y.doc_id as doc_b from f x join f y on x.form = y.form where x.doc_id < y.doc_id and x.text <> y.text"
_CLASSES = f"""{_FORMS}, c as (select form, min(doc_id) as class_id, count(*) as members, count(distinct text) as variants from f where form is not null group by form)
select doc_id, class_id, members, variants from f join c using (form)"""
_LINKS = f"""{_FORMS}, v as (select form, text, min(doc_id) as variant_id, count(*) as copies from f where form is not null group by form, text),
w as (select *, min(variant_id) over (partition by form) as class_id from v)
select class_id, variant_id, copies from w where variant_id <> class_id"""


def oracle_sql() -> dict[str, str]:
    return {"p1_listed": _LISTED, "p1_wordless": _WORDLESS, "p2_found": _P2, "p6_ledger": _P6, "p7_found": _P7, "p7_spans": _SPANS, "p8_found": _P8, "p8_classes": _CLASSES, "p8_links": _LINKS, "p8_forms": f"{_FORMS} select doc_id, form from f"}

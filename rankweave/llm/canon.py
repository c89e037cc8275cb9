"""Freely typed values mapped to the entry of a reference list that is meant.

Every term of the list (entries, their known other names, and for places the
names of their people, derived by rule) is stored under all strings got by
deleting up to two of its characters. A typed value is brought to its bare form,
and the same deletions of it meet the terms within two edits; those are ranked
by weighted Damerau-Levenshtein distance, then by how often their entry occurs
as typed exactly.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.keyed import attach, missing
from rankweave.session import checkpointed, spread

# Words around a value that leave its meaning clear.
BEFORE = re.compile(r"^(?:(?:born|raised|based|lives?|living|fights?|competes?|fighting|competing)\s+(?:in|at|out of)|from|at|in|the|republic of(?= the)|women'?s|woman'?s|men'?s|mens|womens|male|female|ladies'?|currently|now|mainly|usually)\s+", re.I)
AFTER = re.compile(r"\s+(?:citizen(?:ship)?|nationals?|nationality|born|division|class|bout|title|limit|category|mma|champion|fighter|descent|by birth)$", re.I)
# Neighbours on a keyboard, as its three rows.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

_NEAR: set[tuple[str, str]] = set()
for _y, _row in enumerate(ROWS):
    for _x, _c in enumerate(_row):
        for _v, _other in enumerate(ROWS):
            for _u, _d in enumerate(_other):
                if _c != _d and abs(_y - _v) <= 1 and abs((_x + 0.4 * _y) - (_u + 0.4 * _v)) <= 1.1:
                    _NEAR.add((_c, _d))

# Endings that make the name of a people from that of a place, and endings of places that fall away before them.
PEOPLE = ("n", "an", "ian", "nian", "vian", "ish", "ese", "i", "er", "e", "man", "woman")
PLACE = ("", "a", "e", "i", "o", "y", "ia", "and", "land")
GENERIC = re.compile(r"\b(?:the|republic|of|democratic|federation|kingdom|states?|united)\b", re.I)

_TAGS = re.compile(r"<ref\b[^<>]*/>|<ref\b.*?</ref\s*>|<[^<>]*>|<!--.*?-->", re.I | re.S)
_FLAG = re.compile(r"\{\{\s*[^{}|]*\|\s*([^{}|]*)(?:\|[^{}]*)?\}\}")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]")
_PARENS = re.compile(r"\s*[(\[]([^()\[\]]*)[)\]]?\s*$")
_EDGES = " \t\r\n,;.:*•·\"'’‘“”`-–—/|_!#"
_BARE_WEIGHT = re.compile(r"^\W*\d+(?:[.,]\d+)?\s*(?:kgs?|kilos?|kilograms?|lbs?|pounds?|st|stones?)?\W*$", re.I)


def fold(text: str) -> str:
    """Letters and digits only, lower case, without accents."""
    flat = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in flat if c.isalnum())


def peoples(name: str) -> set[str]:
    """Bare forms that the people of a place may be called by: endings changed by rule, of its first word too if names are joined by "and"."""
    whole = GENERIC.sub(" ", name)
    bases = {fold(name), fold(whole), *(fold(x) for x in re.split(r"\s(?:and|&)\s|[/-]", whole))}
    out = set(bases)
    for base in bases:
        for end in PLACE:
            stem = base[: len(base) - len(end)] if base.endswith(end) else ""
            if len(stem) >= 3:
                out |= {stem + p for p in PEOPLE} | {stem + stem[-1] + p for p in PEOPLE if p[0] in "aei"}
    return {x for x in out if len(x) >= 4}


def distance(a: str, b: str, most: float = 9.0) -> float:
    """Damerau-Levenshtein from typed ``a`` to ``b`` with typing weights: a letter doubled 0.6, a double letter written once 0.8, letters swapped 0.7, a neighbouring key 0.7, else 1."""
    before: list[float] = []
    last = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            if x == y:
                cost = last[j - 1]
            else:
                cost = last[j - 1] + (0.7 if (x, y) in _NEAR else 1.0)
            drop = last[j] + (0.6 if i > 1 and a[i - 2] == x else 1.0)
            add = row[j - 1] + (0.8 if j > 1 and b[j - 2] == y else 1.0)
            cost = min(cost, drop, add)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                cost = min(cost, before[j - 2] + 0.7)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def deletions(term: str, edits: int) -> set[str]:
    """The term and all that is left of it after deleting up to so many characters."""
    out = {term}
    for k in range(1, edits + 1):
        if len(term) > k:
            out |= {"".join(c for i, c in enumerate(term) if i not in gone) for gone in map(set, combinations(range(len(term)), k))}
    return out


class Reference:
    """The symmetric-delete dictionary of one list.

    ``exact``: bare form of entries and aliases to entry; ``derived``: forms
    made by rule, where only one entry has them and no listed term is the same.
    Listed terms come before derived ones. Forms shorter than ``short`` are
    codes and are only met exactly.
    """

    #: What a derived form costs more than a listed one.
    DERIVED = 0.3

    def __init__(self, entries: list[tuple[int, str]], aliases: list[tuple[str, int]], frequency: dict[int, int], people: bool = False, short: int = 4):
        self.exact: dict[str, int] = {}
        for name, ord_ in [(n, o) for o, n in entries] + aliases:
            self.exact.setdefault(fold(name), ord_)
        self.exact.pop("", None)
        self.names = {n: o for o, n in entries}
        made: dict[str, set[int]] = {}
        if people:
            for name, ord_ in [(n, o) for o, n in entries] + aliases:
                for form in (peoples(name) if len(fold(name)) >= short else set()) - self.exact.keys():
                    made.setdefault(form, set()).add(ord_)
        self.derived = {form: next(iter(o)) for form, o in made.items() if len(o) == 1}
        self.frequency = frequency
        self.index: dict[str, list[str]] = {}
        for term in [*self.exact, *self.derived]:
            if len(term) >= short:
                for d in deletions(term, self.edits(len(term))):
                    self.index.setdefault(d, []).append(term)
        self.short, self.longest = short, max(map(len, [*self.exact, *self.derived]), default=0)

    @staticmethod
    def edits(length: int) -> int:
        """How many characters of a form may be wrong."""
        return 1 if length <= 4 else 2

    def nearest(self, bare: str) -> tuple[float, int] | None:
        """The smallest weighted distance and the entry meant; ties go to the more frequent entry, then the lower ord."""
        if not self.short - 1 <= len(bare) <= self.longest + 2:
            return None
        best, met = None, set()
        for d in deletions(bare, self.edits(len(bare))):
            for term in self.index.get(d, ()):
                if term in met:
                    continue
                met.add(term)
                edits = self.edits(min(len(term), len(bare)))
                cost = distance(bare, term, float(edits))
                if cost <= edits:
                    listed = self.exact.get(term)
                    ord_ = self.derived[term] if listed is None else listed
                    rank = (cost + (self.DERIVED if listed is None else 0.0), -self.frequency.get(ord_, 0), ord_)
                    best = rank if best is None or rank < best else best
        return None if best is None else (best[0], best[2])

    def lookup(self, value: str) -> int:
        """The entry meant by a typed value, 0 if none."""
        forms = [fold(f) for f in readings(value)]
        for terms in (self.exact, self.derived):
            for form in forms:
                if got := terms.get(form):
                    return got
        found = None
        for k, form in enumerate(forms):
            if got := self.nearest(form):
                rank = (got[0], k, got[1])
                found = rank if found is None or rank < found else found
        return found[2] if found else 0


def readings(value: str) -> Iterator[str]:
    """The value without markup, then without what is only added to it, most literal first."""
    text = html.unescape(value)
    text = _TAGS.sub(" ", text)
    text = _FLAG.sub(r"\1", _LINK.sub(r"\1", text)).replace("'''", "").replace("''", "")
    text = re.sub(r"\s+", " ", text).strip(_EDGES)
    seen: set[str] = set()
    todo = [text]
    while todo:
        form = todo.pop(0).strip(_EDGES)
        if not form or form in seen or _BARE_WEIGHT.match(form):
            continue
        seen.add(form)
        yield form
        if (m := _PARENS.search(form)) and m.start():
            todo.append(form[: m.start()])
        if " - " in form:
            todo.append(form.split(" - ")[0])
        if (short := BEFORE.sub("", form)) != form:
            todo.append(short)
        if (short := AFTER.sub("", form)) != form:
            todo.append(short)
        if "," in form and "(" not in form:
            head, _, tail = form.rpartition(",")
            todo.append(tail)
            if "," not in head:
                todo.append(f"{tail.strip()} {head.strip()}")


@lru_cache(maxsize=4)
def _references(spec: tuple) -> dict[str, Reference]:
    return {field: Reference(list(e), list(a), dict(f), people) for field, e, a, f, people in spec}


#: Lists with more terms than this aren't sent to every task: their values meet them in a shuffle.
MAX_TERMS = 200_000
_FORMS = "value string, place int, form string"


def _value_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(v, k, f) for v in b["value"] for k, f in enumerate(map(fold, readings(v)))]
        yield pd.DataFrame(rows, columns=["value", "place", "form"])


def _deleted(column: str, short: int, keep: list[str]):
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b[column].str.len() >= short]
            parts = [sorted(deletions(x, Reference.edits(len(x)))) for x in b[column]]
            out = b[keep].loc[b.index.repeat([len(x) for x in parts])].reset_index(drop=True)
            yield out.assign(part=[y for x in parts for y in x])

    return explode


def join_to_list(values: DataFrame, terms: DataFrame, short: int = 4) -> DataFrame:
    """``(value, ord)`` of each different value, by the rules of ``Reference.lookup``, for a list of any size.

    ``terms`` is ``(term, ord, derived, frequency)`` with bare terms, listed or
    derived. Nothing is broadcast: forms meet terms by equality, what is left
    meets them by shared deletions in a shuffle, and the distance is taken of
    the pairs that share one. Terms longer than two characters more than a form
    share none.
    """
    forms = checkpointed(values.select("value").distinct().mapInPandas(_value_forms, _FORMS))
    equal = forms.join(terms, forms["form"] == terms["term"]).groupBy("value").agg(F.min_by("ord", F.struct("derived", "place", "ord")).alias("ord"))
    left = forms.join(equal, "value", "left_anti")
    typed = left.select("form").distinct().mapInPandas(_deleted("form", short - 1, ["form"]), "form string, part string")
    parts = terms.mapInPandas(_deleted("term", short, ["term", "ord", "derived", "frequency"]), "term string, ord long, derived boolean, frequency long, part string")

    @F.pandas_udf("double")
    def cost(form: pd.Series, term: pd.Series) -> pd.Series:
        most = [float(Reference.edits(min(len(a), len(b)))) for a, b in zip(form, term)]
        got = [distance(a, b, m) for a, b, m in zip(form, term, most)]
        return pd.Series([g if g <= m else None for g, m in zip(got, most)], dtype="float64")

    pairs = typed.join(parts, "part").drop("part").distinct().withColumn("cost", cost("form", "term")).where("cost is not null and not isnan(cost)")
    rank = F.struct((F.col("cost") + F.when(F.col("derived"), Reference.DERIVED).otherwise(0.0)).alias("c"), (-F.col("frequency")).alias("f"), F.col("ord").alias("o"))
    best = pairs.groupBy("form").agg(F.min(rank).alias("r"))
    near = left.join(best, "form").groupBy("value").agg(F.min_by("r.o", F.struct("r.c", "place", "r.o")).alias("ord"))
    return equal.unionByName(near)


def _all_terms(entries: DataFrame, aliases: DataFrame, typed: DataFrame, people: bool, short: int = 4) -> DataFrame:
    """``(term, ord, derived, frequency)`` of a list of any size; a term of several entries goes to the entry's own name, then the lowest ord."""
    names = entries.select(F.col("ord").cast("long"), "name", F.lit(0).alias("kind")).unionByName(aliases.select(F.col("canon_ord").cast("long").alias("ord"), F.col("alias").alias("name"), F.lit(1).alias("kind")))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(fold(n), o, k) for n, o, k in zip(b["name"], b["ord"], b["kind"])]
            if people:
                rows += [(f, o, 2) for n, o in zip(b["name"], b["ord"]) if len(fold(n)) >= short for f in peoples(n)]
            yield pd.DataFrame([r for r in rows if r[0]], columns=["term", "ord", "kind"])

    made = names.where("name is not null").mapInPandas(make, "term string, ord long, kind int")
    own = made.groupBy("term").agg(F.min(F.struct("kind", "ord")).alias("first"), F.count_distinct("ord").alias("n"))
    own = own.where("first.kind < 2 or n = 1").select("term", "first.ord", (F.col("first.kind") == 2).alias("derived"))
    counts = entries.select(F.col("ord").cast("long"), "name").join(typed.groupBy(F.col("v").alias("name")).agg(F.count("*").alias("n")), "name").groupBy("ord").agg(F.sum("n").alias("frequency"))
    return own.join(counts, "ord", "left").select("term", "ord", "derived", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def map_to_list(df: DataFrame, key: str, fields: dict[str, DataFrame], aliases: DataFrame, places: tuple[str, ...] = (), max_terms: int = MAX_TERMS) -> DataFrame:
    """``(key, field, value, canon_ord, is_entry)`` of every typed value; ``canon_ord`` 0 where no entry is meant.

    ``fields`` maps each column of ``df`` to its list, a frame of ``(ord,
    name)``; ``aliases`` has ``(field, alias, canon_ord)``. Lists of fields in
    ``places`` name places: the names of their people are derived from them.
    ``is_entry`` tells that the value is an entry character for character.

    Defined cases: null and empty values give no row; markup, case, accents,
    edge punctuation and additions ("from X", "X (since 2012)", "City, X") are
    set aside; bare weights and values whose weighted distance to every term is
    more than 2 (1 up to four letters) are unmatched; forms below four letters
    are met only as they stand; rows that repeat give one row per repeat (use
    ``distinct``); an empty list leaves all unmatched; other columns are
    ignored. Long texts are read whole; what remains longer than every term by
    more than two characters is further than two edits from each.

    A narrow map: the dictionary, whose size is checked, goes to every task and
    each task looks up each different value once. Nothing is shuffled but the
    exact-match counts of the list's own entries. A list of more than
    ``max_terms`` terms is joined instead (``join_to_list``), to the same rows.
    """
    spec, large = [], []
    for field, entries in fields.items():
        entries = entries.toDF("ord", "name").where(F.col("name").isNotNull())
        known = aliases.where((F.col("field") == field) & ~missing("alias")).select("alias", "canon_ord")
        typed = df.select(F.col(field).cast("string").alias("v")).where(~missing("v"))
        listed = entries.select(F.col("ord").cast("long"), "name").limit(max_terms + 1).collect()
        others = known.limit(max_terms + 1).collect()
        if len(listed) + len(others) > max_terms:
            large.append((field, entries, known, typed))
            continue
        names = {r[1]: r[0] for r in listed}
        hits = typed.join(F.broadcast(entries.select(F.col("name").alias("v"))), "v", "left_semi")
        counts = {names[r["v"]]: r["count"] for r in hits.groupBy("v").count().collect()} if listed else {}
        spec.append((
            field,
            tuple(sorted((r[0], r[1]) for r in listed)),
            tuple(sorted((r["alias"], r["canon_ord"]) for r in others)),
            tuple(sorted(counts.items())),
            field in places,
        ))
    fixed = tuple(spec)
    columns = [x[0] for x in spec]

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = _references(fixed)
        memo: dict[tuple[str, str], int] = {}
        for batch in batches:
            parts = []
            for field in columns:
                values = batch[field]
                some = values.notna() & (values != "")
                values, ref = values[some], refs[field]
                got = {}
                for v in values.unique():
                    if (o := memo.get((field, v))) is None:
                        o = ref.names.get(v) or ref.lookup(v)
                        if len(memo) < 500_000:
                            memo[field, v] = o
                    got[v] = o
                parts.append(pd.DataFrame({
                    "row_key": batch["__key"][some], "field": field, "value": values,
                    "canon_ord": values.map(got).astype("int64"), "is_entry": values.isin(ref.names),
                }))
            yield pd.concat(parts)

    out = None
    if columns:
        rows = df.select(F.col(key).cast("long").cast("string").alias("__key"), *(F.col(c).cast("string").alias(c) for c in columns))
        out = spread(rows, "__key").mapInPandas(look_up, "row_key string, field string, value string, canon_ord long, is_entry boolean").select(
            F.col("row_key").cast("long").alias(key), "field", "value", "canon_ord", "is_entry"
        )
    for field, entries, known, typed in large:
        own = entries.groupBy(F.col("name").alias("value")).agg(F.min(F.col("ord").cast("long")).alias("own"))
        values = typed.groupBy(F.col("v").alias("value")).agg(F.count("*").alias("n"))
        met = join_to_list(values, _all_terms(entries, known, typed, field in places), 4)
        state = checkpointed(values.join(own, "value", "left").join(met, "value", "left").select(
            "value", "n", F.coalesce("own", "ord", F.lit(0).cast("long")).alias("canon_ord"), F.col("own").isNotNull().alias("is_entry")
        ))
        rows = df.select(F.col(key).cast("long").alias(key), F.col(field).cast("string").alias("value")).where(~missing("value"))
        one = attach(rows, state, ["value"], "n", df.count()).select(key, F.lit(field).alias("field"), "value", "canon_ord", "is_entry")
        out = one if out is None else out.unionByName(one)
    return out

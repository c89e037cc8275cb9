"""Several values packed in one field, one row per value.

A parsing expression grammar with ordered choice. In the order tried:

    field   <- list template / (sep* value (sep+ value)* sep*)
    value   <- part+                       parts up to the next separator
    part    <- quoted / link / bracketed / name / bare
    quoted  <- q (!q .)* q &(space* (sep / end / '('))   q opens only at a value's start
    link    <- '[[' (target '|')? text ']]'
    bracketed <- '(' (bracketed / !')' .)* ')'
    name    <- a known name that holds a separator, at word edges, in any case
    sep     <- break tag / newline / [,;/|&•] / 'and' between spaces

If an alternative fails the parser goes back and tries the next: a quote that
never closes, or closes in the middle of a word, is read as an ordinary
character and the value is flagged ``malformed_quote``; a bracket that never
closes is flagged ``open_bracket``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quote pairs, the names of list templates, separator characters.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“"}
LIST_TEMPLATES = ("plainlist", "plain list", "hlist", "flatlist", "ubl", "unbulleted list", "ublist")
SEPARATORS = ",;/|&•·\n\r"

_BREAK = re.compile(r"<\s*/?\s*(?:br|li|ul|ol|p|hr)\b[^<>]*>", re.I)
_AND = re.compile(r"and(?=\s)", re.I)
_BULLET = re.compile(r"(?:(?<=\n)|^)[ \t]*[*#](?=\s*\S)")
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(r"<[^<>]*>")
_TEMPLATE = re.compile(r"\{\{\s*(" + "|".join(re.escape(x) for x in LIST_TEMPLATES) + r")\s*\|(.*)\}\}\s*", re.I | re.S)
_MARKS = re.compile(r"'{2,5}")
_SPACE = re.compile(r"[^\S\n\r]+")


class FieldGrammar:
    """The grammar over one set of names that hold separators themselves."""

    def __init__(self, names: Iterable[str] = ()):
        hard = [n for n in names if n and re.search(r"[,;/|&•·]|\sand\s", n, re.I)]
        alt = "|".join(re.escape(n) for n in sorted(hard, key=lambda n: (-len(n), n)))
        self._name = re.compile(rf"(?<!\w)(?:{alt})(?!\w)", re.I) if alt else None

    # Each rule takes the text and a place; it gives the place after what it
    # matched and the text shown to a reader, or None if it doesn't match.

    def _sep(self, t: str, i: int) -> int | None:
        if m := _BREAK.match(t, i):
            return m.end()
        if i < len(t) and t[i] in SEPARATORS:
            return i + 1
        if (m := _AND.match(t, i)) and (i == 0 or t[i - 1].isspace() or t[i - 1] in SEPARATORS or t[i - 1] in "\"'”’»>])"):
            return m.end()
        return None

    def _quoted(self, t: str, i: int) -> tuple[int, str] | None:
        close = QUOTES.get(t[i])
        if close is None:
            return None
        j = i + 1
        while (j := t.find(close, j)) > 0:
            k = j + 1
            while k < len(t) and t[k] in " \t ":
                k += 1
            ends = k >= len(t) or t[k] == "(" or (k > j + 1 or t[k] != "/") and self._sep(t, k) is not None or t[k] == "/"
            if ends and j > i + 1:
                return j + 1, t[i + 1 : j]
            j += 1
        return None

    @staticmethod
    def _link(t: str, i: int) -> tuple[int, str] | None:
        if not t.startswith("[[", i):
            return None
        j = t.find("]]", i)
        if j < 0:
            return None
        return j + 2, t[i + 2 : j].rpartition("|")[2]

    @staticmethod
    def _brackets(t: str) -> dict[int, int]:
        """Every bracket that closes, with the place of its partner; each kind is matched by itself, in one pass."""
        partner, stacks, opens = {}, {")": [], "]": [], "}": []}, {"(": ")", "[": "]", "{": "}"}
        for i, c in enumerate(t):
            if c in opens:
                stacks[opens[c]].append(i)
            elif c in stacks and stacks[c]:
                partner[stacks[c].pop()] = i
        return partner

    def parse(self, raw: str | None) -> list[tuple[int, str, str | None]]:
        """``(pos, item, error)`` of each value; pos counts from 1, empty places not counted."""
        if not raw:
            return []
        t = _REF.sub("", raw)
        t = html.unescape(t) if "&" in t and ";" in t else t
        if m := _TEMPLATE.fullmatch(t.strip()):
            t = m[2]
        t = _BULLET.sub("\n", _MARKS.sub("", t) if "''" in t else t)
        out: list[tuple[int, str, str | None]] = []
        shown: list[str] = []
        error: str | None = None

        def close() -> None:
            nonlocal error
            item = _SPACE.sub(" ", _TAG.sub("", "".join(shown))).strip()
            if item:
                out.append((len(out) + 1, item, error))
            shown.clear()
            error = None

        i, n = 0, len(t)
        partner = self._brackets(t) if any(c in t for c in "([{") else {}
        while i < n:
            if (j := self._sep(t, i)) is not None:
                close()
                i = j
                continue
            fresh = not any(x.strip() for x in shown)
            c = t[i]
            got = None
            if fresh and c in QUOTES:
                got = self._quoted(t, i)
                if got is None:
                    error = "malformed_quote"
                else:  # what is quoted may hold links, never separators
                    inner = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", got[1])
                    got = (got[0], inner)
            if got is None:
                got = self._link(t, i)
            if got is None and c in "([{":
                if i in partner:
                    got = (partner[i] + 1, t[i : partner[i] + 1])
                else:
                    error = error or "open_bracket"
            if got is None and self._name is not None and (m := self._name.match(t, i)):
                got = (m.end(), m[0])
            if got is None:
                got = (i + 1, c)
            shown.append(got[1])
            i = got[0]
        close()
        return out


@lru_cache(maxsize=8)
def _grammar(names: tuple[str, ...]) -> FieldGrammar:
    return FieldGrammar(names)


#: Names that hold a separator are few; a longer list is refused rather than shipped to every task.
MAX_NAMES = 10_000


def split_values(df: DataFrame, key: Column | str, field: Column | str, names: Iterable[str] = (), min_values: int = 1) -> DataFrame:
    """``(row_key, pos, item, error)``, one row per value of ``field``.

    ``names`` are values that hold a separator themselves ("Trinidad and
    Tobago") and stay whole. Fields with fewer than ``min_values`` values give
    no row. ``error`` is null, ``malformed_quote`` or ``open_bracket``.

    Defined cases: null and empty fields, and fields of separators only, have
    no values; rows that repeat in full give their values once, but a value
    written twice in a field counts twice; a null key is a key; other columns
    are ignored, whatever their names. Long fields are parsed whole.

    The parse is a narrow map over Arrow batches; the only shuffle is the
    distinct on ``(key, field)`` before it, which combines on the map side.
    """
    fixed = tuple(sorted(set(names)))
    if len(fixed) > MAX_NAMES:
        raise ValueError(f"{len(fixed)} names with separators; at most {MAX_NAMES} are sent to every task")
    key = F.col(key) if isinstance(key, str) else key
    field = F.col(field) if isinstance(field, str) else field
    rows = df.select(key.cast("long").cast("string").alias("row_key"), field.cast("string").alias("field"))
    # A field without any separator character holds one value at most.
    if min_values > 1:
        rows = rows.where(F.col("field").rlike(r"(?i)[,;/|&•·\n\r*#]|<|and"))
    rows = rows.where((F.col("field") != "") & F.col("field").isNotNull()).distinct()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = _grammar(fixed)
        for batch in batches:
            keys, pos, items, errors = [], [], [], []
            for k, text in zip(batch["row_key"], batch["field"]):
                got = grammar.parse(text)
                if len(got) >= min_values:
                    for p, item, error in got:
                        keys.append(k)
                        pos.append(p)
                        items.append(item)
                        errors.append(error)
            yield pd.DataFrame({"row_key": pd.array(keys, dtype=object), "pos": pos, "item": pd.array(items, dtype=object), "error": pd.array(errors, dtype=object)})

    # Keys pass as text, since a column of numbers and nulls would reach Python as floating point.
    out = rows.mapInPandas(parse, "row_key string, pos long, item string, error string")
    return out.withColumn("row_key", F.col("row_key").cast("long"))

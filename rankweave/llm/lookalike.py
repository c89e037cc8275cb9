"""One consistent form for text that looks the same but differs in its characters.

A transducer is compiled from a mapping of widths, spaces, invisible characters,
accents and look-alike letters. It reads a text once, standard grapheme cluster
by grapheme cluster. Of each cluster it takes the longest match: from the state
of the base letter each mark leads to the state of the accented letter, as far
as there is one. What a state writes is stated beforehand for all of them; no
text is normalised while it is read. The mapping is made by rule from the
character database and a list of letters that share one shape, and is checked
for conflicts when compiled: no character has two results, every result maps to
itself, and every spelling of a letter with its accents gives the same.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.keyed import HOT_ROWS, attach
from rankweave.session import checkpointed, spread

# Letters of other scripts and the letter whose shape they share.
SHAPES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y",
    "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ѵ": "V", "Ӏ": "I", "Ь": "b",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "ԍ": "ɢ",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "Γ": "Г", "Π": "П", "Φ": "Ф",
    # Armenian, Latin of other alphabets
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "ɑ": "a", "ɡ": "g",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b",
    "Ꮢ": "R", "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓒ": "d", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R",
    "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Coptic
    "Ⲃ": "B", "Ⲍ": "Z", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # hyphens and the minus sign
    "\u2010": "-", "\u2011": "-", "\u2212": "-",
}
# Characters that take no room and change no other's look: soft hyphen, joiners, marks of direction, fillers, selectors.
UNSEEN = [
    0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0x3164,
    *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xE0100, 0xE01F0),
]
# Blocks in which joiners do change the look (Arabic to Khmer, pictographs), and blocks of compatibility letters.
JOINING = "\u0600-\u08ff\u0900-\u0dff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u2600-\u27bf\U0001f000-\U0001faff"
COMPATIBLE = [(0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFF01, 0xFFEE)]
#: Marks in the table of characters that write nothing or several characters.
NONE, MANY = 0xFFFFFFFE, 0xFFFFFFFF
#: Kinds of character: what may begin a cluster of several (0), what attaches to it, what is unseen, what ends it.
ATTACHED, HIDDEN, CONTROL = 1, 2, 3
JOINERS = "\u200c\u200d\ufe0e\ufe0f"


def _one_to_one() -> dict[str, str]:
    """Characters to what they look like, before accents; a character that stands for itself is left out."""
    out: dict[str, str] = {}

    def put(a: str, b: str) -> None:
        if out.setdefault(a, b) != b:
            raise ValueError(f"two results for U+{ord(a):04X}")

    for c in map(chr, UNSEEN):
        put(c, "")
    for lo, hi in COMPATIBLE:
        for c in map(chr, range(lo, hi + 1)):
            if unicodedata.category(c) != "Cn" and c not in out:
                put(c, unicodedata.normalize("NFKC", c))
    for c in map(chr, range(0x00A0, 0x3001)):  # every space of any width
        if unicodedata.category(c) == "Zs":
            put(c, " ")
    for c in "\r\u2028\u2029\u0085":
        put(c, "\n")
    for a, b in SHAPES.items():
        put(a, b)
    return {k: v for k, v in out.items() if k != v}


def _code_points(property: str) -> list[int]:
    """The characters with a property of the Unicode segmentation rules."""
    some = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE1000)]))
    return [ord(c) for c in regex.findall(f"[{property}]", some)]


class Transducer:
    """The compiled mapping.

    ``single`` is what a cluster of one character writes, ``table`` the same by
    code point where it is one character or none.
    ``parts`` leads each character to the base and marks it stands for,
    ``goto`` a state (a base, or base with accents) and a mark to the next
    state, ``rank`` gives marks their standard order. Marks that no state takes
    are written after the state they stand on.
    """

    def __init__(self, one: dict[str, str]):
        nfc, nfd = (lambda x, f=f: unicodedata.normalize(f, x) for f in ("NFC", "NFD"))
        self.parts: dict[str, str] = {}
        self.single: dict[int, str] = {}
        self.rank: dict[str, int] = {}
        self.goto: dict[tuple[str, str], str] = {}
        for c in map(chr, [*range(0xAC00), *range(0xF900, 0x1E000), *range(0x2F800, 0x2FA20), *range(0xE0100, 0xE01F0)]):
            if k := unicodedata.combining(c):
                self.rank[c] = k
            split = unicodedata.decomposition(c)
            if not split and c not in one:
                continue
            if split and split[0] != "<" and " " in split and nfc(c) == c:
                a, b = (chr(int(x, 16)) for x in split.split())
                self.goto[a, b] = c
            whole, met = nfd(c), set()
            while (step := nfd("".join(one.get(x, x) for x in whole))) != whole:
                if step in met:
                    raise ValueError(f"U+{ord(c):04X} leads round in a circle")
                met.add(whole := step)
            if whole != c:
                self.parts[c] = whole
                if nfc(whole) != c:
                    self.single[ord(c)] = nfc(whole)
        for k in range(11172):  # syllables, by the rule of their block: first part, vowel, and 27 last parts
            c, lead, vowel, tail = chr(0xAC00 + k), chr(0x1100 + k // 588), chr(0x1161 + k % 588 // 28), k % 28
            self.goto[(chr(0xAC00 + k - tail), chr(0x11A7 + tail)) if tail else (lead, vowel)] = c
            self.parts[c] = lead + vowel + (chr(0x11A7 + tail) if tail else "")
        self.table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for k, v in self.single.items():
            self.table[k] = ord(v) if len(v) == 1 else MANY if v else NONE
        self.kind = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
        for property, k in ((r"\p{GCB=Control}\p{GCB=CR}\p{GCB=LF}", CONTROL), ("", HIDDEN), (r"\p{GCB=Extend}\p{GCB=SpacingMark}\p{GCB=ZWJ}\p{GCB=V}\p{GCB=T}", ATTACHED)):
            self.kind[_code_points(property) if property else UNSEEN] = k
        self.joined = re.compile(f"[{JOINING}]")
        self._check(one)

    def cluster(self, cluster: str) -> str:
        """What a cluster of several characters writes: one walk over its states."""
        keeps = self.joined.match(cluster) is not None
        rank, parts = self.rank.get, self.parts.get
        seq: list[str] = []
        for c in cluster:
            for x in c if keeps and c in JOINERS else parts(c, c):
                k, at = rank(x, 0), len(seq)
                while k and at and rank(seq[at - 1], 0) > k:  # marks in their standard order
                    at -= 1
                seq.insert(at, x)
        out, state, waiting = [], "", []
        for x in seq:
            k = rank(x, 0)
            blocked = waiting and (not k or rank(waiting[-1], 0) >= k)
            if state and not blocked and (to := self.goto.get((state, x))):
                state = to
            elif k:
                waiting.append(x)
            else:
                out += [state, *waiting]
                state, waiting = x, []
        return "".join([*out, state, *waiting])

    def clusters(self, text: str, kinds: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where the clusters of several characters lie: a base with all that attaches to it, unseen characters between them included."""
        end, n = 0, len(text)
        for h in np.flatnonzero(kinds == ATTACHED).tolist():
            if h < end:
                continue
            begin = h - 1
            while begin >= end and kinds[begin] == HIDDEN:
                begin -= 1
            begin += begin < end or kinds[begin] == CONTROL
            end = h + 1
            while end < n:
                k = end
                while k < n and kinds[k] == HIDDEN:
                    k += 1
                if k < n and kinds[k] == ATTACHED:
                    end = k + 1
                elif text[end - 1] == "\u200d" and self.joined.match(text[end]):
                    end += 1
                else:
                    break
            yield begin, end

    def __call__(self, text: str) -> str:
        if text.isascii() and "\r" not in text:
            return text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds = self.kind[codes]
        out, at = [], 0
        for begin, end in self.clusters(text, kinds) if (kinds == ATTACHED).any() else ():
            out += [self.singles(codes[at:begin]), self.cluster(text[begin:end])]
            at = end
        return "".join([*out, self.singles(codes[at:])])

    def singles(self, codes: np.ndarray) -> str:
        """What a run of clusters of one character each writes; a line end of two characters is one cluster."""
        if not len(codes):
            return ""
        to = self.table[codes]
        to[:-1][(codes[:-1] == 13) & (codes[1:] == 10)] = NONE
        odd = to >= NONE
        if odd.any():
            if (to[odd] == MANY).any():
                return "".join("" if t == NONE else self.single[c] if t == MANY else chr(t) for c, t in zip(codes.tolist(), to.tolist()))
            to = to[~odd]
        return to.tobytes().decode("utf-32-le", "surrogatepass")

    def _check(self, one: dict[str, str]) -> None:
        for k, v in {**one, **{chr(c): v for c, v in self.single.items()}}.items():
            v = self(v)
            if self(k) != v or self(v) != v:
                raise ValueError(f"{k!r} gives {self(k)!r}, which is not its own form")
            if self(split := unicodedata.normalize("NFD", k)) != v:
                raise ValueError(f"{k!r} and its parts give {v!r} and {self(split)!r}")


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(_one_to_one())


def consistent(text: str) -> str:
    """The one form of all texts that look like ``text``."""
    return transducer()(text)


def consistent_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``, the consistent form of ``text``; null stays null, empty stays empty, other columns pass through."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        t = transducer()
        return texts.map(lambda x: None if x is None else t(x))

    return df.withColumn(out, form(F.col(text)))


def _prints(df: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, form, raw)``: 128-bit prints of the consistent form and of the text as stored. Texts never leave the scan."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer()
        for b in batches:
            forms, raws = [], []
            for x in b["text"]:
                raw = x.encode("utf-8", "surrogatepass")
                raws.append(xxhash.xxh3_128_digest(raw))
                y = t(x)
                forms.append(raws[-1] if y == x else xxhash.xxh3_128_digest(y.encode("utf-8", "surrogatepass")))
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "form": forms, "raw": raws})

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null and id is not null")
    return spread(rows, "id").mapInPandas(scan, "id long, form binary, raw binary")


def look_alike_classes(df: DataFrame, id: str, text: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, class_id, members, variants)``: for each text its class, the smallest id that looks the same.

    ``members`` counts the texts of the class and ``variants`` the ways in
    which they are stored. Null texts and null ids belong to no class; every
    other text has one, if only its own; a repeated row is one member.
    """
    rows = checkpointed(_prints(df, id, text).distinct())
    n_raw = rows.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = n_raw.groupBy("form").agg(F.sum("n").alias("members"), F.min("least").alias("class_id"), F.count("*").alias("variants"))
    return attach(rows, classes, ["form"], "members", rows.count(), hot_rows).select("id", "class_id", "members", "variants")


def look_alike_pairs(df: DataFrame, id: str, text: str, hot_rows: int = HOT_ROWS, block: int = 2000) -> DataFrame:
    """``(doc_a, doc_b)``, ``doc_a < doc_b``: texts that look the same and are not stored as the same characters.

    Texts of classes stored in one way only take no part. A class of more than
    ``block`` members is joined in blocks: one side is spread over as many
    salts as it has blocks, the other meets each, so no task gets more than a
    block of the hot class on one side.

    Defined cases: null texts look like nothing; empty texts look like texts
    of invisible characters only; a repeated row counts once; other columns
    are ignored.
    """
    rows = checkpointed(_prints(df, id, text).distinct())
    n_raw = rows.groupBy("form", "raw").agg(F.count("*").alias("n"))
    classes = n_raw.groupBy("form").agg(F.sum("n").alias("members"), F.count("*").alias("variants")).where("variants > 1").drop("variants")
    few = attach(rows, classes, ["form"], "members", rows.count(), hot_rows)
    salts = F.ceil(F.col("members") / F.lit(block)).cast("int")
    few = checkpointed(few.withColumn("salts", salts))
    left = few.select("form", F.col("id").alias("doc_a"), F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    right = few.select("form", F.col("id").alias("doc_b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, ["form", "salt"]).where("doc_a < doc_b and raw_a != raw_b").select("doc_a", "doc_b")


def look_alike_links(df: DataFrame, id: str, text: str) -> DataFrame:
    """``(class_id, variant_id, copies)``: the links of each class, from its smallest id to the smallest id of every other way it is stored.

    With ``look_alike_classes`` as membership this says what the pairs of
    ``look_alike_pairs`` say, in as many rows as there are ways of storing.
    """
    n_raw = checkpointed(_prints(df, id, text).distinct().groupBy("form", "raw").agg(F.count("*").alias("copies"), F.min("id").alias("variant_id")))
    classes = n_raw.groupBy("form").agg(F.min("variant_id").alias("class_id"), F.count("*").alias("variants")).where("variants > 1")
    return n_raw.join(classes, "form").where("variant_id != class_id").select("class_id", "variant_id", "copies")

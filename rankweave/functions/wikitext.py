"""Wiki markup as column expressions; nothing leaves the JVM, nothing is shuffled.

Braces are followed by folding over the few marks a text holds, not over its
characters: the marks come from one regular expression, the text between them
from a split on the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.text import WS, encode_component, let, squeeze, trim_ws

# Infobox kinds in the order tried, weight classes in the order tried, image kinds, unwanted images.
INFOBOXES = ("{{Infobox martial artist", "{{Infobox person", "{{Infobox officeholder", "{{Infobox military")
WEIGHT_CLASSES = (
    "Super heavyweight", "Light heavyweight", "Super middleweight", "Super featherweight", "Light welterweight", "Light middleweight",
    "Featherweight", "Cruiserweight", "Middleweight", "Welterweight", "Lightweight", "Heavyweight", "Bantamweight", "Strawweight",
    "Flyweight", "Atomweight",
)
IMAGE = r"jpg|jpeg|png|gif|svg|webp"
NO_PORTRAIT = r"(?i)Med[\s_]*\d*\.png|Generic_belt_icon\.svg|Olympic[\s_]*rings\.svg|Boxbelt|Medal[\s_]|Ribbon[\s_]|File-icon"
IMAGE_BASE = "https://en.wikipedia.org/wiki/Special:FilePath/"

# Patterns of markup and what stands for each in plain text, in the order applied.
_LINK = r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]"
_PLAIN = (
    (_LINK, "$1"), ("'''", ""), ("''", ""), (r"\{\{[^}]*\}\}", ""), (r"<ref[^>]*/>", ""), (r"<ref[^>]*>[\s\S]*?</ref>", ""), (r"<[^>]+>", ""), ("&nbsp;", " "),
)
_PLAIN_CLASS = ((r"<[^>]+>", " "), (r"\{\{[^}]*\}\}", " "), (_LINK, "$1"), ("'''", ""), ("''", ""), ("&nbsp;", " "))
_PARAM = rf"([A-Za-z0-9_ ]+)[{WS}]*=[{WS}]*"


def _until(text: Column, marks: str, stop, keep_last: bool) -> Column:
    """``text`` up to the mark where ``stop(depth_after, mark, depth_before)`` holds first; null if it never does."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, mark: Column) -> Column:
        depth = acc["depth"] + F.when(mark == "{{", 1).when(mark == "}}", -1).otherwise(0)
        hit = stop(depth, mark, acc["depth"])
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), hit.alias("done")))

    def taken(found: Column, between: Column, n: Column) -> Column:
        pieces = F.array_join(F.zip_with(F.slice(between, 1, n), F.slice(found, 1, n), lambda g, m: F.concat(g, m)), "")
        return pieces if keep_last else F.substring(pieces, F.lit(1), F.length(pieces) - F.length(F.element_at(found, n)))

    parts = F.struct(F.regexp_extract_all(text, F.lit(f"({marks})"), 1).alias("found"), F.split(text, marks, -1).alias("between"))
    return let(parts, lambda p: let(F.aggregate(p["found"], start, step), lambda s: F.when(s["done"], taken(p["found"], p["between"], s["n"]))))


def infobox(text: Column, prefixes: tuple[str, ...] = INFOBOXES) -> Column:
    """The first balanced infobox, trying the kinds in order; null if none is balanced."""
    balanced = lambda rest: _until(rest, r"\{\{|\}\}", lambda depth, mark, _: (mark == "}}") & (depth == 0), True)
    return F.coalesce(*(F.when(F.contains(text, F.lit(p)), let(F.substring(text, F.instr(text, p), F.length(text)), balanced)) for p in prefixes))


def strip_markup(c: Column) -> Column:
    """Links shown by their text; emphasis, templates, references and tags removed; space squeezed."""
    for pattern, to in _PLAIN:
        c = F.regexp_replace(c, pattern, to)
    return squeeze(c)


def weight_class(raw: Column) -> Column:
    """The first class of the list found between blanks; else the first two words; nothing for a bare weight."""
    inner = F.regexp_replace(F.regexp_replace(raw, rf"^\{{\{{plainlist[{WS}]*\|?", ""), r"\}\}\z", "")
    items = F.filter(F.transform(F.split(inner, r"\*"), trim_ws), lambda x: x != "")
    c = F.when(F.contains(raw, F.lit("{{plainlist")), F.coalesce(F.get(items, F.lit(0)), F.lit(""))).otherwise(raw)
    for pattern, to in _PLAIN_CLASS:
        c = F.regexp_replace(c, pattern, to)
    return let(squeeze(c), _listed_class)


def _listed_class(c: Column) -> Column:
    def search(plain: Column) -> Column:
        found = F.lit(None).cast("string")
        for name in reversed(WEIGHT_CLASSES):
            at = F.instr(plain, name.lower())
            edges = ((at == 1) | (F.substring(plain, at - 1, F.lit(1)) == " ")) & (F.substring(plain, at + len(name), F.lit(1)).isin("", " "))
            found = F.when((at > 0) & edges, name).otherwise(found)
        return found

    amount = c.rlike(rf"(?i)^\d+(\.\d+)?[{WS}]*(kg|lbs?)[{WS}]") | c.rlike(rf"(?i)^\d+(\.\d+)?[{WS}]*(kg|lbs?)\.?[{WS}]*\z")
    found = let(F.regexp_replace(F.lower(c), "[-–]", " "), search)
    return F.coalesce(found, F.when(amount, "").otherwise(F.array_join(F.slice(F.split(c, " "), 1, 2), " ")))


def line_params(line: Column) -> Column:
    """``ARRAY<STRUCT<key, value>>`` of every ``name = value`` of a line, empty values included.

    A value ends at a bar outside braces that another name follows; a name
    inside a value counts as a parameter too.
    """
    def ended(tail: Column) -> Column:
        cut = _until(tail, r"\{\{|\}\}|\|(?=[A-Za-z0-9_ ]+=)", lambda _, mark, before: (mark == "|") & (before == 0), False)
        return let(trim_ws(F.coalesce(cut, tail)), unbarred)

    def unbarred(value: Column) -> Column:
        bar = value.endswith("|") & ~F.contains(value, F.lit("{{"))
        return F.when(bar, trim_ws(F.regexp_replace(value, r"\|\z", ""))).otherwise(value)

    def all_params(p: Column) -> Column:
        def param(key: Column, i: Column) -> Column:
            rest = F.zip_with(F.slice(p["gaps"], i + 2, F.size(p["gaps"])), F.slice(p["whole"], i + 2, F.size(p["gaps"])), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
            return F.struct(F.replace(F.lower(F.trim(key)), F.lit(" "), F.lit("_")).alias("key"), let(F.array_join(rest, ""), ended).alias("value"))

        return F.transform(p["keys"], param)

    def parts(rest: Column) -> Column:
        return F.struct(
            F.regexp_extract_all(rest, F.lit(f"({_PARAM})"), 1).alias("whole"), F.regexp_extract_all(rest, F.lit(_PARAM), 1).alias("keys"), F.split(rest, _PARAM, -1).alias("gaps")
        )

    return let(parts(F.regexp_replace(line, r"^\|", "")), all_params)


def image_url(raw: Column) -> Column:
    """Address of an image named in markup; empty for what is no portrait."""
    linked = F.regexp_extract(raw, r"(?i)\[\[(?:File|Image):([^\]|]+)", 1)
    bare = trim_ws(F.regexp_replace(F.regexp_replace(raw, r"(?i)^(?:File|Image):", ""), r"\|.*", ""))
    name = F.when(raw.rlike(r"(?i)\[\[(?:File|Image):[^\]|]"), linked).otherwise(bare)
    return let(name, _portrait)


def _portrait(name: Column) -> Column:
    cut = F.regexp_extract(name, rf"(?i)(.+\.(?:{IMAGE}))", 1)
    return let(F.when(cut != "", cut).otherwise(name), _address)


def _address(name: Column) -> Column:
    bad = (
        name.startswith("<!--") | F.contains(name, F.lit("Insert image")) | F.contains(name, F.lit("only free-content"))
        | ~name.rlike(rf"(?i)\.(?:{IMAGE})\z") | name.rlike(NO_PORTRAIT)
    )
    url = F.concat(F.lit(IMAGE_BASE), encode_component(F.replace(name, F.lit(" "), F.lit("_"))))
    return F.when(F.coalesce(bad, F.lit(True)), "").otherwise(url)


def quality_wins(text: Column) -> Column:
    """Rows of the record table that say "Win" and link their third cell."""
    head = rf"(?i)={{2,}}[{WS}]*(?:Professional[{WS}]+)?(?:Mixed martial arts[{WS}]+)?record[{WS}]*={{2,}}"
    section = F.get(F.split(F.get(F.split(text, head, 2), F.lit(1)), rf"\n={{2,}}[{WS}]*[A-Z]", 2), F.lit(0))

    def counts(row: Column) -> Column:
        cells = F.filter(F.transform(F.split(row, r"\n\|"), trim_ws), lambda c: c != "")
        third = F.coalesce(F.get(cells, F.lit(2)), F.lit(""))
        return row.rlike(r"(?i)(?<![A-Za-z0-9_])Win(?![A-Za-z0-9_])") & third.rlike(r"\[\[.+?\]\]")

    return F.coalesce(F.size(F.filter(F.split(section, r"\n\|-"), counts)), F.lit(0)).cast("long")


def leading_int(value: Column) -> Column:
    """The integer a text begins with, null if none or beyond 64 bits."""
    return F.nullif(F.regexp_extract(value, rf"^[{WS}]*([+-]?\d+)", 1), F.lit("")).try_cast("long")


def _weight_param(lines: Column) -> Column:
    """The raw weight parameter: ``weight_class`` replaces ``weight``, an open template runs on over lines."""
    opens = lambda c: F.regexp_count(c, F.lit(r"\{\{"))
    closes = lambda c: F.regexp_count(c, F.lit(r"\}\}"))
    state = lambda raw, depth, open_, text, fresh: F.struct(
        raw.alias("raw"), depth.cast("int").alias("depth"), open_.alias("open"), text.alias("text"), fresh.alias("fresh")
    )

    def one(acc: Column, p: Column) -> Column:
        v = p["value"]
        raw = F.when((p["key"] == "weight_class") | (acc["raw"] == ""), v).otherwise(acc["raw"])
        braces = F.contains(v, F.lit("{{")) | F.contains(v, F.lit("}}"))

        def noted(depth: Column) -> Column:
            begins = braces & (depth > 0)
            return state(raw, depth, acc["open"] | begins, F.when(begins, v).otherwise(acc["text"]), acc["fresh"] | begins)

        return let(F.when(braces, opens(v) - closes(v)).otherwise(acc["depth"]), noted)

    def run_on(acc: Column, l: Column) -> Column:
        def after(depth: Column) -> Column:
            text = F.concat(acc["text"], F.lit("\n"), l["line"])
            ends = depth <= 0
            return state(F.when(ends, text).otherwise(acc["raw"]), F.when(ends, 0).otherwise(depth), ~ends, text, F.lit(False))

        runs = (acc["depth"] > 0) & acc["open"] & ~acc["fresh"]
        kept = state(acc["raw"], acc["depth"], acc["open"], acc["text"], F.lit(False))
        return F.when(runs, let(acc["depth"] + opens(l["line"]) - closes(l["line"]), after)).otherwise(kept)

    def line(acc: Column, l: Column) -> Column:
        named = F.filter(l["params"], lambda p: p["key"].isin("weight", "weight_class"))
        return let(F.aggregate(named, state(acc["raw"], acc["depth"], acc["open"], acc["text"], F.lit(False)), one), lambda a: run_on(a, l))

    none = F.lit("")
    return F.aggregate(lines, state(none, F.lit(0), F.lit(False), none, F.lit(False)), line, lambda acc: acc["raw"])


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that the optimizer can neither copy into its uses nor into a filter moved below it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def parse_records(pages: DataFrame, text: str) -> DataFrame:
    """``pages`` with the fields read from their infobox and record table.

    Adds total, wins, kos, losses, draws, nationality, weightClass, imageUrl,
    birthDate and qualityWins. Wins and losses are the sums of their kinds and
    null where no such parameter occurs. A narrow projection in three steps.

    Defined cases: a null text, or one without a balanced infobox, gives null
    counts and empty strings; a later number replaces an earlier one, the first
    nationality stays; other columns pass through.
    """
    lines = F.transform(F.split(F.col("__box"), "\n"), lambda l: F.struct(l.alias("line"), line_params(l).alias("params")))
    none = F.expr("cast(array() as array<struct<line string, params array<struct<key string, value string>>>>)")
    df = _once(_once(pages, "__box", infobox(F.col(text))), "__lines", F.coalesce(lines, none))
    params = F.transform(
        F.filter(F.flatten(F.transform("__lines", lambda l: l["params"])), lambda p: (p["key"] != "") & ~p["key"].isin("weight", "weight_class")),
        lambda p: F.struct(p["key"].alias("key"), strip_markup(p["value"]).alias("value")),
    )
    df = _once(df, "__params", params)
    df = _once(df, "__nums", F.filter(F.transform("__params", lambda p: F.struct(p["key"].alias("key"), leading_int(p["value"]).alias("n"))), lambda p: p["n"].isNotNull()))

    def last(*keys: str) -> Column:
        return F.get(F.reverse(F.filter("__nums", lambda p: p["key"].isin(*keys))), F.lit(0))["n"]

    def seen(*keys: str) -> Column:
        return F.exists("__params", lambda p: p["key"].isin(*keys))

    def total(*keys: str) -> Column:
        out = F.lit(0).cast("long")
        for k in keys:
            out = out + F.coalesce(last(k), F.lit(0))
        return out

    won = seen("mma_kowin", "mma_subwin", "mma_decwin", "ko", "win_by_ko")
    lost = seen("mma_koloss", "mma_subloss", "mma_decloss", "mma_dqloss", "mma_draw")

    def per_line(key: str) -> Column:
        """The last non-empty value of a parameter in each line that has one."""
        values = F.transform("__lines", lambda l: F.get(F.reverse(F.filter(l["params"], lambda p: (p["key"] == key) & (p["value"] != ""))), F.lit(0))["value"])
        return values

    first = lambda values: F.coalesce(F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0)), F.lit(""))
    named = first(F.transform(F.filter("__params", lambda p: p["key"] == "nationality"), lambda p: p["value"]))
    born = lambda place: F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.filter(F.transform(F.split(strip_markup(place), ","), trim_ws), lambda x: x != "")), -1), F.lit(""))
    told = first(F.zip_with(per_line("nationality"), per_line("birth_place"), lambda n, b: F.when(n.isNotNull(), strip_markup(n)).otherwise(born(b))))
    shown = first(F.transform(per_line("image"), image_url))
    anywhere = first(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(?i)\[\[(?:File|Image):([^\]|]+)"), 1), image_url))
    df = df.withColumns({
        "wins": F.when(won, total("mma_kowin", "mma_subwin", "mma_decwin")),
        "losses": F.when(lost, total("mma_koloss", "mma_subloss", "mma_decloss", "mma_dqloss")),
        "kos": F.coalesce(F.when(won, total("mma_kowin")), F.lit(0).cast("long")),
        "draws": F.coalesce(last("mma_draw"), F.lit(0)),
        "__nc": F.coalesce(last("no_contests", "nc"), F.lit(0)),
        "__total": last("total", "total_fights"),
        "nationality": F.when(named != "", named).otherwise(told),
        "weightClass": weight_class(_weight_param(F.col("__lines"))),
        "birthDate": first(F.transform(per_line("birth_date"), lambda v: F.regexp_extract(v, r"(\d{4})", 1))),
        "__image": shown,
        "qualityWins": quality_wins(F.col(text)),
    })
    df = df.withColumns({
        "total": F.coalesce("__total", F.col("wins") + F.col("losses") + F.col("draws") + F.col("__nc")),
        "imageUrl": F.when(F.col("__image") != "", F.col("__image")).otherwise(F.coalesce(anywhere, F.lit(""))),
    })
    return df.drop("__box", "__lines", "__params", "__nums", "__nc", "__total", "__image")


def records(pages: DataFrame, text: str) -> DataFrame:
    """``parse_records`` without pages that tell no wins or no losses."""
    return parse_records(pages, text).where(F.col("wins").isNotNull() & F.col("losses").isNotNull())

"""Small text expressions: web-style space, percent encoding, display names, initials, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the web counts it, for use inside a character class.
WS = r"\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    """Without white space of any kind at either end; null stays null."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, the ends are trimmed."""
    return F.trim(F.regexp_replace(c, rf"[{WS}]+", " "))


def encode_component(c: Column) -> Column:
    """Percent-encoded as a URL component: letters, digits and ``-_.!~*'()`` stay."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def page_url(title: Column, base: str = "https://en.wikipedia.org/wiki/") -> Column:
    """The article's address: blanks become underscores, the rest is encoded."""
    return F.concat(F.lit(base), encode_component(F.replace(title, F.lit(" "), F.lit("_"))))


def display_name(name: Column) -> Column:
    """Without a closing "(martial artist)" or "(mixed martial artist)"."""
    return F.regexp_replace(name, rf"[{WS}]*\((?:mixed )?martial artist\)\z", "")


def search_name(name: Column) -> Column:
    """Without any closing parenthesis, as used to look a name up in news."""
    return trim_ws(F.regexp_replace(name, rf"[{WS}]*\([^)]*\)[{WS}]*\z", ""))


def initials(name: Column) -> Column:
    """First letters of at most two words of the display name, upper case."""
    firsts = F.transform(F.split(display_name(name), " "), lambda w: F.substring(w, 1, 1))
    return F.upper(F.substring(F.array_join(firsts, ""), 1, 2))


def ko_percent(kos: Column, wins: Column) -> Column:
    """Knock-outs per hundred wins, rounded half up; 0 without wins."""
    return F.when(wins > 0, F.round(kos / wins * 100, 0).cast("long")).otherwise(F.lit(0).cast("long"))

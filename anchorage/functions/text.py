"""Column helpers shared by the Markdown, HTML and URL expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII alphabet for locale-free lower-casing.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

_GAP = "\uffff"  # not a character, so a text has no use for it

# The named character references of HTML, from Python's own table, as one literal: it is folded to a map once.
_ENTITIES = "\u0002".join(f"&{name}\u0001{char}" for name, char in html5.items() if name.endswith(";"))

_PUNCT = r"[!-/:-@\[-`{-~]"
_ESCAPE_OR_ENTITY = (
    rf"\\{_PUNCT}|&(?:[A-Za-z][A-Za-z0-9]++|#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}});"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Catalyst merges neighbouring projections, so a column used several times inside a lambda
    would be computed again for every use; a lambda variable is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_matches(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` in ``text`` by ``fn(match)``, in time linear in the text.

    The text between the matches is found by a replacement and a split at one character: splitting
    at a pattern would compile the pattern again for every row.
    """

    def rebuild(clean: Column) -> Column:
        gaps = F.split(F.regexp_replace(clean, pattern, _GAP), _GAP, -1)
        matches = F.transform(F.regexp_extract_all(clean, F.lit(pattern), F.lit(0)), fn)
        return F.array_join(
            F.zip_with(gaps, matches, lambda gap, match: F.concat(gap, F.coalesce(match, F.lit("")))), ""
        )

    return let(F.replace(text, F.lit(_GAP), F.lit("\ufffd")), rebuild)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def count_newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def code_point(number: Column) -> Column:
    """The character with the given code point; U+FFFD for zero, surrogates and out-of-range numbers."""
    number = number.cast("int")
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number.cast("bigint")), 8, "0")), "UTF-32")
    return F.when(valid, char).otherwise(F.lit("\ufffd"))


def _unescape_one(match: Column) -> Column:
    value = F.when(match.startswith("\\"), F.substring(match, 2, 1))
    named = F.try_element_at(F.str_to_map(F.lit(_ENTITIES), F.lit("\u0002"), F.lit("\u0001")), match)
    value = value.when(match.rlike("^&[A-Za-z]"), F.coalesce(named, match))
    digits = F.regexp_extract(match, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
    is_hex = match.rlike("^&#[xX]")
    return value.otherwise(
        code_point(F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)))
    )


def unescape(text: Column) -> Column:
    """Resolve backslash escapes, named and numeric entities, left to right."""
    return let(
        text,
        lambda t: F.when(
            t.rlike(r"[\\&]"), map_matches(t, _ESCAPE_OR_ENTITY, _unescape_one)
        ).otherwise(t),
    )


def percent_encode(text: Column, unsafe: str) -> Column:
    """Percent-encode (as UTF-8) the characters of the regex class body ``unsafe``."""
    run = f"[{unsafe}]+"

    def encode(t: Column) -> Column:
        encoded = map_matches(
            t, run, lambda match: F.replace(F.url_encode(match), F.lit("+"), F.lit("%20"))
        )
        return F.when(t.rlike(run), encoded).otherwise(t)

    return let(text, encode)


def percent_decode(text: Column) -> Column:
    """Percent-decode; ``+`` stays, and the result is NULL where the escapes are malformed."""
    return F.when(
        text.contains("%") & ~text.rlike("%(?![0-9a-fA-F]{2})"),
        F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))),
    )

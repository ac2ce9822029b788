"""Text normalisation as Column expressions.

The order repair -> NFC -> running lines -> page furniture -> whitespace is part
of the contract: content, hash, embedding and tokens all derive from its result.
Every step but NFC is a built-in expression and stays inside code generation.
"""

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from quirework.functions.common import let

# The whitespace set of a Unicode-aware strip, and the same set as
# a regex class that Java (and RE2) read alike. The inline class leaves out \n.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WS_INLINE = r"[\t\x0b-\r\x1c-\x20\x{85}\p{Z}]"
DIGIT = r"\p{Nd}"

# Private-use glyph codes (F7xx) and the Thai marks (0Exx) they stand for.
PUA_TO_THAI = {
    "\uf700": "\u0e4d",
    "\uf701": "\u0e48",
    "\uf702": "\u0e49",
    "\uf703": "\u0e4a",
    "\uf704": "\u0e4b",
    "\uf705": "\u0e47",
    "\uf706": "\u0e49",
    "\uf708": "\u0e4b",
    "\uf70a": "\u0e48",
    "\uf70b": "\u0e49",
    "\uf70e": "\u0e4c",
    "\uf710": "\u0e34",
    "\uf711": "\u0e35",
    "\uf712": "\u0e36",
    "\uf713": "\u0e37",
    "\uf714": "\u0e31",
    "\uf718": "\u0e38",
    "\uf719": "\u0e39",
    "\uf71a": "\u0e3a",
}
THAI_PUA = "[\uf700-\uf71a]"
UNMAPPED_THAI_PUA = (
    "[" + "".join(chr(c) for c in range(0xF700, 0xF71B) if chr(c) not in PUA_TO_THAI) + "]"
)
ANY_PUA = "[\ue000-\uf8ff]"
SYMBOL_PUA = "[\ue000-\uf6ff\uf71b-\uf8ff]"

# Number of edge lines looked at, page-number line, dot leader.
EDGE_LINES = 3
_PAGE_NUMBER = rf"{WS_INLINE}*[-_\[]?{WS_INLINE}*{DIGIT}+{WS_INLINE}*[-_\]]?{WS_INLINE}*"
_DOT_LEADER = rf"{WS_INLINE}*\.{{3,}}{WS_INLINE}*{DIGIT}*{WS_INLINE}*(\n|\z)"
# a run of blanks, or a tab; a single space is one already
_BLANK_RUN = r"[ \t](?:[ \t]+|(?<=\t))"
_LEADING_PAGE_NUMBER = rf"\A(?:((?:{WS}*\n)?){_PAGE_NUMBER}\n|(?:({WS}*)\n)?{_PAGE_NUMBER}\z)"
_TRAILING_PAGE_NUMBER = rf"\n{_PAGE_NUMBER}((?:\n{WS}*)?)\z"

TOKEN = r"[\p{L}\p{M}\p{N}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def restore_pua(text: Column, strict: bool = False) -> Column:
    """Map private-use tone marks to Thai. Unmapped codes are never dropped:
    they stay in the text, or fail the job when ``strict``."""
    marks = F.translate(text, "".join(PUA_TO_THAI), "".join(PUA_TO_THAI.values()))
    repaired = F.when(text.rlike(THAI_PUA), marks).otherwise(text)
    if not strict:
        return repaired
    message = F.concat(
        F.lit("unmapped private-use codepoints: "),
        F.array_join(codepoint_labels(text, UNMAPPED_THAI_PUA), ", "),
    )
    return F.when(text.rlike(UNMAPPED_THAI_PUA), F.raise_error(message).cast("string")).otherwise(
        repaired
    )


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def to_nfc(text: Column) -> Column:
    """Canonical composition. Text below U+0300 is composed already, so only the
    remaining rows carry their text to the Python worker."""
    needs_work = text.rlike(r"[^\x00-\x{2ff}]")
    return F.coalesce(_nfc(F.when(needs_work, text)), text)


def _where(holds: Callable[[Column], Column], change: Callable[[Column], Column], text: Column) -> Column:
    """``change`` where there is something to change; most texts are only looked through."""
    return let(text, lambda t: F.when(holds(t), change(t)).otherwise(t))


def collapse_whitespace(text: Column) -> Column:
    runs = lambda t: F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t"))
    spaced = _where(runs, lambda t: F.regexp_replace(t, _BLANK_RUN, " "), strip(text))
    gaps = lambda t: F.contains(t, F.lit("\n\n\n"))
    limited = _where(gaps, lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"), spaced)
    trailing = lambda t: t.rlike(rf"\n(?<={WS_INLINE}\n)")
    return _where(trailing, lambda t: F.regexp_replace(t, rf"{WS_INLINE}+\n", "\n"), limited)


def flatten_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+", " ")


def running_key(line: Column) -> Column:
    """Key of a header or footer line: digit runs masked, whitespace collapsed."""
    return collapse_whitespace(F.regexp_replace(line, rf"{DIGIT}+", "#"))


def edge_lines(text: Column) -> Column:
    """First and last three non-blank lines of a page."""
    return let(
        F.filter(split_lines(text), lambda line: ~is_blank(line)),
        lambda filled: F.concat(
            F.slice(filled, 1, EDGE_LINES),
            F.slice(filled, F.greatest(F.size(filled) - (EDGE_LINES - 1), F.lit(1)), EDGE_LINES),
        ),
    )


def edge_keys(text: Column) -> Column:
    """Distinct keys of the edge lines; on a short page the first lines are the last ones, too, and get one key."""
    return F.array_distinct(F.transform(F.array_distinct(edge_lines(text)), running_key))


def strip_running_lines(text: Column, keys: Column) -> Column:
    """Drop edge lines whose key is in ``keys``; the same line mid-page stays."""

    def cut(lines: Column) -> Column:
        def running(edges: Column) -> Column:
            """Edges with a key in ``keys``; only lines that begin as one of them does are keyed."""
            first = lambda i: F.substring(F.ltrim(F.get(lines, i), F.lit(WHITESPACE)), 1, 1)
            begins = lambda heads, i: F.array_contains(heads, "#") | F.array_contains(heads, first(i))
            return let(
                F.transform(keys, lambda k: F.substring(k, 1, 1)),
                lambda heads: F.filter(
                    edges, lambda i: begins(heads, i) & F.array_contains(keys, running_key(F.get(lines, i)))
                ),
            )

        filled = F.filter(
            F.transform(lines, lambda line, i: F.when(~is_blank(line), i)),
            lambda i: i.isNotNull(),
        )

        def without(positions: Column) -> Column:
            n = F.size(positions)
            edges = F.concat(
                F.slice(positions, 1, EDGE_LINES),
                F.slice(positions, F.greatest(n - (EDGE_LINES - 1), F.lit(EDGE_LINES + 1)), EDGE_LINES),
            )
            return let(
                running(edges),
                lambda drop: F.array_join(
                    F.filter(lines, lambda _, i: ~F.array_contains(drop, i)), "\n"
                ),
            )

        return let(filled, without)

    return F.when(F.coalesce(F.size(keys), F.lit(0)) <= 0, text).otherwise(
        let(split_lines(text), cut)
    )


def strip_page_furniture(text: Column) -> Column:
    """Drop dot leaders on every line and a page number on the outermost lines.
    A page that holds nothing else comes back unchanged."""
    leaders = lambda t: F.contains(t, F.lit("..."))

    def without_leaders(t: Column) -> Column:
        """No leader begins before the blanks in front of the first three dots."""
        before = F.rtrim(F.substring_index(t, "...", 1), F.lit(WHITESPACE.replace("\n", "")))
        return let(before, lambda b: F.concat(b, F.regexp_replace(F.substring(t, F.length(b) + 1, F.length(t)), _DOT_LEADER, "$1")))

    trimmed = _where(leaders, without_leaders, text)

    def outer(t: Column) -> Column:
        no_footer = F.regexp_replace(t, _TRAILING_PAGE_NUMBER, "$1")
        return F.when(~is_blank(t), F.regexp_replace(no_footer, _LEADING_PAGE_NUMBER, "$1$2"))

    return F.coalesce(let(trimmed, outer), text)


def normalize_page(text: Column, running_keys: Column, strict: bool = False) -> Column:
    composed = to_nfc(restore_pua(text, strict))
    return collapse_whitespace(strip_page_furniture(strip_running_lines(composed, running_keys)))


def normalize_fragment(text: Column, strict: bool = False) -> Column:
    """Tables and questions: the steps that are not about page edges."""
    return collapse_whitespace(to_nfc(restore_pua(text, strict)))


normalize_table = normalize_fragment
normalize_query = normalize_fragment


def tokenize(text: Column) -> Column:
    """Lowercased word tokens in order; the same call on both sides of a search."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def codepoint_label(char: Column) -> Column:
    return F.format_string("U+%04X", F.ascii(char))


def codepoint_labels(text: Column, char_class: str) -> Column:
    """Sorted distinct ``U+XXXX`` labels of the characters in a class."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(char_class), F.lit(0)))
    return F.array_sort(F.transform(found, codepoint_label))


def listed_characters(char_class: str) -> str | None:
    """The characters of a class made of single characters and ranges; None for any other pattern."""
    if not re.fullmatch(r"\[[^\\\[\]^&]+\]", char_class) or "-" in (char_class[1], char_class[-2]):
        return None
    found = []
    for low, high in re.findall(r"(.)(?:-(.))?", char_class[1:-1], re.DOTALL):
        found.extend(map(chr, range(ord(low), ord(high or low) + 1)))
    return "".join(found)


def count_characters(text: Column, char_class: str) -> Column:
    """Characters of a class that most of a text may belong to: taken out and missed, not matched one by one."""
    listed = listed_characters(char_class)
    if listed is None:
        return F.regexp_count(text, F.lit(char_class))
    return F.length(text) - F.length(F.translate(text, listed, ""))


def script_majority(text: Column, first: str = "[\u0e00-\u0e7f]", second: str = "[A-Za-z]") -> Column:
    """True when characters of class ``first`` outnumber those of ``second``."""
    return F.regexp_count(text, F.lit(first)) > F.regexp_count(text, F.lit(second))


def parse_scopes(values: Column) -> Column:
    """Repeated and/or comma-separated values to an ordered distinct list."""
    parts = F.flatten(F.transform(values, lambda v: F.split(v, ",", -1)))
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda p: p != ""))


def unknown_scopes(scopes: Column, allowed: list[str]) -> Column:
    return F.array_sort(F.array_except(scopes, F.array(*[F.lit(a) for a in allowed])))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)

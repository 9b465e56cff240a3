"""Text expressions over whole texts: lines, numbering, counting, cleaning."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Line separators of universal-newline splitting.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Characters that count as white space.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Word characters: letters, numbers, underscore (any script); the common ones are tried first.
WORD = r"[A-Za-z0-9_\p{L}\p{N}]"
# A whole word in front of '('; tried only where a word starts.
CALL = rf"(?<!{WORD})({WORD}++)\s*+\("

# Decision keywords counted for complexity.
DECISION_KEYWORDS = ["if", "elif", "for", "while", "except", "with", "and", "or"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines of ``text``; no entry after a trailing break, none for ''."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def numbered_line(number: Column, line: Column) -> Column:
    """``'   7: text'``: the number right-aligned to four places or wider."""
    digits = number.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit(" ")), F.lit(": "), line)


def number_lines(text: Column) -> Column:
    """The text with every line prefixed by its 1-based number."""
    return F.array_join(F.transform(split_lines(text), lambda line, i: numbered_line(i + 1, line)), "\n")


def called_names(body: Column, own: Column, limit: int | None = None) -> Column:
    """Distinct names followed by '(' in order of appearance, own name left out; the first ``limit`` if given."""
    names = F.array_distinct(F.filter(F.regexp_extract_all(body, F.lit(CALL), F.lit(1)), lambda n: n != own))
    return names if limit is None else F.slice(names, 1, limit)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    removed = F.replace(text, F.lit(part), F.lit(""))
    return F.floor((F.length(text) - F.length(removed)) / F.lit(len(part))).cast("int")


def complexity(text: Column, keywords: list[str] = DECISION_KEYWORDS) -> Column:
    """1 + the number of decision keywords standing between blanks or at a line start.

    Keywords of one word are counted in one pass.  Of equal ones in a row every second shares its blank with the one before,
    so it is no occurrence of its own unless that stands at a line start.
    """
    total = F.lit(1)
    words = [keyword for keyword in keywords if not re.search("[ \n]", keyword)]
    if words:
        one = "|".join(re.escape(word) for word in words)
        total = total + F.regexp_count(text, F.lit(rf"(?=[ \n])(?: ({one})(?= )(?: \1(?= ))?|\n(?:{one})(?= ))"))
    for keyword in keywords:
        if keyword not in words:
            total = total + occurrences(text, f" {keyword} ") + occurrences(text, f"\n{keyword} ")
    return total


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any literal term occurs (NULL text counts as no)."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return F.coalesce(found, F.lit(False))


def shorten(text: Column, limit: int, keep: int | None = None) -> Column:
    """``text`` when it has at most ``limit`` characters, else its head and '...'."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep or limit), F.lit("..."))).otherwise(text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*>", "")


def squeeze(text: Column) -> Column:
    """Whitespace runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def squeeze_ends(text: Column) -> Column:
    """No white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescape_all(texts: pd.Series) -> pd.Series:
    """Named and numeric character references to characters, in every text of an array (Arrow batches)."""
    return texts.map(lambda parts: [html.unescape(p) for p in parts], na_action="ignore")


# What ``html.unescape`` takes for a character reference.
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"


def decode_references(text: Column) -> Column:
    """Character references to characters; only the references go to Python, so its memory does not grow with the texts."""
    found = unescape_all(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    # one more piece than references; a text without any is one piece
    joined = F.zip_with(F.split(text, REFERENCE, -1), found, lambda piece, said: F.concat(piece, F.coalesce(said, F.lit(""))))
    return F.array_join(joined, "")


def clean_markup(text: Column) -> Column:
    """Tags out, then references decoded, then whitespace collapsed; NULL gives ''."""
    return squeeze(decode_references(strip_tags(F.coalesce(text, F.lit("")))))


def word_count(text: Column) -> Column:
    squeezed = squeeze(text)
    return F.when(squeezed == "", 0).otherwise(F.size(F.split(squeezed, " ")))


def title_case(text: Column) -> Column:
    """First letter of every run of letters upper-case, the rest lower-case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


def estimate_tokens(text: Column) -> Column:
    """One token per six characters, at least one; none for empty or missing text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(
        F.greatest(F.lit(1), F.floor(F.length(text) / 6).cast("int"))
    )

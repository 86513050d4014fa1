"""Text as columns: normal forms, joining of words, quotes, cleaning of drafts, numbers in words.

Null in, null out, unless stated otherwise. Patterns carry the flag (?U), so letters of all scripts are letters.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm(text: Column) -> Column:
    """Lower case with straight apostrophes; punctuation kept (PRJ1)."""
    return F.translate(F.lower(text), "’", "'")


def quote_norm(text: Column) -> Column:
    """Letters, digits and apostrophes only, single spaces (PRJ2)."""
    return F.trim(F.regexp_replace(norm(text), r"(?U)[^\w']+", " "))


def lookup_form(word: Column) -> Column:
    """A token as it is counted: norm without hyphens in front (PRJ3)."""
    return F.regexp_replace(norm(word), "^-+", "")


def is_word(token: Column) -> Column:
    return token.rlike(r"\p{L}")


def ends_with(text: Column) -> Column:
    """The last character if it is ?, ! or a full stop, else "" (PRJ4)."""
    last = F.right(text, F.lit(1))
    return F.when(last.isin("?", "!", "."), last).otherwise(F.lit(""))


def whitespace_words(text: Column) -> Column:
    """The number of words between white space (notion 1)."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def space_marks(text: Column, french: Column) -> Column:
    """Spacing around apostrophes, hyphens and marks, for words joined by spaces (SEG2)."""
    t = F.regexp_replace(text, r"(?U)\s+(?=['’-])|(?<=['’])\s+", "")
    t = F.regexp_replace(t, r"(?U)\s+([,.;:…])", "$1")
    t = F.when(french, F.regexp_replace(t, r"(?U)\s*([?!])", " $1")).otherwise(F.regexp_replace(t, r"(?U)\s+([?!])", "$1"))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def join_tokens(tokens: Column) -> Column:
    """Tokens as text: none after an elision, none before a clitic (FN2)."""
    return F.regexp_replace(F.array_join(tokens, " "), r"(?U)(?<=['’]) | (?=['’]\w|n't\b)", "")


def quote_in(quote: Column, passage: Column) -> Column:
    """Whether the parts of a quote, split at elisions, stand in the passage in order (FN3). An empty quote does not."""
    parts = F.filter(F.transform(F.split(quote, r"\[\.\.\.\]|\.\.\.|…"), quote_norm), lambda p: p != "")
    hay = quote_norm(passage)

    def step(at: Column, part: Column) -> Column:
        hit = _locate_at(hay, part, at)
        return F.when((at == 0) | (hit == 0), F.lit(0)).otherwise(hit + F.length(part))

    return (F.size(parts) > 0) & (F.aggregate(parts, F.lit(1), step) > 0)


def _locate_at(text: Column, part: Column, at: Column) -> Column:
    rest = F.instr(F.substring(text, at, F.length(text)), part)
    return F.when(rest == 0, F.lit(0)).otherwise(rest + at - 1)


def clean_draft(text: Column) -> Column:
    """A model's answer without headings, bold lines, bullets, stage directions and outer quotes (FN5)."""
    t = F.regexp_replace(text, r"(?m)^\s*(?:#+ .*|\*\*.*\*\*|[-*] )", "")
    t = F.regexp_replace(t, r"(?m)^\s*[\[(].*?[\])]\s*$", "")
    t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, "^[«»\"“”]+|[«»\"“”]+$", "")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def without_thinking(text: Column) -> Column:
    """Without a model's <think> parts (FN15)."""
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def slug(text: str | None, longest: int = 60, empty: str = "recording") -> str:
    plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")[:longest].rstrip("-") or empty


@F.pandas_udf(T.StringType())
def slugify(texts: pd.Series) -> pd.Series:
    """File name of a title: ASCII letters and digits with hyphens, at most 60 characters (FN1). Null gives the default."""
    return pd.Series([slug(t if isinstance(t, str) else None) for t in texts], dtype=object)


def per_1k(count: Column, words: Column) -> Column:
    """Occurrences in a thousand words; 0 where there are none (AGG1)."""
    return F.when(words > 0, F.round(F.lit(1000.0) * count / words, 2)).otherwise(F.lit(0.0))


def every(rate: Column) -> Column:
    """A rate in words (FN8)."""
    words = F.lit(1000.0) / rate
    return (
        F.when(rate <= 0, F.lit("never"))
        .when(words < 150, F.concat(F.lit("about once every "), F.bround(words / 10, 0).cast("int") * 10, F.lit(" words")))
        .when(words < 600, F.concat(F.lit("about once every "), F.bround(words / 100, 0).cast("int") * 100, F.lit(" words")))
        .otherwise(F.lit("occasionally"))
    )


def share_words(share: Column) -> Column:
    """A share in words (FN9)."""
    return (
        F.when(share < 0.15, "rarely").when(share < 0.35, "about a third of the time").when(share < 0.6, "about half the time")
        .when(share < 0.85, "most of the time").otherwise("almost always")
    )


def percent(share: Column) -> Column:
    """To the nearest five per cent; "a few" for null (FN10)."""
    return F.when(share.isNull(), F.lit("a few")).otherwise(F.concat((F.bround(share * 20, 0) * 5).cast("int"), F.lit("%")))


def guillemets(text: Column) -> Column:
    return F.concat(F.lit("« "), text, F.lit(" »"))


def ratio(rate: Column, base: Column) -> Column:
    """A rate against its baseline (FN12)."""
    r = rate / base
    return (
        F.when(base.isNull() | (base == 0), F.lit("–")).when(rate == 0, F.lit("never"))
        .when(r >= 1, F.concat(F.lit("×"), F.format_number(r, 1))).otherwise(F.concat(F.lit("÷"), F.format_number(F.lit(1.0) / r, 1)))
    )


def clock(seconds: Column) -> Column:
    """H:MM:SS (FN13)."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)

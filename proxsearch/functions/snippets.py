"""Snippets around matches, as column expressions over (text, match)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 100


def _end(p: Column) -> Column:
    return p["char_start"] + p["char_len"]


def snippet(text: Column, match: Column, window: int = WINDOW, cleanup: bool = True) -> Column:
    """Raw text from ``window`` characters before the match to ``window`` after it, its words marked.

    ``match`` is an array of postings that don't overlap, in order. cleanup removes other tags, and the
    halves of tags cut at either end (so also all before a first ">" without "<"), and trims.
    """
    start = F.greatest(F.array_min(F.transform(match, lambda p: p["char_start"])) - window, F.lit(0))
    end = F.least(F.array_max(F.transform(match, _end)) + window, F.length(text))
    cut = F.substring(text, start + 1, end - start)

    def mark(s: Column, p: Column) -> Column:
        a = F.least(p["char_start"] - start, F.length(s))
        n = F.least(p["char_len"], F.length(s) - a)
        return F.concat(F.substring(s, F.lit(1), a), F.lit("<mark>"), F.substring(s, a + 1, n), F.lit("</mark>"), F.substring(s, a + n + 1, F.length(s)))

    marked = F.aggregate(F.reverse(match), cut, mark)
    return clean(marked) if cleanup else marked


def clean(s: Column) -> Column:
    s = F.regexp_replace(s, r"<(?!/?mark>)[^>]*>|^[^<]*?>|<(?!/?mark>)[^>]*$", "")
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def snippets(text: Column, matches: Column, window: int = WINDOW, cleanup: bool = True) -> Column:
    """One snippet per match; none for a null text."""
    made = F.when(text.isNotNull(), F.transform(matches, lambda m: snippet(text, m, window, cleanup)))
    return F.coalesce(made, F.array().cast("array<string>"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)

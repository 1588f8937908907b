"""Helpers shared by the operators: scratch tables of the library, and columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomshed.scratch import drop_path, free, scratch, settings, shuffles_dropped, stored

__all__ = ["WORD", "ascii_lower", "drop_path", "free", "scratch", "settings", "shuffles_dropped", "stored", "word_count"]

#: ASCII white space; words are maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else touched."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")

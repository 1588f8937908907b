"""Keys, names and display strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip_of(path: Column) -> Column:
    """Parent folder of a relative path, '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem_of(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def frame_number(stem: Column) -> Column:
    """Last field after ``_`` if all digits and within 64 unsigned bits, else null."""
    number = F.try_to_number(
        F.nullif(F.regexp_extract(stem, r"(?:^|_)([0-9]+)$", 1), F.lit("")), F.lit("9" * 38)
    ).cast("decimal(38,0)")
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(38,0)"), number.cast("decimal(20,0)"))


def display_key(clip: Column, stem: Column) -> Column:
    return F.when(clip == "", stem).otherwise(F.concat(clip, F.lit("/"), stem))


def ratio(n: Column, d: Column) -> Column:
    """n/d, 0.0 where d is 0."""
    return F.when(d > 0, n.cast("double") / F.nullif(d, F.lit(0)).cast("double")).otherwise(F.lit(0.0))


def space_estimate(total: Column, bound: float, margin: float) -> Column:
    """Bytes to expect of an output, rounded up."""
    return F.ceil(total.cast("double") / bound * margin)


def eta_minutes(frames: Column, ms: float) -> Column:
    return frames.cast("double") * ms / 60000.0


def bit_length(delta: Column) -> Column:
    """Bits of a positive whole number; 0 for 0."""
    return F.when(delta > 0, F.length(F.bin(delta.cast("long")))).otherwise(0)


def glob_match(pattern: str, name: Column) -> Column:
    """A pattern with one ``*`` at its start or end, or none."""
    if pattern.startswith("*"):
        return name.endswith(pattern[1:])
    if pattern.endswith("*"):
        return name.startswith(pattern[:-1])
    return name == pattern


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether any part of a path matches any pattern, so whole subtrees go."""
    hit = F.lit(False)
    parts = F.split(path, "/")
    for p in patterns:
        hit = hit | F.exists(parts, _matcher(p))
    return hit


def _matcher(pattern: str):
    return lambda part: glob_match(pattern, part)


def is_path_prefix(a: Column, b: Column) -> Column:
    """Whether a is b or a folder above it, by whole parts."""
    return (a == b) | b.startswith(F.concat(a, F.lit("/")))


def path_order(path: Column) -> Column:
    """Sort key that compares paths part by part."""
    return F.split(path, "/")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), r"\s+", "-")


def default_sample(n: Column) -> Column:
    """min(n, min(60, max(20, ceil(n/10))))."""
    return F.least(n, F.least(F.lit(60), F.greatest(F.lit(20), F.expr("1") * F.floor((n + 9) / 10)))).cast("long")


def csv_field(x: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line end."""
    return F.when(x.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def minutes_seconds(ms: Column) -> Column:
    """mm:ss of rounded seconds; 'n/a' for null."""
    s = F.round(ms / 1000.0).cast("long")
    return F.coalesce(F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60))), F.lit("n/a"))


def set_display(values: Column) -> Column:
    """{a, b} of an array, sorted."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_distinct(values)), ", "), F.lit("}"))


def selection_text(values: Column) -> Column:
    """A selection as a sorted list between commas; '' for none."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")


def codec_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("+", a, b)


def utc_text(seconds: Column) -> Column:
    """Unix seconds as text, in the session's zone, which is UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def civil_date(days: Column) -> Column:
    """The date so many days after the beginning of 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def fatal_in(mode: Column, modes: tuple[str, ...]) -> Column:
    """Whether a gate's failure ends a run of this mode."""
    return mode.isin(*modes)

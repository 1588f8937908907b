"""Whole sets of name patterns: suffixes (``*x``), prefixes (``x*``) and exact names, all tried at once.

A set within ``MOST_BYTES`` of a worker's memory becomes sets of prefixes and suffixes by their lengths, with
the exact names beside them; it is broadcast once, and a name costs a look for each length however many
patterns there are. A larger set is a table, and is joined with the beginnings and ends of a name that have
a pattern's length. Both give the same rows.

Defined results: a null path is ignored by no pattern; an empty segment is a name like others; ``*`` alone
fits every name; in a pattern with a mark at both ends the last one is an ordinary character; null patterns
are left out; without patterns nothing is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Bytes of a worker's memory that the patterns which are broadcast take, at most, and those of a pattern beside its text.
MOST_BYTES, EACH = 64 << 20, 110
#: Names whose verdict a worker remembers.
KNOWN = 100_000


@dataclass
class Patterns:
    """Prefixes and suffixes as sets by their length, and exact names."""

    prefixes: dict[int, set[str]] = field(default_factory=dict)
    suffixes: dict[int, set[str]] = field(default_factory=dict)
    names: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, patterns: list[str]) -> "Patterns":
        found = cls()
        for p in patterns:
            if p.startswith("*"):
                found.suffixes.setdefault(len(p) - 1, set()).add(p[1:])
            elif p.endswith("*"):
                found.prefixes.setdefault(len(p) - 1, set()).add(p[:-1])
            else:
                found.names.add(p)
        return found

    def match(self, name: str) -> bool:
        """Whether a pattern fits the name."""
        size = len(name)
        return (
            name in self.names
            or any(n <= size and name[:n] in held for n, held in self.prefixes.items())
            or any(n <= size and name[size - n :] in held for n, held in self.suffixes.items())
        )


def ignored(rows: DataFrame, path: str, patterns: DataFrame) -> DataFrame:
    """The rows with ``ignored``: whether a segment of a path fits one of (pattern); a folder that fits takes all below it along."""
    patterns = patterns.select(F.col("pattern").cast("string").alias("pattern")).filter("pattern is not null").distinct()
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern") + EACH), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        return _joined(rows, path, patterns)
    held = rows.sparkSession.sparkContext.broadcast(Patterns.of([r["pattern"] for r in patterns.collect()]))

    @F.pandas_udf("boolean")
    def fits(paths: pd.Series) -> pd.Series:
        match, known = held.value.match, {}

        def one(p) -> bool:
            if p is None:
                return False
            for name in p.split("/"):
                if name not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[name] = match(name)
                if known[name]:
                    return True
            return False

        return pd.Series([one(p) for p in paths], dtype=bool)

    return rows.withColumn("ignored", fits(path))


def _joined(rows: DataFrame, path: str, patterns: DataFrame) -> DataFrame:
    """By a join: every segment, and its beginnings and ends of the patterns' lengths, against the patterns that there are."""
    end = F.startswith("pattern", F.lit("*"))
    begin, n = ~end & F.endswith("pattern", F.lit("*")), F.length("pattern") - 1
    lengths = patterns.agg(F.collect_set(F.when(end, n)).alias("_ends"), F.collect_set(F.when(begin, n)).alias("_begins"))
    paths = rows.select(path).filter(F.col(path).isNotNull()).distinct()
    segments = paths.select(path, F.explode(F.array_distinct(F.split(path, "/"))).alias("_s"))

    def forms(held, make):
        return F.transform(F.filter(held, lambda k: k <= F.length("_s")), make)

    ends = forms("_ends", lambda k: F.concat(F.lit("*"), F.right("_s", k)))
    begins = forms("_begins", lambda k: F.concat(F.left("_s", k), F.lit("*")))
    # A pattern that begins with the mark is a suffix's, so of a name that does only its ends are asked for.
    asks = F.when(F.startswith("_s", F.lit("*")), ends).otherwise(F.concat(F.array("_s"), ends, begins))
    asked = segments.select("_s").distinct().crossJoin(F.broadcast(lengths)).select(
        "_s", F.explode(F.array_distinct(asks)).alias("pattern")
    )
    fits = asked.join(patterns, "pattern", "left_semi").select("_s").distinct()
    hit = segments.join(fits, "_s", "left_semi").select(path).distinct().withColumn("ignored", F.lit(True))
    return rows.join(hit, path, "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))

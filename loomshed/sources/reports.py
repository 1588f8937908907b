"""Job reports as rows of text: CSV, Markdown and HTML, rendered by expressions and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomshed.functions.keys import csv_field, html_escape
from loomshed.sources.records import FILE_ROWS

# The report's columns.
COLUMNS = ("clip", "file", "size_bytes", "source_sha256", "dest_sha256", "verdict", "skipped", "copied_ms")


def _cells(extra: tuple[str, ...] = ()) -> list[Column]:
    return [
        F.coalesce((F.col(c).cast("int") if c == "skipped" else F.col(c)).cast("string"), F.lit("")) for c in (*extra, *COLUMNS)
    ]


def csv_lines(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(clip, file, line): one quoted line a row; ``extra`` columns (source, dest) come first."""
    return rows.select("clip", "file", F.concat_ws(",", *[csv_field(c) for c in _cells(extra)]).alias("line"))


def markdown_lines(rows: DataFrame) -> DataFrame:
    """(clip, file, line): one table line a row."""
    file, *rest = _cells()[1:]
    return rows.select(
        "clip", "file", F.concat(F.lit("| `"), file, F.lit("` | "), F.concat_ws(" | ", *rest), F.lit(" |")).alias("line")
    )


def html_lines(rows: DataFrame) -> DataFrame:
    """(clip, file, line): one escaped table row a row."""
    cells = [F.concat(F.lit("<td>"), html_escape(c), F.lit("</td>")) for c in _cells()[1:]]
    return rows.select("clip", "file", F.concat(F.lit("<tr>"), F.concat(*cells), F.lit("</tr>")).alias("line"))


def run_lines(clips: DataFrame) -> DataFrame:
    """(clip, line): a run report's table line of each clip (clip, frames, in_bytes, out_bytes, fine)."""
    ratio = F.when(
        F.col("out_bytes") > 0, F.format_string("%.2f", F.col("in_bytes").cast("double") / F.col("out_bytes"))
    ).otherwise("n/a")
    cells = [
        F.col("clip"),
        *[F.col(c).cast("string") for c in ("frames", "in_bytes", "out_bytes")],
        ratio,
        F.when(F.col("fine"), "PASS").otherwise("FAIL"),
    ]
    return clips.select("clip", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def totals(rows: DataFrame, clips: DataFrame) -> DataFrame:
    """Files, bytes and milliseconds of each clip of ``clips``, those without files too."""
    got = rows.groupBy("clip").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size"), F.sum("copied_ms").alias("ms")
    )
    return clips.join(got, "clip", "left").fillna(0, ["files", "size", "ms"])


def write(lines: DataFrame, header: str, path: str) -> None:
    """A report, header first, rows by clip and file: one file up to ``FILE_ROWS`` rows, else several in order."""
    n = lines.count()
    head = lines.sparkSession.createDataFrame([(0, "", "", header)], "n int, clip string, file string, line string")
    body = lines.select(F.lit(1).alias("n"), "clip", "file", "line")
    sort = ["n", "clip", "file", "line"]
    whole = head.unionByName(body).repartitionByRange(max(1, -(-n // FILE_ROWS)), *sort).sortWithinPartitions(*sort)
    whole.select("line").write.mode("overwrite").text(path)


def phase_profile(rows: DataFrame, phases: list[str]) -> DataFrame:
    """(file, phase, ns) widened: a column of nanoseconds a phase."""
    return rows.groupBy("file").pivot("phase", phases).agg(F.sum("ns"))


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return rows.select(F.to_json(F.struct("*")).alias("line"))


def canonical_pins(rows: DataFrame, version: str) -> DataFrame:
    """One line of the pins that name versions: ``component=expected``, sorted, joined by '; '."""
    probe = F.split(F.trim("probe"), r"\s+").getItem(0)
    pair = F.concat_ws("=", "component", "expected")
    both = F.array(F.concat(F.lit("cjxl="), "expected"), F.concat(F.lit("djxl="), "expected"))
    parts = F.when(
        probe.isin("version-contains", "lock-grep"), F.when(F.col("component") == "cjxl/djxl", both).otherwise(F.array(pair))
    ).when(probe == "toml-grep", F.array(F.lit(f"tool={version}"))).otherwise(F.array().cast("array<string>"))
    return rows.agg(F.array_join(F.array_sort(F.flatten(F.collect_list(parts))), "; ").alias("pins"))

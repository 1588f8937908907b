"""Queries that write record files to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomshed.plans.registry import register
from loomshed.plans.sources import _lines
from loomshed.scratch import scratch, stored
from loomshed.session import table
from loomshed.sources import records


@register("record_round_trip", "SELECT 'd' || doc_id AS file, n_chars AS size, sha256(text) AS sha256 FROM documents")
def record_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A source record written, sorted by name, and read back."""
    rows = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"),
        F.col("n_chars").alias("size"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
    )
    path = scratch(spark, "sources")
    records.write_record(rows, path, "# sources v1", records.SOURCES[0], "file", {"count": str(rows.count())})
    found, _ = records.read_sources(spark, path)
    return found.select(*records.SOURCES[0])


@register(
    "torn_ledger",
    "SELECT floor(epoch(ts))::BIGINT AS created, event_type AS command, 'reel' || user_id AS output FROM events WHERE event_id % 7 <> 3",
)
def torn_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger of mixed arities with bad rows between, beside ledgers of no known version, which are not read."""
    e = table(spark, sf, "events")
    created = F.when(F.col("event_id") % 7 == 3, "soon").otherwise(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
    cells = [
        created,
        F.col("event_type"),
        F.lit("v"),
        F.lit("in"),
        F.concat(F.lit("reel"), F.col("user_id").cast("string")),
        F.lit("c"),
        F.lit("1"),
        F.lit("OK"),
        F.lit("0"),
        F.lit("d"),
    ]
    line = F.concat_ws("\t", *cells, F.when(F.col("event_id") % 2 == 0, "s"), F.when(F.col("event_id") % 4 == 0, "x"))
    path = scratch(spark, "ledger")
    for name, top in (("known", ["version: 3", "\t".join(records.LEDGER[0])]), ("later", ["version: 9"]), ("none", [])):
        _lines(e, line, F.col("event_id"), f"{path}/kind={name}", top)
    rows, _ = records.read_ledger(spark, path)
    return rows.select("created", "command", "output")


@register(
    "ledger_stream",
    "SELECT floor(epoch(ts))::BIGINT AS created, event_type AS command, event_id::VARCHAR AS input, 'reel' || user_id AS output FROM events",
)
def ledger_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Ledgers that grow, followed as a stream; first up to the middle of a line, then to their ends."""
    from loomshed.sources import ledger_stream as stream, trees

    e = table(spark, sf, "events")
    path, out, checkpoint = (scratch(spark, f"ledgers-{w}") for w in ("files", "rows", "state"))
    created = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    cells = [created, "event_type", F.lit("v"), F.col("event_id").cast("string"), F.concat(F.lit("reel"), F.col("user_id").cast("string"))]
    line = F.concat_ws("\t", *cells, *[F.lit("x")] * 7)
    top = "version: 3\n" + "\t".join(records.LEDGER[0]) + "\n"
    held = e.select(F.expr("event_id div 1000").alias("k"), line.alias("line")).groupBy("k").agg(
        F.concat(F.lit(top), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n")).alias("text")  # 1,000 lines
    )
    held, rel = stored(held, "ledgers"), F.format_string("ledger-%d.tsv", "k").alias("rel")
    for share in (0.0, 0.37, 0.8, 1.0):
        part = F.left("text", F.ceil(F.length("text") * share).cast("int")).cast("binary").alias("content")
        trees.write_files(held.select(rel, part), path)
        stream.follow(spark, path, out, checkpoint, range=50_000)
    return stream.told(spark, out).select("created", "command", "input", "output")

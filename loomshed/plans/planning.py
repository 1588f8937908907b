"""Queries of sampling, packing, projections and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomshed.operators import planning
from loomshed.plans.registry import register
from loomshed.session import table


def sampled_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The deterministic sample of a collection's frames."""
    return planning.sample(spark, table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "place")


def _sample_sql() -> str:
    """The generator in SQL: 128-bit whole numbers stand in for wrapping 64-bit ones."""
    m = "18446744073709551616::UHUGEINT"

    def mul(a, b):
        return f"((({a}) * {b}::UHUGEINT) % {m})"

    z1 = "xor(s, s >> 30)"
    z2 = mul(z1, "13787848793156543929")
    z3 = f"xor({z2}, ({z2}) >> 27)"
    z4 = mul(z3, "10723151780598845931")
    return f"""
    WITH n AS (SELECT count(*) AS n FROM documents),
    draws AS (SELECT i, ((539363606::UHUGEINT + i::UHUGEINT * 11400714819323198485::UHUGEINT) % {m}) AS s FROM range(1, 2001) t(i)),
    vals AS (SELECT i, xor({z4}, ({z4}) >> 31) % (SELECT n FROM n)::UHUGEINT AS idx FROM draws),
    firsts AS (SELECT idx, min(i) AS i FROM vals GROUP BY idx),
    picked AS (SELECT idx FROM firsts ORDER BY i LIMIT (SELECT least(n, least(60, greatest(20, (n + 9) // 10))) FROM n)),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)
    SELECT doc_id, place FROM ranked WHERE place IN (SELECT idx::BIGINT FROM picked)
    """


register("sampled_frames", _sample_sql())(sampled_frames)


@register(
    "part_packing",
    """
    WITH RECURSIVE f AS (SELECT source AS clip, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    p AS (SELECT clip, doc_id, i, size AS cur, 0 AS part FROM f WHERE i = 1
      UNION ALL SELECT f.clip, f.doc_id, f.i, CASE WHEN p.cur + f.size > 20000 THEN f.size ELSE p.cur + f.size END, CASE WHEN p.cur + f.size > 20000 THEN p.part + 1 ELSE p.part END FROM p JOIN f ON f.clip = p.clip AND f.i = p.i + 1)
    SELECT clip, doc_id, part FROM p
    """,
)
def part_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a clip, in order, next-fit into parts."""
    files = table(spark, sf, "documents").select(F.col("source").alias("clip"), "doc_id", F.col("n_chars").alias("size"))
    return planning.next_fit(files, "clip", "doc_id", "size", 20_000)


@register(
    "running_eta",
    """
    WITH s AS (SELECT user_id, event_id, row_number() OVER w AS done, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, done::INT AS done, l[greatest(1, least(done, ceil(0.95::DOUBLE * done)))::INT] AS p95, l[greatest(1, least(done, ceil(0.95::DOUBLE * done)))::INT] * greatest(500 - done, 0) AS eta FROM s
    """,
)
def running_eta(spark: SparkSession, sf: str) -> DataFrame:
    """p95 of all times so far, times the frames left."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return planning.running_p95(rows, "user_id", ["ts", "event_id"], "value", 500).select(
        "user_id", "event_id", "done", "p95", "eta"
    )


@register(
    "class_projection",
    "SELECT source AS clip, round(sum(CASE WHEN doc_id % 5 = 0 THEN n_chars // 3 ELSE 0 END) + sum(CASE WHEN doc_id % 5 <> 0 THEN n_chars ELSE 0 END) / 2.2::DOUBLE)::BIGINT AS projected FROM documents WHERE lang = 'en' GROUP BY 1",
)
def class_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Measured sizes, and the rest by a ratio, of one class."""
    rows = table(spark, sf, "documents").filter("lang = 'en'").select(
        F.col("source").alias("clip"),
        (F.col("doc_id") % 5 == 0).alias("sampled"),
        F.expr("n_chars div 3").alias("encoded"),
        F.col("n_chars").alias("size"),
    )
    return planning.project_sampled(rows, ["clip"], "sampled", "encoded", "size", 2.2)


@register(
    "space_preflight",
    "SELECT source AS clip, count(*) AS frames, ceil(sum(n_chars) / 2.0::DOUBLE * 1.1)::BIGINT AS bytes, count(*) * 405.0::DOUBLE / 60000.0 AS eta FROM documents GROUP BY 1",
)
def space_preflight(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and minutes to expect."""
    from loomshed.functions.keys import eta_minutes, space_estimate

    d = table(spark, sf, "documents").groupBy(F.col("source").alias("clip")).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("n_chars").alias("total")
    )
    return d.select(
        "clip",
        "frames",
        space_estimate(F.col("total"), 2.0, 1.1).alias("bytes"),
        eta_minutes(F.col("frames"), 405.0).alias("eta"),
    )


@register(
    "quality_search",
    """
    WITH RECURSIVE c AS (SELECT p_partkey AS k, 3000 + p_size * 100 AS lim, list_transform(range(1, 101), lambda q: q * 60 + (q * p_partkey * 37 % 211)) AS s FROM part),
    b AS (SELECT k, lim, s, 1 AS lo, 100 AS hi, 1 AS ans FROM c
      UNION ALL SELECT k, lim, s, CASE WHEN s[(lo + (hi - lo) // 2)::INT] <= lim THEN (lo + (hi - lo) // 2)::INT + 1 ELSE lo END, CASE WHEN s[(lo + (hi - lo) // 2)::INT] <= lim THEN hi ELSE (lo + (hi - lo) // 2)::INT - 1 END,
        CASE WHEN s[(lo + (hi - lo) // 2)::INT] <= lim THEN (lo + (hi - lo) // 2)::INT ELSE ans END FROM b WHERE lo <= hi),
    d AS (SELECT k, any_value(lim) AS lim, any_value(s) AS s, arg_max(ans, lo * 1000 - hi) AS ans FROM b GROUP BY k),
    e AS (SELECT k, lim, s, ans, unnest(range(greatest(ans - 3, 1), least(ans + 3, 100) + 1)) AS q FROM d)
    SELECT k, coalesce(arg_max(q, s[q::INT] * 1000 + q) FILTER (WHERE s[q::INT] <= lim AND s[q::INT] >= s[ans]), any_value(ans))::INT AS quality FROM e GROUP BY k
    """,
)
def quality_search(spark: SparkSession, sf: str) -> DataFrame:
    """Bisection over a curve that dips, then refinement."""
    k = F.col("p_partkey")
    sizes = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda q: q * 60 + (q * k * 37 % 211))
    curves = table(spark, sf, "part").select(k.alias("k"), (F.lit(3000) + F.col("p_size") * 100).alias("lim"), sizes.alias("s"))
    return planning.search_quality(curves, "k", "lim", "s")


@register(
    "candidate_argmin",
    "WITH c AS (SELECT l_orderkey AS tile, l_linenumber AS cand, min(l_quantity)::INT AS size FROM lineitem GROUP BY 1, 2) SELECT tile, arg_min(cand, size * 100 + cand) AS cand, min(size) AS size FROM c GROUP BY tile",
)
def candidate_argmin(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest candidate of a tile, the earliest on a tie."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tile"), F.col("l_linenumber").alias("cand")).agg(
        F.min("l_quantity").cast("int").alias("size")
    )
    return planning.smallest(c, ["tile"], "cand", "size")


@register(
    "latest_manifest",
    "SELECT user_id, max(event_id) + 1 AS next_generation, arg_max(event_type, event_id) AS latest FROM events GROUP BY 1",
)
def latest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The last record of a chain, and the next number."""
    return planning.latest(table(spark, sf, "events"), ["user_id"], "event_id", "event_type")


@register(
    "archive_frames",
    "SELECT source AS clip, CASE WHEN source LIKE '%1%' THEN count(DISTINCT doc_id // 4) ELSE count(*) FILTER (WHERE lang <> 'xx') END AS frames FROM documents GROUP BY source",
)
def archive_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of an archive, by files or by distinct stems of four planes."""
    return table(spark, sf, "documents").groupBy(F.col("source").alias("clip")).agg(
        F.count_if(F.col("lang") != "xx").alias("n"), F.countDistinct(F.expr("doc_id div 4")).alias("d")
    ).select("clip", F.when(F.col("clip").contains("1"), F.col("d")).otherwise(F.col("n")).alias("frames"))


@register(
    "status_windows",
    "SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def status_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Status events by day, as the batch form of the streaming view."""
    from loomshed.streaming.status import by_window

    w = by_window(table(spark, sf, "events"), "1 day")
    return w.select(
        "event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total")
    )


@register(
    "running_rate",
    """WITH r AS (SELECT user_id, event_id, event_id % 10 / 20.0::DOUBLE AS el, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events)
    SELECT user_id, event_id, done::INT AS done, CASE WHEN el < 0.1 THEN 0.0 ELSE done / greatest(el, 0.1) END AS rate, CASE WHEN el < 0.1 THEN 77.0 ELSE greatest(200 - done, 0) / (done / greatest(el, 0.1)) END AS eta FROM r""",
)
def running_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Rate and time left after each frame."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 10 / 20.0).alias("el"))
    return planning.running_rate(rows, "user_id", ["ts", "event_id"], "el", 200, 77.0).select(
        "user_id", "event_id", "done", "rate", "eta"
    )


@register(
    "naming",
    """WITH s AS (SELECT o_custkey AS batch, CASE WHEN o_orderkey % 500 = 0 THEN 'B' ELSE 'A' END || '_' || strftime(o_orderdate, '%Y%m%d') || '_' || CASE WHEN o_orderkey % 300 = 0 THEN 'x' ELSE lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') END AS stem FROM orders),
    g AS (SELECT batch, bool_and(regexp_matches(stem, '^[^_]*(_[^_]*)*_[0-9]{8}_[0-9]{6}$')) AS fine, min(split_part(stem, '_', 1)) AS a, max(split_part(stem, '_', 1)) AS b FROM s GROUP BY 1)
    SELECT batch, CASE WHEN fine AND a = b THEN a END AS designation FROM g""",
)
def naming(spark: SparkSession, sf: str) -> DataFrame:
    """A batch's common designation."""
    k = F.col("o_orderkey")
    stem = F.concat_ws(
        "_",
        F.when(k % 500 == 0, "B").otherwise("A"),
        F.date_format("o_orderdate", "yyyyMMdd"),
        F.when(k % 300 == 0, "x").otherwise(F.lpad((k % 1_000_000).cast("string"), 6, "0")),
    )
    return planning.naming(
        table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), stem.alias("stem")), ["batch"], "stem"
    )

"""Queries of plane gates and job reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomshed.operators import plane_gates as pg
from loomshed.plans.planes import _PAIR, H, W, pairs
from loomshed.plans.registry import register
from loomshed.session import table
from loomshed.sources import reports

_NUM = "SELECT event_id, value, event_id % 7 / 4.0::DOUBLE AS a, event_id % 11 / 8.0::DOUBLE AS b, CASE WHEN event_id % 3 <> 0 THEN (event_id % 5) / 4.0::DOUBLE END AS c, event_id % 13 / 8.0::DOUBLE AS d FROM events"


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        "value",
        (e % 7 / 4.0).alias("a"),
        (e % 11 / 8.0).alias("b"),
        F.when(e % 3 != 0, (e % 5) / 4.0).alias("c"),
        (e % 13 / 8.0).alias("d"),
    )


@register(
    "structure_gate",
    f"WITH n AS ({_NUM}) SELECT event_id, CASE WHEN b < CASE WHEN c IS NOT NULL THEN greatest(0.5, 0.5 * c) ELSE 0.5 END THEN 'v low' WHEN a > 1.0 THEN 'h high' WHEN c IS NOT NULL AND c <= 0 THEN 'anchor' WHEN c IS NOT NULL AND b > greatest(1.4, 3.5 * c) THEN 'v high' WHEN c IS NOT NULL AND a > greatest(1.0, 2.0 * d) THEN 'h anchored' ELSE 'ok' END AS gate FROM n",
)
def structure_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of step ratios."""
    return _numbers(spark, sf).select("event_id", pg.structure(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("gate"))


@register(
    "pixel_gate",
    f"WITH n AS ({_NUM}) SELECT event_id, CASE WHEN c > 0 AND a / nullif(c, 0) >= 2.0 THEN 'error' WHEN event_id % 4 = 0 AND NOT event_id % 120 BETWEEN greatest(100 - 5, 0) AND 105 THEN 'size' ELSE 'ok' END AS gate FROM n",
)
def pixel_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Error against an anchor, size against a target."""
    e = F.col("event_id")
    return _numbers(spark, sf).select(
        "event_id", pg.pixels(F.col("a"), F.coalesce("c", F.lit(0.0)), F.when(e % 4 == 0, F.lit(100)), e % 120).alias("gate")
    )


@register(
    "scan_gate",
    f"WITH n AS (SELECT *, a * 90 AS x, b * 90 AS y FROM ({_NUM})) SELECT event_id, CASE WHEN x > greatest(100.0, 0.75 * d * 100) OR y > greatest(100.0, 0.75 * d * 100) THEN 'dead scan' WHEN least(x, y) <= 0 OR greatest(x, y) > 10.0 * least(x, y) THEN 'ratio' ELSE 'ok' END AS gate FROM n",
)
def scan_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A dead half of a frame."""
    return _numbers(spark, sf).select(
        "event_id", pg.scan_complete(F.col("a") * 90, F.col("b") * 90, F.col("d") * 100, F.col("d") * 100).alias("gate")
    )


@register(
    "demosaic_gate",
    f"WITH n AS ({_NUM}) SELECT event_id, CASE WHEN c IS NULL THEN 'ok' WHEN c <= 0 THEN 'anchor' WHEN a < greatest(0.5 * c - 0.03, 0.0) OR a > greatest(2.0 * c, 0.75) THEN 'channel 0' WHEN b < greatest(0.5 * c - 0.03, 0.0) OR b > greatest(2.0 * c, 0.75) THEN 'channel 1' WHEN d < greatest(0.5 * c - 0.03, 0.0) OR d > greatest(2.0 * c, 0.75) THEN 'channel 2' ELSE 'ok' END AS gate FROM n",
)
def demosaic_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Chroma spreads against an anchor's."""
    return _numbers(spark, sf).select(
        "event_id", pg.demosaic([F.col("a"), F.col("b"), F.col("d")], [F.col("c")] * 3).alias("gate")
    )


@register(
    "class_bias",
    _PAIR
    + """, e AS (SELECT vec_id, list_transform(range(0, 64), lambda i: a[i + 1] - b[i + 1]) AS e FROM pr), m AS (SELECT vec_id,
      list_sum(list_transform(range(0, 64), lambda i: CASE WHEN (i // 8) % 2 = 0 AND i % 2 = 0 THEN e[i + 1] ELSE 0 END)) / 16.0::DOUBLE AS w, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN (i // 8) % 2 <> i % 2 THEN e[i + 1] ELSE 0 END)) / 32.0::DOUBLE AS g,
      list_sum(list_transform(range(0, 64), lambda i: CASE WHEN (i // 8) % 2 = 1 AND i % 2 = 1 THEN e[i + 1] ELSE 0 END)) / 16.0::DOUBLE AS r FROM e)
    SELECT *, CASE WHEN abs(w) >= 31 THEN 'W' WHEN abs(g) >= 31 THEN 'G' WHEN abs(r) >= 31 THEN 'R' ELSE 'ok' END AS gate FROM m""",
)
def class_bias(spark: SparkSession, sf: str) -> DataFrame:
    """mean error of the three pattern classes, and its gate."""
    w, g, r = pg.class_bias(F.col("a"), F.col("b"), W, H)
    m = pairs(spark, sf).select("vec_id", w.alias("w"), g.alias("g"), r.alias("r"))
    return m.withColumn("gate", pg.class_bias_gate([F.col("w"), F.col("g"), F.col("r")]))


def _std(steps: str, n: int) -> str:
    return f"sqrt(greatest(list_sum(list_transform({steps}, lambda v: v * v)) / {n}.0::DOUBLE - (list_sum({steps}) / {n}.0::DOUBLE) * (list_sum({steps}) / {n}.0::DOUBLE), 0.0))"


@register(
    "structure_ratios",
    _PAIR
    + """, s AS (SELECT vec_id, list_transform(range(0, 56), lambda i: a[(i // 7) * 8 + i % 7 + 2] - a[(i // 7) * 8 + i % 7 + 1]) AS ah, list_transform(range(0, 56), lambda i: b[(i // 7) * 8 + i % 7 + 2] - b[(i // 7) * 8 + i % 7 + 1]) AS bh,
      list_transform(range(0, 56), lambda i: a[i + 9] - a[i + 1]) AS av, list_transform(range(0, 56), lambda i: b[i + 9] - b[i + 1]) AS bv FROM pr)
    SELECT vec_id, round("""
    + f"{_std('ah', 56)} / {_std('bh', 56)}, 9) AS h, round({_std('av', 56)} / {_std('bv', 56)}, 9) AS v FROM s",
)
def structure_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """spread of a plane's steps over its source's."""
    h, v = pg.structure_ratios(F.col("a"), F.col("b"), W, H)
    return pairs(spark, sf).select("vec_id", F.round(h, 9).alias("h"), F.round(v, 9).alias("v"))


@register(
    "band_mix",
    _PAIR + ", x AS (SELECT vec_id, list_transform(range(0, 64), lambda i: list_avg(list_filter(list_transform(range(0, 64), lambda j: CASE WHEN abs(j // 8 - i // 8) <= 2 AND abs(j % 8 - i % 8) <= 2 THEN a[j + 1]::DOUBLE END), lambda q: q IS NOT NULL))) AS m, a FROM pr) SELECT vec_id, round(list_sum(list_transform(range(0, 64), lambda i: (i + 1) * (8.0::DOUBLE * a[i + 1] - 7.0 * m[i + 1]))), 1) AS mixed FROM x",
)
def band_mix(spark: SparkSession, sf: str) -> DataFrame:
    """A box mean of the block grid, cut at its edges, mixed out."""
    x = pairs(spark, sf).select("vec_id", pg.band_mix(F.transform("a", lambda v: v.cast("double")), W, H, reach=2).alias("m"))
    return x.select(
        "vec_id",
        F.round(F.aggregate(F.transform("m", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 1).alias("mixed"),
    )


def _mean_sql(pick: str, n: int) -> str:
    return f"list_sum(list_transform(range(0, 64), lambda i: CASE WHEN {pick} THEN abs(a[i + 1] - b[i + 1]) ELSE 0 END)) / {n}.0::DOUBLE"


def _flat_sql(first: str, second: str, out: str) -> str:
    return f"list_avg(list_filter(list_transform(range(0, 8), lambda i: CASE WHEN abs(b[{second}] - b[{first}]) < 300 THEN (a[{second}] - a[{first}])::DOUBLE END), lambda v: v IS NOT NULL)) AS {out}"


@register(
    "seams",
    _PAIR
    + f""", m AS (SELECT vec_id, {_mean_sql("i % 8 IN (3, 4)", 16)} AS sv, {_mean_sql("i % 8 IN (1, 2, 6, 7)", 32)} AS bv, {_mean_sql("i // 8 IN (3, 4)", 16)} AS sh, {_mean_sql("i // 8 IN (1, 2, 6, 7)", 32)} AS bh,
      {_flat_sql("i * 8 + 4", "i * 8 + 5", "fv")}, {_flat_sql("i + 25", "i + 33", "fh")} FROM pr)
    SELECT vec_id, CASE WHEN bv < 0.05 THEN sv * 1.5 ELSE sv / bv END AS v, CASE WHEN bh < 0.05 THEN sh * 1.5 ELSE sh / bh END AS h, round(fv, 6) AS flat_v, round(fh, 6) AS flat_h FROM m""",
)
def seams(spark: SparkSession, sf: str) -> DataFrame:
    """Error and steps at a seam against its sides; a seam whose source is never flat has no step."""
    a, b = F.col("a"), F.col("b")

    def known(c):
        return F.round(F.when(~F.isnan(c), c), 6)

    return pairs(spark, sf).select(
        "vec_id",
        pg.seam_ratio(a, b, W, H, 4, True, 2).alias("v"),
        pg.seam_ratio(a, b, W, H, 4, False, 2).alias("h"),
        known(pg.flat_step(a, b, W, H, 4, True, 300)).alias("flat_v"),
        known(pg.flat_step(a, b, W, H, 4, False, 300)).alias("flat_h"),
    )


_GRID_SQL = """CASE WHEN w = 3024 AND h = 2010 THEN '252x252' WHEN w = 1936 AND h = 1090 THEN CASE WHEN d = 10 THEN '484x274' WHEN d IN (8, 12) THEN '242x274' ELSE '482x272' END
  WHEN w = 2016 AND h = 1344 THEN '252x336' WHEN w = 3856 AND h = 2170 AND d = 10 THEN '964x272' ELSE '482x272' END"""


@register(
    "tile_grids",
    f"""WITH f AS (SELECT p_partkey, [3024, 1936, 2016, 3856, 4000][p_partkey % 5 + 1] AS w, [2010, 1090, 1344, 2170, 3000][p_partkey % 5 + 1] AS h, [8, 10, 12, 14][p_size % 4 + 1] AS d FROM part),
    g AS (SELECT *, {_GRID_SQL} AS grid FROM f)
    SELECT p_partkey, grid, (((w + split_part(grid, 'x', 1)::INT - 1) // split_part(grid, 'x', 1)::INT) * ((h + split_part(grid, 'x', 2)::INT - 1) // split_part(grid, 'x', 2)::INT))::BIGINT AS tiles, p_partkey % 5 < 4 AND d IN (8, 10, 12) AS archive FROM g""",
)
def tile_grids(spark: SparkSession, sf: str) -> DataFrame:
    """The tile grid of a frame size and depth, its tiles, and whether the size is an archive's."""
    from loomshed.sources.frames import archive_geometry, expected_tiles, tile_dims

    k, pick = F.col("p_partkey"), lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("i") + 1).cast("int"))
    f = table(spark, sf, "part").withColumn("i", k % 5).select(
        k,
        pick(3024, 1936, 2016, 3856, 4000).alias("w"),
        pick(2010, 1090, 1344, 2170, 3000).alias("h"),
        F.element_at(F.array(*[F.lit(x) for x in (8, 10, 12, 14)]), F.col("p_size") % 4 + 1).alias("d"),
    )
    g = f.withColumn("g", tile_dims(F.col("w"), F.col("h"), F.col("d")))
    return g.select(
        k,
        F.concat_ws("x", F.col("g.tw").cast("string"), F.col("g.th").cast("string")).alias("grid"),
        expected_tiles(F.col("w"), F.col("h"), F.col("g.tw"), F.col("g.th")).alias("tiles"),
        archive_geometry(F.col("w"), F.col("h"), F.col("d")).alias("archive"),
    )


@register(
    "job_report_csv",
    """SELECT doc_id, source || ',' || CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || n_chars || ',' || md5(text) || ',,OK,' || CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '0' END || ',' || doc_id % 100 AS line FROM documents""",
)
def job_report_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A job report's lines."""
    d = table(spark, sf, "documents")
    rows = d.select(
        F.col("source").alias("clip"),
        F.col("text").alias("file"),
        F.col("n_chars").alias("size_bytes"),
        F.md5(F.col("text").cast("binary")).alias("source_sha256"),
        F.lit(None).cast("string").alias("dest_sha256"),
        F.lit("OK").alias("verdict"),
        (F.col("doc_id") % 2 == 0).alias("skipped"),
        (F.col("doc_id") % 100).alias("copied_ms"),
        "doc_id",
    )
    return rows.withColumn("line", F.concat_ws(",", *[reports.csv_field(c) for c in reports._cells()])).select("doc_id", "line")


@register(
    "phase_profile",
    "SELECT user_id AS file, sum(event_id) FILTER (WHERE event_type = 'click')::BIGINT AS click, sum(event_id) FILTER (WHERE event_type = 'view')::BIGINT AS view FROM events GROUP BY 1",
)
def phase_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Long profile rows widened by phase."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("file"), F.col("event_type").alias("phase"), F.col("event_id").alias("ns")
    )
    return reports.phase_profile(rows, ["click", "view"])


@register("directory_hashes")
def directory_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Content and structure hashes of a tree, rolled up by depth."""
    from loomshed.functions.hashing import c4_id
    from loomshed.sources.hashlists import directory_hashes as roll

    d = table(spark, sf, "documents")
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    return roll(d.select(path.alias("path"), c4_id(F.col("text").cast("binary")).alias("c4")))

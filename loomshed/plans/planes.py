"""Queries of plane operators, over embeddings scaled to 12-bit samples in 8x8 planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomshed.operators import planes as pl
from loomshed.plans.registry import register
from loomshed.session import table

W = H = 8
_PLANE = "SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(4095, floor((x::DOUBLE + 0.5) * 4000)::INT))) AS p FROM embeddings"
_PAIR = f"WITH p AS ({_PLANE}), pr AS (SELECT a.vec_id, a.p AS a, b.p AS b FROM p a JOIN p b ON b.vec_id = a.vec_id + 1)"


def sampled(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform(
        "embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(4095), F.floor((x.cast("double") + 0.5) * 4000).cast("int")))
    )
    return table(spark, sf, "embeddings").select("vec_id", v.alias("p"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = sampled(spark, sf)
    return p.withColumnRenamed("p", "a").join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("b")), "vec_id")


def _show(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def _sql(make: str, n: int, src: str = _PLANE) -> str:
    """SQL of a plane whose sample i is ``make``."""
    return f"WITH p AS ({src}) SELECT vec_id, array_to_string(list_transform(range(0, {n}), lambda i: ({make})::INT), ',') AS out FROM p"


@register(
    "deinterleave",
    "WITH p AS (" + _PLANE + ") SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda i: p[((i % 16) // 4 * 2 + (i // 16) // 2) * 8 + 2 * (i % 4) + (i // 16) % 2 + 1]), ',') AS planes, array_to_string(p, ',') AS back FROM p",
)
def deinterleave(spark: SparkSession, sf: str) -> DataFrame:
    """Four phase planes, and back."""
    d = sampled(spark, sf).withColumn("d", pl.deinterleave(F.col("p"), W, H))
    return d.select("vec_id", _show(F.flatten("d")).alias("planes"), _show(pl.reinterleave(F.col("d"), W, H)).alias("back"))


@register("decimate", _sql("p[(2 * (i // 4) + (i % 4) % 2) * 8 + 2 * (i % 4) + (i // 4) % 2 + 1]", 16))
def decimate(spark: SparkSession, sf: str) -> DataFrame:
    """Half size by the staircase rule."""
    return sampled(spark, sf).select("vec_id", _show(pl.decimate(F.col("p"), W, H)).alias("out"))


@register("derive_depth", _sql("p[i + 1] >> 2", 64))
def derive_depth(spark: SparkSession, sf: str) -> DataFrame:
    """12 bits to 10."""
    return sampled(spark, sf).select("vec_id", _show(pl.derive_depth(F.col("p"), 10)).alias("out"))


def _box_sql() -> str:
    cells = " + ".join(
        f"p[greatest(0, least(7, i // 8 + {dy})) * 8 + greatest(0, least(7, i % 8 + {dx})) + 1]" for dy in (-1, 0, 1) for dx in (
            -1, 0, 1
        )
    )
    return _sql(f"({cells}) // 9", 64)


@register("box3", _box_sql())
def box3(spark: SparkSession, sf: str) -> DataFrame:
    """3x3 mean, edges clamped."""
    return sampled(spark, sf).select("vec_id", _show(pl.box3(F.col("p"), W, H)).alias("out"))


@register("two_tap", _sql("(p[i + 1] + p[CASE WHEN i % 8 = 7 THEN i + 1 ELSE i + 2 END]) // 2", 64))
def two_tap(spark: SparkSession, sf: str) -> DataFrame:
    """Mean with the right neighbour."""
    return sampled(spark, sf).select("vec_id", _show(pl.two_tap(F.col("p"), W, H)).alias("out"))


@register(
    "plane_delta",
    _PAIR + """, d AS (SELECT vec_id, list_transform(range(1, 65), lambda i: abs(a[i] - b[i])) AS d FROM pr), z AS (SELECT vec_id, d, list_filter(d, lambda v: v > 0) AS nz FROM d)
    SELECT vec_id, len(nz)::INT AS n_diff, coalesce(list_min(nz), 0) AS min_delta, coalesce(list_max(nz), 0) AS max_delta, CASE WHEN coalesce(list_max(nz), 0) > 0 THEN length(bin(list_max(nz))) ELSE 0 END::INT AS lsb_k, list_max(d) <= 256 AS in_band FROM z""",
)
def plane_delta(spark: SparkSession, sf: str) -> DataFrame:
    """How two planes differ."""
    from loomshed.functions.keys import bit_length

    p = pairs(spark, sf)
    got = pl.compare(F.col("a"), F.col("b"))
    return p.select(
        "vec_id",
        *[c.alias(n) for n, c in got.items()],
        bit_length(got["max_delta"]).alias("lsb_k"),
        pl.in_band(F.col("a"), F.col("b")).alias("in_band"),
    )


@register(
    "delta_histogram",
    _PAIR + ", d AS (SELECT unnest(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) AS delta FROM pr) SELECT delta, count(*) AS n FROM d WHERE delta > 0 GROUP BY 1",
)
def delta_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """histogram of differences that are not zero."""
    return pairs(spark, sf).select(
        F.explode(pl.deltas(F.col("a"), F.col("b"))).alias("delta")
    ).filter("delta > 0").groupBy("delta").agg(F.count(F.lit(1)).alias("n"))


@register(
    "plane_quality",
    _PAIR + """, d AS (SELECT vec_id, list_transform(range(1, 65), lambda i: abs(a[i] - b[i])) AS d, a FROM pr)
    SELECT vec_id, list_sum(d) / 64.0::DOUBLE AS mae, len(list_filter(d, lambda v: v = 0)) * 100.0::DOUBLE / 64 AS exact_pct, len(list_filter(d, lambda v: v <= 1)) * 100.0::DOUBLE / 64 AS within_one_pct, list_max(d) AS max_err,
      list_sum(list_transform(range(0, 64), lambda i: CASE WHEN (i // 8) % 2 = 0 THEN d[i + 1] ELSE 0 END)) / 32.0::DOUBLE AS even_mae, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN (i // 8) % 2 = 1 THEN d[i + 1] ELSE 0 END)) / 32.0::DOUBLE AS odd_mae,
      list_sum(list_transform(range(0, 64), lambda i: CASE WHEN (i // 8) % 2 = 0 THEN a[i + 1] ELSE 0 END)) / 32.0::DOUBLE AS even_mean, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN (i // 8) % 2 = 1 THEN a[i + 1] ELSE 0 END)) / 32.0::DOUBLE AS odd_mean,
      abs(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 1 THEN a[i + 1] ELSE -a[i + 1] END))) / 32.0::DOUBLE AS contrast FROM d""",
)
def plane_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Error measures and parity means."""
    a, b = F.col("a"), F.col("b")
    even, odd = pl.parity_means(a, W, H)
    return pairs(spark, sf).select(
        "vec_id",
        *[c.alias(n) for n, c in pl.quality(a, b, W, W * H).items()],
        even.alias("even_mean"),
        odd.alias("odd_mean"),
        pl.column_contrast(a, W * H).alias("contrast"),
    )


@register(
    "class_means",
    _PAIR + " SELECT vec_id, " + ", ".join(
        f"list_sum(list_transform(range(0, 64), lambda i: CASE WHEN (i // 8) % 2 * 2 + i % 2 = {p} THEN a[i + 1] - b[i + 1] ELSE 0 END)) / 16.0::DOUBLE AS m{p}" for p in range(4)
    ) + " FROM pr",
)
def class_means(spark: SparkSession, sf: str) -> DataFrame:
    """mean error of each 2x2 phase."""
    return pairs(spark, sf).select(
        "vec_id", *[c.alias(f"m{i}") for i, c in enumerate(pl.class_means(F.col("a"), F.col("b"), W, H))]
    )


@register(
    "difference_categories",
    f"WITH p AS ({_PLANE}), d AS (SELECT unnest(list_transform(range(1, 64), lambda i: abs(p[i + 1] - p[i]))) AS d FROM p) SELECT CASE WHEN d > 0 THEN length(bin(d)) ELSE 0 END::INT AS category, count(*) AS n FROM d GROUP BY 1",
)
def difference_categories(spark: SparkSession, sf: str) -> DataFrame:
    """bit lengths of neighbours' differences."""
    return sampled(spark, sf).select(
        F.explode(pl.difference_categories(F.col("p"))).alias("category")
    ).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register(
    "temporal_bound",
    _PAIR + ", m AS (SELECT vec_id % 7 AS clip, list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) AS d FROM pr) SELECT clip, max(d) AS band, least(4 * max(d), 65535) AS bound FROM m GROUP BY 1",
)
def temporal_bound(spark: SparkSession, sf: str) -> DataFrame:
    """the band of a clip and four times it, bounded."""
    d = pairs(spark, sf).select((F.col("vec_id") % 7).alias("clip"), pl.max_delta(F.col("a"), F.col("b")).alias("d"))
    return d.groupBy("clip").agg(F.max("d").alias("band")).withColumn("bound", F.least(4 * F.col("band"), F.lit(65535)))


_CURVE = "SELECT c::INT AS code, round(4095.0::DOUBLE * (pow(2.0::DOUBLE, 2.0::DOUBLE * c / 1023.0) - 1.0) / 3.0)::INT AS linear FROM range(1024) t(c)"


@register(
    "log_curve",
    "WITH c AS (SELECT list(linear ORDER BY code) AS t FROM (" + _CURVE + ")), p AS (" + _PLANE + ") SELECT vec_id, array_to_string(list_transform(p, lambda v: t[(v >> 2) + 1]), ',') AS out FROM p, c",
)
def log_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Planes of 10-bit codes through the log curve."""
    table_ = pl.curve_table(pl.log_curve(spark), "code", "linear")
    return sampled(spark, sf).select("vec_id", _show(pl.through(pl.derive_depth(F.col("p"), 10), table_)).alias("out"))


@register(
    "inverse_curve",
    f"""WITH c AS ({_CURVE}), x AS (SELECT l::INT AS level, code, abs(linear - l::INT) AS d FROM range(4096) t(l), c),
    n AS (SELECT level, arg_min(code, d * 10000 + code) AS code, min(d) AS error FROM x GROUP BY level),
    i AS (SELECT list(code ORDER BY level) AS codes, list(error ORDER BY level) AS errors FROM n), p AS ({_PLANE})
    SELECT vec_id, array_to_string(list_transform(p, lambda v: codes[v + 1]), ',') AS codes, list_max(list_transform(p, lambda v: errors[v + 1])) AS error FROM p, i""",
)
def inverse_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest code of every sample of a plane, and the largest error that the way back has."""
    inverse = pl.inverse_curve(spark, pl.log_curve(spark))
    codes_, errors = (pl.curve_table(inverse, "level", c) for c in ("code", "error"))
    return sampled(spark, sf).select(
        "vec_id", _show(pl.through(F.col("p"), codes_)).alias("codes"), F.array_max(pl.through(F.col("p"), errors)).alias("error")
    )


@register(
    "tile_regions",
    """WITH f AS (SELECT p_partkey AS k, 900 + p_size * 17 AS w, 500 + p_size * 11 AS h FROM part), g AS (SELECT *, (w + 481) // 482 AS nc, (h + 271) // 272 AS nr FROM f),
    r AS (SELECT *, unnest(range(0, nr)) AS r FROM g), c AS (SELECT *, unnest(range(0, nc)) AS c FROM r)
    SELECT k, r::INT AS r, c::INT AS c, (c * 482)::INT AS x0, (r * 272)::INT AS y0, least(482, w - c * 482)::INT AS rw, least(272, h - r * 272)::INT AS rh FROM c""",
)
def tile_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A frame's tiles."""
    f = table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"),
        (F.lit(900) + F.col("p_size") * 17).alias("w"),
        (F.lit(500) + F.col("p_size") * 11).alias("h"),
    )
    return pl.tile_regions(f, "k", "w", "h", 482, 272)


@register(
    "plane_orient",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND (p_size * ((p_partkey % 40 + 2) // 2)) % (p_partkey % 40 + 2) = 0 THEN p_size // 2 ELSE p_size END::INT AS rows, CASE WHEN p_size % 2 = 0 AND (p_size * ((p_partkey % 40 + 2) // 2)) % (p_partkey % 40 + 2) = 0 THEN p_partkey % 40 + 2 ELSE (p_partkey % 40 + 2) // 2 END::INT AS cols FROM part",
)
def plane_orient(spark: SparkSession, sf: str) -> DataFrame:
    """How a tile's columns fold into planes."""
    o = pl.plane_orient((F.col("p_partkey") % 40 + 2).cast("int"), F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", o["rows"].alias("rows"), o["cols"].alias("cols"))


@register(
    "pack_round_trip",
    f"WITH p AS ({_PLANE}) SELECT vec_id, array_to_string(p, ',') AS p12, array_to_string(list_transform(p, lambda v: v >> 2), ',') AS p10, array_to_string(list_transform(p, lambda v: v >> 4), ',') AS p8, 96::INT AS bytes12, 80::INT AS bytes10, 64::INT AS bytes8 FROM p",
)
def pack_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Samples packed at each depth, and unpacked."""
    p = sampled(spark, sf)
    a, b, c = pl.pack12("p"), pl.pack10(pl.derive_depth(F.col("p"), 10)), pl.pack8(pl.derive_depth(F.col("p"), 8))
    packed = p.select("vec_id", a.alias("a"), b.alias("b"), c.alias("c"))

    def n(x):
        return F.octet_length(x)

    return packed.select(
        "vec_id",
        _show(pl.unpack12("a")).alias("p12"),
        _show(pl.unpack10("b")).alias("p10"),
        _show(pl.unpack8("c")).alias("p8"),
        n("a").alias("bytes12"),
        n("b").alias("bytes10"),
        n("c").alias("bytes8"),
    )


@register(
    "frame_classes",
    """SELECT p_partkey, CASE WHEN comp = 1 AND tw IS NULL THEN 'raw' WHEN comp = 7 AND tw IS NOT NULL THEN CASE WHEN w = 3856 AND tw = 512 THEN 'camera-lossless' ELSE 'archive' END ELSE 'unknown' END AS class
    FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 END AS comp, CASE WHEN p_partkey % 2 = 0 THEN 512 END AS tw, CASE WHEN p_partkey % 4 = 0 THEN 3856 ELSE 4000 END AS w FROM part)""",
)
def frame_classes(spark: SparkSession, sf: str) -> DataFrame:
    """A frame's class from its structure, nulls included."""
    from loomshed.sources.frames import frame_class

    k = F.col("p_partkey")
    facts = F.struct(
        F.when(F.col("p_size") % 3 == 0, 1).when(F.col("p_size") % 3 == 1, 7).alias("compression"),
        F.when(k % 2 == 0, 512).alias("tile_width"),
        F.lit(368).alias("tile_height"),
        F.when(k % 4 == 0, 3856).otherwise(4000).alias("width"),
        F.lit(2170).alias("height"),
        F.lit(12).alias("bits"),
    )
    return table(spark, sf, "part").select("p_partkey", facts.alias("facts")).select("p_partkey", frame_class().alias("class"))

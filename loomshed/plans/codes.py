"""Queries of code lengths, block transforms, tiles as planes, candidate families and small planning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomshed.operators import codes, planes as pl, planning, plane_gates as pg
from loomshed.plans.planes import _PLANE, _PAIR, _show, H, W, pairs, sampled
from loomshed.plans.registry import register
from loomshed.session import table


@register(
    "linear_table",
    f"WITH p AS ({_PLANE}) SELECT vec_id, array_to_string(list_transform(p, lambda v: (v >> 4) * 16), ',') AS out FROM p",
)
def linear_table(spark: SparkSession, sf: str) -> DataFrame:
    """Planes of 8-bit codes through the linear table."""
    table_ = pl.curve_table(codes.linear_table(spark), "code", "linear")
    return sampled(spark, sf).select("vec_id", _show(pl.through(pl.derive_depth(F.col("p"), 8), table_)).alias("out"))


@register("code_cost")
def code_cost(spark: SparkSession, sf: str) -> DataFrame:
    """category counts of two components, and the bits that their best codes take."""
    p = pl.column_planes(F.col("p"), W)

    def counts(i):
        return codes.category_counts(pl.difference_categories(F.element_at(p, i)))

    rows = sampled(spark, sf).select("vec_id", counts(1).alias("a"), counts(2).alias("b"))
    return rows.select(
        "vec_id", _show(F.col("a")).alias("first"), _show(F.col("b")).alias("second"), codes.expected_bits("a", "b").alias("bits")
    )


def _stats_sql(values: str, name: str) -> str:
    return f"sqrt(greatest(list_sum(list_transform({values}, lambda v: v * v)) / 64.0::DOUBLE - pow(list_sum({values}) / 64.0::DOUBLE, 2), 0.0)) AS {name}"


_KIND = "CASE WHEN ({y}) % 2 = 0 AND ({x}) % 2 = 0 THEN 0 WHEN ({y}) % 2 = 1 AND ({x}) % 2 = 1 THEN 2 ELSE 1 END"


def _channel_sql(c: int) -> str:
    """SQL of a filled channel: the class's own samples, else the mean of those two steps off, else the sample itself."""
    near = ", ".join(
        f"CASE WHEN {_KIND.format(y=y, x=x)} = {c} THEN p[(({y}) * 8 + ({x}) + 1)::INT]::DOUBLE END"
        for y, x in (("i // 8", "greatest(i % 8 - 2, 0)"), ("i // 8", "least(i % 8 + 2, 7)"), ("greatest(i // 8 - 2, 0)", "i % 8"), ("least(i // 8 + 2, 7)", "i % 8"))
    )
    own = _KIND.format(y="i // 8", x="i % 8")
    return f"list_transform(range(0, 64), lambda i: CASE WHEN {own} = {c} THEN p[i + 1]::DOUBLE ELSE coalesce(list_avg([{near}]), p[i + 1]::DOUBLE) END)"


@register(
    "chroma_spread",
    f"""WITH p AS ({_PLANE}), c AS (SELECT vec_id, {_channel_sql(0)} AS w, {_channel_sql(1)} AS g, {_channel_sql(2)} AS r FROM p),
    d AS (SELECT vec_id, list_transform(range(1, 65), lambda i: w[i] - g[i]) AS wg, list_transform(range(1, 65), lambda i: g[i] - r[i]) AS gr, list_transform(range(1, 65), lambda i: w[i] - r[i]) AS wr FROM c),
    s AS (SELECT vec_id, {_stats_sql("wg", "wg")}, {_stats_sql("gr", "gr")}, {_stats_sql("wr", "wr")} FROM d) SELECT vec_id, round(wg, 6) AS wg, round(gr, 6) AS gr, round(wr, 6) AS wr FROM s""",
)
def chroma_spread(spark: SparkSession, sf: str) -> DataFrame:
    """the spread of the differences of a mosaic's classes."""
    rows = sampled(spark, sf).select("vec_id", codes.chroma_spread(F.col("p"), W, H).alias("s"))
    return rows.select("vec_id", *[F.round(F.col("s").getItem(i), 6).alias(n) for i, n in enumerate(("wg", "gr", "wr"))])


_STEPS = [16 + 2 * i for i in range(64)]


def _transform_sql() -> str:
    """The 8x8 transform and its quantiser in SQL: sums of cosines, place by place."""
    at = codes.zigzag()
    step = [0] * 64
    for i, q in zip(at, _STEPS, strict=True):
        step[i] = q
    scale = "CASE WHEN {k} = 0 THEN sqrt(0.5::DOUBLE) ELSE 1.0 END / 2"
    cos = "cos((2 * {x} + 1) * {k} * pi() / 16)"
    u, v = "(k // 8)", "(k % 8)"
    term = f"(p[j + 1] - {codes.LEVEL}) * {cos.format(x='(j // 8)', k=u)} * {cos.format(x='(j % 8)', k=v)}"
    value = f"round({scale.format(k=u)} * {scale.format(k=v)} * list_sum(list_transform(range(0, 64), lambda j: {term})), 9)"
    return f"list_transform(range(0, 64), lambda k: trunc(({value} + {step}[k + 1] / 2.0::DOUBLE) / {step}[k + 1])::INT)"


@register("quantised_blocks", f"WITH p AS ({_PLANE}) SELECT vec_id, array_to_string({_transform_sql()}, ',') AS indexes FROM p")
def quantised_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Indexes of 8x8 blocks under a table."""
    rows = sampled(spark, sf)
    return rows.select("vec_id", _show(codes.quantise(_STEPS, W, H)(rows["p"])).alias("indexes"))


def _inverse_sql() -> str:
    """Samples of coefficients c in SQL: sums of cosines, place by place."""
    scale = "CASE WHEN {k} = 0 THEN sqrt(0.5::DOUBLE) ELSE 1.0 END / 2"
    cos = "cos((2 * {x} + 1) * {k} * pi() / 16)"
    u, v = "(j // 8)", "(j % 8)"
    term = f"{scale.format(k=u)} * {scale.format(k=v)} * c[j + 1] * {cos.format(x='(i // 8)', k=u)} * {cos.format(x='(i % 8)', k=v)}"
    return f"list_transform(range(0, 64), lambda i: greatest(0, least(65535, floor(round(list_sum(list_transform(range(0, 64), lambda j: {term})), 9) + 0.5::DOUBLE)))::INT)"


@register(
    "inverse_blocks",
    f"WITH p AS ({_PLANE}), c AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN i = 0 THEN 8 * p[1] ELSE p[i + 1] - 2048 END) AS c FROM p) SELECT vec_id, array_to_string({_inverse_sql()}, ',') AS samples FROM c",
)
def inverse_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Samples from the coefficients of 8x8 blocks."""
    coefficients = F.transform("p", lambda v, i: F.when(i == 0, 8 * v).otherwise(v - 2048))
    return sampled(spark, sf).select("vec_id", _show(codes.inverse_blocks(coefficients)).alias("samples"))


@register(
    "padded_tiles",
    f"WITH p AS ({_PLANE}) SELECT vec_id, array_to_string(list_transform(range(0, 48), lambda i: p[(CASE WHEN i // 8 < 5 THEN i // 8 ELSE 3 + (i // 8 - 5) % 2 END * 8 + i % 8 + 1)::INT]), ',') AS tile, array_to_string(p[1:40], ',') AS back FROM p",
)
def padded_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """A tile of five rows padded to six, split to column planes, merged again, its padding cut off."""
    rows = sampled(spark, sf).select("vec_id", codes.padded(F.slice("p", 1, 40), W, 5, 3).alias("t"))
    merged = pl.merge_columns(pl.column_planes(F.col("t"), W), W)
    return rows.select("vec_id", _show(F.col("t")).alias("tile"), _show(codes.unpadded(merged, W, 5)).alias("back"))


_DELTA = "list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))"


@register(
    "verify_stats",
    _PAIR
    + f""", d AS (SELECT vec_id, a, b, {_DELTA} AS d FROM pr) SELECT vec_id, list_sum(d) / 64.0::DOUBLE AS mae, round(10 * log10(65025.0::DOUBLE / (list_sum(list_transform(d, lambda v: v * v)) / 64.0::DOUBLE)), 6) AS psnr, list_max(d) AS max_err,
      len(list_filter(d, lambda v: v <= 1)) * 100.0::DOUBLE / 64 AS within_one_pct, list_max(d) > 4 AS over, list_sum(d) = 0 AS same FROM d""",
)
def verify_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of a decoded plane against its source."""
    a, b = F.col("a"), F.col("b")
    lossy, log = pl.lossy_stats(a, b), pl.log_stats(a, b)
    return pairs(spark, sf).select(
        "vec_id",
        lossy["mae"].alias("mae"),
        F.round(lossy["psnr"], 6).alias("psnr"),
        lossy["max_err"].alias("max_err"),
        log["within_one_pct"].alias("within_one_pct"),
        log["broken"].alias("over"),
        pl.bit_exact(a, b).alias("same"),
    )


@register(
    "decimation_rules",
    "SELECT p_partkey, CASE WHEN p_size % 3 <> 2 AND p_partkey % 2 = 0 AND p_size % 5 <> 1 THEN 'staircase' ELSE 'phase' END AS rule FROM part",
)
def decimation_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rule of a frame's half size, from its pattern tags."""
    k, s = F.col("p_partkey"), F.col("p_size")
    two, none = F.array(F.lit(2), F.lit(2)), F.lit(None).cast("array<int>")
    repeat, old = F.when(s % 3 == 0, two), F.when(s % 3 == 1, two).otherwise(F.array(F.lit(3), F.lit(3)))
    pattern = F.array(F.lit(0), F.lit(1), F.when(k % 2 == 0, 1).otherwise(2), F.lit(2))
    origin = F.when(s % 5 == 1, F.array(F.lit(1), F.lit(0))).when(s % 5 == 2, F.array(F.lit(0), F.lit(0)))
    return table(spark, sf, "part").select(k, pl.decimation_rule(repeat, old, pattern, none, origin).alias("rule"))


@register(
    "tag_changes",
    "SELECT p_partkey, p_partkey % 4 NOT IN (1, 2) AS preserved FROM part",
)
def tag_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a frame's tags are its source's, but for those of strips and tiles."""
    k = F.col("p_partkey")

    def pair(t, v):
        return F.struct(F.lit(t).alias("key"), v.cast("string").alias("value"))

    source = F.map_from_entries(
        F.array(pair(256, F.col("p_size")), pair(271, F.col("p_brand")), pair(273, F.lit("s")), pair(279, F.lit("n")))
    )
    kept = [
        pair(256, F.when(k % 4 == 1, -1).otherwise(F.col("p_size"))),
        pair(271, F.col("p_brand")),
        *[pair(t, F.lit("t")) for t in (322, 323, 324)],
    ]
    out = F.map_from_entries(F.array_compact(F.array(*kept, F.when(k % 4 != 2, pair(325, F.lit("t"))))))
    return table(spark, sf, "part").select(k, pl.metadata_preserved(source, out).alias("preserved"))


# Frame and tile sizes that have candidates of their own, and those in the order that they are tried
# (a wrapped or natural orientation with its predictor).
FAMILIES = (
    (968, 545, 242, 274, "W6 N5"),
    (968, 545, 484, 274, "W6 N5"),
    (1008, 672, 252, 336, "W7 W6 N5"),
    (1512, 1005, 252, 252, "W7 W2 N1"),
    (1928, 1085, 964, 272, "W2 N1"),
    (1928, 1085, 482, 272, "W7 W2 N1"),
    (1936, 1090, 242, 274, "W7 W6 N5"),
    (1936, 1090, 484, 274, "W7 W6 N5"),
    (2016, 1344, 252, 336, "W7 W6 N5"),
)
DEFAULT_FAMILY = "W7 W2 N1"


def families(spark: SparkSession) -> DataFrame:
    """(w, h, tw, th, candidates) of the geometries with a family of their own."""
    return spark.createDataFrame(FAMILIES, "w int, h int, tw int, th int, c string").select(
        "w", "h", "tw", "th", F.split("c", " ").alias("candidates")
    )


_SIZES = "[968, 1008, 1928, 1936, 2016, 3856][p_partkey % 6 + 1] AS w, [545, 672, 1085, 1090, 1344, 2170][p_partkey % 6 + 1] AS h, [242, 252, 482, 484, 964][p_size % 5 + 1] AS tw, [274, 336, 272, 274, 272][p_size % 5 + 1] AS th"


@register(
    "candidate_families",
    f"""WITH f AS (SELECT p_partkey, {_SIZES} FROM part), k(w, h, tw, th, c) AS (VALUES {', '.join(str(f) for f in FAMILIES)})
    SELECT p_partkey, f.w, f.tw, coalesce(c, '{DEFAULT_FAMILY}') AS candidates FROM f LEFT JOIN k USING (w, h, tw, th)""",
)
def candidate_families(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates of a frame's geometry and grid, in order."""
    k, s = F.col("p_partkey") % 6, F.col("p_size") % 5

    def pick(of, *v):
        return F.element_at(F.array(*[F.lit(x) for x in v]), (of + 1).cast("int"))

    rows = table(spark, sf, "part").select(
        "p_partkey",
        pick(k, 968, 1008, 1928, 1936, 2016, 3856).alias("w"),
        pick(k, 545, 672, 1085, 1090, 1344, 2170).alias("h"),
        pick(s, 242, 252, 482, 484, 964).alias("tw"),
        pick(s, 274, 336, 272, 274, 272).alias("th"),
    )
    found = planning.candidate_families(families(spark), rows, ["w", "h", "tw", "th"], DEFAULT_FAMILY.split(" "))
    return found.select("p_partkey", "w", "tw", F.array_join("candidates", " ").alias("candidates"))


@register(
    "scale_search",
    """WITH RECURSIVE c AS (SELECT p_partkey, (200 + p_size * 40)::DOUBLE AS lim, p_retailprice AS t FROM part),
    g AS (SELECT p_partkey, lim, t, list_filter(list_transform(range(0, 40), lambda i: 0.05::DOUBLE * pow(2::DOUBLE, i / 5.0::DOUBLE)), lambda s: s <= 16) AS grid FROM c),
    a AS (SELECT *, list_position(list_transform(grid, lambda s: floor(t / s) <= lim), true) AS pos FROM g),
    b AS (SELECT p_partkey, lim, t, pos, CASE WHEN pos > 1 THEN grid[pos - 1] ELSE grid[1] END AS lo, CASE WHEN pos IS NULL OR pos = 0 THEN grid[len(grid)] ELSE grid[pos] END AS hi, 0 AS n FROM a
      UNION ALL SELECT p_partkey, lim, t, pos, CASE WHEN floor(t / ((lo + hi) / 2)) <= lim THEN lo ELSE (lo + hi) / 2 END, CASE WHEN floor(t / ((lo + hi) / 2)) <= lim THEN (lo + hi) / 2 ELSE hi END, n + 1 FROM b WHERE n < 6 AND pos > 1)
    SELECT p_partkey, round(hi, 9) AS scale FROM b WHERE n = CASE WHEN pos > 1 THEN 6 ELSE 0 END""",
)
def scale_search(spark: SparkSession, sf: str) -> DataFrame:
    """The finest scale whose size fits, for many frames at once."""
    rows = table(spark, sf, "part").select(
        "p_partkey", (200 + F.col("p_size") * 40).cast("double").alias("lim"), F.col("p_retailprice").alias("t")
    )
    scale = pg.finest_scale(F.col("lim"), lambda s: F.floor(F.col("t") / s))
    return rows.select("p_partkey", F.round(scale, 9).alias("scale"))


@register(
    "sample_fingerprint",
    "WITH p AS (SELECT p_partkey - 1 AS place FROM part WHERE p_partkey % 37 = 5) SELECT sha256(string_agg(place::VARCHAR, ',' ORDER BY place) || chr(10)) AS sha256, count(*) AS places FROM p",
)
def sample_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint of a sample's places."""
    return planning.fingerprint(
        table(spark, sf, "part").filter("p_partkey % 37 = 5").select((F.col("p_partkey") - 1).alias("place")), "place"
    )


@register(
    "source_totals",
    """WITH o AS (SELECT n_regionkey AS ordinal, count(DISTINCT s_suppkey) AS clips, sum(n_nationkey)::BIGINT AS files FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT ordinal, r_name AS source, clips, files, sum(clips) OVER (ORDER BY ordinal)::BIGINT AS clips_so_far, sum(files) OVER (ORDER BY ordinal)::BIGINT AS files_so_far FROM o JOIN region ON r_regionkey = ordinal""",
)
def source_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Clips and files of several sources, in the order of the arguments."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = s.select(
        F.col("n_regionkey").alias("ordinal"),
        F.col("r_name").alias("source"),
        F.col("s_suppkey").alias("clip"),
        F.col("n_nationkey").cast("long").alias("files"),
    )
    return planning.source_totals(rows, "ordinal", "source")


@register(
    "profile_places",
    "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, CASE WHEN p_size % 2 = 0 THEN p_type END, p_name) AS place FROM part",
)
def profile_places(spark: SparkSession, sf: str) -> DataFrame:
    """The first of several places that is there."""
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        planning.first_place(
            [F.when(s % 3 == 0, F.col("p_brand")), F.when(s % 2 == 0, F.col("p_type")), F.col("p_name")]
        ).alias("place"),
    )


@register("stale_files", "SELECT doc_id FROM documents WHERE doc_id % 4 IN (1, 2)")
def stale_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that an interrupted run left."""
    k = F.col("doc_id")
    end = F.when(k % 4 == 1, ".dng.tmp").when(k % 4 == 2, ".sidecar.tmp").when(k % 4 == 3, ".tmp").otherwise(".dng")
    rows = table(spark, sf, "documents").select(k, F.concat(F.lit("a/"), k.cast("string"), end).alias("rel"))
    return planning.stale_files(rows, "rel").select("doc_id")

"""Whole frames as tiles: frames of 64 x 64 samples, each of 64 vectors' 8 x 8 blocks, cut, worked on and joined."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loomshed.operators import tiles
from loomshed.operators.planes import packed
from loomshed.plans.planes import sampled
from loomshed.plans.registry import register
from loomshed.scratch import scratch, stored
from loomshed.sources import bands, tiff, trees

SIDE = 64
#: Tiles of odd shapes, so that every frame has seams, and cut ones at its edges.
TILE = (12, 20)

_PIXELS = """
    f AS (SELECT DISTINCT vec_id // 64 AS frame FROM embeddings),
    e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: greatest(0, least(4095, floor((x::DOUBLE + 0.5) * 4000)::INT)))) AS v FROM embeddings),
    a AS (SELECT frame, y, x, coalesce(v, 0) AS v FROM f, range(64) ys(y), range(64) xs(x) LEFT JOIN e ON e.vec_id = frame * 64 + y // 8 * 8 + x // 8 AND e.i = y % 8 * 8 + x % 8),
    b AS (SELECT frame, y, x, (v * 3 + y * 5 + x) % 4096 AS v FROM a)"""


def whole_frames(spark: SparkSession, sf: str) -> DataFrame:
    """(frame, width, height, a, b): a frame's blocks put together, missing ones zero, and another plane made of it."""

    def run(keys, table):
        a = np.zeros((SIDE, SIDE), "<i4")
        for i, p in zip(table.column("i").to_pylist(), table.column("p").to_pylist(), strict=True):
            a[i // 8 * 8 : i // 8 * 8 + 8, i % 8 * 8 : i % 8 * 8 + 8] = np.reshape(p, (8, 8))
        b = (a * 3 + np.arange(SIDE)[:, None] * 5 + np.arange(SIDE)) % 4096
        return pa.table(
            {
                "frame": pa.array([keys[0].as_py()], pa.int64()),
                "width": pa.array([SIDE], pa.int32()),
                "height": pa.array([SIDE], pa.int32()),
                "a": pa.array([a.tobytes()], pa.binary()),
                "b": pa.array([b.astype("<i4").tobytes()], pa.binary()),
            }
        )

    blocks = sampled(spark, sf).select(
        F.expr("vec_id div 64").alias("frame"), (F.col("vec_id") % 64).cast("int").alias("i"), "p"
    )
    return blocks.groupBy("frame").applyInArrow(run, "frame long, width int, height int, a binary, b binary")


@F.pandas_udf(T.StringType())
def _shown(planes: pd.Series) -> pd.Series:
    return planes.map(lambda p: ",".join(map(str, np.frombuffer(p, "<i4").tolist())))


def _digest(name: str) -> Column:
    return F.md5(_shown(name).cast("binary")).alias(name)


@register(
    "frame_tiles",
    f"""WITH {_PIXELS},
    box AS (SELECT a.frame, a.y, a.x, sum(n.v) // 9 AS v FROM a, range(-1, 2) dys(dy), range(-1, 2) dxs(dx)
      JOIN a n ON n.frame = a.frame AND n.y = greatest(0, least(63, a.y + dy)) AND n.x = greatest(0, least(63, a.x + dx)) GROUP BY ALL),
    tap AS (SELECT a.frame, a.y, a.x, (a.v + n.v) // 2 AS v FROM a JOIN a n ON n.frame = a.frame AND n.y = a.y AND n.x = least(63, a.x + 1)),
    mix AS (SELECT a.frame, a.y, a.x, (8000 * any_value(a.v) * count(*) - 7000 * sum(n.v)) AS top, count(*) AS c
      FROM a JOIN a n ON n.frame = a.frame AND abs(n.y - a.y) <= 2 AND abs(n.x - a.x) <= 2 GROUP BY ALL),
    half AS (SELECT frame, y // 2 AS y, x // 2 AS x, v FROM a WHERE y % 2 = (x // 2) % 2 AND x % 2 = (y // 2) % 2)
    SELECT frame, box, tap, mix, half FROM
      (SELECT frame, md5(string_agg(v::BIGINT, ',' ORDER BY y, x)) AS box FROM box GROUP BY 1) JOIN
      (SELECT frame, md5(string_agg(v::BIGINT, ',' ORDER BY y, x)) AS tap FROM tap GROUP BY 1) USING (frame) JOIN
      (SELECT frame, md5(string_agg(floor(top / c)::BIGINT, ',' ORDER BY y, x)) AS mix FROM mix GROUP BY 1) USING (frame) JOIN
      (SELECT frame, md5(string_agg(v, ',' ORDER BY y, x)) AS half FROM half GROUP BY 1) USING (frame)""",
)
def frame_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Whole frames cut in tiles with halos, smoothed, mixed and halved, and joined without seams."""
    cut = tiles.cut(whole_frames(spark, sf), ["frame"], ["a"], 2, TILE)
    same = {"box": tiles.box3, "tap": tiles.two_tap, "mix": tiles.band_mix(2)}
    one = tiles.join(tiles.map_tiles(cut, ["frame"], ["a"], same), ["frame"], list(same))
    half = tiles.join(tiles.map_tiles(cut, ["frame"], ["a"], {"half": tiles.decimate}, scale=2), ["frame"], ["half"])
    both = one.select("frame", *[_digest(n) for n in same]).join(half.select("frame", _digest("half")), "frame")
    return both.select("frame", *same, "half")


@F.pandas_udf(T.BinaryType())
def _frame_file(plane: pd.Series, frame: pd.Series) -> pd.Series:
    """A plane as a raw frame file of 12, 10 or 8 bits; of every seventh the strip is cut off."""

    def one(p: bytes, k: int) -> bytes:
        bits = (12, 10, 8)[k % 3]
        data = packed(np.frombuffer(p, "<i4") >> (12 - bits), bits)
        tags = [(256, 4, [SIDE]), (257, 4, [SIDE]), (258, 3, [bits]), (259, 3, [1]), (262, 3, [32803]), (273, 4, [0]), (277, 3, [1]), (279, 4, [len(data)])]
        return tiff.write([tags], payload=data[: len(data) // 2] if k % 7 == 6 else data)

    return pd.Series([one(bytes(p), int(k)) for p, k in zip(plane, frame, strict=True)])


@register(
    "band_statistics",
    f"""WITH {_PIXELS}, s AS (SELECT frame, v >> frame % 3 * 2 AS v FROM a)
    SELECT frame, CASE WHEN frame % 7 = 6 THEN 'strip outside the file' END AS error, CASE WHEN frame % 7 <> 6 THEN min(v) END::BIGINT AS lo, CASE WHEN frame % 7 <> 6 THEN max(v) END::BIGINT AS hi,
      CASE WHEN frame % 7 <> 6 THEN count(*) END AS n, CASE WHEN frame % 7 <> 6 THEN sum(v) END::BIGINT AS total, CASE WHEN frame % 7 <> 6 THEN sum(v * v) END::BIGINT AS squares FROM s GROUP BY frame""",
)
def band_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of packed frames, read from their files in bands of rows."""
    root = scratch(spark, "packed")
    rows = whole_frames(spark, sf)
    name = F.format_string("c/f%d.dng", "frame")
    trees.write_files(rows.select(name.alias("rel"), _frame_file("a", "frame").alias("content")), root)
    listed = stored(bands.frame_bands(spark, root, samples=700, window=256), "bands")
    frames_ = listed.select("rel", "error").distinct().join(bands.frame_statistics(listed, root), "rel", "left")
    frame = F.regexp_extract("rel", "f([0-9]+)", 1).cast("long").alias("frame")
    return frames_.select(frame, "error", "lo", "hi", "n", "total", F.col("squares").cast("long").alias("squares"))


def _spread_sql(of: str) -> str:
    return f"sqrt(greatest(avg({of} * {of}) - avg({of}) * avg({of}), 0.0))"


@register(
    "frame_measures",
    f"""WITH {_PIXELS},
    p AS (SELECT a.frame, a.y, a.x, a.v AS a, b.v AS b FROM a JOIN b USING (frame, y, x)),
    s AS (SELECT p.frame, p.y, p.x, p.a, p.b, r.a - p.a AS ra, r.b - p.b AS rb, d.a - p.a AS da, d.b - p.b AS db FROM p
      LEFT JOIN p r ON r.frame = p.frame AND r.y = p.y AND r.x = p.x + 1 LEFT JOIN p d ON d.frame = p.frame AND d.y = p.y + 1 AND d.x = p.x),
    m AS (SELECT frame, {_spread_sql("ra::DOUBLE")} / {_spread_sql("rb::DOUBLE")} AS h, {_spread_sql("da::DOUBLE")} / {_spread_sql("db::DOUBLE")} AS v,
      sum(abs(a - b)) FILTER (x IN (19, 20)) / 128.0::DOUBLE AS on_seam, sum(abs(a - b)) FILTER (x BETWEEN 14 AND 18 OR x BETWEEN 22 AND 26) / 640.0::DOUBLE AS sides,
      avg(ra) FILTER (x = 19 AND abs(rb) < 900) AS step FROM s GROUP BY frame)
    SELECT frame, round(h, 9) AS h, round(v, 9) AS v, round(CASE WHEN sides < 0.05 THEN on_seam * 1.5 ELSE on_seam / sides END, 9) AS ratio, round(step, 6) AS step FROM m""",
)
def frame_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Step spreads, and the seam at column 20, of whole frames, as sums over tiles."""
    cut = tiles.cut(whole_frames(spark, sf), ["frame"], ["a", "b"], 1, TILE)
    spreads = tiles.structure_ratios(cut, ["frame"], "a", "b")
    seam = tiles.seams(cut, ["frame"], "a", "b", 20, True, 5, 900)
    step = F.round(F.when(~F.isnan("step"), F.col("step")), 6)
    return spreads.join(seam, "frame").select(
        "frame", F.round("h", 9).alias("h"), F.round("v", 9).alias("v"), F.round("ratio", 9).alias("ratio"), step.alias("step")
    )

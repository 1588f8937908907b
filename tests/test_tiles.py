"""Operators on tiles: equal to the whole plane whatever the tiles, and to the expressions over arrays."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomshed.operators import codes, plane_gates as pg, planes as pl, tiles

W, H = 52, 40


def plane(seed, w=W, h=H, top=4096):
    return np.random.default_rng(seed).integers(0, top, (h, w), dtype=np.int32)


@pytest.fixture(scope="module")
def frames(spark):
    rows = []
    for k in range(3):
        a = plane(k)
        b = (a // 7 + plane(k + 10, top=30)).astype(np.int32)
        rows.append((f"f{k}", W, H, bytearray(a.tobytes()), bytearray(b.tobytes())))
    return spark.createDataFrame(rows, "id string, width int, height int, a binary, b binary").repartition(2)


SIZES = [(H, W), (4, 4), (12, 20), (16, 64), (100, 8)]


def whole(df, name, shape):
    return {r.id: np.frombuffer(r[name], "<i4").reshape(shape) for r in df.collect()}


@pytest.mark.parametrize("size", SIZES)
def test_tiles_join_without_seams(frames, size):
    held = tiles.cut(frames, ["id"], ["a", "b"], halo=3, tile=size)
    back = whole(tiles.join(held, ["id"], ["a", "b"]), "b", (H, W))
    for r in frames.collect():
        assert (back[r.id] == np.frombuffer(r.b, "<i4").reshape(H, W)).all()


@pytest.mark.parametrize("size", SIZES)
def test_samples_do_not_depend_on_the_tiles(frames, size):
    out = {"box": tiles.box3, "tap": tiles.two_tap, "mix": tiles.band_mix(3)}
    got = tiles.join(tiles.map_tiles(tiles.cut(frames, ["id"], ["a"], 3, size), ["id"], ["a"], out), ["id"], list(out))
    for r in frames.collect():
        a = np.frombuffer(r.a, "<i4").reshape(H, W)
        p = np.pad(a, 1, mode="edge")
        box = sum(p[dy : dy + H, dx : dx + W] for dy in range(3) for dx in range(3)) // 9
        tap = (a + np.concatenate([a[:, 1:], a[:, -1:]], 1)) // 2
        mix = np.zeros((H, W), np.int64)
        for y in range(H):
            for x in range(W):
                part = a[max(y - 3, 0) : y + 4, max(x - 3, 0) : x + 4]
                mix[y, x] = (8000 * int(a[y, x]) * part.size - 7000 * int(part.sum())) // part.size
        for name, want in (("box", box), ("tap", tap), ("mix", mix)):
            assert (whole(got, name, (H, W))[r.id] == want).all(), name


@pytest.mark.parametrize("size", SIZES)
def test_half_sizes_and_phases(spark, frames, size):
    cut = tiles.cut(frames, ["id"], ["a"], 0, size)
    out = {"stairs": tiles.decimate, "blocks": lambda r, a: tiles.decimate(r, a, False), **{f"p{i}": tiles.phase(i) for i in range(4)}}
    got = tiles.join(tiles.map_tiles(cut, ["id"], ["a"], out, scale=2), ["id"], list(out)).orderBy("id").collect()
    lists = [(r.id, np.frombuffer(r.a, "<i4").tolist()) for r in frames.collect()]
    df = spark.createDataFrame(lists, "id string, p array<int>")
    want = df.select(
        "id",
        pl.decimate(F.col("p"), W, H).alias("stairs"),
        pl.decimate(F.col("p"), W, H, False).alias("blocks"),
        *[pl.deinterleave(F.col("p"), W, H)[i].alias(f"p{i}") for i in range(4)],
    ).orderBy("id").collect()
    for g, w in zip(got, want, strict=True):
        for name in out:
            assert np.frombuffer(g[name], "<i4").tolist() == w[name], name


@pytest.mark.parametrize("size", SIZES)
def test_measures_equal_those_of_arrays(spark, frames, size):
    cut = tiles.cut(frames, ["id"], ["a", "b"], 2, size)
    lists = [(r.id, np.frombuffer(r.a, "<i4").tolist(), np.frombuffer(r.b, "<i4").tolist()) for r in frames.collect()]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(lists, "id string, a array<int>, b array<int>")
    h, v = pg.structure_ratios(a, b, W, H)
    want = {
        r.id: r
        for r in df.select(
            "id",
            h.alias("h"),
            v.alias("v"),
            codes.chroma_spread(a, W, H, 1, 0).alias("chroma"),
            pg.seam_ratio(a, b, W, H, 20, True, 5).alias("across"),
            pg.flat_step(a, b, W, H, 20, True, 200).alias("step"),
            pg.seam_ratio(a, b, W, H, 16, False, 5).alias("down"),
        ).collect()
    }
    for r in tiles.structure_ratios(cut, ["id"], "a", "b").collect():
        assert (r.h, r.v) == pytest.approx((want[r.id].h, want[r.id].v), rel=1e-9)
    for r in tiles.chroma_spread(cut, ["id"], "a", 1, 0).collect():
        assert [r.wg, r.gr, r.wr] == pytest.approx(want[r.id].chroma, rel=1e-9)
    for r in tiles.seams(cut, ["id"], "a", "b", 20, True, 5, 200).collect():
        assert (r.ratio, r.step) == pytest.approx((want[r.id].across, want[r.id].step), rel=1e-9)
    for r in tiles.seams(cut, ["id"], "a", "b", 16, False, 5).collect():
        assert r.ratio == pytest.approx(want[r.id].down, rel=1e-9)


def test_faults_raise(spark, frames):
    with pytest.raises(Exception, match="samples for"):
        tiles.cut(frames.withColumn("height", F.lit(H + 1)), ["id"], ["a"])
    with pytest.raises(Exception, match="halo"):
        tiles.map_tiles(tiles.cut(frames, ["id"], ["a"], 0, (8, 8)), ["id"], ["a"], {"o": tiles.box3})
    cut = tiles.cut(frames, ["id"], ["a"], 0, (8, 8))
    with pytest.raises(Exception, match="for a frame"):
        tiles.join(cut.filter("y > 0"), ["id"], ["a"]).collect()
    assert tiles.join(tiles.cut(frames.limit(0), ["id"], ["a"]), ["id"], ["a"]).count() == 0


def test_a_whole_frame_takes_a_second_or_two():
    """All samples of a 3856 x 2170 plane, tile by tile, in one task."""
    w, h = 3856, 2170
    a = plane(1, w, h)
    began = time.process_time()
    for r in tiles._regions(w, h, (tiles.SIDE, tiles.SIDE), 16):
        part = a[r.y - r.top : r.y + r.rows + 16, r.x - r.left : r.x + r.cols + 16]
        assert tiles.box3(r, part).shape == (r.rows, r.cols)
    assert time.process_time() - began < 2.0

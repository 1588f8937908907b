"""Packed frames read in bands: equal to their samples whatever the bands, broken frames named."""

import numpy as np
import pytest

from loomshed.operators.planes import packed, unpacked
from loomshed.session import ship
from loomshed.sources import bands, tiff, trees

SHAPES = [(12, 6, 8), (12, 6, 10), (7, 10, 12), (8, 9, 12), (3856, 40, 12)]


def frame(samples: np.ndarray, bits: int, cut: int = 0) -> bytes:
    h, w = samples.shape
    data = packed(samples.ravel(), bits)
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits]), (259, 3, [1]), (262, 3, [32803]), (273, 4, [0]), (277, 3, [1]), (279, 4, [len(data)])]
    out = tiff.write([tags], payload=data)
    return out[: len(out) - cut] if cut else out


@pytest.mark.parametrize("bits", [8, 10, 12])
def test_packing_round_trips(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 40)
    assert (unpacked(packed(x, bits), bits) == x).all()
    with pytest.raises(ValueError):
        packed([1 << bits] * 4, bits)


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    ship(spark)
    root, r, held = str(tmp_path_factory.mktemp("frames")), np.random.default_rng(4), {}
    for i, (w, h, bits) in enumerate(SHAPES):
        held[f"c/f{i}.dng"] = (r.integers(0, 1 << bits, (h, w), dtype=np.int32), bits)
    rows = [(rel, frame(*v)) for rel, v in held.items()]
    rows += [("c/short.dng", frame(*held["c/f0.dng"], cut=9)), ("c/none.dng", b"no frame"), ("c/other.txt", b"x")]
    trees.write_files(spark.createDataFrame(rows, "rel string, content binary"), root)
    return root, held


@pytest.mark.parametrize("samples", [1, 30, 5000, 1 << 20])
def test_statistics_do_not_depend_on_the_bands(spark, tree, samples):
    root, held = tree
    listed = bands.frame_bands(spark, root, samples, window=128)
    assert {(r.rel, r.error) for r in listed.filter("error is not null").collect()} == {
        ("c/short.dng", "strip outside the file"),
        ("c/none.dng", "not a TIFF"),
    }
    for r in listed.filter("error is null").collect():
        assert r.first_row * r.width * r.bits % 8 == 0 and (r.first_row * r.width) % {8: 1, 10: 4, 12: 2}[r.bits] == 0
    got = {r.rel: r for r in bands.frame_statistics(listed, root).collect()}
    assert got.keys() == held.keys()
    for rel, (x, _) in held.items():
        x, r = x.astype(np.int64), got[rel]
        assert (r.lo, r.hi, r.n, r.total, int(r.squares)) == (x.min(), x.max(), x.size, x.sum(), (x * x).sum())


def test_bands_are_the_rows(spark, tree):
    root, held = tree
    listed = bands.frame_bands(spark, root, 20)
    rows = bands.map_bands(listed, root, lambda s, y, w: {"y": y, "v": s.ravel().tolist()}, "y int, v array<int>").collect()
    for rel, (x, _) in held.items():
        parts = sorted((r.y, r.v) for r in rows if r.rel == rel)
        assert sum((v for _, v in parts), []) == x.ravel().tolist()
    assert len(rows) > len(held)


def test_an_empty_tree(spark, tmp_path):
    ship(spark)
    assert bands.frame_statistics(bands.frame_bands(spark, str(tmp_path)), str(tmp_path)).count() == 0

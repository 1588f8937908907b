"""Trees of files by executors: ranged reads, a sink with one file a row, and copies to several folders."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from loomshed.scratch import stored
from loomshed.session import ship
from loomshed.sources import frames, tiff, trees


def frame(width: int, far: int = 0, pixels: int = 64) -> bytes:
    """A frame whose pixels stand before or, with ``far``, between its directory's values and its end."""
    directories = [[(256, 4, [width]), (257, 4, [2]), (258, 3, [8]), (259, 3, [1]), (271, 2, [*b"maker", 0])]]
    data = tiff.write(directories, payload=b"\1" * pixels)
    if not far:
        return data
    # The text of tag 271 moved behind the pixels, as some writers place it.
    data = bytearray(data + b"\0" * far)
    at = len(data)
    entry = data.index((271).to_bytes(2, "little") + (2).to_bytes(2, "little"))
    data[entry + 8 : entry + 12] = at.to_bytes(4, "little")
    return bytes(data) + b"maker\0"


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    """200 frames in three folders, one of them hot, with shadow files, a broken frame and others."""
    ship(spark)
    root = str(tmp_path_factory.mktemp("tree"))
    rows = [(f"hot/f{i:04d}.dng", frame(4 + i, far=300_000 if i % 50 == 0 else 0, pixels=2_000_000 if i == 7 else 64)) for i in range(150)]
    rows += [(f"a/b/f{i}.DNG", frame(4)) for i in range(40)]
    rows += [("a/._f1.dng", b"shadow"), ("a/note.txt", b"x"), ("top.dng", frame(9)), ("a/broken.dng", b"II*\0" + b"\xff" * 40), ("a/empty.dng", None)]
    trees.write_files(spark.createDataFrame(rows, "rel string, content binary").repartition(5), root)
    return root, rows


def test_the_sink_writes_one_file_a_row_and_leaves_nothing_else(tree):
    root, rows = tree
    found = {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names}
    assert {f for f in found if not f.endswith(".crc")} == {rel for rel, _ in rows}
    assert not [d for d, *_ in os.walk(root) if trees.STAGE in d]
    for rel, data in rows:
        with open(f"{root}/{rel}", "rb") as f:
            assert f.read() == (data or b"")


@pytest.mark.parametrize("window", [64, 4096, 1 << 20])
def test_ranged_facts_equal_those_of_whole_files(spark, tree, window):
    root, rows = tree
    got = {r.rel: r for r in trees.frame_files(spark, root, window=window, slice=17).collect()}
    want = {rel: frames.facts_of(data or b"") for rel, data in rows if rel.lower().endswith(".dng") and "._" not in rel}
    assert got.keys() == want.keys()
    for rel, facts in want.items():
        assert {k: got[rel][k] for k in facts if k != "error"} == {k: v for k, v in facts.items() if k != "error"}
        assert (got[rel].error is None) == (facts["error"] is None)
        assert got[rel].length == len(dict(rows)[rel] or b"")
    assert got["hot/f0001.dng"].clip == "hot" and got["a/b/f3.DNG"].stem == "f3"


def test_bytes_that_are_read_do_not_grow_with_the_pixels(spark, tree):
    root, _ = tree
    told = trees.frame_files(spark, root, ["rel", "length", "bytes_read"], window=4096)
    rows = {r.rel: r for r in told.collect()}
    assert rows["hot/f0007.dng"].length > 2_000_000 and rows["hot/f0007.dng"].bytes_read == 4096
    assert rows["hot/f0050.dng"].bytes_read <= 4096 + 2 * trees.BLOCK
    assert sum(r.bytes_read for r in rows.values()) < 0.2 * sum(r.length for r in rows.values())


def test_no_byte_is_read_without_a_fact(spark, tree, monkeypatch):
    root, _ = tree
    reader = trees.FrameReader(frames_schema("rel", "length"), {"path": root})
    monkeypatch.setattr(trees.FrameReader, "_told", lambda *a: pytest.fail("a file was opened"))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 193 and ("top.dng", len(frame(9))) in rows


def frames_schema(*names):
    whole = trees.FrameFiles({}).schema()
    return type(whole)([whole[n] for n in names])


def test_slices_cover_a_hot_folder_once(tree):
    root, _ = tree
    reader = trees.FrameReader(frames_schema("rel"), {"path": root, "slice": "10"})
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) >= 19 and len(rows) == len(set(rows)) == 193
    assert max(sum(1 for _ in reader.read(p)) for p in parts) <= 10


def seen(path) -> list[str]:
    """What a reader sees of a folder."""
    return [n for n in os.listdir(path) if not n.startswith(trees.STAGE)]


@pytest.mark.parametrize("bad", [None, "", "/abs", "a/../b", "a//b", "dir/", "./a"])
def test_names_that_leave_the_folder_fail_the_write(spark, tmp_path, bad):
    ship(spark)
    rows = spark.createDataFrame([("fine", b"1"), (bad, b"2")], "rel string, content binary")
    with pytest.raises(Exception, match="no name of a file"):
        trees.write_files(rows, str(tmp_path))
    assert not seen(tmp_path)


def test_a_name_given_twice_fails_the_write(spark, tmp_path):
    ship(spark)
    rows = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("a", b"3")], "rel string, content binary").repartition(3)
    with pytest.raises(Exception, match="twice"):
        trees.write_files(rows, str(tmp_path))
    assert not seen(tmp_path)


def test_a_task_that_dies_leaves_no_file(spark, tmp_path):
    ship(spark)

    def boom(batches):
        for b in batches:
            yield b
            raise RuntimeError("killed")

    rows = spark.range(50).select(F.format_string("f%d", "id").alias("rel"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="killed"):
        trees.write_files(rows.mapInArrow(boom, rows.schema), str(tmp_path))
    assert not seen(tmp_path)


def test_an_existing_file_is_replaced(spark, tmp_path):
    ship(spark)
    for data in (b"one", b"two"):
        trees.write_files(spark.createDataFrame([("d/a", data)], "rel string, content binary"), str(tmp_path))
    assert (tmp_path / "d/a").read_bytes() == b"two" and os.listdir(tmp_path) == ["d"]


# Copies.


def plan(spark, rels, dests):
    return spark.createDataFrame([(r, dests) for r in rels], "rel string, dests array<string>")


def test_copies_arrive_whole_in_every_folder(spark, tree, tmp_path):
    root, rows = tree
    dests = [str(tmp_path / d) for d in ("x", "y")]
    got = {(r.rel, r.dest): r for r in trees.copy_files(root, plan(spark, [r for r, _ in rows], dests)).collect()}
    assert len(got) == 2 * len(rows)
    for rel, data in rows:
        for d in dests:
            r = got[rel, d]
            assert (r.verdict, r.size, r.sha256) == ("COPIED", len(data or b""), hashlib.sha256(data or b"").hexdigest())
            with open(f"{d}/{rel}", "rb") as f:
                assert f.read() == (data or b"")
    left = [f for d in dests for _, _, names in os.walk(d) for f in names if f.startswith(trees.STAGE)]
    assert not left


def test_a_target_or_source_that_fails_is_told_and_harms_no_other(spark, tree, tmp_path):
    root, _ = tree
    (tmp_path / "file").write_text("a file where a folder should be")
    fine, bad = str(tmp_path / "fine"), str(tmp_path / "file")
    told = {(r.rel, r.dest): r.verdict.split(":")[0] for r in trees.copy_files(root, plan(spark, ["top.dng", "gone.dng"], [fine, bad])).collect()}
    assert told == {
        ("top.dng", fine): "COPIED",
        ("top.dng", bad): "COPY_FAIL",
        ("gone.dng", fine): "SOURCE_FAIL",
        ("gone.dng", bad): "SOURCE_FAIL",
    }
    assert os.listdir(fine) == ["top.dng"]


def test_a_second_attempt_does_no_damage(spark, tree, tmp_path):
    """An attempt that dies between two chunks, another that runs beside it, and the sweep."""
    root, rows = tree
    target, data = str(tmp_path / "t"), dict(rows)["hot/f0007.dng"]

    class Dies(Exception):
        pass

    whole, calls = trees.hashlib.sha256, []

    class Hash:
        def __init__(self):
            self.h = whole()

        def update(self, chunk):
            calls.append(len(chunk))
            if len(calls) == 2:
                raise Dies
            self.h.update(chunk)

        def hexdigest(self):
            return self.h.hexdigest()

    with pytest.MonkeyPatch.context() as m:
        m.setattr(trees.hashlib, "sha256", Hash)
        with pytest.raises(Dies):
            trees._fan_out(root, "hot/f0007.dng", [target], "job", 1)
    assert os.listdir(f"{target}/hot") == []
    for attempt in (2, 3):
        (row,) = trees._fan_out(root, "hot/f0007.dng", [target], "job", attempt)
        assert row[3] == hashlib.sha256(data).hexdigest()
    assert os.listdir(f"{target}/hot") == ["f0007.dng"]


def test_reading_the_record_again_copies_nothing(spark, tree, tmp_path):
    root, _ = tree
    dest = str(tmp_path / "d")
    told = trees.copy_files(root, plan(spark, ["top.dng"], [dest]))
    os.remove(f"{dest}/top.dng")
    assert told.count() == 1 and stored(told, "again").count() == 1 and not os.listdir(dest)

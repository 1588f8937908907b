"""Trees and records: what passes the driver or one task does not grow with the tree."""

import os

import pytest

from loomshed.session import ship
from loomshed.sources import frames, records, trees


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    """Files with odd names and bytes, hidden ones among them."""
    ship(spark)
    root = str(tmp_path_factory.mktemp("odd tree"))
    rows = [(f"c{i % 3}/f{i}.dng", b"x" * i) for i in range(60)]
    rows += [(n, b"1") for n in ("a b/%41+é.dng", "_hid/x.dng", ".hid/x.dng", "c0/.y", "c0/_y", "c0/_k=1", "c0/._f.dng", "top", "deep/er/z.txt")]
    trees.write_files(spark.createDataFrame(rows, "rel string, content binary").repartition(4), root)
    return root, dict(rows)


def test_frames_are_listed_by_executors_as_spark_would(spark, tree):
    root, rows = tree
    found = frames.files(spark, root)
    assert not any("odd%20tree" in f or "odd tree" in f for f in found.inputFiles())
    got = {r.rel: r for r in found.collect()}
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    want = {r.path.split("/odd tree0/")[1]: r for r in theirs.collect()}
    # Spark's reader passes over empty files, which are files of a tree like others.
    assert got.keys() == {k for k in want if "._" not in k} | {"c0/f0.dng"} and "c0/_k=1" in got and "a b/%41+é.dng" in got
    assert all((got[k].length, got[k].content) == (len(rows[k]), rows[k]) for k in got)
    assert {r.rel for r in frames.files(spark, root, "{f1,f2}?.[dx]ng").collect()} == {f"c{i % 3}/f{i}.dng" for i in range(10, 30)}


def test_digests_are_made_where_files_lie(spark, tree):
    import hashlib

    from loomshed.functions.hashing import crc32c_bytes

    root, rows = tree
    got = frames.digests(frames.files(spark, root), crc=True).collect()
    assert len(got) > 60
    for r in got:
        assert (r.d_size, r.d_sha256, r.d_crc32c) == (len(rows[r.rel]), hashlib.sha256(rows[r.rel]).hexdigest(), crc32c_bytes(rows[r.rel]))


def test_the_driver_renames_nothing(spark, tmp_path, monkeypatch):
    ship(spark)
    driver, moved = os.getpid(), trees._moved

    def checked(*a):
        assert os.getpid() != driver
        moved(*a)

    monkeypatch.setattr(trees, "_moved", checked)
    rows = spark.createDataFrame([(f"d{i % 2}/f{i}", b"x") for i in range(20)], "rel string, content binary")
    trees.write_files(rows, str(tmp_path))
    assert sum(len(n) for _, _, n in os.walk(tmp_path)) == 20


def test_a_rename_that_is_repeated_finds_the_file_there(tmp_path):
    fs, path = trees.opened(str(tmp_path))
    (tmp_path / "t").write_bytes(b"x")
    for _ in range(2):
        trees._moved(fs, f"{path}/t", f"{path}/f")
    with pytest.raises(FileNotFoundError):
        trees._moved(fs, f"{path}/t", f"{path}/g")


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines_of_named_files_equal_those_of_sparks_reader(spark, tmp_path, monkeypatch, size):
    ship(spark)
    texts = {"a": b"h\r\none\r\n\r\nlast", "b": b"x\n\n\ny\n", "c": b"", "d %41+\xc3\xa9": b"k: v\n\xff\xfe\tz\n" + b"w" * 100, "e": b"\n"}
    for name, data in texts.items():
        (tmp_path / f"{os.fsdecode(name.encode('latin-1'))}.tsv").write_bytes(data)
    for n in range(3):
        (tmp_path / f"part-0000{n}-{'0' * 36}-c000.tsv").write_text(f"p{n}\nq\n")
    want = sorted(map(str, records.text_lines(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(records, "RANGE", size)
    found = records.text_lines(spark, str(tmp_path), "*.tsv")
    assert sorted(map(str, found.collect())) == want and not any(str(tmp_path) in f for f in found.inputFiles())


def test_a_record_of_wide_rows_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 2_000)
    rows = spark.createDataFrame([(f"f{i:04d}", i, "x" * 90) for i in range(200)], "file string, size long, sha256 string")
    records.write_sources(rows, str(tmp_path / "r"), "# m")
    assert len([f for f in os.listdir(tmp_path / "r") if f.startswith("part-")]) > 5
    found, bad = records.read_sources(spark, str(tmp_path / "r"))
    assert sorted(r.size for r in found.collect()) == [*range(200)] and bad.count() == 0

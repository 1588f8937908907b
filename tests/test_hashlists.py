"""Hash lists, reports and scale search against small hand-made cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomshed.functions.hashing import c4_bytes, c4_of_digest
from loomshed.operators import plane_gates
from loomshed.session import ship
from loomshed.sources import hashlists, reports


def c4(data: bytes) -> str:
    return c4_of_digest(hashlib.sha512(data).digest())


def brute(files, base=""):
    """(content, structure) of the folder ``base`` by recursion."""
    kids, content, structure = {}, [], []
    for p, h in files.items():
        if p.startswith(base):
            kids.setdefault(p[len(base) :].split("/")[0], []).append((p, h))
    for name, inside in kids.items():
        c, s = (inside[0][1],) * 2 if inside[0][0] == base + name else brute(files, base + name + "/")
        content.append(c)
        structure.append(c4(name.encode() + c4_bytes(s)))
    fold = lambda ids: c4(b"".join(c4_bytes(i) for i in sorted(ids)))
    return fold(content), fold(structure)


FILES = {p: c4(p.encode()) for p in ("a/x.dng", "a/y.dng", "a/b/c/z.dng", "top.txt", "d/e.txt")}


def test_directory_hashes(spark):
    ship(spark)
    got = {r.dir: (r.content, r.structure) for r in hashlists.directory_hashes(spark.createDataFrame(list(FILES.items()), "path string, c4 string")).collect()}
    assert set(got) == {"", "a", "a/b", "a/b/c", "d"}
    for d, hashes in got.items():
        assert hashes == brute(FILES, d + "/" if d else "")
    assert hashlists.directory_hashes(spark.createDataFrame([], "path string, c4 string")).count() == 0


def test_hash_list_round_trip_and_verdicts(spark, tmp_path):
    ship(spark)
    rows = [{"path": p, "size": len(p), "c4": h} for p, h in FILES.items()]
    content, structure = brute(FILES)
    text = hashlists.render("card", rows, {"content": content, "structure": structure})
    assert text == hashlists.render("card", rows[::-1], {"content": content, "structure": structure})
    (tmp_path / "0001.mhl").write_text(text)
    listed = hashlists.read_hash_lists(spark, str(tmp_path))
    assert {r.path: r.c4 for r in listed.collect()} == FILES
    disk = spark.createDataFrame([("a/x.dng", 7, FILES["a/x.dng"]), ("a/y.dng", 9, "c4"), ("top.txt", 7, "c4"), ("d/e.txt", 7, FILES["d/e.txt"])], "path string, d_size int, d_c4 string")
    got = {r.path: r.verdict for r in hashlists.verify(listed, disk).collect()}
    assert got == {"a/x.dng": "OK", "a/y.dng": "SIZE", "a/b/c/z.dng": "MISSING", "top.txt": "C4", "d/e.txt": "OK"}


@pytest.mark.parametrize(
    "text",
    [
        "<hashlist><hash><path>../x</path><c4>" + c4(b"") + "</c4></hash></hashlist>",
        "<hashlist><hash><path>/x</path></hash></hashlist>",
        "<hashlist><hash><path>x</path><c4>bad</c4></hash></hashlist>",
        "<!DOCTYPE a><hashlist/>",
        "<hashlist>",
        "<hashlist><hash/></hashlist>",
    ],
)
def test_hostile_lists_are_refused(text):
    with pytest.raises(Exception):  # noqa: B017
        hashlists.parse_list(text)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("c", 'a,"b"', 5, "s", None, "OK", True, 7), ("c", "<x>", 6, "s", "d", "SIZE", False, 8)], "clip string, file string, size_bytes long, source_sha256 string, dest_sha256 string, verdict string, skipped boolean, copied_ms long")
    assert {r.line for r in reports.csv_lines(rows).collect()} == {"c,<x>,6,s,d,SIZE,0,8", 'c,"a,""b""",5,s,,OK,1,7'}
    assert any("<td>&lt;x&gt;</td>" in r.line for r in reports.html_lines(rows).collect())
    assert any(r.line.startswith("| `<x>` | 6 |") for r in reports.markdown_lines(rows).collect())
    reports.write(reports.csv_lines(rows), ",".join(reports.COLUMNS), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()][0] == ",".join(reports.COLUMNS)
    clips = spark.createDataFrame([("c",), ("empty",)], "clip string")
    assert {r.clip: (r.files, r["size"]) for r in reports.totals(rows, clips).collect()} == {"c": (2, 11), "empty": (0, 0)}
    pins = spark.createDataFrame([("zlib", "1", "lock-grep x"), ("cjxl/djxl", "2", "version-contains"), ("t", "3", "toml-grep"), ("s", "4", "sha256-equal")], "component string, expected string, probe string")
    assert reports.canonical_pins(pins, "9").first().pins == "cjxl=2; djxl=2; tool=9; zlib=1"


def test_scale_search():
    size = lambda s: int(1000 / s)
    got = plane_gates.search_scale(700, size)
    assert size(got) <= 700 and size(got * 0.98) > 700
    assert plane_gates.search_scale(0, lambda s: 1) == pytest.approx(0.05 * 2 ** (39 / 5))
    assert plane_gates.search_scale(10**9, size) == pytest.approx(0.05)


def test_flat_source_has_no_ratio(spark):
    df = spark.createDataFrame([([1] * 4, [1, 2, 3, 4])], "s array<int>, d array<int>")
    h, v = plane_gates.structure_ratios(F.col("d"), F.col("s"), 2, 2)
    r = df.select(h.alias("h"), v.alias("v")).first()
    assert r.h != r.h and r.v != r.v

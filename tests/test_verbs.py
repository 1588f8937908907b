"""One-call jobs over small folders."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomshed import verbs
from loomshed.functions.hashing import crc32c_bytes
from loomshed.session import ship
from loomshed.sources import records, tiff

FRAME = [(256, 4, [16]), (257, 4, [8]), (258, 3, [12]), (259, 3, [1]), (262, 3, [32803]), (271, 2, list(b"M\0")), (272, 2, list(b"m\0")), (273, 4, [0]), (277, 3, [1]), (279, 4, [192])]


def put(root, files):
    for rel, data in files.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(data)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def sidecar(files):
    return "".join(["file\tsize\tcrc32c\tsha256\n", *(f"{n}\t{len(d)}\t{crc32c_bytes(d):08x}\t{sha(d)}\n" for n, d in files.items())]).encode()


@pytest.fixture
def card(spark, tmp_path):
    ship(spark)
    frames = {f"A_{i:06d}.dng": tiff.write([FRAME], payload=bytes([i]) * 192) for i in (1, 2, 3, 5)}
    put(tmp_path / "card", {f"c1/{n}": d for n, d in frames.items()})
    put(tmp_path / "card", {"c2/B_000001.dng": b"broken", "c2/notes.txt": b"n"})
    return tmp_path, frames


def test_checksums_and_audit(spark, card):
    root, frames = card
    held = {**frames, "A_000009.dng": b"gone"}
    put(root / "card", {"c1/x.checksums.tsv": sidecar(held)})
    (root / "card/c1/A_000002.dng").write_bytes(b"other size")
    got = verbs.verify_checksums(spark, str(root / "card"))
    assert {r.rel: r.verdict for r in got.rows.collect()} == {"c1/A_000001.dng": "ok", "c1/A_000002.dng": "size", "c1/A_000003.dng": "ok", "c1/A_000005.dng": "ok", "c1/A_000009.dng": "missing"}
    assert tuple(got.summary.first()) == (5, 2, "FAIL", 1)
    row = lambda rel, d: f"{rel}\t{len(d)}\t{sha(d)}\t-\tOK\n"
    text = "# m\ndest: {}\n" + "\t".join(records.OFFLOAD[0]) + "\n"
    put(root / "card", {"a.offload-manifest.tsv": (text.format("/a") + row("c2/notes.txt", b"n") + row("c9/x", b"x")).encode(), "b.offload-manifest.tsv": (text.format("/b") + row("c2/notes.txt", b"n")).encode()})
    put(root / "card", {"s.sources.tsv": ("# m\n" + "\t".join(records.SOURCES[0]) + f"\nc2/notes.txt\t1\t{sha(b'n')}\nc2/notes2.txt\t1\t{sha(b'n')}\n").encode()})
    put(root / "dest", {"c2/notes.txt": b"n"})
    got = verbs.audit(spark, str(root / "card"), str(root / "dest"), {"/a": str(root / "dest")})
    rows = sorted((r.record, r.rel, r.verdict) for r in got.rows.filter("record <> 'checksums'").collect())
    assert rows == [("offload", "c2/notes.txt", "DEST_MISSING"), ("offload", "c2/notes.txt", "OK"), ("offload", "c9/x", "MISSING"), ("sources", "c2/notes.txt", "OK"), ("sources", "c2/notes2.txt", "MISSING")]
    assert got.summary.first().bad == 5


def test_diff_and_offload_and_repair(spark, card):
    root, frames = card
    put(root / "copy", {f"c1/{n}": d for n, d in list(frames.items())[:3]})
    (root / "copy/c1/A_000002.dng").write_bytes(b"changed")
    got = verbs.diff(spark, str(root / "card"), str(root / "copy"))
    assert {(r.clip, r.stem): r.verdict for r in got.rows.collect()} == {("c1", "A_000001"): "IDENTICAL", ("c1", "A_000002"): "DELTA", ("c1", "A_000003"): "IDENTICAL", ("c1", "A_000005"): "MISSING", ("c2", "B_000001"): "MISSING"}
    assert got.summary.first().run == "FAIL"
    plan = verbs.offload_plan(spark, str(root / "card"), {"x": str(root / "copy")})
    assert tuple(plan.summary.first()) == (4, 2)
    with pytest.raises(ValueError, match="in one another"):
        verbs.offload_plan(spark, str(root / "card"), {"x": str(root / "card" / "c1")})
    done = verbs.offload_record(spark, str(root / "card"), str(root / "copy"), str(root / "m"), "# m", "/x")
    assert {r.file: r.verdict for r in done.rows.collect()} == {"c1/A_000001.dng": "OK", "c1/A_000002.dng": "SIZE", "c1/A_000003.dng": "OK", "c1/A_000005.dng": "MISSING", "c2/B_000001.dng": "MISSING", "c2/notes.txt": "MISSING"}
    fixed = verbs.repair(spark, str(root / "m"), str(root / "card"), str(root / "card"), str(root / "copy"), ["c1/A_000002.dng", "c2/notes.txt"])
    got = {(r.rel, r.side): r.action for r in fixed.rows.collect()}
    assert got["c1/A_000002.dng", "dest"] == "copy" and got["c1/A_000005.dng", "dest"] == "stays dirty" and got["c2/notes.txt", "workspace"] == "none" and ("c1/A_000001.dng", "workspace") not in got
    with pytest.raises(ValueError, match="unknown: nothing"):
        verbs.repair(spark, str(root / "m"), str(root / "card"), str(root / "card"), str(root / "copy"), ["nothing"])


def test_gate_dry_run_plan_bake_measure(spark, card):
    root, frames = card
    gate = {r.clip: r for r in verbs.ingest_gate(spark, str(root / "card"), spark.createDataFrame([("c1", 4), ("c2", 9)], "clip string, declared long")).rows.collect()}
    assert (gate["c1"].n_missing, gate["c1"].verdict, gate["c2"].mismatch, gate["c2"].verdict) == (1, "FAIL", True, "FAIL")
    dry = verbs.dry_run(spark, str(root / "card"), 2.0, 60_000.0, include=["c1"])
    size = sum(map(len, frames.values()))
    assert [(r.clip, r.frames, r.bytes, r.projected, r.minutes) for r in dry.rows.collect()] == [("c1", 4, size, round(size / 2), 4.0)]
    assert (dry.summary.first().places, dry.summary.first().sha256) == (4, sha(b"0,1,2,3\n"))
    put(root / "out", {"c1/A_000001.dng": b"done", "x.checksums.tsv": sidecar({"c1/A_000001.dng": b"done"})})
    (root / "run").mkdir()
    put(root / "run", {"c1/A_000001.dng": b"done"})
    (root / "side").mkdir()
    plan = verbs.run_plan(spark, str(root / "card"), str(root / "out"), spark.createDataFrame([("M", "m")], "make string, model string"))
    got = {r.rel: r.action for r in plan.rows.collect()}
    assert got["c2/B_000001.dng"] == "refuse" and got["c1/A_000002.dng"] == "encode" and plan.summary.first().camera == "OK"
    one = len(next(iter(frames.values())))
    bake = verbs.bake_plan(spark, str(root / "card"), 2 * one, 10 * one)
    assert {r.clip: r.parts for r in bake.summary.collect()} == {"c1": 2, "c2": 1}
    with pytest.raises(ValueError, match="above the most"):
        verbs.bake_plan(spark, str(root / "card"), one, one - 1)
    seen = verbs.measure(spark, [str(root / "card"), str(root / "card")])
    assert sorted((r["class"], r.frames, r.clips) for r in seen.rows.collect()) == [("raw", 8, 2), ("unknown", 2, 2)]


def test_restore_ledger_statistics(spark, card):
    root, frames = card
    put(root / "master", {**{f"c1/{n}": d for n, d in frames.items()}, "c1/x.checksums.tsv": sidecar({**frames, "A_000003.dng": b"older"})})
    offenders = spark.createDataFrame([("c1", f"c1/A_{i:06d}.dng") for i in (2, 3, 7)], "clip string, rel string")
    got = {r.rel[-5]: (r.n, r.action) for r in verbs.restore(spark, offenders, str(root / "master")).rows.collect()}
    assert got == {"2": (1, "restore"), "3": (2, "master bad"), "7": (3, "no master")}
    assert verbs.restore(spark, offenders, str(root / "master"), nth=2).rows.count() == 1
    line, TOP = "\t".join(["{}", "audit", *["x"] * 8]), "\t".join(records.LEDGER[0][:10])
    (root / "ledger.tsv").write_text(f"version: 1\n{TOP}\n{line.format(5)}\n{line.format('soon')}\n{line.format(9)}\n")
    found = verbs.ledger(spark, str(root / "ledger.tsv"), since=6, as_json=True)
    assert ['"created":9' in r.line for r in found.rows.collect()] == [True] and found.summary.first().rejects == 1
    samples = spark.createDataFrame([("c", f, v) for f, vs in (("flat", [5] * 9), ("wide", [0, 4000])) for v in vs], "c string, f string, v int")
    got = verbs.statistics(samples, "c", "f", "v")
    assert {r.f: r.black for r in got.rows.collect()} == {"flat": True, "wide": False} and got.summary.select(F.sum("frames")).first()[0] == 2

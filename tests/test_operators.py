"""Verdict matrices, fixed vectors and record files."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loomshed.functions import ed25519, hashing, keys
from loomshed.operators import codes, gates, planes, planning, reconcile, stats
from loomshed.scratch import placed
from loomshed.session import ship
from loomshed.sources import frames, hashlists, records, signatures, tiff
from loomshed.streaming import status


def test_sequence_order_independent(spark):
    rows = [("a", n) for n in (1, 2, 2, 5, 9)] + [("b", None), ("b", 3)]
    for data in (rows, rows[::-1]):
        got = {r.clip: r for r in gates.sequence_gate(spark.createDataFrame(data, "clip string, num int"), "clip", "num").collect()}
        assert (got["a"].n_dup, got["a"].n_gap, got["a"].n_missing, got["a"].verdict) == (1, 2, 5, "FAIL")
        assert (got["b"].frames, got["b"].verdict) == (1, "PASS")


def test_audit_precedence(spark):
    m = spark.createDataFrame([(i, 10, "s", "c") for i in range(6)] + [(6, 10, "s", None)], "k int, size int, sha256 string, crc32c string")
    d = spark.createDataFrame([(1, 99, None, "x"), (2, 11, "t", "x"), (3, 10, "t", "x"), (4, 10, "s", "x"), (5, 10, "s", "c"), (6, 10, "s", "x")], "k int, d_size int, d_sha256 string, d_crc32c string")
    got = {r.k: r.verdict for r in reconcile.audit(m, d, "k").collect()}
    assert got == {0: "missing", 1: "size", 2: "size", 3: "sha256", 4: "crc32c", 5: "ok", 6: "ok"}
    d = spark.createDataFrame([(0, None, None, "x"), (1, 10, None, "x")], "k int, d_size int, d_sha256 string, d_crc32c string")
    got = {r.k: r.verdict for r in reconcile.audit(m, d, "k").collect()}
    assert (got[0], got[1], got[2]) == ("unreadable", "unreadable", "missing")


def test_reverify_names_every_class(spark):
    m = spark.createDataFrame([("a", i, 10, "s") for i in range(6)] + [("a", 6, 10, "-"), ("gone", 7, 10, "s")], "dest string, k int, size int, sha256 string")
    d = spark.createDataFrame([("a", 1, None, None), ("a", 2, 9, None), ("a", 3, 10, None), ("a", 4, 10, "t"), ("a", 5, 10, "s"), ("a", 6, 10, None), ("gone", 7, 10, "s")], "dest string, k int, d_size int, d_sha256 string")
    here = spark.createDataFrame([("a",), ("b",)], "dest string")
    got = {r.k: r.verdict for r in reconcile.reverify(m, d, ["dest", "k"], here).collect()}
    assert got == {0: "MISSING", 1: "UNREADABLE", 2: "SIZE", 3: "UNREADABLE", 4: "SHA", 5: "OK", 6: "OK", 7: "DEST_MISSING"}


def test_black_rule(spark):
    rows = [("flat", v) for v in [100] * 8] + [("wide", v) for v in (0, 4000, 0, 4000)] + [("narrow", v) for v in (0, 31)]
    m = stats.moments(stats.frame_stats(spark.createDataFrame(rows, "f string, v int"), ["f"], "v"))
    got = {r.f: r.b for r in m.select("f", stats.is_black(F.col("range"), F.col("var_num"), F.col("n")).alias("b")).collect()}
    assert got == {"flat": True, "wide": False, "narrow": True}


def test_three_places_ties_to_even(spark):
    values = [22.5625, 0.0625, 157.6375, 1.0005, 2.9996, 0.0, 123456.0005]
    got = [r.s for r in spark.createDataFrame([(v,) for v in values], "x double").select(stats.three_places(F.col("x")).alias("s")).collect()]
    assert got == [f"{v:.3f}" for v in values]


def test_digests(spark):
    ship(spark)
    assert hashing.crc32c_bytes(b"123456789") == 0xE3069283
    empty = hashing.c4_of_digest(hashlib.sha512(b"").digest())
    assert len(empty) == 90 and hashing.c4_bytes(empty) == hashlib.sha512(b"").digest()
    with pytest.raises(ValueError):
        hashing.c4_bytes("c4" + "0" * 88)
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "c binary")
    got = df.select(hashing.crc32c("c").alias("x"), hashing.c4_id("c").alias("y")).collect()
    assert got[0].x == 0xE3069283 and got[1].x is None and got[1].y is None
    tiles = spark.createDataFrame([([bytearray(b"a"), bytearray(b"b")],)], "t array<binary>")
    want = hashlib.md5(hashlib.md5(b"a").digest() + hashlib.md5(b"b").digest()).hexdigest()
    assert tiles.select(hashing.tile_set_digest(F.col("t")).alias("d")).first().d == want


def test_sampling_is_a_permutation_prefix():
    got = planning.sample_indexes(1000, 60)
    assert len(set(got)) == 60 and max(got) < 1000 and got == planning.sample_indexes(1000, 60)
    assert planning.default_size(5) == 5 and planning.default_size(150) == 20 and planning.default_size(10_000) == 60
    with pytest.raises(ValueError):
        planning.sample_indexes(3, 4)


def test_selection_errors_in_order(spark):
    u = spark.createDataFrame([("a",), ("b",), ("a",)], "clip string")
    chosen = lambda *flags: {r.clip for r in planning.resolve_selection(u, "clip", *flags).collect()}
    assert planning.resolve_selection(u, "clip", None, None) is None and planning.apply_selection(u, None, "clip").count() == 3
    assert chosen(None, ["a"]) == {"b"} and chosen(["a"], []) == {"a"}
    for include, skip, what in ((["a", "z"], ["a"], "unknown: z"), (["a"], ["a"], "both"), (None, ["a", "b"], "nothing")):
        with pytest.raises(ValueError, match=what):
            planning.resolve_selection(u, "clip", include, skip)
    with pytest.raises(ValueError):
        planning.parse_list("a,,b")


def test_next_fit(spark):
    df = spark.createDataFrame([("c", i, s) for i, s in enumerate([5, 5, 1, 20, 3, 9])], "c string, i long, s long")
    assert sorted((r.i, r.part) for r in planning.next_fit(df, "c", "i", "s", 10).collect()) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    with pytest.raises(ValueError, match="file 3 is 20 B"):
        planning.next_fit(df, "c", "i", "s", 10, most=15)
    assert planning.next_fit(df.limit(0), "c", "i", "s", 10).count() == 0


@pytest.mark.parametrize("target", [1, 37, 100, 5000, 10**9])
def test_next_fit_over_many_ranges_equals_the_plain_fold(spark, target):
    r = random.Random(target)
    sizes = {"hot": [r.randrange(1, 60) for _ in range(900)], "big": [200, 1, 1, 200], None: [r.randrange(1, 9) for _ in range(40)]}
    df = spark.createDataFrame([(g, i, s) for g, v in sizes.items() for i, s in enumerate(v)], "c string, i long, s long")
    want = {}
    for g, v in sizes.items():
        cur, part = None, -1
        for i, s in enumerate(v):
            if cur is None or cur + s > target:
                cur, part = 0, part + 1
            cur += s
            want[g, i] = part
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {(x.c, x.i): x.part for x in planning.next_fit(df, "c", "i", "s", target).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_running_p95_equals_sorting_anew(spark):
    r = random.Random(3)
    rows = [(k, i, r.choice([None, r.random() * 100, 7.0])) for k in ("a", "b") for i in range(150)] + [("n", 0, None)]
    got = {(x.k, x.i): (x.done, x.p95, x.eta) for x in planning.running_p95(spark.createDataFrame(rows, "k string, i int, ms double"), "k", ["i"], "ms", 100).collect()}
    for k in ("a", "b", "n"):
        seen = []
        for i, ms in [(i, ms) for kk, i, ms in rows if kk == k]:
            seen += [ms] if ms is not None else []
            want = sorted(seen)[max(1, math.ceil(0.95 * len(seen))) - 1] if seen else None
            assert got[k, i] == (i + 1, want, None if want is None else want * max(100 - i - 1, 0))


def test_places_and_cumulative_counts(spark):
    r = random.Random(4)
    data = [("hot" if r.random() < 0.7 else r.choice("ab"), r.choice([None, 5.0, r.random()])) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, v double")
    got = placed(df, F.col("k"), F.col("v").asc_nulls_first()).orderBy("place").collect()
    assert [x.place for x in got] == list(range(500))
    assert [(x.k, x.v) for x in got] == sorted(data, key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    cum = {(x.k, x.v): (x.cum, x.n) for x in stats.cumulative(df, ["k"], "v").collect()}
    for k, v in set(data):
        mine = [w for kk, w in data if kk == k]
        assert cum[k, v] == (sum(w is None or (v is not None and w <= v) for w in mine), len(mine))
    assert stats.cumulative(df.limit(0), ["k"], "v").count() == 0 and placed(df.limit(0), "k").count() == 0


def test_frame_numbers(spark):
    stems = {"A_001": "1", "001": "1", "A_1x": None, "A_": None, "A_18446744073709551615": "18446744073709551615", "A_18446744073709551616": None}
    got = spark.createDataFrame([(s,) for s in stems], "s string").select("s", keys.frame_number(F.col("s")).cast("string").alias("n")).collect()
    assert {r.s: r.n for r in got} == stems


def test_ignored_paths(spark):
    df = spark.createDataFrame([("a/.git/x",), ("a/b.tmp",), ("tmpx/b",), ("a/b",)], "p string")
    assert [r.i for r in df.select(keys.is_ignored(F.col("p"), [".git", "*.tmp", "tmp*"]).alias("i")).collect()] == [True, True, True, False]


def test_checksum_sidecars(spark, tmp_path):
    sha = "ab" * 32
    (tmp_path / "a.checksums.tsv").write_text(f"file\tsize\tcrc32c\tsha256\nf1\t10\tdeadbeef\t{sha}\nbad\nf2\tx\tdeadbeef\t{sha}\nold\t1\tdeadbeef\nf4\t1\tdead\t{sha}\nf3\t7\tdead")
    (tmp_path / "b.checksums.tsv").write_text("# magic\r\nclip: b\r\n" + "\t".join(records.CHECKSUMS[0]) + f"\r\ng1\t10\tdeadbeef\t{sha}\ttc\t24/1\t\t1/50\r\ng2\t10\tdeadbeef\t{sha}\r\n")
    rows, rejects = records.read_checksums(spark, str(tmp_path), tolerate_torn=True)
    assert sorted((r.file, r.size, r.timecode, r.exposure) for r in rows.collect()) == [("f1", 10, "", ""), ("g1", 10, "tc", "1/50")]
    got = sorted((r.manifest.rsplit("/", 1)[1][0], r.n, r.reason) for r in rejects.collect())
    assert got == [("a", 2, "1 columns"), ("a", 3, "bad size"), ("a", 4, "predates the sha256 column"), ("a", 5, "bad crc32c"), ("b", 4, "4 columns")]
    assert {r.key: r.value for r in records.header_values(spark, str(tmp_path)).collect()} == {"clip": "b"}
    assert [(r.n, r.line) for r in records.torn_tails(spark, str(tmp_path)).collect()] == [(6, "f3\t7\tdead")]


def test_lines_of_files_that_are_read_in_splits(spark, tmp_path):
    for name, lines, end in (("a", 5000, "\n"), ("b", 3000, ""), ("empty", 0, "")):
        (tmp_path / f"{name}.tsv").write_text("\n".join(f"{name}{i}" for i in range(lines)) + end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = records.text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line[0], r.n, r.line, r.torn, r.head) for r in got) == sorted([("a", i, f"a{i}", False, "a0") for i in range(5000)] + [("b", i, f"b{i}", i == 2999, "b0") for i in range(3000)])


def test_a_large_record_is_several_files_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILE_ROWS", 100)
    rows = spark.createDataFrame([(f"f{i:04d}", i, "x") for i in range(950)], "file string, size long, sha256 string")
    records.write_sources(rows.repartition(5), str(tmp_path / "r"), "# m")
    parts = sorted(p for p in (tmp_path / "r").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert len(parts) > 5 and text.startswith("# m\ncount: 950\nfile\tsize\tsha256\nf0000\t0\tx\n") and text.endswith("f0949\t949\tx\n")
    assert records.read_sources(spark, str(tmp_path / "r"))[0].count() == 950


def test_resume_reels_and_bakes(spark, tmp_path):
    sha = "0" * 64
    (tmp_path / "r.tsv").write_text(f"a\t1\tdeadbeef\t{sha}\nb\t1\tdeadbeef\t{sha}\na\t1\tdeadbeef\t{sha}\nc\t1")
    rows, bad = records.read_resume(spark, str(tmp_path / "r.tsv"))
    assert [r.file for r in rows.collect()] == ["b"] and [(r.line, r.reason) for r in bad.collect()] == [("a", "held twice")]
    (tmp_path / "reel.tsv").write_text(f"# m\ncreated: 5 (unix)\nclips: 2\nframes: 4\n{records.REEL_HEADER}\nc\tx\ta1, a2\t{sha}, {sha}\tm\t{sha}\t3\nd\tx\ta1, a2\t{sha}\tm\t{sha}\t1\ne\tx\ta\tzz\tm\t{sha}\t1\n")
    head, rows, bad = records.read_reels(spark, str(tmp_path / "reel.tsv"))
    assert [(r.created, r.error) for r in head.collect()] == [(5, "clips")] and [r.archive for r in rows.collect()] == [["a1", "a2"]]
    assert sorted(r.reason for r in bad.collect()) == ["archive lists differ in length", "bad digest"]
    (tmp_path / "b.tsv").write_text(f"# m\nclip: c\ncontainer: tar\nfile_count: 1\narchive: p1, p2\nrelpath\tsize\tsha256\nf\t1\t{sha}\n")
    head, rows, bad = records.read_bake(spark, str(tmp_path / "b.tsv"))
    assert [(r.clip, r.parts, r.error) for r in head.collect()] == [("c", ["p1", "p2"], None)] and rows.count() == 1 and bad.count() == 0


def test_anchors_that_are_missing_or_no_numbers_raise(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("f1\t1.5\nf1\t9\nf2\tx\nshort\n")
    anchors = records.read_anchors(spark, str(tmp_path / "a.tsv"), ["mae"])
    assert anchors.filter("file = 'f1'").first().mae == 1.5
    with pytest.raises(Exception, match="bad mae of f2"):
        anchors.collect()
    with pytest.raises(Exception, match="no anchor for f3"):
        records.anchored(spark.createDataFrame([("f3",)], "k string"), anchors.filter("file = 'f1'"), "k").collect()


def test_ingest_ranges(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("# m\nclip\tframes\tmanifest_declared\tframe_range\ttc_start\ttc_end\nc\t3\t-\t5..7\t-\t00:00:00:01\n")
    rows, _ = records.read_ingest(spark, str(tmp_path))
    r = rows.first()
    assert (r.manifest_declared, r["first"], r["last"], r.tc_start, r.tc_end) == (None, 5, 7, None, "00:00:00:01")


def test_unique_keys(spark):
    df = spark.createDataFrame([("m", "x"), ("m", "x")], "make string, model string")
    with pytest.raises(ValueError, match="claimed twice"):
        records.unique_or_raise(df, ["make", "model"], "camera")


def test_tiff_rules():
    good = [(256, 4, [16]), (257, 4, [8]), (258, 3, [12]), (259, 3, [1]), (262, 3, [32803]), (273, 4, [0]), (277, 3, [1]), (278, 4, [8]), (279, 4, [192])]
    make = lambda *changed, order="little", payload=b"\1" * 192 + b"\0\0": tiff.write([[t for t in good if t[0] not in {c[0] for c in changed}] + [c for c in changed if c[2]]], order, payload)
    assert tiff.raw_frame(make())["strip_bytes"] == 192
    cases = {
        "big-endian": make(order="big"), "tiled": make((322, 4, [4])), "no samples": make((277, 3, [])), "rows per strip": make((278, 4, [4])), "compressed": make((259, 3, [7])), "no mosaic": make((262, 3, [2])),
        "samples": make((277, 3, [3])), "depth": make((258, 3, [14])), "odd pixel count": make((256, 4, [15]), (257, 4, [9]), (278, 4, [9])), "width": make((258, 3, [10]), (256, 4, [18])), "strip length": make((279, 4, [191])),
        "strip outside the file": make(payload=b"\1" * 100), "tail": make(payload=b"\1" * 192 + b"\1"), "not a TIFF": b"nothing at all",
    }
    for what, data in cases.items():
        with pytest.raises(tiff.Broken, match=what):
            tiff.raw_frame(data)
    loop = bytearray(tiff.write([[(330, 4, [0]), (256, 4, [1])], [(257, 4, [2])]]))
    at = loop.index((330).to_bytes(2, "little"))
    loop[at + 8 : at + 12] = (8).to_bytes(4, "little")
    with pytest.raises(tiff.Broken, match="met again"):
        tiff.read(bytes(loop))
    for cut in range(0, 120, 7):
        with pytest.raises(tiff.Broken):
            tiff.raw_frame(make()[:cut])


def test_code_lengths_are_the_best_there_are():
    r = random.Random(6)
    assert codes.code_lengths([0] * 17) == [0] * 17 and codes.code_lengths([5] + [0] * 16) == [1] + [0] * 16
    for _ in range(200):
        counts = [r.choice([0, 1, 2, r.randrange(1000)]) for _ in range(r.randrange(2, 9))]
        used = [c for c in counts if c]
        lengths = codes.code_lengths(counts)
        assert all((n > 0) == (c > 0) for n, c in zip(lengths, counts, strict=True))
        assert sum(2.0**-n for n in lengths if n) < 1 or not used  # the all-ones word is free
        best = min((sum(c * n for c, n in zip(sorted(used, reverse=True), sorted(p), strict=True)) for p in itertools.combinations_with_replacement(range(1, 9), len(used)) if sum(2.0**-n for n in p) < 1), default=0) if len(used) < 6 else None
        if best is not None:
            assert sum(c * n for c, n in zip(counts, lengths, strict=True)) == best
    deep = [1, 1]
    while len(deep) < 24:
        deep.append(deep[-1] + deep[-2])
    assert max(codes.code_lengths(deep)) <= 16 and sum(2.0**-n for n in codes.code_lengths(deep)) < 1


def test_signatures():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert ed25519.sign(seed, b"").hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    key = signatures.key_of(seed)
    assert signatures.parse_key(signatures.render_key(key)) == key
    public = signatures.Key(key.public)
    assert signatures.parse_key(signatures.render_key(public)) == public
    for bad in (signatures.render_key(key).replace("private", "public"), signatures.render_key(key).replace(key.fingerprint, "0" * 64), signatures.render_key(key) + "version: 1\n", signatures.render_key(key).replace("version: 1\n", "")):
        with pytest.raises(ValueError):
            signatures.parse_key(bad)
    envelope = signatures.sign_manifest(b"rows", "m.tsv", key, 5, "a=1", "9")
    assert envelope == signatures.sign_manifest(b"rows", "m.tsv", key, 5, "a=1", "9") and signatures.verify_envelope(b"rows", envelope, public) == "OK"
    found = {signatures.verify_envelope(*x) for x in ((b"rowz", envelope, public), (b"rows", envelope, signatures.key_of(bytes(32))), (b"rows", envelope.replace("signed_at: 5", "signed_at: 6"), public), (None, envelope, public), (b"rows", "x", public))}
    assert found == {"manifest", "key", "signature", "no manifest", "envelope"}
    with pytest.raises(ValueError):
        signatures.sign_manifest(b"rows", "m", public, 5, "", "")


def test_hash_chains():
    id_ = hashing.c4_of_digest(bytes(64))
    text = hashlists.append_generation(hashlists.append_generation(None, "1.mhl", id_), "2.mhl", id_)
    assert [(r["sequence"], r["path"]) for r in hashlists.parse_chain(text)] == [(1, "1.mhl"), (2, "2.mhl")]
    for bad in (text.replace("<path>", "<other>").replace("</path>", "</other>"), text.replace('sequencenr="1"', ""), text.replace("ascmhldirectory", "x"), "<!DOCTYPE x>" + text):
        with pytest.raises(ValueError):
            hashlists.parse_chain(bad)


def test_profiles(spark, tmp_path):
    identity = {"camera": "c", "make": "M", "model": "m", "naming": "A_*"}
    text = records.render_profile(identity, [(3, 4, 12, "raw"), (1, 2, 8, "raw")], "# p")
    (tmp_path / "a.profile").write_text(text)
    head, geo = records.profile_set(spark, str(tmp_path))
    assert [(r.camera, r.make) for r in head.collect()] == [("c", "M")] and sorted((r.w, r.fine) for r in geo.collect()) == [(1, True), (3, True)]
    (tmp_path / "b.profile").write_text(text.replace("camera: c", "camera: d"))
    with pytest.raises(ValueError, match="make and model claimed twice"):
        records.profile_set(spark, str(tmp_path))
    for refused in (({**identity, "naming": ""}, [(1, 2, 8, "raw")]), (identity, [])):
        with pytest.raises(ValueError):
            records.render_profile(*refused, "# p")


def test_checksums_of_many_buffers():
    r = random.Random(1)
    table = [i for i in range(256)]
    for _ in range(8):
        table = [i >> 1 ^ (hashing.CASTAGNOLI if i & 1 else 0) for i in table]

    def plain(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc = table[(crc ^ b) & 255] ^ crc >> 8
        return crc ^ 0xFFFFFFFF

    buffers = [r.randbytes(n) for n in (0, 1, 7, 8, 9, 4095, 4096, 4097, 8192, 12289)] + [r.randbytes(r.randrange(40)) for _ in range(200)]
    assert hashing.crc32c_many(buffers) == [plain(b) for b in buffers] and hashing.crc32c_many([]) == []


def test_camera_line(spark):
    known = spark.createDataFrame([("A", "b")], "make string, model string")
    frames_ = lambda *rows: spark.createDataFrame([(f"f{i}", *r) for i, r in enumerate(rows)], "path string, make string, model string")
    line = lambda f, p=known: reconcile.camera_line(f, p, "path", [["make"], ["model"]])
    assert line(frames_(("A", "b"), ("X", "y"))) == "OK" and line(frames_(("A", "x"))) == "UNKNOWN"
    assert line(frames_(("A", "b")), None) == line(frames_((None, None))) == line(frames_(("A", "b")).limit(0)) == "ABSENT"


def test_only_planes_raise(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a_p2_00.jxl").write_bytes(b"x")
    with pytest.raises(ValueError, match="other codec"):
        frames.encoded(frames.files(spark, str(tmp_path)))


def test_frame_scan(spark, tmp_path):
    ship(spark)
    root = tmp_path / "card"
    (root / "clip1").mkdir(parents=True)
    (root / "clip1" / "A_000001.DNG").write_bytes(tiff.write([[(256, 4, [3856]), (257, 4, [2170]), (258, 3, [12]), (259, 3, [1])]]))
    (root / "clip1" / "A_000002.dng").write_bytes(b"broken")
    (root / "clip1" / "._A_000001.DNG").write_bytes(b"shadow")
    (root / "clip1" / "notes.txt").write_bytes(b"x")
    scanned = frames.scan(spark, str(root))
    assert [r.n for r in frames.totals(scanned).select(F.col("frames").alias("n")).collect()] == [2]
    got = {r.stem: r for r in scanned.select("clip", "stem", frames.facts("content").alias("facts")).select("clip", "stem", "facts", frames.frame_class().alias("cls")).collect()}
    assert got["A_000001"].clip == "clip1" and got["A_000001"].facts.width == 3856 and got["A_000001"].cls == "raw"
    assert got["A_000002"].facts.error and got["A_000002"].cls == "unknown"


def test_status_stream_equals_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / p) for p in ("in", "out", "ck"))
    rows = [(i, f"2024-01-01 0{i % 6}:10:00", i % 3, "ab"[i % 2], float(i), "{}") for i in range(60)] + [(99, "2024-01-02 10:00:00", 0, "a", 0.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.json(src)
    query = status.start_rollup(spark, src, out, ck)
    query.awaitTermination(120)
    key = lambda d: {(r.window.start, r.event_type): (r.n, r.total) for r in d.collect()}
    streamed, batch = key(spark.read.parquet(out)), key(status.by_window(df.filter("event_id < 99"), "1 hour"))
    assert streamed == batch


def test_archive_and_repair_verdicts(spark):
    m = spark.createDataFrame([(f"f{i}", 10, "s") for i in range(6)], "k string, size int, sha256 string")
    members = spark.createDataFrame([("f1", "gone", 10, "s"), ("f2", "p", 10, None), ("f3", "p", 9, "s"), ("f4", "p", 10, "t"), ("f5", "p", 10, "s")], "k string, part string, d_size int, d_sha256 string")
    parts = spark.createDataFrame([("p",)], "part string")
    got = {r.k: r.verdict for r in reconcile.archive_audit(m, members, parts, "k").collect()}
    assert got == {"f0": "not found", "f1": "missing part", "f2": "unreadable", "f3": "size", "f4": "sha256", "f5": "ok"}
    with pytest.raises(ValueError, match="two parts"):
        reconcile.archive_audit(m, members.unionByName(members.withColumn("part", F.lit("q"))), parts, "k")
    names = spark.createDataFrame([("a.DNG", 1, "s"), ("b.txt", 1, "old")], "k string, size int, sha256 string")
    held = spark.createDataFrame([("a.DNG", 1, "s"), ("b.txt", 2, "s")], "k string, d_size int, d_sha256 string")
    fresh = spark.createDataFrame([("a.DNG", 1, "s"), ("b.txt", 1, "s")], "k string, f_size int, f_sha256 string")
    rows = {(r.k, r.side): (r.verdict, r.in_scope, r.drifted) for r in reconcile.repair_rows(names, held, held.limit(0), fresh, "k", ["a.DNG"]).collect()}
    assert rows == {("a.DNG", "dest"): ("Clean", True, False), ("b.txt", "dest"): ("SizeMismatch", False, True), ("b.txt", "workspace"): ("Missing", False, True)}
    with pytest.raises(ValueError, match="unknown: z"):
        reconcile.repair_scope(names, "k", ["z", "a.DNG"])


def test_plane_helpers(spark):
    df = spark.createDataFrame([(list(range(16)), [v + (v == 3) for v in range(16)])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    stats_, log = planes.lossy_stats(a, b), planes.log_stats(a, b)
    r = df.select(planes.merge_columns(planes.column_planes(a, 4), 4).alias("back"), planes.bit_exact(a, b).alias("same"), stats_["mae"].alias("mae"), planes.lossy_stats(a, a)["psnr"].alias("inf"), log["within_one_pct"].alias("one"), log["broken"].alias("broken")).first()
    assert r.back == list(range(16)) and not r.same and r.mae == 1 / 16 and r.inf == float("inf") and r.one == 100 and not r.broken
    two, other = [2, 2], [3, 3]
    rules = spark.createDataFrame([(two, None, [0, 1, 1, 2], [0, 0]), (None, two, [0, 1, 2, 1], None), (other, two, [0, 1, 1, 2], None), (None, None, None, None)], "n array<int>, o array<int>, p array<int>, z array<int>")
    assert [x.r for x in rules.select(planes.decimation_rule(F.col("n"), F.col("o"), F.col("p"), F.lit(None).cast("array<int>"), F.col("z")).alias("r")).collect()] == ["staircase", "phase", "phase", "phase"]
    tags = spark.createDataFrame([({256: "w", 273: "s"}, {256: "w", 322: "", 323: "", 324: "", 325: ""}), ({256: "w"}, {256: "x", 322: "", 323: "", 324: "", 325: ""})], "s map<int,string>, o map<int,string>")
    assert [x.f for x in tags.select(planes.metadata_preserved(F.col("s"), F.col("o")).alias("f")).collect()] == [True, False]


def test_pam(spark):
    ship(spark)
    data = frames.render_pam(2, 3, [0, 1, 256, 4095, 7, 9])
    assert frames.parse_pam(data) == (2, 3, [0, 1, 256, 4095, 7, 9])
    for bad in (b"", data[:-1], data.replace(b"4095", b"255"), data.replace(b"P7", b"P5"), data.replace(b"DEPTH 1\n", b"")):
        with pytest.raises(ValueError):
            frames.parse_pam(bad)
    got = spark.createDataFrame([(bytearray(data),)], "c binary").select(frames.pam("c").alias("p")).first().p
    assert (got.width, got.height, list(got.plane)) == (2, 3, [0, 1, 256, 4095, 7, 9])

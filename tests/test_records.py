"""Records beyond one file are read back whole, headers included; ledgers of unknown versions are named and not read."""

import pytest
from pyspark.sql import functions as F

from loomshed.sources import records

SHA, N = "a" * 64, 57


@pytest.fixture(autouse=True)
def ten_rows_a_file(monkeypatch):
    monkeypatch.setattr(records, "FILE_ROWS", 10)


def names(df, column="file"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture
def files(spark):
    return spark.range(N).select(
        F.format_string("f%03d", "id").alias("file"),
        F.col("id").alias("size"),
        F.lit(SHA).alias("sha256"),
        F.lit("0badcafe").alias("crc32c"),
        *[F.lit(c).alias(c) for c in ("timecode", "framerate", "iso", "exposure")],
    )


def parts(path):
    return len(list(path.glob("part-*")))


WANT = [f"f{i:03d}" for i in range(N)]


def test_checksums(spark, tmp_path, files):
    records.write_checksums(files, str(tmp_path / "r"), "# m", "t")
    rows, bad = records.read_checksums(spark, str(tmp_path / "r"))
    assert parts(tmp_path / "r") > 3 and names(rows) == WANT and bad.count() == 0
    assert rows.select("manifest").distinct().count() == 1
    rows, bad = records.read_resume(spark, str(tmp_path / "r"))
    assert names(rows) == WANT and bad.count() == 0


def test_offload_keeps_its_destination(spark, tmp_path, files):
    rows = files.select("file", "size", F.col("sha256").alias("source_sha256"), F.col("sha256").alias("dest_sha256"), F.lit("OK").alias("verdict"))
    records.write_offload(rows, str(tmp_path / "r"), "# m", "/d")
    found, bad = records.read_offload(spark, str(tmp_path / "r"))
    assert names(found) == WANT and {r.dest for r in found.collect()} == {"/d"} and bad.count() == 0
    fixed = rows.limit(3).select("file", F.lit("b" * 64).alias("dest_sha256"), F.lit("OK").alias("verdict"))
    records.rewrite_offload(found, fixed, str(tmp_path / "again"), "# m", "/d")
    again, _ = records.read_offload(spark, str(tmp_path / "again"))
    assert again.filter(F.col("dest_sha256") == "b" * 64).count() == 3 and again.filter("dest = '/d'").count() == N


def test_members_keep_their_verdict(spark, tmp_path, files):
    records.write_members(files.select("file", "size", "sha256", F.lit("OK").alias("verdict")), str(tmp_path / "r"), "# m")
    found, _ = records.read_members(spark, str(tmp_path / "r"))
    assert names(found) == WANT and {r.record_verdict for r in found.collect()} == {f"OK {N}/{N}"}


def test_bake_headers(spark, tmp_path, files):
    rows = files.select(F.col("file").alias("relpath"), "size", "sha256")
    heads = {"clip": "c", "container": "tar", "file_count": N, "archive": "a.tar, b.tar"}
    records.write_record(rows, str(tmp_path / "r"), "# m", records.BAKE[0], "relpath", heads)
    head, found, bad = records.read_bake(spark, str(tmp_path / "r"))
    (told,) = head.collect()
    assert (told.clip, told.file_count, told.parts, told.error) == ("c", N, ["a.tar", "b.tar"], None)
    assert names(found, "relpath") == WANT and bad.count() == 0


def test_reel_headers(spark, tmp_path, files):
    rows = files.select(
        F.col("file").alias("clip"),
        F.lit("c").alias("codec"),
        F.array(F.lit("a"), F.lit("b")).alias("archive"),
        F.array(F.lit(SHA), F.lit(SHA)).alias("archive_sha256"),
        F.lit("m").alias("manifest_name"),
        F.lit(SHA).alias("manifest_sha256"),
        F.col("size").alias("frames"),
    )
    records.write_reels(rows, str(tmp_path / "r"), "# m", 5, "t")
    head, found, bad = records.read_reels(spark, str(tmp_path / "r"))
    (told,) = head.collect()
    assert (told.created, told.clips, told.frames, told.error) == (5, N, N * (N - 1) // 2, None)
    assert names(found, "clip") == WANT and bad.count() == 0


def test_sources_qc_and_ingest(spark, tmp_path, files):
    records.write_sources(files.select("file", "size", "sha256"), str(tmp_path / "s"), "# m")
    assert names(records.read_sources(spark, str(tmp_path / "s"))[0]) == WANT
    qc = files.select("file", *[F.lit(1).alias(c) for c in ("bps", "raw_min", "raw_max")], F.lit("1.0").alias("raw_mean"),
                      F.lit(1).alias("range"), F.lit("1").alias("variance"), F.lit(0).alias("black"))
    records.write_qc(qc, str(tmp_path / "q"), "# m", N, [])
    rows, bad = records.read_qc(spark, str(tmp_path / "q"))
    assert names(rows) == WANT and bad.count() == 0
    ingest = files.select(F.col("file").alias("clip"), F.col("size").alias("frames"), F.lit(None).cast("string").alias("manifest_declared"),
                          F.lit(1).alias("first"), F.lit(2).alias("last"), *[F.lit(None).cast("string").alias(c) for c in ("tc_start", "tc_end")])
    records.write_ingest(ingest, str(tmp_path / "i"), "# m")
    rows, bad = records.read_ingest(spark, str(tmp_path / "i"))
    assert names(rows, "clip") == WANT and bad.count() == 0 and {r.last for r in rows.collect()} == {2}


def ledger_rows(spark, start, n):
    blank = [F.lit("").alias(c) for c in records.LEDGER[0][2:]]
    return spark.range(start, start + n).select(F.col("id").alias("created"), F.lit("audit").alias("command"), *blank)


def test_a_ledger_of_appends_beyond_one_file(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for start in (0, 100):
        records.append_ledger(ledger_rows(spark, start, 35), path)
    rows, bad = records.read_ledger(spark, path)
    assert sorted(r.created for r in rows.collect()) == [*range(35), *range(100, 135)] and bad.count() == 0
    assert rows.select("manifest").distinct().count() == 2
    head = [p.read_text().split("\n")[:2] for p in sorted((tmp_path / "ledger").glob("part-00000-*"))]
    assert all(h == ["version: 3", "\t".join(records.LEDGER[0])] for h in head)


@pytest.mark.parametrize("top, reason", [("version: 9\n", "unknown version"), ("# a ledger\n", "no version"), ("", "no version")])
def test_ledgers_of_unknown_versions_are_named_not_read(spark, tmp_path, top, reason):
    row = "\t".join(["7", *["x"] * 9])
    (tmp_path / "odd.tsv").write_text(f"{top}{row}\n{row}\n")
    header = "\t".join(records.LEDGER[0][:11])
    (tmp_path / "fine.tsv").write_text(f"version: 2\n{header}\n{row}\n{row}\tsel\n{row}\tsel\tctx\n\n{row}")
    rows, bad = records.read_ledger(spark, str(tmp_path))
    assert rows.count() == 4 and [r.reason for r in bad.collect()] == [reason]
    with pytest.raises(ValueError, match="unknown version"):
        records.append_ledger(ledger_rows(spark, 0, 1), str(tmp_path))


def test_another_column_line_is_named_and_passed_over(spark, tmp_path):
    row = "\t".join(["7", *["x"] * 9])
    (tmp_path / "a.tsv").write_text(f"version: 1\nother\tcolumns\n{row}\n")
    rows, bad = records.read_ledger(spark, str(tmp_path))
    assert rows.count() == 1 and [(r.n, r.reason) for r in bad.collect()] == [(1, "unexpected columns")]


def test_a_torn_tail_is_the_last_files(spark, tmp_path, files):
    records.write_sources(files.select("file", "size", "sha256"), str(tmp_path / "r"), "# m")
    assert records.torn_tails(spark, str(tmp_path / "r")).count() == 0
    last = sorted((tmp_path / "r").glob("part-*"))[-1]
    last.write_text(last.read_text()[:-1])
    for crc in (tmp_path / "r").glob(".*.crc"):
        crc.unlink()
    (torn,) = records.torn_tails(spark, str(tmp_path / "r")).collect()
    assert torn.line.startswith("f056") and torn.n == N + 2

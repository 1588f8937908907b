"""Joins of names and digests of trees, whose files are small and whose rows are many."""

import re

import pytest

from loomshed import verbs
from loomshed.operators import planning, scans
from loomshed.session import ship
from loomshed.sources import records, trees


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    ship(spark)
    root = str(tmp_path_factory.mktemp("many"))
    rows = [(f"c{i % 3}/A_{i:06d}.dng", b"x" * i) for i in range(30)] + [("c0/x.checksums.tsv", b"A_000000.dng\t0\t00000000\t" + b"0" * 64 + b"\n")]
    trees.write_files(spark.createDataFrame(rows, "rel string, content binary"), root)
    return root


def broadcast(found) -> list[str]:
    """Joins on names of files that are planned as broadcasts."""
    plan = found._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"BroadcastHashJoin \[[^\]]*\b(?:rel|_k)#[^\n]*", plan)


def test_a_repair_broadcasts_no_table_of_names(spark, tree, tmp_path):
    listed = spark.createDataFrame([("c0/A_000000.dng", 0, "0" * 64, "-", "OK")], "file string, size long, source_sha256 string, dest_sha256 string, verdict string")
    records.write_offload(listed, str(tmp_path / "m"), "# m", "/d")
    found = verbs.repair(spark, str(tmp_path / "m"), tree, tree, tree)
    assert not broadcast(found.rows) and found.rows.count() == 1


def test_a_restore_broadcasts_no_table_of_names(spark, tree):
    offenders = spark.createDataFrame([("c0", "c0/A_000000.dng")], "clip string, rel string")
    found = verbs.restore(spark, offenders, tree).rows
    assert not broadcast(found) and [r.action for r in found.collect()] == ["master bad"]


def test_checks_and_offloads_broadcast_no_table_of_names(spark, tree, tmp_path):
    assert not broadcast(verbs.verify_checksums(spark, tree).rows)
    (tmp_path / "x").mkdir()
    found = verbs.offload_plan(spark, tree, {"x": str(tmp_path / "x")}).rows
    assert not broadcast(found) and found.count() == 31


def test_a_run_plan_broadcasts_no_table_of_names(spark, tree, tmp_path):
    (tmp_path / "x.checksums.tsv").write_text("file\tsize\tcrc32c\tsha256\nA\t1\t00000000\t" + "0" * 64 + "\n")
    found = verbs.run_plan(spark, tree, str(tmp_path)).rows
    assert not broadcast(found) and found.count() == 30


def test_parts_of_archives_broadcast_no_table_of_names(spark, tree):
    found = verbs.bake_plan(spark, tree, 100, 1_000).rows
    assert not broadcast(found) and found.count() == 31


def test_beginnings_of_parts_are_doubled_without_a_broadcast_of_places(spark, monkeypatch):
    monkeypatch.setattr(scans, "WINDOW_ROWS", 10)
    plans, kept = [], planning.stored

    def stored(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, what)

    monkeypatch.setattr(planning, "stored", stored)
    rows = spark.range(50).selectExpr("'g' g", "id i", "3L s")
    found = planning.next_fit(rows, "g", "i", "s", 10)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if re.search(r"BroadcastHashJoin \[(?:place|next)#", p)]
    assert {x.i: x.part for x in found.collect()} == {i: i // 3 for i in range(50)}

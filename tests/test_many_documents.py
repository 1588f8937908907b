"""Trees of more documents than names of six digits tell apart, and of tables whose file is one split."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from loomshed.session import ship
from loomshed.sources import trees

VERBS = ["verb_run_plan", "verb_offload", "verb_bake_plan", "verb_diff", "verb_restore"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("documents")
    ids = [1, 2, 5, 999_999, *range(1_000_000, 1_000_012), 12_345_678]
    rows = [(k, None if k == 5 else f"text {k}", "en", "s", 9) for k in ids]
    told = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told.coalesce(1).write.parquet(f"{out}/documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", VERBS)
def test_documents_of_seven_digits_are_files_of_their_own(spark, folder, name):
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        columns, want = want.columns, want.fetchall()
    got = entry.queries()[name](spark, folder).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_files_of_one_split_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    ship(spark)
    monkeypatch.setattr(trees, "UNEVEN", 10)
    rows = spark.range(0, 200, 1, 1).selectExpr("concat('d/', id) rel", "cast('x' as binary) content")
    trees.write_files(rows, str(tmp_path))
    assert len(list((tmp_path / "d").iterdir())) == 200
    assert trees.even(rows).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert trees.even(rows.repartition(16)).rdd.getNumPartitions() == 16


def test_the_sink_is_handed_large_contents_a_few_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    rows = spark.range(0, 64, 1, 1).selectExpr("repeat('x', 1048576) c")
    with trees.in_pieces(spark):
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 64 << 20 and max(got) <= trees.HELD_BYTES + (2 << 20)

"""What a task holds of whole texts and of what is learned of them is bounded, whatever Spark hands it at once."""

import pyarrow as pa

import corpus_pipeline
from loomshed.llm import pii


def test_learning_rows_are_handed_on_piece_by_piece(spark, monkeypatch):
    text = "call +49 170 1234567 or write to ann.lee@host.example, server 10.0.0.1, no. 4711"
    taken = {}
    docs = spark.createDataFrame([(text,)], "text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.setdefault("run", run))
    pii.learning_rows(docs, pii.Field())
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 3_000), pa.array([1] * 3_000, pa.int64())], names=["text", "copies"])
    sizes = [b.num_rows for b in taken["run"](iter([batch]))]
    one = len(pii._examples(text, pii.Field()))
    assert sum(sizes) == 3_000 * one and max(sizes) < pii.HELD + one


def test_slices_of_a_batch_are_the_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_201))], names=["n"])
    parts = list(pii._parts([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [500, 500, 201, 0]
    assert pa.Table.from_batches(parts).column("n").to_pylist() == [*range(1_201)]


def test_stages_of_the_pipeline_take_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    spark.range(5_000).selectExpr("id doc_id", "'x' text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def sizes(spark, docs, sf_dir):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        return docs.mapInArrow(run, "n long")

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", sizes), ("same", lambda spark, docs, sf_dir: docs)])
    got = [r["n"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(got) == 5_000 and max(got) <= corpus_pipeline.HELD
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

"""Learning from tables in which a few texts are repeated many times."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomshed.llm import pii

TEXTS = [f"write to user{i}@mail.example.com or call +1 (555) 010-99{i:02d} before {i + 3} o'clock, host 10.0.0.{i}" for i in range(10)]


@pytest.mark.parametrize("times", [1, 20_000])
@pytest.mark.parametrize("which", range(4))
def test_one_repeated_text(spark, times, which):
    docs = spark.range(times).select(F.col("id").alias("doc_id"), F.lit(TEXTS[which]).alias("text"))
    weights = pii.train(docs)
    base, _ = pii.find_spans(TEXTS[which], weights)
    assert {k for k, *_ in base} >= {"email", "phone", "ip"}


def test_copies_weigh_as_their_number(spark):
    """Ten texts, 2,000 copies of each, are learned from as a plain fit of every node with its count."""
    field = pii.Field()
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("id") % 10 + 1).cast("int")).alias("text")
    )
    got = pii.train(docs, field)
    rows, weight = [], []
    for text in TEXTS:
        plain = pii._examples(text, field)
        seed = int.from_bytes(pii.hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")
        changed = [e for c in range(field.altered) for e in pii._examples(text, field, random.Random(seed + c))]
        rows += plain + changed
        weight += [2000.0] * len(plain + changed)
    table = pa.table({c: [r[c] for r in rows] for c in ("y", "before", "after", "tied", "f")})
    want = pii.fit(table, weight, field)
    z = lambda w, r: np.array(w.unary)[r["y"]] @ np.array(r["f"]) + w.skip * r["tied"][r["y"]]
    # The penalty is a row's share, and merged rows are fewer; beliefs agree all the same.
    for r in rows:
        assert np.sign(z(got, r)) == np.sign(z(want, r)) or abs(z(got, r) - z(want, r)) < 0.5


def test_contexts_count_every_node(spark):
    field = pii.Field()
    docs = spark.createDataFrame([(t,) for t in TEXTS for _ in range(7)] + [(None,), ("",), ("no digits",)], "text string")
    rows = pii.contexts(pii.learning_rows(docs, field)).collect()
    assert sum(r.n for r in rows) == 7 * sum(len(pii._examples(t, field)) for t in TEXTS)
    assert len({r.order for r in rows}) == len(rows) and sum(r.based for r in rows) == len(TEXTS)


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, "no personal data")], [(1, None), (2, "")]):
        assert pii.train(spark.createDataFrame(rows, "doc_id long, text string")) == pii.nothing()

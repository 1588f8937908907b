"""Faults of earlier rounds: ties and names in the mix, runs of quotation marks, halves of one class, mined entries."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomshed.llm import mixing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: The plain form of a quotation.
PLAIN = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|»[^«\n]*«|‹[^›\n]*›|`[^`\n]*`')


def test_reruns_of_the_mix_agree_on_rows_that_repeat_an_id(spark):
    rows = [(1 if i % 3 else i, f"w{i} " * (1 + i % 2), "en", "ab"[i % 7 == 0], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    runs = [sorted(r.text for r in mixing.mixed(docs.repartition(n)).collect()) for n in (1, 5, 13)]
    assert runs[0] == runs[1] == runs[2] and 3000 < len(runs[0]) < 6000


def test_the_mix_carries_columns_of_any_name(spark):
    names = ("positions", "position", "size", "target", "taken", "source_size", "tie", "h", "skey", "range", "start", "starts")
    rows = [(i, f"a b {i}", "en", "s", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.col("doc_id").alias(n) for n in names])
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert all(r[n] == r.doc_id for r in got.collect() for n in names)


def test_quotations_equal_the_plain_pattern():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice("ab \n\"“”„«»‹›`") for _ in range(r.randrange(30)))
        assert toxicity.quotations(text) == [m.span() for m in PLAIN.finditer(text)], text
        assert toxicity.unquoted(text) == PLAIN.sub(" ", text)


@pytest.mark.parametrize("mark", ["«", "»", '"', "„", "`"])
def test_unclosed_marks_take_linear_time(mark):
    began = time.process_time()
    toxicity.quotations(mark + "x")
    for n in (200_000, 400_000):
        text = (mark + "x") * n if mark in '"`' else mark * n
        toxicity.quotations(text)
    assert time.process_time() - began < 20


def test_a_half_of_one_class_tells_nothing(spark):
    for n in (1, 2, 3):
        rows = [(i, f"text {i} idiot" if i < n else f"text {i}") for i in range(8)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(i < n)) for i in range(8)], "doc_id long, toxic int")
        model = toxicity.train(docs, labels)
        scores = [r.score for r in toxicity.score_documents(docs, model).collect()]
        assert all(s > 0.05 for s in scores)


def test_mined_entries_equal_a_plain_count(spark):
    """Every entry that the thresholds let through, and no other."""
    r, fit = random.Random(3), toxicity.Fit(least_docs=3, purity=4.0)
    bad, good = [f"vile{i}x" for i in range(40)] + ["gruntly", "grunted", "grunts"], [f"word{i}" for i in range(60)]
    rows = []
    for i in range(400):
        y = i % 2
        words = [r.choice(good) for _ in range(12)] + ([r.choice(bad) for _ in range(3)] if y else [])
        rows.append((i, " ".join(words) + ' "' + r.choice(bad) + ' in a quotation"', y, i))
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int, copies long").withColumn(
        "own", F.udf(toxicity.unquoted)("text")
    )
    got = toxicity.mine(sample, fit, 200, 200)
    seen: dict[tuple[int, str], dict[int, int]] = {}
    for _, text, y, _ in rows:
        words = {w for w in re.findall(r"\w+", PLAIN.sub(" ", text)) if len(w) >= 4}
        for e in {(0, w) for w in words} | {(1, w[:k]) for w in words for k in range(4, 8) if len(w) >= k}:
            seen.setdefault(e, {0: 0, 1: 0})[y] += 1
    fine = {e: n for e, n in seen.items() if n[1] >= 3 and (n[1] / 200) / ((n[0] + 0.5) / 200) >= 4.0}
    whole = {w: n for (s, w), n in fine.items() if s == 0}
    stems: list[str] = []
    for (s, t), n in sorted(fine.items(), key=lambda x: (len(x[0][1]), x[0][1])):
        if s and not any(w.startswith(t) and m[1] >= 0.9 * n[1] for w, m in whole.items()) and not any(t.startswith(x) for x in stems):
            stems.append(t)
    assert set(got.stems) == set(stems) and stems
    assert set(got.words) == {w for w in whole if not any(w.startswith(x) for x in stems)}

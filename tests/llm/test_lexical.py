"""Block-max search against a plain version, on hard rows, with small blocks and batches."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomshed.llm import lexical
from loomshed.llm.common import scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, queries, k):
    terms = [(d, TERM.findall(lower(t))) for d, t in docs]
    terms = [(d, t) for d, t in terms if t]
    n_docs, total = len(terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in queries:
        asked = [w for w in set(TERM.findall(lower(text))) if w in df]
        found = []
        for d, t in terms:
            m = 50 + 50 * len(t) * n_docs // total
            score = 0
            for w in asked:
                if tf := t.count(w):
                    score += math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(80)] + ["été", "ÉTÉ", "中", "a1", "x"]
    text = lambda n: r.choice([" ", "_", "\x00", "\n- "]).join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.choice([1, 5, 20, 60]))) for i in range(150)]
    docs += [(i, docs[3][1]) for i in range(500, 540)]  # ties
    docs += [(7, docs[7][1]), (7, text(9)), (None, docs[3][1]), (None, docs[3][1]), (900, None), (901, ""), (902, " \x7f-_"), (903, text(30_000))]
    queries = [(i, text(r.choice([1, 3, 12]))) for i in range(25)]
    queries += [(3, "W1 w2"), (3, "W1 w2"), (None, "w3 été"), (80, None), (81, ""), (82, "unknown-word"), (83, "w1 w1 W1 unknown"), (84, docs[3][1])]
    return docs, queries


def run(spark, docs, queries, k, spec):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("block", "terms", "score")})
    q = spark.createDataFrame(queries, "item_id long, text string").withColumns({c: F.lit(1) for c in ("query", "term", "rank")})
    found = lexical.search(lexical.write_index(d, scratch(spark, "lexical-test"), spec), q, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


SPECS = {
    "as it is": lexical.Lexical(),
    "small": lexical.Lexical(docs=3, entries=40, buffer=100, postings=20, batch=2),
    "one wave": lexical.Lexical(docs=1, waves=()),
    "many waves": lexical.Lexical(docs=2, waves=(0.02, 0.05, 0.2, 0.5)),
}


@pytest.mark.parametrize("name", SPECS)
@pytest.mark.parametrize("k", [1, 7])
def test_search_equals_a_plain_version(spark, name, k):
    docs, queries = corpus()
    assert run(spark, docs, queries, k, SPECS[name]) == plain(docs, queries, k)


def test_ways_beyond_the_bounds_give_the_same(spark, monkeypatch):
    docs, queries = corpus(2)
    for name, value in (("MOST_PAIRS", 0), ("GATHERED", 3), ("EXACT", 1), ("SALT", 2)):
        monkeypatch.setattr(lexical, name, value)
    assert run(spark, docs, queries, 5, SPECS["small"]) == plain(docs, queries, 5)


@pytest.mark.parametrize("docs, queries", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "b")], [(1, "a")])])
def test_nothing_to_find(spark, docs, queries):
    assert run(spark, docs, queries, 5, lexical.Lexical()) == []


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    """Documents of two languages: a query of one leaves the blocks of the other, and most with low bounds, alone."""
    r = random.Random(4)
    tongues = [[f"{c}{i}" for i in range(300)] for c in "uv"]
    docs = [(i, " ".join([f"{'uv'[i % 2]}the"] * 5 + [r.choice(tongues[i % 2]) for _ in range(30)])) for i in range(2000)]
    docs += [(5000 + i, " ".join(f"u{j}" for j in range(10)) + f" u{i}") for i in range(60)]
    queries = [(1, " ".join(f"u{j}" for j in range(10)))]
    scored, whole = [], lexical.Batch.sums

    def counted(self, row, terms, shares, n_rows):
        scored.append(n_rows)
        return whole(self, row, terms, shares, n_rows)

    path = scratch(spark, "lexical-test")
    index = lexical.write_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), path, lexical.Lexical(docs=16))
    waves = []
    plain_scored = lexical._scored

    def watched(index, chosen, *rest):
        waves.append(chosen.count())
        return plain_scored(index, chosen, *rest)

    monkeypatch.setattr(lexical, "_scored", watched)
    got = lexical.search(index, spark.createDataFrame(queries, "item_id long, text string"), 50).collect()
    assert len(got) == 50 and all(g.doc_id >= 5000 for g in got)
    assert sum(waves) < 0.5 * index.maxima().count()

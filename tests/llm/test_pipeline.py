"""The pipeline against a plain-Python version of its stages, on a small fixture of hard rows."""

import hashlib
import random
from collections import defaultdict

import corpus_pipeline
from loomshed.llm import bpe, pii, toxicity
from loomshed.llm.registry import tokenizer
from loomshed.session import table
from tests.llm.test_brute_force import DOCS, WORDS, brute_components, corpus


def fixture(spark, path):
    r = random.Random(11)
    rows, labels = [], []
    for i, t in corpus(3, 50):
        if i is not None:
            rows.append((i, t, "en", None if i % 9 == 0 else f"s{i % 4}", None if t is None else len(t)))
    for i in range(20_000, 20_080):
        words = [r.choice(WORDS) for _ in range(50)]
        bad = i % 2 == 0
        if bad:
            words[r.randrange(50)] = r.choice(["idiotic", "scumbag"])
            words[r.randrange(50)] = "worthless"
        if i % 5 == 0:
            words.append(f"mail me{i}.x@mail.example.com or +1 (555) 010-99{i % 100:02d}")
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(bad)))
    labels += [(i, 1, 0) for i, *_ in rows[:40]]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_pipeline_equals_plain_version(spark, tmp_path):
    path = str(tmp_path)
    rows = fixture(spark, path)
    got = corpus_pipeline.run(spark, path).collect()

    docs = {i: (t, s) for i, t, _, s, _ in rows}
    model = toxicity.train(table(spark, path, "documents"), table(spark, path, "labels"))
    scorer = toxicity.Scorer(model.lexicon, model.window)
    clean = {i: v for i, v in docs.items() if toxicity._score(model.weights, scorer.features(v[0])) < 0.5}
    assert len(docs) - len(clean) >= 35
    kept = {i: clean[i] for i, (_, c) in brute_components([(i, t) for i, (t, _) in clean.items()], 5).items() if i == c}
    assert len(kept) < len(clean)
    stage2 = spark.createDataFrame([(i, t) for i, (t, _) in kept.items()], "doc_id long, text string")
    weights = pii.train(stage2)
    shown = {i: (pii.redact(t, [s for part in pii.find_spans(t or "", weights) for s in part]), s) for i, (t, s) in kept.items()}
    assert not any("@mail" in (t or "") for t, _ in shown.values())

    size = {i: len((t or "").encode().split()) for i, (t, _) in shown.items()}
    sources = defaultdict(list)
    for i, (_, s) in shown.items():
        sources[s].append(i)
    total = {s: sum(size[i] for i in ids) for s, ids in sources.items()}
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    want = defaultdict(int)
    for s, ids in sources.items():
        at = 0
        for i in sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            for p in (0, 1):
                want[i] += size[i] > 0 and at + p * total[s] < target[s] - 1e-6
            at += size[i]

    ranks, pattern = tokenizer(spark)
    enc = bpe.encoder(ranks, pattern)
    copies = defaultdict(int)
    for r in got:
        copies[r.doc_id] += 1
        text = shown[r.doc_id][0] or ""
        assert r.token_ids == enc.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert dict(copies) == {i: n for i, n in want.items() if n}


def test_stages_keep_the_columns_and_pass_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

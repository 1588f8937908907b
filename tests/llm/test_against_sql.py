"""The subpackage's queries against their SQL twins, on the tables and on tables of hard rows; and held-out accuracy."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomshed.llm import registry, toxicity, url_reputation
from loomshed.session import ship, table

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
TABLES = ("documents", "embeddings", "pages", "labels", "conversations", "benchmark")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def equal(spark, name, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet{'' if sf == SF else '/*.parquet'}')")
    got = registry.queries()[name](spark, sf)
    want = c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    left = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=key)
    right = sorted((tuple(norm(v) for v in r) for r in want.fetchall()), key=key)
    assert left == right
    return left


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    ship(spark)
    assert equal(spark, name, SF)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Tables with nulls in every column, empty and long texts, ties, repeated ids and rows."""
    root, r = str(tmp_path_factory.mktemp("hard")), random.Random(17)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(r.randrange(1, 60)) for _ in range(40)]
    docs = [(i, t, "en", r.choice(["a", "b", None]), len(t)) for i, t in enumerate(base)]
    docs += [(100 + i, t + " tail" * (i % 2), None, "a", None) for i, t in enumerate(base[:20])]
    docs += [
        (7, text(30), "en", "a", 1),
        (8, base[3].upper(), "en", "b", 1),
        (200, None, None, None, None),
        (201, "", "en", "c", 0),
        (202, " \t\n", "en", "c", 3),
        (203, text(20_000), "en", "a", 1),
        (204, "one", "en", "b", 1),
        (205, "ONE", "en", "b", 1),
    ]
    spark.createDataFrame(
        docs, "doc_id long, text string, lang string, source string, n_chars long"
    ).repartition(3).write.parquet(f"{root}/documents.parquet")
    vec = lambda: [r.uniform(-1, 1) for _ in range(8)]
    vectors = [(i, vec(), 0) for i in range(160)] + [
        (50, vec(), 0),
        (50, None, 0),
        (100, [None] * 8, 0),
        (150, [float("inf")] * 8, 0),
        (None, vec(), 0),
        (300, [], 0),
        (301, [], 0),
        (350, [1.0], 0),
        (12, vec(), None),
    ]
    vectors += [(i, vectors[5][1], 0) for i in range(400, 406)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    big = "<p>" + "é" * 700
    urls = [
        "http://A.example.net/es/x",
        "https://user@casino.org:80/a?b#c",
        "ftp://10.0.0.1/x",
        "no scheme",
        None,
        "http://b.co.uk/",
        "http://www.example.com/en/1",
        "http://sub.example.com/en/",
        "http://x.net/fr/",
        "http://c.org",
        "http://[::1]:8/p",
        "a://b://c",
    ]
    pages = [
        (
            i, urls[i % len(urls)], r.choice([None, "", "short", big, big + str(i % 3), f"the Casino {i}", "x" * 999, "x" * 1000])
        ) for i in range(150)
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    turns = [
        (c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", "", None]))
        for c in [*range(40), 100, 101, 104] for t in range(r.choice([1, 3, 9, 12]))
    ]
    turns += [(60, None, "user", "x"), (60, 1, "b", "x"), (60, 1, "a", "y"), (60, 1, "a", "y"), (60, 1, "a", "z"), (None, 1, "a", "b")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{root}/conversations.parquet")
    items = [(i, text(r.choice([1, 4, 15]))) for i in range(12)] + [(3, "W1 w2"), (None, "w3 One"), (20, None), (21, ""), (22, "none-such")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.mark.parametrize("name", ["op1_url_reputation", "op2_warc", "op5_top_k", "op8_near_duplicates", "op11_conversation_trie", "op12_lexical_search"])
def test_query_equals_sql_on_hard_rows(spark, hard, name):
    ship(spark)
    assert equal(spark, name, hard)


def test_posteriors_equal_a_plain_version(spark):
    r = random.Random(4)
    hosts = [f"{a}.{b}.{c}" for a in "pqr" for b in ("one", "two", "three") for c in ("com", "co.uk", "org")]
    rows = [(i, r.choice(hosts)) for i in range(600)]
    rate = {h: r.random() for h in hosts}
    good = {i: None if r.random() < 0.1 else int(r.random() < rate[h]) for i, h in rows}
    outcomes = spark.createDataFrame([(h, good[i]) for i, h in rows], "host string, good int")
    got = {x.host: (x.n, x.k, x.mean, x.alpha + x.beta) for x in url_reputation.host_reputation(outcomes).collect()}

    tally = lambda name: {
        k: (
            sum(good[i] is not None for i, h in rows if name(h) == k), sum(good[i] or 0 for i, h in rows if name(h) == k)
        ) for k in {name(h) for _, h in rows}
    }
    suffix = lambda h: "co.uk" if h.endswith("co.uk") else h.rsplit(".", 1)[1]
    domain = lambda h: h.split(".", 1)[1]

    def shrink(counts, prior):
        known = [(n, k, prior[c]) for c, (n, k) in counts.items() if n]
        total = sum(n for n, *_ in known)
        between = (sum(n * (k / n - m) ** 2 for n, k, m in known) - sum(m * (1 - m) for *_, m in known)) / total
        noise = sum(n * m * (1 - m) for n, _, m in known) / total
        s = 1000.0 if between <= 0 else min(1000.0, max(1.0, noise / between - 1))
        return {c: ((k + s * prior[c]) / (n + s), n + s) for c, (n, k) in counts.items()}

    n, k = sum(v is not None for v in good.values()), sum(v or 0 for v in good.values())
    tops = tally(suffix)
    a = shrink(tops, dict.fromkeys(tops, (k + 1) / (n + 2)))
    names = {domain(h): suffix(h) for _, h in rows}
    b = shrink(tally(domain), {d: a[s][0] for d, s in names.items()})
    mine = tally(lambda h: h)
    c = shrink(mine, {h: b[domain(h)][0] for h in mine})
    for h, (n, k) in mine.items():
        assert got[h][:2] == (n, k) and got[h][2:] == pytest.approx(c[h])


def test_held_out_documents_are_told(spark):
    """Learned without a fifth of the labelled rows; those are judged."""
    ship(spark)
    got = registry.op9_toxicity(spark, MORE).join(table(spark, MORE, "labels"), "doc_id").filter("held_out")
    told = {(r.toxic, r.predicted): r.n for r in got.groupBy("toxic", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = told.get((1, 1), 0) + told.get((1, 0), 0), told.get((0, 1), 0) + told.get((0, 0), 0)
    assert toxic > 80 and clean > 500
    assert told.get((1, 1), 0) / toxic >= 0.9 and told.get((0, 1), 0) / clean <= 0.01


def test_features_are_sums_over_hits():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "moron": 3.0}, {"blorgen": 1.5})
    scorer = toxicity.Scorer(lexicon, 2)
    text = 'a idiot b c d e blorgenia f g h i morom j k l m "moron" n o p q blorgem r'
    hits = [(h.kind, h.term, h.quoted) for h in scorer.hits(text)]
    assert hits == [
        ("word", "idiot", False),
        ("stem", "blorgen", False),
        ("near", "moron", False),
        ("word", "moron", True),
        ("near stem", "blorgen", False),
    ]
    names = dict(zip(toxicity.FEATURES, scorer.features(text), strict=True))
    want = {
        "words": math.log1p(2.0),
        "stems": math.log1p(1.5),
        "near": math.log1p(3.0),
        "near stems": math.log1p(1.5),
        "quoted": math.log1p(3.0),
        "address": 0.0,
        "distinct": math.log1p(2),
        "dense": math.log1p(2000 / (len(text) + 1)),
    }
    assert names == pytest.approx(want)
    assert scorer.hits(None) == scorer.hits("") == [] and scorer.features(None) == [0.0] * len(toxicity.FEATURES)

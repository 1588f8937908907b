"""Sets of patterns against a loop over them."""

import random

import pytest

from loomshed.functions import patterns
from loomshed.session import table


def fits(pattern, name):
    if pattern.startswith("*"):
        return name.endswith(pattern[1:])
    if pattern.endswith("*"):
        return name.startswith(pattern[:-1])
    return name == pattern


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_random_patterns_equal_a_loop(spark, monkeypatch, most):
    monkeypatch.setattr(patterns, "MOST_BYTES", most)
    r = random.Random(1)
    text = lambda n: "".join(r.choice("ab*é.") for _ in range(n))
    asked = [r.choice(["*{}", "{}*", "{}"]).format(text(r.randrange(1, 4))) for _ in range(60)] + [None]
    paths = ["/".join(text(r.randrange(5)) for _ in range(r.randrange(1, 4))) for _ in range(400)] + [None, "", "*", "a*"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = patterns.ignored(rows, "path", spark.createDataFrame([(p,) for p in asked], "pattern string")).collect()
    assert len(got) == len(paths)
    for row in got:
        want = row.path is not None and any(fits(p, n) for p in asked if p is not None for n in row.path.split("/"))
        assert row.ignored == want, row.path


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_marks_alone_and_no_patterns(spark, monkeypatch, most):
    monkeypatch.setattr(patterns, "MOST_BYTES", most)
    rows = spark.createDataFrame([("a/b",), ("",), (None,)], "path string")
    for asked, want in (([], {False}), (["*"], {True, False})):
        got = patterns.ignored(rows, "path", spark.createDataFrame([(p,) for p in asked], "pattern string"))
        assert {r.ignored for r in got.collect()} == want


def test_ten_thousand_patterns_against_every_page(spark):
    r = random.Random(2)
    urls = [x.url for x in table(spark, "/root/testdata/sf0.01", "pages").select("url").collect() if x.url]
    asked = set()
    while len(asked) < 10_000:
        name = r.choice(r.choice(urls).split("/")) + r.choice(["", "x", "y7"])
        n = r.randrange(len(name) + 1)
        asked.add(r.choice([f"*{name[n:]}z" if r.random() < 0.9 else f"*{name[n:]}", f"{name[:n]}q*", name + r.choice("abc")]) + str(len(asked) % 977) * (r.random() < 0.5))
    frame = spark.createDataFrame([(p,) for p in asked], "pattern string")
    got = {x.url: x.ignored for x in patterns.ignored(table(spark, "/root/testdata/sf0.01", "pages").select("url"), "url", frame).collect()}
    held = patterns.Patterns.of(list(asked))
    for url in r.sample(urls, 150):
        assert got[url] == any(fits(p, n) for p in asked for n in url.split("/"))
    assert all(got[u] == any(held.match(n) for n in u.split("/")) for u in urls)

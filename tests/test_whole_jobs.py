"""Queries that must take every row and every character, against plain forms over the tables."""

import html
from datetime import UTC

import duckdb
import pyarrow.parquet as pq

from loomshed.operators import planning
from loomshed.plans import registry

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(name, *columns, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).to_pylist()


def test_every_event_reaches_the_ledger(spark):
    got = sorted((int(r.created), r.command, r.output) for r in registry.queries()["torn_ledger"](spark, SF).collect())
    want = sorted((int(e["ts"].replace(tzinfo=UTC).timestamp()), e["event_type"], f"reel{e['user_id']}") for e in rows("events", "event_id", "ts", "event_type", "user_id") if e["event_id"] % 7 != 3)
    assert got == want and len(want) > 500


def test_every_offender_gets_an_action(spark):
    quality = {r["doc_id"]: r["quality"] for r in rows("labels", "doc_id", "quality", sf=MORE)}
    clips: dict = {}
    for d in rows("documents", "doc_id", "source", "n_chars", sf=MORE):
        clips.setdefault(d["source"], []).append(d)
    want = set()
    for clip, docs in clips.items():
        places = {i: n for n, i in enumerate(sorted({d["doc_id"] for d in docs}), 1)}
        for d in docs:
            if d["n_chars"] > 1000:
                q = quality.get(d["doc_id"])
                want.add((clip, d["doc_id"], places[d["doc_id"]], "no master" if q is None else "master bad" if q == 0 else "restore"))
    got = [tuple(r) for r in registry.queries()["restore_plan"](spark, MORE).select("clip", "doc_id", "n", "action").collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(w[2] for w in want) > 10


def test_dense_places_over_ranges(spark):
    data = [(g, i) for g, i in [(None, 5), (None, None), ("a", None), ("a", -7), ("a", -7), ("a", 900), ("b", 3)]] + [("hot", i * i) for i in range(50)]
    got = planning.with_dense_place(spark.createDataFrame(data, "g string, i long"), "g", "i", range_rows=3).collect()
    order = lambda i: (i is not None, i or 0)
    places = {g: {i: n for n, i in enumerate(sorted({i for h, i in data if h == g}, key=order), 1)} for g, _ in data}
    assert sorted(((r.g, r.i, r.n) for r in got), key=repr) == sorted(((g, i, places[g][i]) for g, i in data), key=repr)
    assert planning.with_dense_place(spark.createDataFrame([], "g string, i long"), "g", "i").count() == 0


def test_whole_pages_are_escaped(spark):
    want = {}
    for p in rows("pages", "page_id", "html"):
        t = p["html"]
        want[p["page_id"]] = ('"' + t.replace('"', '""') + '"' if any(c in t for c in ',"\r\n') else t, html.escape(t).replace("&#x27;", "&#39;"))
    got = {r.page_id: (r.csv, r.html_) for r in registry.queries()["text_escapes"](spark, SF).collect()}
    assert got == want and max(len(r["html"]) for r in rows("pages", "html")) > 200


def test_numbers_of_more_than_six_digits_are_whole(spark, tmp_path):
    found = pq.read_table(f"{SF}/part.parquet")
    numbers = [0, 7, 99_999, 999_999, 1_000_000, 1_000_001, 1_199_999, 12_345_678, 2**53 + 1, 2**62 + 1]
    at = found.schema.get_field_index("p_partkey")
    pq.write_table(found.slice(0, len(numbers)).set_column(at, found.schema.field(at), [numbers]), tmp_path / "part.parquet")
    got = registry.queries()["scalar_keys"](spark, str(tmp_path))
    want = duckdb.sql(registry.oracle_sql()["scalar_keys"].replace("FROM part", f"FROM '{tmp_path}/part.parquet'"))
    assert {r.p_partkey: r.num for r in got.collect()} == {n: str(n) for n in numbers}
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())

"""The conversation trie against a plain version, on rows with nulls, ties, long shared prefixes and copies."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomshed.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(seed=1):
    r = random.Random(seed)
    rows = []
    for c in [*range(60), 1000, 1001, 1004, -7, -5]:
        for t in range(r.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", "", None])))
    for c in range(200, 240, 5):  # one sequence, and others that leave it late
        shared = [(t, "user", f"turn {t % 3}") for t in range(40)]
        rows += [(c, *x) for x in shared[: 40 if c % 10 else 25]] + [(c, 41, "user", str(c % 3))]
    rows += [(70, None, "user", "first"), (70, 3, "b", "x"), (70, 3, "a", "y"), (70, 3, "a", "y"), (70, 3, "a", "x")]
    rows += [(None, 1, "user", "no conversation"), (75, 0, None, None)]
    r.shuffle(rows)
    return rows


def plain(rows, family=5, cycle=9):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            held[c].append(((turn is not None, turn or 0), role, hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(role, text) for *_, role, _, text in sorted(v)] for c, v in held.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % cycle
        base = c - int(abs(c) % family * (1 if c >= 0 else -1))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        own_bytes = len(p[-1][1].encode()) if p else 0
        saved[p] = (len(members[p]) - 1) * own_bytes + sum(saved[k] for k in kids[p])
    return sorted(
        (
            min(m),
            len(p),
            min(members[p[:-1]]) if p else None,
            len(m),
            len(kids[p]),
            leaves[p],
            saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def built(df):
    found = trie.prefix_trie(trie.rebuilt(trie.numbered(df)))
    assert found.columns == list(COLUMNS)
    return sorted(tuple(r) for r in found.collect())


def test_trie_equals_a_plain_version(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in ("node", "depth", "len", "digest", "place", "block", "n"):
        df = df.withColumn(c, F.lit(1))
    got = built(df)
    assert got == plain(rows) and max(r[1] for r in got) > 2 * trie.AHEAD


def test_small_parts_segments_and_files_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(trie, "PART", 3)
    monkeypatch.setattr(trie, "SEGMENT", 4)
    monkeypatch.setattr(trie, "AHEAD", 3)
    monkeypatch.setattr(trie, "FILE_ROWS", 5)
    rows = conversations(2) + [(c, 0, "user", "same") for c in range(300, 360)]
    assert built(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(4, 0, "user", "only")], [(5, None, None, None)]])
def test_tables_with_next_to_nothing(spark, rows):
    assert built(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_one_conversation_and_its_copies_are_one_chain(spark):
    rows = [(c, t, "user", "x" * t) for c in range(0, 50, 5) for t in range(100)]
    assert built(spark.createDataFrame(rows, SCHEMA)) == plain(rows)

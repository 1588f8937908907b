"""Prefix trie of conversations, built level by level from the top and rolled up level by level from below.

A turn is compared by a SHA-256 of its role and text, taken where the text lies, so that no
text is shuffled. Per depth, the conversations that still share something (the live ones) are
grouped by (parent node, next turn); a node's name is the smallest conversation in it. A group
whose conversations are all one sequence, above all a group of one, is a chain from there on:
its nodes are written down directly from its turns, and it leaves the loop. So the number of
levels is the longest prefix that different conversations share, not the longest conversation.

Defined results: rows without conv_id are left out; null role or text counts as empty; turns
stand by turn number, null first, those that share one by role, then by the SHA-256 of their
text; repeated rows are turns of their own; other columns are not read; an empty table has no node.

No step holds a conversation or a group whole: turns are numbered in ranges of the order
(``scratch.placed``), sums along a chain are made in segments, groups are counted with map-side
sums, members find their group by a join of written tables, and the ids that end at a node are
joined in parts of ``PART`` ids, which one hash reads in turn.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomshed.llm.common import free, stored
from loomshed.scratch import placed

#: Turns that a live conversation carries along; every so many levels it fetches the next ones.
AHEAD = 16
#: Turns of a chain that are summed in one piece.
SEGMENT = 4096
#: Rows of a file of a level's tables: levels are many and can be small, so their files follow their rows.
FILE_ROWS = 5_000
#: Ids that are joined to one string.
PART = 65_536


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes): every turn with its place from 1 in its conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_digest"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = placed(narrow, "conv_id", F.col("turn").asc_nulls_first(), "role", "text_digest")
    first = stored(order.groupBy("conv_id").agg(F.min("place").alias("_first")), "trie-first")
    pos = (F.col("place") - F.col("_first") + 1).alias("pos")
    found = stored(order.join(first, "conv_id").select("conv_id", pos, "digest", "bytes"), "trie-numbered")
    free(first)
    return found


def rebuilt(turns: DataFrame, family: int = 5, cycle: int = 9) -> DataFrame:
    """(conv_id, depth, digest, bytes) of every conversation with its beginning taken from its family's first one.

    Conversation c begins with the first h turns of c - c % family, h = crc32(c) % cycle, and goes on
    with its own after its first h. A conversation left without turns is one row of depth 0.
    """
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < cycle))
    bases = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("n_base"))
    plan = counts.select(
        "conv_id",
        "n",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % cycle).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
    )
    plan = plan.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    plan = stored(plan.select("conv_id", "base", "n", "h", "taken"), "trie-plan")
    begun = plan.join(heads.withColumnRenamed("conv_id", "base"), "base").filter(F.col("pos") <= F.col("h"))
    own = turns.join(plan, "conv_id").filter(F.col("pos") > F.col("h"))
    bare = plan.filter((F.col("taken") == 0) & (F.col("n") <= F.col("h")))
    return (
        begun.select("conv_id", F.col("pos").alias("depth"), "digest", "bytes")
        .unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes"))
        .unionByName(
            bare.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes"))
        )
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row a node of the trie of (conv_id, depth, digest, bytes), depths of a conversation running from 1.

    A conversation without turns is a row of depth 0. Gives conv_id (the node's smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    turns = stored(turns, "trie-turns")
    # Two sums without order over (depth, turn) tell whether two conversations are one sequence.
    mark = [F.bit_xor(F.xxhash64(*c)) for c in (("depth", "digest"), ("digest", "depth", F.lit(7)))]
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("len"), mark[0].alias("x"), mark[1].alias("y"), _ahead(0))
    members, groups = _root(stored(convs, "trie-convs"))
    nodes, ended, chained, depth, sizes = [groups], [], [], 0, [1]
    while True:
        done = F.col("alike") | (F.col("len") == depth)
        ended.append(members.filter(done).select("conv_id", "node", "len"))
        chained.append(groups.filter("alike").select("node", "depth", "n"))
        live = members.filter(~done)
        rows = live.count()
        if not rows:
            break
        sizes.append(rows)
        if depth and depth % AHEAD == 0:
            further = turns.filter(F.col("depth") > depth).groupBy("conv_id").agg(_ahead(depth))
            live = stored(live.drop("ahead").join(further, "conv_id"), "trie-live")
        depth += 1
        members, groups = _level(live, depth, rows)
        nodes.append(groups)
    chains = _chains(reduce(DataFrame.unionByName, chained), turns)
    whole = _rolled_up(nodes, sizes, chains)
    ends = _ends(reduce(DataFrame.unionByName, ended))
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.join(ends, ["depth", "conv_id"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def _ahead(depth: int):
    """A conversation's next ``AHEAD`` turns below a depth, in order; null elements never arise, shorter ones have fewer."""
    turn = F.when(F.col("depth").between(depth + 1, depth + AHEAD), F.struct("depth", "digest", "bytes"))
    return F.sort_array(F.collect_list(turn)).alias("ahead")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most so many rows in as many files as they fill."""
    return df.coalesce(1 + rows // FILE_ROWS)


def _told() -> list:
    """The aggregates of a group: its name, its size, the bytes of its turn, and whether its members are one sequence."""
    return [
        F.min("conv_id").alias("node"),
        F.count(F.lit(1)).alias("n"),
        F.max("bytes").alias("bytes"),
        ((F.min("x") == F.max("x")) & (F.min("y") == F.max("y"))).alias("alike"),
    ]


def _root(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and group of depth 0."""
    rows = convs.withColumns({"bytes": F.lit(0).cast("long")})
    group = stored(
        rows.agg(*_told()).filter("n > 0").select(F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), "node", "n", "bytes", "alike"),
        "trie-root",
    )
    root = group.first()
    node, alike = (root["node"], root["alike"]) if root else (None, True)
    return convs.withColumns({"node": F.lit(node).cast("long"), "alike": F.lit(alike)}), group


def _level(live: DataFrame, depth: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Members (conv_id, node, len, x, y, ahead, alike) and groups (depth, parent, node, n, bytes, alike) of one depth."""
    turn = F.col("ahead")[(depth - 1) % AHEAD]
    asked = live.select(
        "conv_id", F.col("node").alias("parent"), "len", "x", "y", "ahead", turn["digest"].alias("digest"), turn["bytes"].alias("bytes")
    )
    groups = stored(_sized(asked.groupBy("parent", "digest").agg(*_told()), rows), "trie-groups")
    members = asked.join(groups.select("parent", "digest", "node", "alike"), ["parent", "digest"])
    members = members.select("conv_id", "node", "len", "x", "y", "ahead", "alike")
    members = stored(_sized(members, rows), "trie-members")
    return members, groups.select(F.lit(depth).alias("depth"), "parent", "node", "n", "bytes", "alike")


def _chains(alike: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes below groups of one sequence: (depth, parent, node, n, n_children, saved, head), by their own turns.

    What is saved below a node is the sum to the chain's end, made in segments of depths.
    """
    start = stored(alike.select(F.col("node").alias("conv_id"), F.col("depth").alias("start"), "n"), "trie-chains")
    rows = turns.join(start, "conv_id").filter(F.col("depth") > F.col("start"))
    rows = stored(rows.select("conv_id", "depth", "start", "n", "bytes", F.expr(f"depth div {SEGMENT}").alias("segment")), "trie-chained")
    parts = rows.groupBy("conv_id", "segment").agg(F.sum("bytes").alias("_sum"), F.max("depth").alias("_last"))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("segment"))
    parts = parts.select(
        "conv_id",
        "segment",
        (F.sum("_sum").over(behind) - F.col("_sum")).alias("_behind"),
        F.max("_last").over(behind).alias("_end"),
    )
    inside = Window.partitionBy("conv_id", "segment").orderBy(F.desc("depth"))
    rest = F.sum("bytes").over(inside) + F.col("_behind")
    return stored(
        rows.join(parts, ["conv_id", "segment"]).select(
            "depth",
            F.col("conv_id").alias("parent"),
            F.col("conv_id").alias("node"),
            "n",
            (F.col("depth") < F.col("_end")).cast("long").alias("n_children"),
            ((F.col("n") - 1) * rest).alias("saved"),
            (F.col("depth") == F.col("start") + 1).alias("head"),
        ),
        "trie-chain-nodes",
    )


def _rolled_up(nodes: list[DataFrame], sizes: list[int], chains: DataFrame) -> DataFrame:
    """All nodes with children, leaves and savings, from the deepest level up; a level is joined to sums of the one below."""
    done, below = [], None
    heads = chains.filter("head").select("depth", "parent", F.lit(1).cast("long").alias("leaves"), "saved")
    for depth in reversed(range(len(nodes))):
        kids = heads.filter(F.col("depth") == depth + 1).drop("depth")
        if below is not None:
            kids = kids.unionByName(below.select("parent", "leaves", "saved"))
        sums = kids.groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved")
        )
        zero = F.lit(0).cast("long")
        below = nodes[depth].join(sums, "node", "left").select(
            "depth",
            "parent",
            "node",
            "n",
            F.coalesce("kids", zero).alias("n_children"),
            F.coalesce("_leaves", F.lit(1).cast("long")).alias("leaves"),
            ((F.col("n") - 1) * F.col("bytes") + F.coalesce("_saved", zero)).alias("saved"),
        )
        below = stored(_sized(below, sizes[depth]), "trie-rolled")
        done.append(below)
    flat = chains.select("depth", "parent", "node", "n", "n_children", F.lit(1).cast("long").alias("leaves"), "saved")
    every = reduce(DataFrame.unionByName, done).unionByName(flat)
    return every.select(
        F.col("node").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
    )


def _ends(ended: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256): the digest of the ids, ascending and joined by commas, that end at a node."""
    order = placed(ended, "node", "len", "conv_id")
    one = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    parts = order.groupBy("len", "node", F.expr(f"place div {PART}").alias("part")).agg(one.alias("ids"))
    parts = stored(parts, "trie-ends")
    several = parts.groupBy("len", "node").agg(F.count(F.lit(1)).alias("k"), F.max("ids").alias("ids"))
    alone = several.filter("k = 1").select("len", "node", F.sha2("ids", 256).alias("ends_sha256"))
    hot = parts.join(several.filter("k > 1").select("len", "node"), ["len", "node"])
    hot = hot.repartition("len", "node").sortWithinPartitions("len", "node", "part").select("len", "node", "ids")
    streamed = hot.mapInArrow(_streamed, "len long, node long, ends_sha256 string")
    return alone.unionByName(streamed).withColumnsRenamed({"len": "depth", "node": "conv_id"})


def _streamed(batches):
    """One digest for each run of rows of a node, a part at a time."""
    key, h = None, None

    def out():
        return pa.RecordBatch.from_pydict(
            {"len": pa.array([key[0]], pa.int64()), "node": pa.array([key[1]], pa.int64()), "ends_sha256": [h.hexdigest()]}
        )

    for batch in batches:
        for n, node, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (n, node) != key:
                if h is not None:
                    yield out()
                key, h = (n, node), hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
    if h is not None:
        yield out()

"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each text becomes its set of hashed word shingles, a 128-bit digest of the whole
   set, 128 minima in 32 bands, and the low 4 bits of every minimum packed in 64 bytes.
2. Rows with equal sets form classes; from here on each class is one node, named
   by its least row number, so groups of exact copies cost one node however large,
   and rows that repeat a doc_id with other texts are nodes of their own.
3. Nodes that share a band are candidates. First each is compared with the least
   node (the pivot) of its bands; the pair with the best estimate is confirmed.
   The estimate counts equal b-bit minima and takes out chance collisions:
   J = (matches/k - 2^-b) / (1 - 2^-b).
4. Links confirmed so far give components. Only bands with more than one component
   among their nodes can hide a link that matters. Such a band is compared by
   packed bits alone: the nodes outside its largest component (the askers) are held
   against all its nodes, in blocks by blocks, so a hot band is many tasks and
   a band of near copies of one another costs what stands apart in it. A task emits
   of the pairs that the estimate lets through only those that connect, fewer than
   its nodes, so a group of n gives no n^2 rows.
5. Nodes connected by such pairs form clusters: chains of true likeness, not of
   chance bands. Inside a cluster, again askers against all in blocks, the pairs
   that the estimate lets through are tested on their full sets in the task, best
   first, unless their ends are connected by then; only links that connect leave it.
   So no pair goes untested whose link could matter.
6. Full sets are fetched for the nodes of star pairs and of clusters only.

A pair at the threshold shares no band with probability (1 - 0.8^4)^32 < 5e-8,
and pairs are dropped by their estimate only ``sigmas`` standard deviations
below the threshold. What is kept of a link is its effect on components.

Defined results: null and empty texts have no shingles and no links; texts with
fewer words than a shingle are one shingle; rows without doc_id link with
nothing, have no component and are kept; rows that repeat a doc_id are judged
each by its own text; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomshed.llm.common import WORD, free, stored


@dataclass(frozen=True)
class NearDup:
    """``words`` a shingle, least Jaccard similarity in hundredths, minima, bands, bits kept of each minimum.

    A band or cluster is dealt into ``parts`` blocks, of ``least_block`` nodes at least and
    ``block`` at most, and of ``items`` shingles. ``known``: ids that are broadcast at most
    to find texts; more are joined.
    """

    words: int = 5
    percent: int = 80
    minima: int = 128
    bands: int = 32
    bits: int = 4
    sigmas: float = 5.0
    block: int = 4_000
    least_block: int = 256
    parts: int = 64
    items: int = 2_000_000
    known: int = 1_000_000

    @property
    def least_estimate(self) -> float:
        t, c = self.percent / 100, 2.0**-self.bits
        p = t + (1 - t) * c
        return t - self.sigmas * math.sqrt(p * (1 - p) / self.minima) / (1 - c)


# Odd multipliers of a published 64-bit mixer.
_M1, _M2, _GOLD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int):
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z lower-cased, words split at ASCII white space."""
    import numpy as np
    import xxhash

    # Bytes split and lower-case by ASCII alone, as the definition asks.
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(t) for t in tokens], np.uint64)
    k = min(words, len(tokens))
    n = len(tokens) - k + 1
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc = _mix(acc + h[i : i + n] * np.uint64(2 * i + 1) + np.uint64(_GOLD * (i + 1) & (1 << 64) - 1))
    return np.unique(acc)


def _functions(minima: int):
    import numpy as np

    rng = np.random.default_rng(20240)
    return (rng.integers(0, 1 << 32, minima, np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, minima, np.uint32)


def signatures(sets: list, spec: NearDup):
    """Minima of a list of non-empty sets, as (sets x minima) 32-bit words."""
    import numpy as np

    a, b = _functions(spec.minima)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    all_ = np.concatenate(sets)
    x = (all_ ^ (all_ >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(sets), spec.minima), np.uint32)
    tmp = np.empty_like(x)
    for k in range(spec.minima):
        np.multiply(x, a[k], out=tmp)
        tmp += b[k]
        out[:, k] = np.minimum.reduceat(tmp, starts)
    return out


def pack(minima, bits: int):
    """Low bits of the minima, packed into 64-bit words: (rows x words)."""
    import numpy as np

    per = 64 // bits
    low = (minima & np.uint32((1 << bits) - 1)).astype(np.uint64)
    pad = -low.shape[1] % per
    low = np.pad(low, ((0, 0), (0, pad)))
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(bits))[None, None, :]
    return np.bitwise_or.reduce(low.reshape(len(low), -1, per) << shifts, axis=2)


def estimate(x, y, spec: NearDup):
    """Collision-corrected similarity of packed rows, by counting equal b-bit fields."""
    import numpy as np

    diff = x ^ y
    folded = diff.copy()
    for s in range(1, spec.bits):
        folded |= diff >> np.uint64(s)
    ones = np.uint64(sum(1 << i for i in range(0, 64, spec.bits)))
    unequal = np.bitwise_count(folded & ones).sum(-1, dtype=np.int64)
    c = 2.0**-spec.bits
    return ((spec.minima - unequal) / spec.minima - c) / (1 - c)


_SIG = "doc_id long, tie long, n long, d1 long, d2 long, bands array<long>, sig binary"


def _digest(items) -> tuple[int, int]:
    """128 bits of a whole set, in any order."""
    import numpy as np

    return int(_mix(items).sum(dtype=np.uint64).view(np.int64)), int(
        _mix(items ^ np.uint64(_GOLD)).sum(dtype=np.uint64).view(np.int64)
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sign(docs: DataFrame, spec: NearDup) -> DataFrame:
    """(doc_id, tie, n, d1, d2, bands, sig) of every row: a hash of the text, set size, 128-bit digest of the set, band keys, packed bits."""

    def run(batches):
        import numpy as np

        rows_per = spec.minima // spec.bands
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                sets, size, first = [], 0, at
                while at < len(texts) and size < 500_000:
                    sets.append(shingle_set(texts[at], spec.words))
                    size += len(sets[-1])
                    at += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                n = [len(s) for s in sets]
                d1, d2 = [0] * len(sets), [0] * len(sets)
                bands: list = [None] * len(sets)
                sig: list = [None] * len(sets)
                if full:
                    minima = signatures([sets[i] for i in full], spec)
                    bits = pack(minima, spec.bits)
                    keys = np.zeros((len(full), spec.bands), np.uint64)
                    place = np.arange(spec.bands, dtype=np.uint64) * np.uint64(_M2)
                    for j in range(rows_per):
                        keys = _mix(keys * np.uint64(_GOLD) + minima[:, j::rows_per].astype(np.uint64) + place)
                    keys = keys.view(np.int64)
                    for r, i in enumerate(full):
                        bands[i], sig[i] = keys[r], bits[r].tobytes()
                        d1[i], d2[i] = _digest(sets[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, at - first),
                        batch.column(2).slice(first, at - first),
                        pa.array(n, pa.int64()),
                        pa.array(d1, pa.int64()),
                        pa.array(d2, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sig, pa.binary()),
                    ],
                    names=["doc_id", "tie", "n", "d1", "d2", "bands", "sig"],
                )

    return _texts(docs).withColumn("tie", F.xxhash64("text")).mapInArrow(run, _SIG)


def _set_table(docs: DataFrame, wanted: DataFrame, spec: NearDup) -> DataFrame:
    """(rep, items): full shingle sets of the wanted classes (rep, low, d1, d2), from the texts of their least ids.

    Up to ``spec.known`` ids are broadcast, so that texts stay where they lie; more are joined by a shuffle.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 200):
                sets = [shingle_set(t, spec.words) for t in texts[at : at + 200]]
                d1, d2 = zip(*map(_digest, sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at : at + 200], pa.int64()),
                        pa.array(d1, pa.int64()),
                        pa.array(d2, pa.int64()),
                        pa.array([s.view("<i8") for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["low", "d1", "d2", "items"],
                )

    ids = wanted.select(F.col("low").alias("doc_id")).distinct()
    if ids.count() <= spec.known:
        ids = F.broadcast(ids)
    found = _texts(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "low long, d1 long, d2 long, items array<long>")
    return found.join(wanted, ["low", "d1", "d2"]).select("rep", "items").dropDuplicates(["rep"])


def _with_estimate(pairs: DataFrame, spec: NearDup) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) with their estimate, those far below the threshold gone."""
    least = spec.least_estimate

    def run(batches):
        import numpy as np

        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            y = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            est = estimate(x, y, spec)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(est)], names=["a", "b", "est"]
            ).filter(pa.array(est >= least))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, est double")


def _alike(n_a: Column, n_b: Column, spec: NearDup) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(n_a, n_b) >= spec.percent * F.greatest(n_a, n_b)


def confirm(pairs: DataFrame, sets: DataFrame, spec: NearDup) -> DataFrame:
    """Those of the pairs (a, b) whose full sets (rep, items) are similar enough, tested exactly in the JVM."""
    a = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    rows = pairs.select("a", "b").join(a, "a").join(b, "b").select(
        "a", "b", both.alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sum")
    )
    return rows.filter(100 * F.col("both") >= spec.percent * (F.col("sum") - F.col("both"))).select("a", "b")


def roots(parents: DataFrame) -> DataFrame:
    """(node, comp) from a forest (node, comp) whose parents are smaller than their nodes, by pointer jumping.

    A chain of length n takes log n rounds; only a count reaches the driver.
    """
    while True:
        up = parents.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        parents = stored(
            parents.join(up, "comp", "left").select(
                "node", F.coalesce("above", "comp").alias("comp"), F.col("above").isNotNull().alias("moved")
            ),
            "roots",
        )
        if not parents.filter("moved").limit(1).count():
            return parents.select("node", "comp")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b) but the least of each component, which comp names.

    Each node hooks on its least smaller neighbour, the forest is flattened, and
    edges are lifted to its roots, until none is left between two roots. Every
    step is written to the shared folder; only counts reach the driver.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    found = None
    while True:
        hooks = stored(
            now.groupBy("u").agg(F.min("v").alias("comp"), F.count(F.lit(1)).alias("c")).withColumnRenamed("u", "node"), "hooks"
        )
        told = hooks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("c"), F.lit(0)).alias("c")).first()
        if not told["n"]:
            return found if found is not None else hooks.select("node", "comp")
        flat = roots(hooks.select("node", "comp"))
        if found is None:
            found = flat
        else:
            up = flat.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
            found = found.join(up, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp")).unionByName(flat)
        if told["c"] == 1:  # every node had one smaller neighbour: the edges were that forest
            return found
        a = flat.select(F.col("node").alias("u"), F.col("comp").alias("ru"))
        b = flat.select(F.col("node").alias("v"), F.col("comp").alias("rv"))
        lifted = now.join(a, "u", "left").join(b, "v", "left").select(
            F.coalesce("ru", "u").alias("x"), F.coalesce("rv", "v").alias("y")
        ).filter("x <> y")
        now = stored(lifted.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Adds ``comp``, the component of ``rep``."""
    return rows.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn(
        "comp", F.coalesce("comp", "rep")
    )


def _blocks(labelled: DataFrame, key: str, spec: NearDup) -> DataFrame:
    """Rows (key, rep, comp, n, ...) of keys with several components, with blocks i and j, and ``ask``.

    Every node is a member in block i; those outside their key's largest component
    ask, in block j. Members go to each block of askers, askers to each block of
    members, so each asker meets each member once.
    """
    sizes = labelled.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    keys = sizes.groupBy(key).agg(
        F.max(F.struct("c", "s", "comp")).alias("main"),
        F.sum("c").alias("c"),
        F.sum("s").alias("s"),
        F.count(F.lit(1)).alias("k"),
    ).filter("k > 1")

    def number(count: Column, items: Column) -> Column:
        size = F.greatest(F.lit(spec.least_block), F.least(F.lit(spec.block), F.ceil(count / spec.parts)))
        return F.greatest(F.ceil(count / size), F.ceil(items / spec.items), F.lit(1)).cast("int")

    main = F.col("main")
    dealt = keys.select(
        key,
        main["comp"].alias("main"),
        number(F.col("c"), F.col("s")).alias("ni"),
        number(F.col("c") - main["c"], F.col("s") - main["s"]).alias("nj"),
    )
    rows = labelled.join(stored(dealt, "dealt"), key)

    def place(n):
        return F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    members = rows.withColumns({"ask": F.lit(False), "i": place("ni")}).withColumn("j", every("nj"))
    askers = rows.filter("comp <> main").withColumns({"ask": F.lit(True), "i": every("ni")}).withColumn("j", place("nj"))
    return members.unionByName(askers.select(*members.columns)).drop("main", "ni", "nj")


class Forest:
    """Union and find over small whole numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether that connected two parts."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _held_against(table, spec: NearDup):
    """(asker, members that may be like it, best first) of one block pair, as row numbers of ``table``."""
    import numpy as np

    ask = table.column("ask").to_numpy()
    rep, comp, n = (table.column(c).to_numpy() for c in ("rep", "comp", "n"))
    bits = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(rep), -1)
    members = np.flatnonzero(~ask)
    for q in np.flatnonzero(ask):
        fits = (comp[members] != comp[q]) & (100 * np.minimum(n[members], n[q]) >= spec.percent * np.maximum(n[members], n[q]))
        at = members[fits]
        if len(at):
            est = estimate(bits[at], bits[q], spec)
            keep = est >= spec.least_estimate
            at, est = at[keep], est[keep]
            if len(at):
                yield int(q), at[np.lexsort((rep[at], -est))]


def _pairs_table(pairs: list[tuple[int, int]]):
    cols = list(zip(*pairs, strict=True)) if pairs else [(), ()]
    return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})


def _maybe(blocks: DataFrame, key: str, spec: NearDup) -> DataFrame:
    """Pairs (a, b) that the estimate lets through, as many as connect the nodes of a block pair."""

    def run(table):
        import numpy as np

        rep = table.column("rep").to_numpy()
        _, node = np.unique(rep, return_inverse=True)
        forest, out = Forest(len(rep)), []
        for q, at in _held_against(table, spec):
            out += [(int(rep[q]), int(rep[t])) for t in at.tolist() if forest.join(int(node[q]), int(node[t]))]
        return _pairs_table(out)

    return blocks.select(
        key, "i", "j", "ask", "rep", "comp", "n", "sig"
    ).groupBy(key, "i", "j").applyInArrow(run, "a long, b long")


def _links(blocks: DataFrame, key: str, spec: NearDup) -> DataFrame:
    """Links (a, b) that connect components in a block pair, tested on the full sets (items) of its nodes."""

    def run(table):
        import numpy as np

        rep, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy()
        lists = table.column("items").combine_chunks()
        values, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        _, part = np.unique(comp, return_inverse=True)
        forest, out = Forest(len(comp)), []
        for q, at in _held_against(table, spec):
            x = values[ends[q] : ends[q + 1]]
            for t in at.tolist():
                if forest.find(int(part[q])) == forest.find(int(part[t])):
                    continue
                y = values[ends[t] : ends[t + 1]]
                u, v = (x, y) if len(x) <= len(y) else (y, x)
                both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                if 100 * both >= spec.percent * (len(u) + len(v) - both):
                    forest.join(int(part[q]), int(part[t]))
                    out.append((int(rep[q]), int(rep[t])))
        return _pairs_table(out)

    return blocks.select(
        key, "i", "j", "ask", "rep", "comp", "n", "sig", "items"
    ).groupBy(key, "i", "j").applyInArrow(run, "a long, b long")


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) with links between nodes of different ones."""
    top = components(
        links.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left")
        .join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    up = top.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
    # Nodes below a root that moved follow it; roots and single nodes enter with their own move.
    return stored(
        comps.join(up, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp")).unionByName(top), "components"
    )


def grouped(docs: DataFrame, spec: NearDup = NearDup()) -> tuple[DataFrame, DataFrame]:
    """Signed rows of ``docs`` (doc_id, tie, n, d1, d2), and (n, d1, d2, comp, first) of every class of them.

    ``first`` is the least (doc_id, tie) of a class.
    """
    signed = stored(sign(docs, spec).withColumn("row", F.monotonically_increasing_id()), "signed")
    classes = stored(
        signed.filter("n > 0 and doc_id is not null")
        .groupBy("n", "d1", "d2")
        .agg(F.min("row").alias("rep"), F.min(F.struct("doc_id", "tie")).alias("first"), F.min_by(F.struct("bands", "sig"), "row").alias("s"))
        .select("rep", "n", "d1", "d2", "first", "s.bands", "s.sig"),
        "classes",
    )
    reps = classes.select("rep", "n", "sig")
    named = classes.select("rep", F.col("first.doc_id").alias("low"), "d1", "d2")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    # Stored on its own, so that a hot band's rows are split in the join.
    buckets = stored(
        banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "bands"
    )
    cand = stored(banded.join(buckets, "key").select("key", "rep", "pivot", "c"), "candidates")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return stored(_set_table(docs, named.join(nodes.select("rep").distinct(), "rep", "left_semi"), spec), "sets")

    # Each node against the least nodes of its bands; the best of those pairs is confirmed.
    star = cand.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()

    def side(c):
        return reps.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))

    sized = star.join(side("a"), "a").join(side("b"), "b").filter(_alike(F.col("n_a"), F.col("n_b"), spec))
    near = stored(_with_estimate(sized, spec), "near-pivots")
    tried = stored(near.groupBy("a").agg(F.max_by("b", F.struct(F.col("est"), -F.col("b"))).alias("b")), "tried")
    sets = sets_of(tried.select(F.col("a").alias("rep")).unionByName(tried.select(F.col("b").alias("rep"))))
    comps = stored(components(confirmed := stored(confirm(tried, sets, spec), "links")), "components")
    free(sets, tried, confirmed)

    # Pairs that may be links between components: those with pivots are known, others hide in bands of three and more.
    among = _labelled(cand.filter("c > 2 and rep <> pivot").select("key", "rep"), comps).join(reps, "rep")
    maybe = stored(_maybe(_blocks(among, "key", spec), "key", spec), "may-be-links")
    clusters = stored(components(maybe.unionByName(near.select("a", "b")).distinct()).toDF("rep", "cluster"), "clusters")
    every = clusters.unionByName(clusters.select("cluster").distinct().select(F.col("cluster").alias("rep"), "cluster"))
    within = stored(_labelled(every, comps).join(reps, "rep"), "clustered")
    mixed = within.groupBy("cluster").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi")
    ).filter("lo <> hi").select("cluster")
    within = stored(within.join(mixed, "cluster", "left_semi"), "mixed")
    sets = sets_of(within)
    links = stored(_links(_blocks(within, "cluster", spec).join(sets, "rep"), "cluster", spec), "hidden-links")
    if links.limit(1).count():
        comps = _merged(comps, links)
    free(sets, near, maybe, clusters, links)
    placed = classes.select("rep", "n", "d1", "d2", "first").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    final = stored(placed.select("n", "d1", "d2", "first", F.coalesce("comp", "rep").alias("comp")), "classed")
    free(classes, buckets, cand, within)
    return signed.select("doc_id", "tie", "n", "d1", "d2"), final


def near_duplicates(docs: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    signed, classes = grouped(docs, spec)
    least = stored(classes.groupBy("comp").agg(F.min("first.doc_id").alias("component")), "least")
    named = stored(classes.join(least, "comp").select("n", "d1", "d2", "component"), "named")
    out = signed.join(named, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of similar texts the row with the least doc_id.

    Of rows with that doc_id, the one least in a hash of the text; of rows equal in
    both, any. Rows without a doc_id or without words are in no group, so all stay.
    Up to ``spec.known`` ids of rows that go are broadcast, so that texts stay where
    they lie; more are joined by a shuffle.
    """
    signed, classes = grouped(docs, spec)
    first = classes.groupBy("comp").agg(F.min("first").alias("stays"))
    told = stored(classes.join(first, "comp").select("n", "d1", "d2", "stays"), "stays")
    rows = signed.filter("n > 0 and doc_id is not null").join(told, ["n", "d1", "d2"])
    counted = rows.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("c"), F.bool_and((F.col("doc_id") == F.col("stays.doc_id")) & (F.col("tie") == F.col("stays.tie"))).alias("one"))
    keys = stored(counted.filter("not one or c > 1").select(F.col("doc_id").alias("_loomshed_id"), F.col("tie").alias("_loomshed_tie"), "one"), "gone")
    on = ["_loomshed_id", "_loomshed_tie"]

    def few(one: bool) -> DataFrame:
        chosen = keys.filter("one" if one else "not one").select(*on)
        return F.broadcast(chosen) if chosen.count() <= spec.known else chosen

    gone, repeated = few(False), few(True)
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    id_, tie = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    held = docs.filter(~alone).withColumns(dict(zip(on, (id_, tie), strict=True))).join(gone, on, "left_anti")
    once = held.join(repeated, on, "left_semi").dropDuplicates(on).unionByName(held.join(repeated, on, "left_anti"))
    return once.select(*docs.columns).unionByName(docs.filter(alone))

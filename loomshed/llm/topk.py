"""Exact top-k by inner product, in columnar branch-and-bound.

A bounded sample of the vectors (``Search.seed``) is scored first: the k-th best score
that a query has there is a floor below which no vector counts for it, so most tasks
of a large table have nothing to tell of most queries. Queries go out in chunks of at
most ``Search.chunk`` bytes, with their floors, as broadcasts; every chunk is held
against all vectors, which stay where they lie. A task turns its
vectors, ``rows`` at a time, into vertical layout (dimension by dimension) with
each vector's norm over every suffix of the dimensions. Scores grow by ``step``
dimensions, the first of them as one matrix product for many queries; after each, what a vector can still gain or lose is at most
the product of the remaining norms, so vectors whose upper bound is below the
k-th best lower bound, or below the k-th best score that the task has seen, are
compacted away. A task gives k rows a query at its end, and the k best of those
are the result.

Components are floor(256 x), held at the borders of 64 bits. Sums in doubles are
exact up to 2^52; beyond, every bound is widened by the doubles' own error and
the survivors are scored anew in whole numbers of any size, so the method is the
same at every size. A score outside 64 bits is held at their border.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without id; each row is a candidate of its own, also
if its id is repeated, and each asking row a query of its own, whose candidates
are all rows but itself; only vectors of one length are compared; ties go to the
smaller id; a query with fewer than k others gets them all; empty vectors score 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomshed.llm.common import free, stored


@dataclass(frozen=True)
class Search:
    """k, vectors in a vertical block, dimensions between two prunings, bytes of a broadcast chunk of queries, vectors a task at least,
    vectors of the sample that sets floors, queries of a matrix product."""

    k: int = 5
    rows: int = 2048
    step: int = 16
    chunk: int = 16 << 20
    task_rows: int = 8192
    seed: int = 4096
    together: int = 256


#: Tasks over the vectors, at most.
MOST_TASKS = 4096
_TOP, _BOTTOM = (1 << 63) - 1, -(1 << 63)
_NEAR_TOP = math.nextafter(2.0**63, 0.0)


def quantised(vectors: DataFrame, ask: Column) -> DataFrame:
    """(vec_id, ask, dim, v): the whole-number vectors that take part, and whether they ask."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    )
    whole = F.transform(x, lambda e: F.floor(F.lit(256.0) * e.cast("double")))
    rows = vectors.filter(F.coalesce(fine, F.lit(False)))
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(ask, F.lit(False)).alias("ask"),
        F.size(x).alias("dim"),
        whole.alias("v"),
    )


def suffix_norms(cols, step: int):
    """Norm of every vector over the dimensions from each pruning point on, the whole first."""
    import numpy as np

    squares = np.square(cols)
    return [np.sqrt(squares[d:].sum(0)) for d in range(0, max(len(cols), 1), step)]


def survivors(query, own_norms, cols, norms, alive, k: int, step: int, floor: float, loss: float, begun=None):
    """(places, scores) of the vectors that may be among the k best: none of them is certain to miss ``floor``.

    ``cols`` is (dimensions, vectors) in doubles; ``loss`` is the relative error of a score; ``begun`` are the
    scores of all vectors over the first ``step`` dimensions, if they are known.
    """
    import numpy as np

    dim = len(cols)
    score = np.zeros(len(alive))
    for point, d in enumerate(range(0, dim, step)):
        part = cols[d : d + step]
        if begun is not None and d == 0:
            score = begun[alive]
        else:
            score = score + query[d : d + step] @ (part if len(alive) == part.shape[1] else part[:, alive])
        if not len(alive):
            break
        rest = norms[point + 1][alive] * (own_norms[point + 1] * (1 + 1e-9)) + 1e-6 if d + step < dim else np.zeros(len(alive))
        if loss:
            rest = rest + norms[0][alive] * (own_norms[0] * loss)
        bound = floor
        if len(alive) >= k:
            low = score - rest
            bound = max(bound, float(np.partition(low, len(low) - k)[len(low) - k]))
        # Scores beyond the borders of 64 bits are ties there.
        bound = -math.inf if bound <= _BOTTOM else min(bound, _NEAR_TOP)
        keep = score + rest >= bound
        if not keep.all():
            alive, score = alive[keep], score[keep]
    return alive, score


def _inner(x, y) -> int:
    """Inner product in whole numbers of any size, held at the borders of 64 bits."""
    return min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), _BOTTOM), _TOP)


class Chunk:
    """Queries of one length, their doubles, suffix norms and floors: (row, vec_id) and (queries x dimensions) whole numbers."""

    def __init__(self, rows, ids, whole, step: int, floors=None):
        import numpy as np

        self.rows, self.ids, self.whole = rows, ids, whole
        self.floors = np.full(len(rows), -math.inf) if floors is None else floors
        self.values = whole.astype(np.float64)
        self.norms = np.array([n.tolist() for n in suffix_norms(self.values.T, step)])
        self.largest = max(abs(int(whole.min(initial=0))), abs(int(whole.max(initial=0))))


class Best:
    """The k best (score, vec_id) of each query that a task has seen, worst last."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def floor(self, query: tuple[int, int]) -> float:
        seen = self.held.get(query, ())
        if len(seen) < self.k:
            return -math.inf
        # Rounded down, for a whole number beyond 2^53 may have no double of its own.
        return math.nextafter(float(seen[-1][0]), -math.inf) if abs(seen[-1][0]) > 1 << 53 else float(seen[-1][0])

    def add(self, query: tuple[int, int], found: list[tuple[int, int]]) -> None:
        if found:
            self.held[query] = sorted(self.held.get(query, []) + found, key=lambda f: (-f[0], f[1]))[: self.k]


def hold_against(chunk: Chunk, rows, ids, whole, best: Best, spec: Search) -> None:
    """Score a block of vectors (row, vec_id and (vectors x dimensions) whole numbers) for every query of a chunk."""
    import numpy as np

    cols = np.ascontiguousarray(whole.T.astype(np.float64))
    norms = suffix_norms(cols, spec.step)
    dim = len(cols)
    largest = max(abs(int(whole.min(initial=0))), abs(int(whole.max(initial=0)))) * chunk.largest
    loss = 0.0 if largest * dim < 1 << 52 else (dim + 2) * 2.0**-51
    everyone = np.arange(len(rows))
    for first in range(0, len(chunk.rows), spec.together):
        here = slice(first, first + spec.together)
        begun = chunk.values[here, : spec.step] @ cols[: spec.step]
        for n, scores in enumerate(begun, first):
            row, query = chunk.rows[n], (int(chunk.rows[n]), int(chunk.ids[n]))
            alive = everyone if not (own := np.flatnonzero(rows == row)).size else np.delete(everyone, own)
            floor = max(best.floor(query), float(chunk.floors[n]))
            at, score = survivors(
                chunk.values[n], chunk.norms[:, n], cols, norms, alive, spec.k, spec.step, floor, loss, scores if dim else None
            )
            if loss:
                best.add(query, [(_inner(chunk.whole[n], whole[a]), int(ids[a])) for a in at.tolist()])
                continue
            if len(at) > spec.k:
                order = np.lexsort((ids[at], -score))[: spec.k]
                at, score = at[order], score[order]
            best.add(query, [(int(s), int(i)) for s, i in zip(score.tolist(), ids[at].tolist(), strict=True)])


def _matrix(column, dim: int):
    """(vectors x dimensions) whole numbers of an Arrow list column of one length."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _by_length(table, rows: int):
    """(dim, row numbers, ids, whole numbers) of blocks of vectors of one length."""
    import numpy as np

    dims = table.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = table.filter(pa.array(dims == dim))
        for at in range(0, part.num_rows, rows):
            block = part.slice(at, rows)
            yield int(dim), block.column("row").to_numpy(), block.column("vec_id").to_numpy(), _matrix(
                block.column("v"), int(dim)
            )


_OUT = "query_row long, query_id long, vec_id long, score long"


def _search(vecs: DataFrame, queries: pa.Table, spec: Search) -> DataFrame:
    """(query_row, query_id, vec_id, score), written: k rows a query and task, at most, for one chunk of queries."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, queries.schema) as out:
        out.write_table(queries)
    sent = vecs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches):
        import numpy as np

        chunks: dict[int, list[Chunk]] = {}
        table = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        for part in table.to_batches():
            floors = dict(zip(part.column("row").to_pylist(), part.column("floor").to_pylist(), strict=True))
            for dim, rows, ids, whole in _by_length(part, part.num_rows):
                low = np.array([floors[r] for r in rows.tolist()], float)
                chunks.setdefault(dim, []).append(Chunk(rows, ids, whole, spec.step, low))
        best = Best(spec.k)
        for batch in batches:
            for dim, rows, ids, whole in _by_length(batch, spec.rows):
                for chunk in chunks.get(dim, ()):
                    hold_against(chunk, rows, ids, whole, best, spec)
        told = [(row, query, vec, score) for (row, query), found in best.held.items() for score, vec in found]
        cols = list(zip(*told, strict=True)) if told else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in cols], names=["query_row", "query_id", "vec_id", "score"]
        )

    found = stored(vecs.select("row", "vec_id", "dim", "v").mapInArrow(run, _OUT), "found")
    sent.destroy()
    return found


def floors(asks: DataFrame, sample: pa.Table, spec: Search) -> DataFrame:
    """The asking rows with ``floor``: a score that k vectors of the sample, other than itself, reach; minus infinity where fewer do.

    Where scores are beyond what doubles hold exactly there is no floor.
    """
    seeds = sample.combine_chunks().to_batches()  # one, or none

    def run(batches):
        import numpy as np

        held = {dim: (rows, whole) for b in seeds for dim, rows, _, whole in _by_length(b, b.num_rows)}
        for batch in batches:
            low = np.full(batch.num_rows, -math.inf)
            dims, own = batch.column("dim").to_numpy(), batch.column("row").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in held:
                    continue
                rows, whole = held[dim]
                mine = np.flatnonzero(dims == dim)
                query = _matrix(batch.column("v").take(pa.array(mine)), dim)
                largest = max(abs(int(x)) for m in (whole, query) for x in (m.min(initial=0), m.max(initial=0)))
                if largest * largest * max(dim, 1) >= 1 << 52 or len(rows) <= spec.k:
                    continue
                for at in range(0, len(mine), spec.together):
                    part = mine[at : at + spec.together]
                    score = query[at : at + spec.together].astype(float) @ whole.T.astype(float)
                    score[own[part][:, None] == rows[None, :]] = -math.inf
                    low[part] = np.partition(score, len(rows) - spec.k, axis=1)[:, len(rows) - spec.k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low)], names=[*batch.schema.names, "floor"])

    kinds = "row long, vec_id long, dim int, v array<long>, floor double"
    return asks.select("row", "vec_id", "dim", F.col("v").cast("array<long>").alias("v")).mapInArrow(run, kinds)


def top_k(vectors: DataFrame, ask: Column, spec: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row of ``vectors`` (vec_id, embedding) where ``ask`` holds."""
    whole = quantised(vectors, ask)
    n = whole.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    tasks = min(max(1, -(-n // spec.task_rows)), MOST_TASKS)
    vecs = stored(whole.repartition(tasks).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # Least by a hash of the row, so that the sample is spread over all tasks; a cut leaves few more to sort.
    h = F.shiftrightunsigned(F.xxhash64("row"), 1)
    few = vecs.filter(h <= F.lit(min(_TOP, int(_TOP * (2.0 * spec.seed / max(n, 1))))))
    sample = few.select("row", "vec_id", "dim", "v").orderBy(h, "row").limit(spec.seed).toArrow()
    asks = stored(floors(vecs.filter("ask"), sample, spec), "queries")
    size = asks.agg(F.coalesce(F.sum(8 * F.col("dim").cast("long") + 24), F.lit(0)).alias("b")).first()["b"]
    chunks = max(1, -(-size // spec.chunk))
    found = None
    for c in range(chunks):
        mine = asks.filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c)
        part = _search(vecs, mine.toArrow(), spec)
        found = part if found is None else found.unionByName(part)
    free(vecs, asks)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")

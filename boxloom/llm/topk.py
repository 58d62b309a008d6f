"""Exact top-k search by inner product with a pivot-distance index.

Components become floor(scale * x). Each vector is keyed by its nearest pivot and the annulus around it in which its distance falls;
pivots and annuli come from a sample of at most `sample` vectors, the index holds every vector. For a query q, the annulus [r, R] of
pivot p holds vectors of distance at least max(0, r - |q - p|, |q - p| - R) from q by the triangle inequality, so their scores are at
most (|q|^2 + N^2 - that distance^2) / 2, N being the largest norm there, and at most q.p + |q| R. Annuli are expanded in the order
of these bounds: first those that hold k candidates, which gives each query a k-th score; then all whose bound reaches that score.
The search stops there: no other annulus can hold a better vector. Scores are exact integers.

Annuli that follow one another are packed into bins of about `block` vectors (fewer, if there would be fewer than four bins for each task;
of at most `weight` bytes); one of more vectors (many copies of one vector, say) has several bins to itself. A query goes to a bin once, with the list
of its annuli there, so its vector is copied once for each bin, not for each annulus. What a task holds is one bin and some queries; it sends
the k best of the bin. What the driver holds is the sample and one row for each annulus.

Vectors that are null or empty or hold null or non-finite components take no part, nor do those without an id or of another length
than most of the sample. Rows of one id count as one: a query never meets its own id, of several rows of its id that of the least bytes
is the query, and an id that is met has the score of its best row and one place. Ties go to the smaller id. Scores beyond 2 ** 63 - 1
of either sign are cut to it. Long vectors are compared whole. Empty tables give empty tables. Only the columns named are read, so others may have any
names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import discard, parallelism, release, staged


#: Below all scores.
LOWEST = -(2**63)


def integer_vectors(rows: DataFrame, scale: float, key: str, vector: str) -> DataFrame:
    """(id, v): components floor(scale * x) as little-endian doubles that hold integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple[int, bytes]] = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = x.values
                if i is None or v is None or not len(v) or v.null_count:
                    continue
                w = v.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(w).all():
                    got.append((i, np.floor(w * scale).astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], names=["id", "v"])

    return rows.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "id long, v binary")


def fit(sample: np.ndarray, pivots: int, rings: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots, by some steps of k-means from far points on, and for each the distances that part its annuli."""
    if not len(sample):
        return np.zeros((1, sample.shape[1])), np.zeros((1, rings - 1))
    at, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(at) < min(pivots, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    p = sample[at].copy()
    for _ in range(5):
        near = nearest(sample, p)[0]
        for k in range(len(p)):
            if (near == k).any():
                p[k] = sample[near == k].mean(axis=0)
    near, dist = nearest(sample, p)
    steps = np.linspace(0, 1, rings + 1)[1:-1]
    return p, np.array([np.quantile(dist[near == k], steps) if (near == k).any() else np.zeros(rings - 1) for k in range(len(p))])


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)
    k = d.argmin(axis=1)
    return k, np.sqrt(((x - pivots[k]) ** 2).sum(axis=1))


def bins(many: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count): the bins of each annulus. Neighbours share one while they have no more than `size` vectors together; an annulus of
    more has several to itself."""
    first, count = np.zeros(len(many), int), np.ceil(many / size).astype(int)
    at, load = 0, 0
    for c, n in enumerate(many.tolist()):
        if load and load + n > size:
            at, load = at + 1, 0
        first[c] = at
        if count[c] > 1:
            at, load = at + int(count[c]), 0
        else:
            load += n
    return first, count


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact; int64."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ v.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.array([[min(max(x, LOWEST + 1), 2**63 - 1) for x in r] for r in big], np.int64)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, pivots: int = 64, rings: int = 8, sample: int = 4096, block: int = 65_536, weight: int = 64 << 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query holds, the k other rows of the largest inner products."""
    vectors = staged(integer_vectors(rows, scale, key, vector).distinct(), "vectors")
    seen = [np.frombuffer(r.v, "<f8") for r in vectors.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()]
    dim = max(Counter(map(len, seen)).items(), key=lambda x: (x[1], x[0]), default=(1, 0))[0]
    centers, parts = fit(np.array([x for x in seen if len(x) == dim]).reshape(-1, dim), pivots, rings)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(v) == 8 * dim]
            x = np.frombuffer(b"".join(v for _, v in keep), "<f8").reshape(-1, dim)
            p, r = nearest(x, centers) if len(x) else (np.zeros(0, int), np.zeros(0))
            cell = p * rings + (parts[p] < r[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(r), pa.array(np.sqrt((x**2).sum(axis=1))), pa.array([i for i, _ in keep], pa.int64()), pa.array([v for _, v in keep], pa.binary())], names=["cell", "r", "norm", "id", "v"])

    index = staged(vectors.mapInArrow(assign, "cell int, r double, norm double, id long, v binary"), "index")
    discard(vectors)
    # a row for each annulus: pivots times rings at most
    cells = sorted(tuple(c) for c in index.groupBy("cell").agg(F.count("*"), F.min("r"), F.max("r"), F.max("norm")).collect())
    no, many, low, high, norm = (np.array([c[i] for c in cells], np.float64) for i in range(5))
    no = no.astype(int)
    first_bin, blocks = bins(many, max(1, min(block, weight // (8 * dim), int(np.ceil(many.sum() / (4 * parallelism(rows.sparkSession)))))))
    queries = staged(index.where(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")

    def bounds(q: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] - 2 * q @ centers.T + (centers**2).sum(axis=1), 0))[:, no // rings]
        size = np.sqrt((q**2).sum(axis=1))[:, None]
        away = np.maximum(0, np.maximum(low - d, d - high) * (1 - 1e-9) - 1e-6)
        most = np.minimum((size**2 + norm**2 - away**2) / 2, (q @ centers.T)[:, no // rings] + size * high)
        return most + np.abs(most) * 1e-9 + 1e-3

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    ids, vs = part.column(0).to_pylist(), part.column(1).to_pylist()
                    most = bounds(np.frombuffer(b"".join(vs), "<f8").reshape(-1, dim))
                    order = np.argsort(-most, axis=1, kind="stable")
                    held = np.cumsum(many[order], axis=1) - many[order]
                    early = np.zeros(most.shape, bool)
                    np.put_along_axis(early, order, held < k + 1, axis=1)
                    if first:
                        go = early
                    else:
                        go = ~early & (most >= part.column(2).to_numpy().astype(np.float64)[:, None])
                    i, c = np.nonzero(go)
                    each = blocks[c]
                    i, c = np.repeat(i, each), np.repeat(c, each)
                    at_bin = first_bin[c] + np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
                    new = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(at_bin, prepend=-1) != 0))
                    cells_ = pa.ListArray.from_arrays(pa.array(np.append(new, len(i)), pa.int32()), pa.array(no[c], pa.int32()))
                    i = i[new]
                    yield pa.RecordBatch.from_arrays([pa.array(at_bin[new], pa.int32()), pa.array(np.ones(len(i), np.int32)), cells_, pa.array([ids[j] for j in i], pa.int64()), pa.array([vs[j] for j in i], pa.binary()), part.column(2).take(pa.array(i))], names=["bin", "kind", "cells", "id", "v", "least"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, x = None, [], None
        for b in batches:
            bin_, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero((np.diff(bin_, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
            for s, e in zip(edge, [*edge[1:], b.num_rows], strict=True):
                if of != bin_[s]:
                    of, held, x = bin_[s], [], None
                rows_ = b.slice(s, e - s)
                if kind[s] == 0:
                    held.append(rows_)
                    continue
                if not held:
                    continue
                if x is None:
                    table = pa.Table.from_batches(held)
                    held = held[:1]
                    cell, own = table.column("cells").combine_chunks().flatten().to_numpy(), table.column("id").to_numpy()
                    order = np.lexsort((own, cell))
                    cell, own = cell[order], own[order]
                    x = np.frombuffer(b"".join(table.column("v").to_pylist()), "<f8").reshape(-1, dim)[order]
                    from_ = np.flatnonzero(np.diff(cell, prepend=-1))
                    spans = [(int(cell[a]), a, z) for a, z in zip(from_.tolist(), [*from_[1:].tolist(), len(cell)], strict=True)]
                    by_id = np.argsort(own, kind="stable")
                    own, first = np.unique(own[by_id], return_index=True)
                step = max(1, min(256, (16 << 20) // (8 * len(x))))  # scores of some queries with the whole bin at a time
                for a in range(0, e - s, step):
                    yield best_of(rows_.slice(a, step), x, spans, by_id, own, first)

    def best_of(some: pa.RecordBatch, x: np.ndarray, spans: list[tuple[int, int, int]], by_id: np.ndarray, own: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        """The k best ids of a bin for each of some queries, from the annuli that are on its list."""
        q, bars = some.column(3).to_numpy(), some.column(5).to_numpy()
        vs = np.frombuffer(b"".join(some.column(4).to_pylist()), "<f8").reshape(-1, dim)
        asked, cells_ = some.column(2).value_parent_indices().to_numpy(), some.column(2).flatten().to_numpy()
        score = np.full((len(q), len(x)), LOWEST)
        for c, a, z in spans:
            of = asked[cells_ == c]
            if len(of):
                score[of, a:z] = exact_scores(vs[of], x[a:z])
        score = score[:, by_id]
        score = score if len(first) == score.shape[1] else np.maximum.reduceat(score, first, axis=1)
        score[q[:, None] == own] = LOWEST
        # a score below the k-th that its query has already can't be among the best, nor one below the k-th of the bin
        least = np.maximum(bars, LOWEST + 1)
        if score.shape[1] > k:
            least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
        row, col = np.nonzero(score >= least[:, None])
        order = np.lexsort((col, ~score[row, col], row))  # the complement falls as the score rises; of equal ones the least id is first
        order = order[np.arange(len(order)) - np.searchsorted(row, row) < k]
        row, col = row[order], col[order]
        return pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(own[col]), pa.array(score[row, col])], names=["query_id", "vec_id", "score"])

    def stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The index, dealt to its bins."""
        for b in batches:
            c = np.searchsorted(no, b.column(0).to_numpy())
            share = b.column(1).to_numpy() % blocks[c]
            n = b.num_rows
            cells_ = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(first_bin[c] + share, pa.int32()), pa.array(np.zeros(n, np.int32)), cells_, b.column(2), b.column(3), pa.array(np.full(n, LOWEST))], names=["bin", "kind", "cells", "id", "v", "least"])

    lowest = F.lit(LOWEST).cast("long")
    form = "bin int, kind int, cells array<int>, id long, v binary, least long"
    stored = index.select("cell", F.xxhash64("id", "v").alias("share"), "id", "v").mapInArrow(stored_rows, form)

    def searched(routes: DataFrame) -> DataFrame:
        met = stored.unionByName(routes).repartition("bin").sortWithinPartitions("bin", "kind")
        return met.mapInArrow(search, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    early = staged(top(searched(queries.select("id", "v", lowest.alias("least")).mapInArrow(route(True), form))), "early")
    bar = early.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    late = searched(queries.join(bar, "id", "left").select("id", "v", F.coalesce("least", lowest).alias("least")).mapInArrow(route(False), form))
    out = staged(top(early.drop("rank").unionByName(late)), "best")
    release(rows.sparkSession)
    return out.select("query_id", "rank", "vec_id", "score")

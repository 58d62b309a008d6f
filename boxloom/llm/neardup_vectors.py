"""Near-duplicate vectors by a forest of random-projection trees.

Vectors that are equal in all components are one class; its least id stands for it. Each tree splits the space again and again: each
of its levels has a random direction, each node the median of a sample's projections on it, and vectors within `spill` of the median
go to both sides. Depth follows from the number of classes, so that leaves hold about `leaf` of them at any size; below the levels at
which nodes hold `fine` vectors of the sample, nodes are split through the projected mean of their last such ancestor's sample. Only
(leaf, id) rows come from the trees; vectors are fetched once for each leaf they are in, and are compared with all others there in
double precision. Whether two link follows from one fixed order of additions, and a pair that meets in several leaves counts in the
least of them only. Leaves leave links from each vector to the first one that a search along their pairs reaches it from; components
of these links are the result. Leaves of over `block` classes are dealt in pairs of blocks, so that no task holds more than two.

The splits are fitted on at most `sample` classes, those of the least hash; every vector is indexed. Two unit vectors of cosine c
are |u - v| = sqrt(2 - 2c) apart, and the projection of that on a random direction of d dimensions has a deviation of |u - v| /
sqrt(d); `spill` is a share of it at the least cosine. A pair is lost in a tree if it lies farther apart than two spills around a
split, and has to be lost in all trees to be missed.

Vectors that are null, empty or zero or hold null or non-finite components link with nothing; so do those of another length than
most of the sample; all of them are kept. A null id has no component, and is kept. Rows of one id and equal vectors link like other
copies. Long vectors are compared whole. Empty tables give empty tables. Only the two columns named are read, so others may have any
names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.llm.common import discard, release, staged
from boxloom.llm.components import components
from boxloom.llm.neardup import _search, by_group, in_blocks


class Forest:
    """Splits of all trees. Node k has the children 2k and 2k + 1, the root is 1."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, spill: float, seed: int, fine: int = 16):
        self.trees, self.depth, self.spill = trees, depth, spill
        d = np.random.default_rng(seed).standard_normal((trees * depth, sample.shape[1]))
        self.directions = np.rint(d / np.maximum(np.linalg.norm(d, axis=1), 1e-300)[:, None] * 2.0**22)
        self.fitted = min(depth, int(np.log2(max(len(sample) // fine, 1))))
        self.at = np.zeros((trees, 1 << self.fitted))
        self.means = np.zeros((trees, 1 << self.fitted, sample.shape[1]))  # of the nodes at which the fitted levels end
        p = self.project(sample)
        for t in range(trees):
            level = {1: np.arange(len(sample))}
            for k in range(self.fitted):
                below = {}
                for node, rows in level.items():
                    x = p[rows, t * depth + k]
                    self.at[t, node] = m = np.median(x) if len(x) else 0.0
                    below[2 * node], below[2 * node + 1] = rows[x <= m], rows[x > m]
                level = below
            for node, rows in level.items():
                if len(rows):
                    self.means[t, node - (1 << self.fitted)] = sample[rows].mean(axis=0)
        self.middles = np.stack([self.project(m)[:, t * depth + self.fitted : (t + 1) * depth] for t, m in enumerate(self.means)])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Projections on all directions. On this grid sums are exact, so those of a row are the same in any batch."""
        return np.rint(x * 2.0**22) @ self.directions.T / 2.0**44

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs, a leaf's rows together; leaves of all trees are numbered through."""
        p, rows, leaves = self.project(x), [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for k in range(self.depth):
                if k < self.fitted:
                    middle = self.at[t, node]
                else:
                    middle = self.middles[t, (node >> (k - self.fitted)) - (1 << self.fitted), k - self.fitted]
                off = p[row, t * self.depth + k] - middle
                left, right = off <= self.spill, off > -self.spill
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            leaves.append(node + np.int64(t) * (2 << self.depth))
        return np.concatenate(rows), np.concatenate(leaves)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    big = np.abs(x).max(axis=1, initial=0.0)
    x = np.where((big < 1e-100) | (big > 1e100), 1 / np.maximum(big, 5e-324), 1.0)[:, None] * x
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def linked(x: np.ndarray, least: float) -> np.ndarray:
    """Which rows of unit length have a cosine of at least `least`; cosines next to it are added up in one fixed order."""
    dots = x @ x.T
    hit = dots >= least
    i, j = np.nonzero(np.abs(dots - least) < 1e-9)
    for a in range(0, len(i), 65_536):
        hit[i[a : a + 65_536], j[a : a + 65_536]] = (x[i[a : a + 65_536]] * x[j[a : a + 65_536]]).sum(axis=1) >= least
    np.fill_diagonal(hit, False)
    return hit


def near_duplicate_vectors(rows: DataFrame, least: float = 0.95, trees: int = 4, leaf: int = 400, spill: float = 0.25, sample: int = 16_384, block: int = 1024, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""
    element = rows.schema[vector].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"  # vectors travel as they are, and become units where they are compared
    width = int(kind[-1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                v, w = x.values, None
                if v is not None and len(v) and not v.null_count:
                    w = v.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # no negative zeros
                    w = w.tobytes() if np.isfinite(w).all() and w.any() else None
                out.append(w)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    plain = F.col(vector) if width == 4 else F.col(vector).cast("array<double>")
    vectors = staged(rows.select(F.col(key).cast("long").alias("id"), plain).mapInArrow(raw, "id long, v binary"), "vectors")
    classes = staged(vectors.where("id is not null and v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("many")), "classes")
    seen = [np.frombuffer(r.v, kind) for r in classes.orderBy(F.xxhash64("v"), "v").limit(sample).collect()]
    dim = max(Counter(map(len, seen)).items(), key=lambda x: (x[1], x[0]), default=(1, 0))[0]
    depth = int(max(0, np.ceil(np.log2(max(classes.count(), 1) / leaf))))
    fit = np.array([x for x in seen if len(x) == dim]).reshape(-1, dim)
    forest = Forest(unit(fit), trees, depth, spill * float(np.sqrt((2 - 2 * least) / dim)), seed)
    units = lambda column: unit(np.frombuffer(b"".join(column), kind).reshape(-1, dim))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                v, rep = part.column(1).to_pylist(), part.column(0).to_numpy()
                good = np.array([len(x) == width * dim for x in v], bool)
                if good.any():
                    row, leaves = forest.leaves(units([x for x in v if len(x) == width * dim]))
                    yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(rep[good][row])], names=["leaf", "rep"])

    placed = staged(classes.select("rep", "v").mapInArrow(spread, "leaf long, rep long"), "leaves")
    # leaves that have to be dealt in blocks, if any; of the others no count is needed
    large = staged(placed.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > block), "large")
    dealt = in_blocks(placed.join(large, "leaf", "left").withColumn("size", F.coalesce("size", F.lit(1))), "leaf", "size", "rep", block).withColumn("own", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / block).cast("long")).cast("int"))
    met = dealt.select("leaf", "b1", "b2", "rep", "own").join(classes, "rep").select("leaf", "b1", "b2", "rep", "own", "many", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in by_group(batches, 3):
            if len(g) < 2:
                continue
            x = units([r[6] for r in g])
            hit = linked(x, least)
            if g[0][1] != g[0][2]:  # two blocks: pairs across only
                own = np.array([r[4] for r in g])
                hit &= own[:, None] != own
            some = np.flatnonzero(hit.any(axis=1))
            if not len(some):
                continue
            hit = hit[np.ix_(some, some)]
            g = [g[i] for i in some.tolist()]
            # pairs that also meet in a lesser leaf count there
            row, leaves = forest.leaves(x[some])
            less = leaves < g[0][0]
            names, column = np.unique(leaves[less], return_inverse=True)
            new = hit
            if len(names):
                met = np.zeros((len(g), len(names)), np.float32)
                met[row[less], column] = 1
                new = hit & (met @ met.T == 0)
            count = new @ np.array([r[5] for r in g], np.int64)
            root = _search(len(g), lambda i, others, hit=hit: hit[i, others])
            out += [(r[3], None, c) for r, c in zip(g, count.tolist(), strict=True) if c]
            out += [(g[i][3], g[j][3], None) for i, j in enumerate(root.tolist()) if i != j]
            if len(out) > 20_000:
                yield rows_of(out)
                out = []
        yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

    found = staged(met.repartition("leaf", "b1", "b2").sortWithinPartitions("leaf", "b1", "b2").mapInArrow(compare, "a long, b long, n long"), "pairs")
    discard(placed)
    release(rows.sparkSession)
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    known = classes.join(counts, "rep", "left").join(groups, "rep", "left").select("v", F.coalesce("root", "rep").alias("component"), (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    out = vectors.join(known, "v", "left")
    one = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), F.col("id"))
    return out.select(F.col("id").alias(key), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).alias("n_links"), one.alias("component_id"), F.coalesce(F.col("id") == one, F.lit(True)).alias("kept"))

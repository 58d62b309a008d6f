"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text is read once: words, the set of its shingles of n words as 64-bit hashes, a 128-bit fingerprint of the set, and the k
   least hashes (the sketch). Texts with equal sets are one class, whose least doc_id stands for it.
2. Inverted lists: the `indexed` least values of each sketch are keys. Of two sets with Jaccard similarity s, none of the `indexed`
   least values of their union is in both with probability (1 - s) ** indexed: under 3 in a million at 0.8, less above.
3. In each list, sketches are compared over the values up to the lesser of their last ones, which are all known for both. Pairs
   whose estimate is `margin` or less below the threshold (over four standard deviations at k = 48) are candidates. A search from
   document to document leaves a link for each one found, never all pairs.
4. Components of the candidates are compared on the full sets of their texts, in the same way: the links that remain are exact.
5. Components of those links are the result.

Lists and components of over `block` documents, and components with over `heavy` shingles (long texts), are dealt in pairs of blocks, so
that no task holds more than two blocks and no pair is missed. A text is cut to its set as it comes in, and sets leave as a group ends.

Null and empty texts, and those without words, have no shingles and link with nothing. Rows of one doc_id are one document; a
null doc_id links with nothing and is kept. Ties don't matter: results depend on sets and least ids only. Long texts are read whole.
Empty tables give empty tables. Only the two columns named are read, so others may have any names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import Words, release, staged, utf8
from boxloom.llm.components import components

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the runs of n words of each text; texts are taken half a megabyte at a time."""
    out, at, held = [], 0, 0
    for i, t in enumerate([*texts, None]):
        if i > at and (t is None or held + len(t) > 1 << 19):
            hashes, first = Words(texts[at:i]).shingles(n)
            out += [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            at, held = i, 0
        held += len(t or b"")
    return out


def _search(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of n members the first one from which links lead to it. linked(i, others): which of them i links with."""
    root, left = np.arange(n), np.arange(1, n)
    i, queue, top = 0, [], 0
    while len(left):
        hit = linked(i, left)
        if hit.any():
            found = left[hit]
            root[found] = top
            queue += found.tolist()
            left = left[~hit]
        if queue:
            i = queue.pop()
        elif len(left):
            i = top = int(left[0])
            left = left[1:]
    return root


def sketch_links(sketches: np.ndarray, k: int, least: float) -> np.ndarray:
    """_search over rows of sorted sketches, filled up with NONE."""
    last = np.where((sketches != NONE).sum(axis=1) == k, sketches[:, -1], NONE - np.uint64(1))

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        own, rest = sketches[i], sketches[others]
        cut = np.minimum(last[i], last[others])
        inside = rest <= cut[:, None]
        at = np.minimum(np.searchsorted(own, rest), k - 1)
        both = ((own[at] == rest) & inside).sum(axis=1)
        union = np.searchsorted(own, cut, "right") + inside.sum(axis=1) - both
        return both >= least * union

    return _search(len(sketches), linked)


def set_links(sets: list[np.ndarray], over: int, of: int) -> np.ndarray:
    """_search over sets: those link for which of * intersection >= over * union."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    flags = np.zeros(int(codes.max()) + 1, np.int32)
    held: dict = {"others": None}

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        if held["others"] is None or len(others) < 0.7 * len(held["others"]):
            held.update(others=others, codes=np.concatenate([codes[at[j] : at[j + 1]] for j in others]), at=np.concatenate([[0], np.cumsum(size[others])[:-1]]))
        mine = codes[at[i] : at[i + 1]]
        flags[mine] = 1
        both = np.add.reduceat(flags[held["codes"]], held["at"])
        flags[mine] = 0
        both = both[np.searchsorted(held["others"], others)].astype(np.int64)
        return of * both >= over * (size[i] + size[others] - both)

    return _search(len(sets), linked)


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each run of equal values in the first `keys` columns, of partitions sorted by them."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def in_blocks(rows: DataFrame, key: str, count: str, member: str, block: int) -> DataFrame:
    """Adds columns b1, b2: a group of over `block` members meets in pairs of blocks, any other once."""
    blocks = F.ceil(F.col(count) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), blocks.cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: F.struct(F.least(x, F.col("_b")).alias("b1"), F.greatest(x, F.col("_b")).alias("b2")))
    return rows.withColumn("_n", blocks).withColumn("_b", own).withColumn("_p", F.explode(pairs)).withColumn("b1", F.col("_p.b1")).withColumn("b2", F.col("_p.b2")).drop("_n", "_b", "_p")


def near_duplicates(docs: DataFrame, words: int = 5, over: int = 80, of: int = 100, k: int = 48, indexed: int = 8, margin: float = 0.26, block: int = 4096, heavy: int = 2_000_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row; sets link for which of * intersection >= over * union."""
    spark, least = docs.sparkSession, over / of - margin
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sets = shingle_sets(utf8(part.column(1)), words)
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([s[:k].astype("<u8").tobytes() for s in sets], pa.binary())], names=["doc", "n", "print", "sketch"])

    seen = staged(docs.mapInArrow(sketch, "doc long, n long, print binary, sketch binary"), "sketches")
    classes = staged(seen.where("print is not null and doc is not null").groupBy("print").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.frombuffer(x, "<i8")[:indexed] for x in b.column(1).to_pylist()]
            n = np.fromiter(map(len, values), np.int64, len(values))
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(np.repeat(b.column(0).to_numpy(), n))], names=["value", "rep"])

    keys = classes.select("rep", "sketch").mapInArrow(index, "value long, rep long")
    lists = keys.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    hits = in_blocks(keys.join(lists, "value"), "value", "size", "rep", block).select("value", "b1", "b2", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for rows in by_group(batches, 3):
            if len(rows) > 1:
                m = np.full((len(rows), k), NONE)
                for i, r in enumerate(rows):
                    v = np.frombuffer(r[4], "<u8")
                    m[i, : len(v)] = v
                root = sketch_links(m, k, least)
                pairs += [(rows[i][3], rows[j][3]) for i, j in enumerate(root.tolist()) if i != j]
            if len(pairs) > 10_000:
                yield _links(pairs)
                pairs = []
        yield _links(pairs)

    met = hits.join(classes.select("rep", "sketch"), "rep").select("value", "b1", "b2", "rep", "sketch").repartition("value", "b1", "b2").sortWithinPartitions("value", "b1", "b2")
    candidates = components(met.mapInArrow(compare, "a long, b long"))
    weighed = candidates.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    sizes = weighed.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") / F.lit(heavy))).alias("blocks"))
    members = in_blocks(candidates.join(sizes, "root"), "root", "blocks", "node", 1).select("root", "b1", "b2", F.col("node").alias("doc"))
    members = staged(members, "members")
    release(spark)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the sets of their texts in place of these."""
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sets = [x.astype("<u8").tobytes() for x in shingle_sets(utf8(part.column(4)), words)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.large_binary())], names=["root", "b1", "b2", "doc", "set"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for rows in by_group(sets_of(batches), 3):
            if len(rows) > 1:
                root = set_links([np.frombuffer(r[4], "<u8") for r in rows], over, of)
                pairs += [(rows[i][3], rows[j][3]) for i, j in enumerate(root.tolist()) if i != j]
            if len(pairs) > 10_000:
                yield _links(pairs)
                pairs = []
        yield _links(pairs)

    texts = docs.where("text is not null").join(members, "doc").select("root", "b1", "b2", "doc", "text").repartition("root", "b1", "b2").sortWithinPartitions("root", "b1", "b2")
    copies = seen.where("doc is not null").join(classes.select("print", "rep"), "print").where("doc != rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")).distinct()
    groups = components(texts.mapInArrow(confirm, "a long, b long").unionByName(copies))
    release(spark)
    classed = seen.select("doc", "n").join(groups.withColumnRenamed("node", "doc"), "doc", "left")
    one = F.when(F.col("doc").isNotNull(), F.coalesce("root", "doc"))
    return classed.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), one.alias("component_id"), F.coalesce(F.col("doc") == one, F.lit(True)).alias("kept"))

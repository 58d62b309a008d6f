"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes (words) are summed by source. Targets share `share` of all sizes by weight; a target stops at `most` times its source's
   size, and the excess is shared again by weight among the others until none is above.
2. Within each source, documents stand in the order of a hash of their ids; the sum of the sizes before a document is its place, and the
   block of `block` words in which it begins is its block. The mix reads a source in passes. What is left behind whole passes is drawn:
   all blocks of the source are permuted, and the first ones are taken until their words reach the target; of the last one the documents
   up to there, of which the last may be cut. So which documents come once more follows from the draw, and each source's words are exact.
3. The blocks of whole passes and those drawn are a source's quota. A tree splits the sources' exact quotas: the root holds all, each node
   deals its blocks to its halves by a multivariate-hypergeometric draw, each leaf is a shard. All blocks of a quota are permuted, and each
   shard takes the next ones of its part: disjoint, and all of them. Within a shard, documents are shuffled by a hash.

Sums by source, where the draw of each ends, and the quotas (sources times shards) come to the driver, never documents or blocks. A source
with most rows is spread like any other, since places and the words of permuted blocks come from range sums. All draws come from `seed`,
so reruns agree.

A null text has no words; a document without words is taken 0 times. A null source is a source of its own, the last. Where no words
are, all targets are 0. Rows that tie (same id, same text) are all kept; they stand in the order in which they are read. Long texts are
counted whole and taken whole, but for the last of a source. Empty tables give empty tables. The columns of docs may have any names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import free_name, prefix_sums

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
SHARDS = 16
#: Blocks grow beyond so many: the generator's hypergeometric draws are exact below a population of 10**9.
MOST_BLOCKS = 500_000_000
#: Words of a part of a shard. A shard is written as parts, in the order of its rows, so that no task holds a shard however large.
PART = 4_000_000
#: Parts grow beyond so many in all, as each is a partition of one shuffle.
MOST_PARTS = 100_000


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """The words of each source in the mix."""
    size, weight = np.array(sizes, np.float64), np.array(weights, np.float64)
    out, free, rest = np.zeros(len(size)), np.ones(len(size), bool), share * size.sum()
    while free.any() and rest > 0:
        part = np.where(free, rest * weight / max(weight[free].sum(), 1e-300), 0.0)
        above = free & (part > most * size)
        if not above.any():
            out[free] = part[free]
            break
        out[above] = most * size[above]
        rest -= out[above].sum()
        free &= ~above
    return out.tolist()


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); the columns add up to the quotas, the rows to equal sums, or one more."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    draw = total * left // shards
    mine, rest, pool = np.zeros_like(quotas), draw, total
    for i, q in enumerate(quotas.tolist()):  # the marginals of the multivariate draw, one source after the other
        pool -= q
        if q and rest:
            mine[i] = rng.hypergeometric(q, pool, rest) if pool else rest
        rest -= int(mine[i])
    return np.concatenate([split(mine, left, rng), split(quotas - mine, shards - left, rng)])


def permuted(index: np.ndarray, size: np.ndarray, key: int) -> np.ndarray:
    """A pseudo-random permutation of 0..size-1 at index, elementwise: a Feistel network that is walked until it falls inside."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x, h, m = out[todo], half[todo], mask[todo]
        a, b = x >> h, x & m
        for r in range(4):
            f = (b + np.uint64(key * 4 + r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ (f >> np.uint64(32)) & m
        out[todo] = a << h | b
        todo[todo] = out[todo] >= size[todo].astype(np.uint64)
    return out.astype(np.int64)


def plan(docs: DataFrame, weights: Sequence[float], **how: object) -> DataFrame:
    """Each row of docs, its columns (or those of keep) in `row`, with size, source_size, target, place, and `pieces`: (pass, words, block (its number in the quota), shard, order)
    for each pass that takes some of it. The weights repeat over the sources in the order of their code points, null last."""
    return _plan(docs, weights, **how)[0]


def _plan(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0, shards: int = SHARDS, block: int = 4096, seed: int = 1, text: str = "text", key: str = "doc_id", source: str = "source", keep: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """plan(), and the words of the whole mix."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(c) for c in keep or docs.columns]).alias("row"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("h1"), F.xxhash64(F.lit(seed + 1), F.col(key).cast("string"), text).alias("h2"))
    placed = prefix_sums(rows, ["h1", "h2"], "size", "place", "source")
    found = placed.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()  # a row for each source
    sizes = [r.n for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    words = [round(t) for t in wanted]
    block = max(block, -(-sum(words) // MOST_BLOCKS))
    whole = [w // s if s else 0 for w, s in zip(words, sizes, strict=True)]
    rest = [w - n * s for w, n, s in zip(words, whole, sizes, strict=True)]
    ends = draw_ends(placed, block, {r.source: (s, x) for r, s, x in zip(found, sizes, rest, strict=True) if x}, seed)
    last = [ends.get(r.source, (-1, 0, 0)) for r in found]
    blocks = [-(-s // block) for s in sizes]
    quotas = np.array([x[0] + 1 + n * k for x, n, k in zip(last, whole, blocks, strict=True)], np.int64)
    limits = np.cumsum(split(quotas, shards, np.random.default_rng(seed)), axis=0) if len(quotas) else np.zeros((shards, 0), np.int64)
    told = zip(found, sizes, wanted, whole, blocks, last, quotas, strict=True)
    by_source = spark.createDataFrame([(r.source, s, t, n, k, *map(int, x), int(q), [int(v) for v in limits[:, i]]) for i, (r, s, t, n, k, x, q) in enumerate(told)], "s string, source_size long, target double, whole long, n_blocks long, last long, upto long, first long, quota long, ends array<long>")
    joined = placed.join(by_source, F.col("source").eqNullSafe(F.col("s"))).drop("s", "h1")
    helpers = ("whole", "n_blocks", "last", "upto", "first", "quota", "ends")
    schema = joined.drop(*helpers).withColumn("pieces", F.expr("array(struct(0 as pass, 0L as words, 0L as block, 0 as shard, 0L as order))")).schema
    names = [c for c in schema.names if c != "pieces"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            of = {c: col(c).to_numpy(zero_copy_only=False) for c in ("size", "place", *helpers[:-1])}
            mine = of["place"] // block
            drawn = permuted(mine, np.maximum(of["n_blocks"], 1), seed)
            # of the pass that is drawn: blocks before the last whole, and the last up to its words
            part = np.where(drawn < of["last"], of["size"], np.where(drawn == of["last"], np.clip(of["upto"] - (of["place"] - of["first"]), 0, of["size"]), 0))
            many = np.where(of["size"] > 0, of["whole"], 0) + (part > 0)
            row = np.repeat(np.arange(b.num_rows), many)
            no = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            full = no < of["whole"][row]
            taken = np.where(full, of["size"][row], part[row])
            # the drawn blocks come first, in the order of the draw, then those of each whole pass
            at = np.where(full, of["last"][row] + 1 + no * of["n_blocks"][row] + mine[row], drawn[row])
            dealt = permuted(at, of["quota"][row], seed + 1)
            upper = np.array(col("ends").to_pylist(), np.int64).reshape(b.num_rows, -1)[row] if b.num_rows else np.zeros((0, 1), np.int64)
            shard = (upper <= dealt[:, None]).sum(axis=1) if len(row) else np.zeros(0, np.int64)
            order = permuted_hash(col("h2").to_numpy()[row], no)
            fields = [pa.array(no.astype(np.int32)), pa.array(taken), pa.array(at), pa.array(shard.astype(np.int32)), pa.array(order)]
            pieces = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.StructArray.from_arrays(fields, names=["pass", "words", "block", "shard", "order"]))
            out = {c: col(c) for c in names} | {"pieces": pieces}
            yield pa.RecordBatch.from_arrays([out[c] for c in schema.names], names=schema.names)

    return joined.mapInArrow(deal, schema), sum(words)


def draw_ends(placed: DataFrame, block: int, wanted: dict[str | None, tuple[int, int]], seed: int) -> dict[str | None, tuple[int, int, int]]:
    """Where the draw of each source ends that has (size, words to draw): the number of its last block in the permuted order, how many
    words of that block are taken, and the place at which the block's documents begin. A row for each source comes to the driver."""
    if not wanted:
        return {}
    spark = placed.sparkSession
    sizes = spark.createDataFrame([(k, -(-s // block), x) for k, (s, x) in wanted.items()], "s string, n_blocks long, rest long")
    weights = placed.where("size > 0").groupBy("source", F.call_function("div", F.col("place"), F.lit(block)).alias("block")).agg(F.sum("size").alias("w"), F.min("place").alias("first"))
    known = weights.join(sizes, F.col("source").eqNullSafe(F.col("s"))).select("source", "block", "n_blocks", "rest", "w", "first")
    kind = "source string, drawn long, rest long, w long, first long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = permuted(b.column(1).to_numpy(), b.column(2).to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(drawn), *b.columns[3:]], names=["source", "drawn", "rest", "w", "first"])

    before = prefix_sums(known.mapInArrow(number, kind), ["drawn"], "w", "before", "source")
    hit = before.where("before < rest and before + w >= rest").select("source", "drawn", (F.col("rest") - F.col("before")).alias("upto"), "first").collect()
    return {r["source"]: (r["drawn"], r["upto"], r["first"]) for r in hit}


def permuted_hash(h: np.ndarray, no: np.ndarray) -> np.ndarray:
    x = (h.astype(np.uint64) + no.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def mixed(docs: DataFrame, weights: Sequence[float], text: str = "text", **how: object) -> DataFrame:
    """The mix: a row of docs for each pass that takes it; the text that the target cuts ends behind its last word taken. Behind the
    columns of docs come shard and order; where docs has such names, theirs are _shard and _order. Each shard is one or more
    partitions that follow each other, sorted by order: what is written right away has a file for each part of about PART words."""
    shards = how.get("shards", SHARDS)
    planned, words = _plan(docs, weights, text=text, **how)
    spread = planned.select("row", "size", F.explode("pieces").alias("piece"))
    body = F.col("row")[text]
    whole = F.when(F.col("piece.words") >= F.col("size"), body).otherwise(first_words(body, F.col("piece.words")))
    columns = [whole.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    shard, order = free_name(docs, "shard"), free_name(docs, "order")
    # orders are spread evenly over 64 bits, so equal stretches of them are parts of about equal size
    parts = max(1, min(-(-words // (shards * PART)), MOST_PARTS // shards))
    part = F.floor((F.col("piece.order").cast("double") / 2.0**64 + 0.5) * parts).cast("int")
    at = F.col("piece.shard") * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))
    rows = spread.select(*columns, F.col("piece.shard").alias(shard), F.col("piece.order").alias(order), at.alias("_at"))
    return rows.repartitionById(shards * parts, "_at").drop("_at").sortWithinPartitions(shard, order)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, n.cast("int")), "")

"""Files of token ids under a canonical, length-limited Huffman code.

A folder holds two Parquet tables. `codebook` (id, bits) has the code length of every id that occurs, found from its count in
all documents; codes are canonical, so the lengths alone give them. `blocks` has a row for each block of whole documents: the
first token's number among all, the documents' keys and token counts, and `block`, which is

    4 bytes BLT2 | u32 tokens | u32 tokens between checkpoints | u32 checkpoints | u64 bit offset at each checkpoint | code bits

in little-endian order, the bits from the highest of each byte on. A block is read without any other; within it all stretches
between checkpoints are decoded side by side, one table lookup a token.

Documents come in ascending order of their keys, null keys first, rows of one key in that of a
hash of their texts. Null and empty
texts have the end id alone. A document is never cut, so a very long one makes a block of its own. Tables without rows give
tables without rows. Only the two columns named are read, so others may have any names."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from boxloom.llm.bpe import LibraryBpe, by_bytes, encoder
from boxloom.llm.common import discard, parallelism, release, stage_path, staged

MAGIC = b"BLT2"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits for counts over 0, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    row, rows = leaves, []
    for _ in range(limit - 1):
        packed = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packed])
        at = np.argsort(both, kind="stable")
        rows.append(at < n)
        row = both[at]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(rows):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: ids and their lengths, as the codebook has them."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = np.asarray(ids, np.int64)[order], np.asarray(bits, np.int64)[order]
        self.longest = int(self.bits[-1]) if len(bits) else 1
        step = np.int64(1) << (self.longest - self.bits)
        self.left = np.cumsum(step) - step  # codes, set to the left of `longest` bits

    def writer(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        code, bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.ids], bits[self.ids] = self.left >> (self.longest - self.bits), self.bits
        return code, bits

    def reader(self) -> tuple[np.ndarray, np.ndarray]:
        """What each string of `longest` bits begins with: an id and its number of bits."""
        step = np.int64(1) << (self.longest - self.bits)
        ids, bits = np.repeat(self.ids, step), np.repeat(self.bits, step)
        rest = (1 << self.longest) - len(ids)
        return np.append(ids, np.zeros(rest, np.int64)).astype(np.uint32), np.append(bits, np.ones(rest, np.int64))


def pack(ids: np.ndarray, code: np.ndarray, bits: np.ndarray, every: int) -> bytes:
    n = len(ids)
    length = bits[ids]
    at = np.cumsum(length) - length
    total = int(at[-1] + length[-1]) if n else 0
    words = np.zeros((total >> 5) + 2, np.uint64)
    if n:
        placed = code[ids] << (np.uint64(64) - (at & 31).astype(np.uint64) - length.astype(np.uint64))
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums, word = np.add.reduceat(placed, first), word[first]
        words[word] |= sums >> np.uint64(32)
        words[word + 1] |= sums & np.uint64(0xFFFFFFFF)
    marks = at[::every].astype("<u8")
    return struct.pack("<4sIII", MAGIC, n, every, len(marks)) + marks.tobytes() + words.astype(">u4").tobytes()


def unpack(block: bytes, ids: np.ndarray, bits: np.ndarray, longest: int) -> np.ndarray:
    magic, n, every, marks = struct.unpack_from("<4sIII", block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    pos = np.frombuffer(block, "<u8", marks, 16).astype(np.int64)
    words = np.frombuffer(block, ">u4", -1, 16 + 8 * marks).astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    out = np.empty((min(every, n) if n else 0, marks), np.uint32)
    shift, last = np.uint64(64 - longest), len(pairs) - 1
    for k in range(len(out)):
        seen = (pairs[np.minimum(pos >> 5, last)] << (pos & 31).astype(np.uint64)) >> shift
        seen = seen.astype(np.int64)
        out[k] = ids[seen]
        pos += bits[seen]
    return out.T.reshape(-1)[:n]


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int | None, path: str, text: str = "text", key: str = "doc_id", longest: int = 18, block_tokens: int = 1 << 18, every: int = 256) -> None:
    """Encodes the texts with the tokenizers library, appends end_id to each, and writes the folder `path`."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, before = encoder(vocabulary, LibraryBpe), TaskContext.get().partitionId(), 0
        most = max(len(bpe.table) - 1, end_id or 0)
        wide, total = "<u4" if most > 65535 else "<u2", np.zeros(most + 1, np.int64)
        for b in batches:
            for rows in by_bytes(b, 1):
                ids, n = bpe.encode_arrays(rows.column(1).to_pylist())
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                ends = np.append(0, np.cumsum(n))
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * int(wide[-1])).astype(np.int32)), pa.py_buffer(ids.astype(wide))])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), rows.column(0), pa.array(before + ends[:-1]), pa.array(n), packed], names=["part", "key", "before", "n", "ids"])
                before += int(ends[-1])
                total += np.bincount(ids, minlength=len(total))
        # a last row, of -1 tokens, has the counts of the ids
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, arrow_kind), pa.array([0], pa.int64()), pa.array([-1], pa.int64()), pa.array([found.astype("<i8").tobytes() + total[found].astype("<i8").tobytes()], pa.binary())], names=["part", "key", "before", "n", "ids"])

    arrow_kind = to_arrow_type(docs.schema[key].dataType)
    ranges = parallelism(spark)
    spread = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(ranges, F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")
    tokens = staged(spread.mapInArrow(tokenize, f"part int, key {kind}, before long, n long, ids binary"), "tokens")
    release(spark)

    def narrow(b: bytes, n: int) -> np.ndarray:
        return np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                found, n = np.frombuffer(x, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["id", "n"])

    # as many rows as the vocabulary has ids
    seen = tokens.where("n < 0").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    ids = np.array([r.id for r in seen], np.int64)
    limit = max(longest, int(np.ceil(np.log2(max(len(ids), 2)))))
    bits = code_lengths(np.array([r.n for r in seen], np.int64), limit)
    book = [(int(i), int(b)) for i, b in zip(ids, bits, strict=True)]
    spark.createDataFrame(book, "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    # one total for each range of keys
    base, start = {}, 0
    for r in tokens.where("n >= 0").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        base[r.part], start = start, start + r.n

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, size = Code(ids, bits).writer()
        keys: list = []
        lens: list[int] = []
        parts: list[np.ndarray] = []
        first, held, of = 0, 0, 0

        def block() -> pa.RecordBatch:
            packed = pack(np.concatenate(parts).astype(np.int64), code, size, every)
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([first], pa.int64()), pa.array([keys], pa.list_(kind_arrow)), pa.array([lens], pa.list_(pa.int64())), pa.array([packed], pa.binary())], names=["part", "start", "keys", "lens", "block"])

        for b in batches:
            kind_arrow = b.schema.field("key").type
            for at in range(0, b.num_rows, 1000):
                rows = b.slice(at, 1000)
                for part, key, before, n, x in zip(*(rows.column(c).to_pylist() for c in ("part", "key", "before", "n", "ids")), strict=True):
                    if held and (held + n > block_tokens or part != of or base[part] + before != first + held):
                        yield block()
                        keys, lens, parts, held = [], [], [], 0
                    if not keys:
                        first, of = base[part] + before, part
                    keys.append(key)
                    lens.append(n)
                    parts.append(narrow(x, n))
                    held += n
        if keys:
            yield block()

    blocks = tokens.where("n >= 0").mapInArrow(encode, f"part int, start long, keys array<{kind}>, lens array<long>, block binary")
    # a file for each range, so that the files, too, are in the order of the keys
    blocks.repartitionById(ranges, "part").sortWithinPartitions("start").drop("part").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(tokens)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids as little-endian unsigned 32-bit integers) of each document of a folder."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # as many rows as the vocabulary has ids
    ids, bits = np.array([r.id for r in book], np.int64), np.array([r.bits for r in book], np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(ids, bits)
        table, size = code.reader()
        for b in batches:
            for row in range(b.num_rows):
                start, keys, lens = b.column(0)[row].as_py(), b.column(1)[row].values, np.array(b.column(2)[row].as_py(), np.int64)
                got = unpack(b.column(3)[row].as_py(), table, size, code.longest).astype("<u4").tobytes()
                at = np.cumsum(lens) - lens
                docs = [got[4 * i : 4 * (i + n)] for i, n in zip(at.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + at), pa.array(lens), pa.array(docs, pa.binary())], names=[key, "start", "n_tokens", "ids"])

    return blocks.select("start", "keys", "lens", "block").mapInArrow(decode, f"`{key}` {blocks.schema['keys'].dataType.elementType.simpleString()}, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, vocabulary: str, end_id: int | None, **how: str) -> DataFrame:
    """Writes the documents' ids to a folder in the shared folder, and reads them back."""
    path = stage_path(docs.sparkSession, "token-file")
    write_tokens(docs, vocabulary, end_id, path, **how)
    release(docs.sparkSession)
    return read_tokens(docs.sparkSession, path, how.get("key", "doc_id"))

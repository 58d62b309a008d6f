"""Token counts: texts are encoded in batches inside Arrow functions, and only lengths come back.

A batch holds runs of rows of about `most` bytes, however long their texts. Texts are split where the pre-tokenizer of a byte-level
vocabulary always begins a token: before single spaces and on both sides of single line breaks that stand between two visible characters
of ASCII or Latin, and between an ASCII letter or digit and punctuation that no special string holds. No special string holds white space
either, so counts of the parts add up to the count of the text. The parts are told apart by Arrow, and the library encodes each distinct
one that a worker has not met lately, in one call for a batch; a part that can't be split further is encoded whole.

For a sentencepiece model the spaces alone are used, the space itself being dropped, since the model puts its mark for a space before
each part; models for which that isn't so (found by a look at their pieces and by probes) encode whole texts.

Vocabularies of other kinds encode whole texts, too. Null and empty texts have no tokens and no bytes; very long texts are counted
whole; each row is counted for itself, so rows that tie or repeat have the same counts; empty tables give empty tables. Only the two
columns named are read, so others may have any names."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.bpe import by_bytes

#: The mark for a space in pieces of sentencepiece models.
MARK = "▁"
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
#: First bytes of the characters U+00C0 to U+023F: two bytes each, and none of them is white space.
_LATIN = np.zeros(256, bool)
_LATIN[0xC3:0xC9] = True


_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def between(data: np.ndarray, byte: int) -> np.ndarray:
    """Places of a byte between visible characters of ASCII or Latin, in UTF-8 bytes."""
    at = np.flatnonzero(data[1:-1] == byte) + 1
    before, after = data[at - 1], data[at + 1]
    latin = (before >= 0x80) & _LATIN[data[np.maximum(at - 2, 0)]] & (at >= 2)
    return at[(_VISIBLE[before] | latin) & (_VISIBLE[after] | _LATIN[after])]


class Counter:
    """Numbers of tokens by one vocabulary file."""

    #: Parts of texts that a worker keeps the counts of, and the longest of these.
    KEPT, LONGEST = 600_000, 60

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[bytes, int] = {}
        self.gap = 0  # what is dropped before a part
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
            inner = any(MARK in p[1:] and p.strip(MARK) for p in map(library.id_to_piece, range(library.get_piece_size())))
            probes = (["a b", "the end", "x1 )y", "é ü", "<s> </s>"], [["a", "b"], ["the", "end"], ["x1", ")y"], ["é", "ü"], ["<s>", "</s>"]])
            same = all(library.encode(w) == [i for p in parts for i in library.encode(p)] for w, parts in zip(*probes, strict=True))
            self.splits, self.gap, self.marks = same and not inner, 1, None
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.encode = lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            spec = json.load(open(path, encoding="utf-8"))
            pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
            plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not spec["normalizer"]
            self.splits = plain and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or any(map(str.isspace, a["content"])) for a in added)
            self.marks = np.isin(np.arange(256), [ord(c) for c in ".,;:!?)" if not any(c in a["content"] for a in added)])

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Places at which a part may begin."""
        spaces = between(data, 32)
        if self.marks is None:
            return spaces
        lines, marks = between(data, 10), np.flatnonzero(_ALNUM[data[:-1]] & self.marks[data[1:]]) + 1
        return np.sort(np.concatenate([spaces, lines, lines + 1, marks]))

    def _lengths(self, parts: list[bytes]) -> np.ndarray:
        get = self.known.get
        found = [get(p, -1) for p in parts]
        new = [i for i, n in enumerate(found) if n < 0]
        if new:
            if len(self.known) > self.KEPT:
                self.known.clear()
            for i, n in zip(new, self.encode([parts[i].decode() for i in new]), strict=True):
                found[i] = n
                if len(parts[i]) <= self.LONGEST:
                    self.known[parts[i]] = n
        return np.array(found, np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text of an Arrow array; null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        out, start = np.zeros(len(size), np.int64), ends - size
        if not len(size) or not ends[-1]:
            return out
        first = int(np.frombuffer(texts.buffers()[1], np.int64, 1, 8 * texts.offset)[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8, int(ends[-1]), first)
        cuts = np.zeros(0, np.int64)
        if self.splits:
            cuts = self._cuts(data)
            row = np.searchsorted(ends, cuts, "right")  # texts that only stand side by side make no cut
            cuts = cuts[(cuts > start[row]) & (cuts < ends[row] - 1)]
        heads = start[size > 0]
        begin = np.sort(np.concatenate([cuts, heads]))
        gap = np.full(len(begin), self.gap)
        gap[np.searchsorted(begin, heads)] = 0
        stop = np.append(begin[1:], ends[-1])
        parts = self._cut(data, begin + gap, stop)
        coded = parts.dictionary_encode()
        n = self._lengths(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        np.add.at(out, np.searchsorted(ends, begin, "right"), n)
        return out

    def _cut(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
        if self.gap:
            keep = np.ones(len(data), bool)
            keep[begin[1:][begin[1:] != stop[:-1]] - 1] = False
            data = data[keep]
        at = np.append(0, np.cumsum(stop - begin))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


@functools.cache
def counter(path: str) -> Counter:
    """The counter of a vocabulary file, made once in each worker."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text", key: str = "doc_id", most: int = 4 << 20) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row; no rows move between tasks."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            for rows in by_bytes(b, 1, most):
                n = count.counts(rows.column(1))
                size = pc.fill_null(pc.binary_length(rows.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), size, pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

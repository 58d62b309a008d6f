"""BPE encoding and decoding by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary is never merged over, so a text may be cut between the two and
the fragments encoded independently; their ids, concatenated, are those of the whole text. Fragments repeat, so each worker
keeps the ids of those it has met in a table of bounded size.

The file read is that of the tokenizers library with a byte-level BPE model. Its pre-tokenizer also cuts texts, by a pattern
that looks at the characters around; a text is first cut before each single space (such cuts are forced: no token has a space
behind visible ASCII, which is checked for each vocabulary, and the pattern matches over none of them), and the pattern is
applied within the pieces. Texts in which a space stands between white space, where the pattern looks across such a cut, are
matched whole. Texts with characters whose class depends on the version of Unicode are cut by the library's own pre-tokenizer.

Null texts are encoded as empty; empty texts have no ids; texts of any length are encoded whole, a fragment of n bytes in
O(n log n). Each row is encoded for itself: rows that tie or repeat have the same ids, and empty tables give empty tables. Columns are
returned under the names given; carried ones that clash have to be renamed before. Decoding replaces invalid UTF-8 by U+FFFD as the
library does."""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers import pre_tokenizers as PreTokenizer

from boxloom.llm.common import by_bytes

#: The pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Every version of Unicode agrees on the letters below.
BEYOND = re.compile("[^\x00-\u024f]")
ACROSS = re.compile(r"\s (?:\s|\Z)")
#: Stands at the begin of a part of a text that has no space before it.
MARK = "\0"
#: The mark, white space but blanks and line breaks, and what may be such or unsettled.
RARE = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u0250-\U0010ffff]")
#: A letter or digit at the end, on which every version of Unicode agrees.
SETTLED = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$"
SYMBOLS = "\n" + "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


#: The rank of pairs that aren't merged.
NONE = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def unsettled() -> re.Pattern:
    """Characters that one version of Unicode calls letters or numbers and another does not."""
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    letters = set(regex.findall(r"[\p{L}\p{N}]", every))
    odd = sorted(c for c in every if (unicodedata.category(c)[0] in "LN") != (c in letters))
    runs: list[list[int]] = []
    for c in map(ord, odd):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]" if runs else r"(?!)")


def gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of data that begin at `at`, one behind the other."""
    kind = np.int32 if len(data) < 1 << 31 > size.sum() else np.int64
    ends = np.cumsum(size)
    return data[np.repeat((at - ends + size).astype(kind), size) + np.arange(ends[-1] if len(ends) else 0, dtype=kind)]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size


def packed(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists, and how many each has."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), "<u4", int(size.sum())), size


class ForcedBpe:
    """Encoder and decoder of one vocabulary. Ids of a text are bytes: little-endian unsigned 32-bit integers."""

    #: Words kept by a worker.
    KEPT = 400_000

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model.get("dropout"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in white space aren't supported")
        letters = byte_alphabet()
        spell = lambda s: bytes(letters[c] for c in s)
        self.vocab = {spell(t): i for t, i in model["vocab"].items()}
        self.ranks = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[self.vocab[spell(a)] << 24 | self.vocab[spell(b)]] = r << 24 | self.vocab[spell(a) + spell(b)]
        self.single = [self.vocab.get(bytes([b])) for b in range(256)]
        size = max([*self.vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.table = [b""] * size
        for t, i in self.vocab.items():
            self.table[i] = t
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.merged = np.array([self.ranks[k] for k in self.pairs.tolist()], np.int64)
        self.bytes = None if None in self.single else np.array(self.single, np.int64)
        self.short: dict[bytes, list[int]] = {}
        some = [t for t in self.vocab if 0 < len(t) < 100]
        ids, size = self.merge_many(*joined(some))
        for t, i, k in zip(some, ids[np.cumsum(size) - size].tolist(), size.tolist(), strict=True):
            if k == 1 and i == self.vocab[t]:  # tokens that their own merges give
                self.short[t] = [i]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.added.items():
            self.table[i] = t.encode()
        self.join = np.zeros((256, 256), bool)  # pairs inside tokens
        for t in self.vocab:
            v = np.frombuffer(t, np.uint8)
            self.join[v[:-1], v[1:]] = True
        self.inside = self.join.tobytes()
        self.at_space = pre.get("use_regex", True) and not self.join[33:127, 32].any()
        self.pre = PreTokenizer.ByteLevel(add_prefix_space=False, use_regex=pre.get("use_regex", True))
        self.pattern = regex.compile(PATTERN if pre.get("use_regex", True) else r"(?s).+")
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tails: dict[str, np.ndarray] = {}
        self.spell: tuple[np.ndarray, np.ndarray] | None = None
        # words met, and where their ids stand in flat
        self.words, self.used = pa.array([], pa.string()), np.zeros(0, bool)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of a fragment: the adjacent pair of least rank is merged, the leftmost first, until none is left."""
        if (whole := self.short.get(fragment)) is not None:
            return whole
        ids = [self.single[b] for b in fragment]
        n, get = len(ids), self.ranks.get
        none, mask = 1 << 62, (1 << 24) - 1
        if n < 100:  # a rank holds the id of the merged token in its low bits
            pairs = [get(a << 24 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
            while pairs and (best := min(pairs)) < none:
                k = pairs.index(best)
                ids[k : k + 2] = [best & mask]
                del pairs[k]
                if k:
                    pairs[k - 1] = get(ids[k - 1] << 24 | ids[k], none)
                if k < len(pairs):
                    pairs[k] = get(ids[k] << 24 | ids[k + 1], none)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := get(a << 24 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = r & mask, -1, after[j]
            if after[j] < n:
                before[after[j]] = k
                if (r := get(ids[k] << 24 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[j]]))
            if before[k] >= 0 and (r := get(ids[before[k]] << 24 | ids[k])) is not None:
                heapq.heappush(heap, (r, before[k], ids[before[k]], ids[k]))
        return [i for i in ids if i >= 0]

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What merge() calls the rank of each pair, and NONE for those that aren't merged."""
        key = a << 24 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def merge_many(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many fragments at once, those of `data` from `first` on: their ids, and how many each has. In each turn every fragment
        merges its leftmost pair of least rank, and those that have none left go. Fragments that aren't short are merged one by one, as a turn
        looks at all of each."""
        n = np.diff(np.append(first, len(data)))
        slow = self.bytes is None or not len(self.pairs)
        apart = np.flatnonzero((n >= 100) | slow)
        got = [np.array(self.merge(data[a : a + k].tobytes()), np.int64) for a, k in zip(first[apart].tolist(), n[apart].tolist(), strict=True)]
        flat, which = got, [np.repeat(apart, np.fromiter(map(len, got), np.int64, len(got)))]
        of = np.repeat(np.arange(len(n)), n)  # the fragment of each id
        short = (n < 100)[of] & (not slow)
        ids, of = (self.bytes[data[short]] if not slow else data[:0].astype(np.int64)), of[short]
        rank = np.full(len(ids), NONE)  # of an id and the next
        inside = np.flatnonzero(of[:-1] == of[1:])
        rank[inside] = self._merged(ids[inside], ids[inside + 1])
        while len(ids):
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            size = np.diff(np.append(begin, len(of)))
            least = np.minimum.reduceat(rank, begin)
            done = least == NONE
            if done.any():
                gone = np.repeat(done, size)
                flat.append(ids[gone]), which.append(of[gone])
                ids, of, rank, size, least = ids[~gone], of[~gone], rank[~gone], size[~done], least[~done]
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = hit[np.diff(of[hit], prepend=-1) > 0]  # the leftmost of each fragment
            ids[hit] = least & (1 << 24) - 1
            left = np.ones(len(ids), bool)
            left[hit + 1] = False
            ids, of, rank = ids[left], of[left], rank[left]
            at = hit - np.arange(len(hit))
            for k in (at, at[at > 0] - 1):  # the pairs of the new id
                near = np.minimum(k + 1, len(ids) - 1)
                rank[k] = np.where((near > k) & (of[k] == of[near]), self._merged(ids[k], ids[near]), NONE)
        every = np.concatenate(which)
        return np.concatenate([*flat, ids])[np.argsort(every, kind="stable")].astype("<u4"), np.bincount(every, minlength=len(n))

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece, cut at every pair of bytes that no token holds."""
        inside = self.inside
        cuts = [k for k in range(1, len(piece)) if not inside[piece[k - 1] << 8 | piece[k]]]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)] if cuts else [piece]

    def _token(self, text: str) -> list[int]:
        out: list[int] = []
        for f in self.fragments(text.encode()):
            out += self.merge(f)
        return out

    def letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that are one token of the pattern: letters, with or without a space before them; and how many each has. All are
        cut at forced boundaries, and the fragments are merged together."""
        data, piece = joined([p.encode() for p in pieces])
        cut = np.append(True, ~self.join[data[:-1], data[1:]])[: len(data)]
        cut[piece] = True
        first = np.flatnonzero(cut)
        ids, size = self.merge_many(data, first)
        return ids, np.add.reduceat(size, np.searchsorted(first, piece)) if len(piece) else size

    def solve(self, pieces: list[str]) -> list[list[int]]:
        """Ids of any other pieces."""
        return [[i for t in self.pattern.findall(p) for i in self._token(t)] for p in pieces]

    def _known(self, words: pa.Array) -> np.ndarray:
        """The numbers of words in the table; those it lacks are encoded. A word has a space before it, unless it begins with the mark."""
        found = pc.index_in(words, value_set=self.words)
        place = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        if not found.null_count:
            self.used[place] = True
            return place
        new = np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
        lacking = words.take(pa.array(new)).dictionary_encode()
        todo = lacking.dictionary.to_pylist()
        alpha = np.fromiter((w.lstrip(MARK).isalpha() for w in todo), bool, len(todo))
        order = np.argsort(~alpha, kind="stable")  # words of letters stand first
        spaced = [w[1:] if w[:1] == MARK else " " + w for w in (todo[i] for i in order.tolist())]
        plain = int(alpha.sum())
        solved = [self.letters(spaced[:plain]), packed(self.solve(spaced[plain:]))]
        flat, size = (np.concatenate(x) for x in zip(*solved, strict=True))
        self.used[place[pc.is_valid(found).to_numpy(zero_copy_only=False)]] = True
        if len(self.words) + len(todo) > self.KEPT:  # what no text has had since the last time goes
            moved = np.cumsum(self.used) - 1
            self._keep(np.flatnonzero(self.used))
            self.used[:] = False
            place = moved[place] if len(moved) else place
        place[new] = len(self.words) + np.argsort(order)[lacking.indices.to_numpy()]
        self.at = np.append(self.at, len(self.flat) + np.cumsum(size) - size)
        self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat)
        self.words, self.used = pa.concat_arrays([self.words, lacking.dictionary.cast(pa.string()).take(pa.array(order))]), np.append(self.used, np.ones(len(todo), bool))
        return place

    def _keep(self, rows: np.ndarray) -> None:
        self.flat = gather(self.flat, self.at[rows], self.size[rows])
        self.words, self.size, self.used = self.words.take(pa.array(rows)), self.size[rows], self.used[rows]
        self.at = np.cumsum(self.size) - self.size

    def _look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one behind the other, and how many each has.

        Symbols behind a letter or digit begin a token of the pattern, so they are looked up apart from what stands before them."""
        bases = pc.utf8_rtrim(words, SYMBOLS)
        bases = pc.if_else(pc.match_substring_regex(bases, SETTLED), bases, words)
        long, short = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (words, bases))
        rows = np.flatnonzero(long > short)
        # what stands behind the bases, cut out of the words' bytes
        first = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_string(words.type) else np.int32, len(words) + 1, words.offset * (8 if pa.types.is_large_string(words.type) else 4)).astype(np.int64)
        n = (long - short)[rows]
        body = gather(np.frombuffer(words.buffers()[2] or b"", np.uint8), first[rows] + short[rows], n)
        tails = pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int32)), pa.py_buffer(body)).dictionary_encode()
        kinds = [self.tails[t] if t in self.tails else self._tail(t) for t in tails.dictionary.to_pylist()]
        k_size = np.fromiter(map(len, kinds), np.int64, len(kinds))
        base = self._known(bases)
        at, size = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        at[:, 0], size[:, 0] = self.at[base], self.size[base]
        code = tails.indices.to_numpy()
        at[rows, 1], size[rows, 1] = (len(self.flat) + np.cumsum(k_size) - k_size)[code], k_size[code]
        return gather(np.concatenate([self.flat, *kinds]), at.ravel(), size.ravel()), size.sum(axis=1)

    def _tail(self, tail: str) -> np.ndarray:
        ids = np.array(self.solve([tail])[0], "<u4")
        if len(self.tails) < 10_000 and len(tail) < 20:
            self.tails[tail] = ids
        return ids

    def _odd(self, text: str) -> list[int]:
        """Ids of a text that may not be cut before each space: with added tokens, or white space or characters that look across."""
        parts = self.split_added.split(text) if self.split_added else [text]
        out: list[int] = []
        for k, x in enumerate(parts):
            if k % 2:
                out.append(self.added[x])
            elif x:
                pieces = [x[a:b] for _, (a, b) in self.pre.pre_tokenize_str(x)] if unsettled().search(x) else self.pattern.findall(x)
                for t in pieces:
                    out += self._token(t)
        return out

    def _parts(self, text: str) -> str | None:
        """The text, so that its parts between spaces can be encoded apart: the first has the mark, and so have those behind line breaks,
        which get a space where no other white space is near. None: it can't be cut."""
        if not self.at_space or any(a in text for a in self.added):
            return None
        if RARE.search(text):
            whole = MARK in text or ACROSS.search(text) or (not text.isascii() and BEYOND.search(text) and unsettled().search(text))
            return None if whole else MARK + text
        if ("  " in text or "\n " in text) and ACROSS.search(text):
            return None
        return MARK + (text if "\n\n" in text or " \n" in text else text.replace("\n", "\n " + MARK))

    def encode_arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text behind the other, and how many each has.

        Words are told apart and numbered by Arrow; only distinct ones are looked up, and their ids are gathered by number."""
        parts = [self._parts(t) if t else "" for t in texts]
        count = np.zeros(len(texts), np.int64)
        odd = {i: np.array(self._odd(texts[i]), "<u4") for i, x in enumerate(parts) if x is None}
        plain = np.array([i for i, x in enumerate(parts) if x], np.int64)
        some = [parts[i] for i in plain.tolist()]
        words = pc.split_pattern(pa.array(some, pa.string() if sum(map(len, some)) < 1 << 28 else pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        flat, size = self._look(coded.dictionary)
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.append(0, np.cumsum(n))
        out = gather(flat, (np.cumsum(size) - size)[code], n)
        bounds = ends[np.append(0, np.cumsum(words.value_lengths().to_numpy()))]
        count[plain] = np.diff(bounds)
        if odd:
            count[list(odd)] = [len(x) for x in odd.values()]
            mine = {i: out[a:b] for i, a, b in zip(plain.tolist(), bounds.tolist(), bounds[1:].tolist(), strict=False)} | odd
            out = np.concatenate([mine[i] for i in sorted(mine)])
        return out, count

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        ids, count = self.encode_arrays(texts)
        data, ends = ids.tobytes(), np.append(0, 4 * np.cumsum(count)).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def spelled_out(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many runs of ids, one behind the other, and how many each has; not decoded."""
        if self.spell is None:
            self.spell = joined(self.table)
        data, at = self.spell
        size = np.diff(np.append(at, len(data)))[ids]
        ends = np.append(0, np.cumsum(size))
        return gather(data, at[ids], size), np.diff(ends[np.append(0, np.cumsum(count))])

    def decode(self, ids: bytes | np.ndarray) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


class LibraryBpe(ForcedBpe):
    """The same with the tokenizers library: it encodes each piece that is in no table yet."""

    KEPT = 800_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.spelled = {b: c for c, b in byte_alphabet().items()}

    def letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One token of the pattern goes right to the library's model, spelled in the alphabet of the vocabulary."""
        tokenize, spelled = self.model.tokenize, self.spelled
        return packed([[t.id for t in tokenize(p.replace(" ", "\u0120") if p.isascii() else p.encode().decode("latin-1").translate(spelled))] for p in pieces])

    def solve(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []

    def _odd(self, text: str) -> list[int]:
        return self.solve([text])[0]


@functools.cache
def encoder(path: str, kind: type[ForcedBpe] = ForcedBpe) -> ForcedBpe:
    """The encoder of a vocabulary file, made once in each worker."""
    return kind(path)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", carry: Sequence[str] = (), decoded: bool = True) -> DataFrame:
    """(key, n_tokens, ids binary, decoded string) of each row, and behind them the columns to carry; no rows move between tasks.

    Without `decoded` the decoded text is held against the text (null: empty), and `round_trip` tells whether they are equal."""
    also = docs.select(*[F.col(c) for c in carry]).schema.fields
    last = T.StructField("decoded", T.StringType()) if decoded else T.StructField("round_trip", T.BooleanType())
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), last, *also])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for b in batches:
            for part in by_bytes(b, 1):
                texts = part.column(1).to_pylist()
                ids, count = bpe.encode_arrays(texts)
                ends = np.append(0, 4 * np.cumsum(count))
                data, size = bpe.spelled_out(ids, count)
                spelled, at = data.tobytes(), np.append(0, np.cumsum(size)).tolist()
                if decoded:
                    column = pa.array([spelled[a:z].decode("utf-8", "replace") for a, z in zip(at, at[1:], strict=False)], pa.string())
                else:  # equal bytes are equal texts; of others what decoding makes of them is looked at
                    same = [spelled[a:z] == (x := t or "").encode() or spelled[a:z].decode("utf-8", "replace") == x for t, a, z in zip(texts, at, at[1:], strict=False)]
                    column = pa.array(same, pa.bool_())
                stored = pa.BinaryArray.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), stored, column, *part.columns[2:]], names=schema.names)

    return docs.select(F.col(key), F.col(text), *[F.col(c) for c in carry]).mapInArrow(run, schema)

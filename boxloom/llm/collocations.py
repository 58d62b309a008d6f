"""Phrase collocations from suffix arrays of word ids.

Texts, A-Z lowered, are cut into pieces at . , ; : ! ? and line breaks, pieces into words at blanks and tabs. Each language is counted
for itself; a null one is `und`. A task takes runs of texts (shards) of one language, numbers their words, and sorts the suffixes of the
word ids by prefix doubling in numpy (by 1, 2, 4 and 5 words; no further, as no phrase is longer). Neighbours in that order share as many
words as their LCP says, so the phrases of n words are the intervals whose LCP is n or more: one interval is one phrase, its length its
count in the shard. Counts are merged by (language, phrase) over all shards; texts are never shuffled.

Only what can occur `least` times need be merged, and nothing is merged twice. So shards are read four times: for words, for pairs of
frequent words, for triples of frequent pairs, and for the four and five words of frequent triples. Each reading sorts suffixes as far as it
needs, and merges phrases by their words themselves, so counts are exact. The hashes of the frequent ones of a language set bits of a map
of fixed size (2 ** bits), which is all that is sent to the tasks of the next readings. A map tells too much (two hashes may share a bit)
but never too little: phrases that reach `least` have frequent words, pairs and triples.

What a task holds is a shard of about `shard` bytes, numbered in 32 bits, and texts not yet in one, at most twice as many bytes in all
languages together; hashes are made in slices.

A phrase is scored at its worst cut: floor(1000 * a * n / (l * r)), in exact decimals. It is dropped if it lies in a phrase of one word
more that occurs as often (longer ones that hold it occur at most as often as one between). The first `most` of each language are ranked
in two steps: within parts of a language, then among the firsts of the parts.

Null and empty texts have no words. A text of any length is read whole, in stretches that overlap by four words where no mark ends a
piece. Phrases that tie in score and count stand in the order of their bytes; repeated rows count as often as they stand; empty tables
give empty tables. Only the two columns named are read, so others may have any names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import BASE, BASE_INV, byte_codes, mix64, parallelism, powers, staged, utf8

_U = np.uint64
LONGEST = 5
#: No byte of UTF-8: it stands where a piece ends.
END = 0xFF
_MAP = bytearray(range(256))
for _b in b".,;:!?\n\x0b\x0c\r":
    _MAP[_b] = END
for _b in range(65, 91):
    _MAP[_b] = _b + 32
_MAP[9] = 32
_MORE = re.compile(rb"(?: *[^ \xff]+){1,4}")
_WORD_END = re.compile(rb"[ \xff]")
_CODES = byte_codes(11)
#: Rows of a batch, places and bytes of a slice.
_ROWS, _PLACES, _BYTES = 100_000, 1 << 18, 1 << 18
_POWERS, _INVERSES = powers(BASE, _BYTES), powers(BASE_INV, _BYTES)


def code(text: str | bytes) -> np.uint64:
    """A 64-bit hash of a language, or of a word that no slice holds."""
    return _U(int.from_bytes(blake2b(text if isinstance(text, bytes) else text.encode(), digest_size=8).digest(), "little"))


def to_next(stops: np.ndarray, n: int) -> np.ndarray:
    """How far it is from each of n places to the next stop, itself included; the last stop is behind them all, or the last of them."""
    stops = stops.astype(np.int32)
    return np.repeat(stops, np.diff(stops, prepend=np.int32(-1)))[:n] - np.arange(n, dtype=np.int32)


def stretches(data: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """The data in stretches of about `most` bytes, cut where pieces end or, within a longer piece, at a blank; there the next four words
    come along. With each, how many of its bytes are its own: phrases that begin behind these belong to the next."""
    at = 0
    while at < len(data):
        if len(data) - at <= most:
            yield data[at:], len(data) - at
            return
        cut = data.rfind(END, at, at + most)
        if cut > at:
            yield data[at:cut], cut - at
        else:
            cut = data.rfind(b" ", at, at + most)
            if cut <= at:
                hit = _WORD_END.search(data, at + most)
                cut = hit.start() if hit else len(data)
            more = _MORE.match(data, cut) if data[cut : cut + 1] == b" " else None
            yield data[at : more.end() if more else cut], cut - at
        at = cut + 1


class Shard:
    """The words of a stretch of text: `ids` in order, `words` by id, `room` how many words of the piece begin at each place, itself
    included, and `own` how many places are the stretch's own."""

    def __init__(self, data: bytes, own: int):
        raw = np.frombuffer(data, np.uint8)
        gap = raw == 32
        gap |= raw == END
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        begin, end = edge[0::2], edge[1::2]
        kind, offset = (pa.binary(), np.int32) if len(raw) < 1 << 31 else (pa.large_binary(), np.int64)
        size = np.zeros(len(begin) + 1, offset)
        np.cumsum(end - begin, out=size[1:])
        self.own = int(np.searchsorted(begin, own))
        last = np.searchsorted(begin, np.flatnonzero(raw == END))  # how many words begin before each end of a piece
        self.ends = np.append(last[np.diff(last, append=len(begin)) > 0], len(begin))
        body = pa.Array.from_buffers(kind, len(begin), [None, pa.py_buffer(size), pa.py_buffer(raw[~gap])])
        del edge, begin, end, gap
        coded = body.dictionary_encode()
        self.ids, self.words = coded.indices.to_numpy(), coded.dictionary

    @cached_property
    def room(self) -> np.ndarray:
        return to_next(self.ends - 1, len(self.ids)) + np.int32(1)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word of the vocabulary."""
        at = np.append(0, np.cumsum(pc.binary_length(self.words).to_numpy().astype(np.int64)))
        out, a = np.empty(len(self.words), _U), 0
        while a < len(out):
            b = int(np.searchsorted(at, at[a] + _BYTES, "right")) - 1  # the words from a to b are a slice
            if b <= a:
                out[a] = code(self.words[a].as_py())
                a += 1
                continue
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), self.words.slice(a, b - a)), b"")[0].as_buffer()
            raw, cut = np.frombuffer(text, np.uint8), at[a : b + 1] - at[a]
            sums = np.zeros(len(raw) + 1, _U)
            np.cumsum(_CODES[raw] * _POWERS[: len(raw)], out=sums[1:])
            out[a:b] = mix64((sums[cut[1:]] - sums[cut[:-1]]) * _INVERSES[cut[:-1]] + np.diff(cut).astype(_U))
            a = b
        return out

    def told(self, h: np.ndarray, k: int, lang: str, bitmap: np.ndarray, bits: int) -> np.ndarray:
        """Of each place, whether the map has the k words that begin there; h are the hashes of the vocabulary."""
        n, out = len(self.ids), np.zeros(len(self.ids), bool)
        for a in range(0, n - k + 1, _PLACES):
            found = is_set(bitmap, runs(h[self.ids[a : a + _PLACES + k - 1]], k) ^ code(lang), bits)
            out[a : a + len(found)] = found
        return out

    def limit(self, good: np.ndarray) -> None:
        """Pieces end before and behind words that aren't good, which have no room themselves; good tells of each place."""
        n = len(self.ids)
        self.room = np.minimum(self.room, to_next(np.append(np.flatnonzero(~good), n), n))

    def limit_pairs(self, good: np.ndarray) -> None:
        """Pieces end between words whose pair isn't good; good tells of each place whether the pair that begins there is."""
        n = len(self.ids)
        self.room = np.minimum(self.room, to_next(np.append(np.flatnonzero(~good[: max(n - 1, 0)]), n - 1), n) + np.int32(1))

    def limit_triples(self, good: np.ndarray) -> None:
        """Phrases of three words and more hold none but good triples; good tells of each place whether the triple that begins there is."""
        n = len(self.ids)
        good = good & (self.room > 2)
        self.room = np.where(good, to_next(np.append(np.flatnonzero(~good), n), n) + np.int32(2), np.minimum(self.room, 2))

    def suffixes(self, depth: int = LONGEST, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Places in pieces of `least` words and more in the order of the words from there on, up to depth, and the LCP of each with the one
        before."""
        n, room = len(self.ids), np.minimum(self.room, np.int32(depth))
        held = room >= least
        for _ in range(least - 1):
            held[1:] |= held[:-1].copy()
        at = np.flatnonzero(held & (room > 0)).astype(np.int32)
        rank, known, order = self.ids + np.int32(1), 1, np.arange(len(at))
        while known < depth:
            step = min(known, depth - known)
            # a rank of `known` words, then one of the `known` words that end at the new depth; 0 where the piece has ended
            key = rank[at].astype(np.int64)
            key *= n + 2
            key += np.where(room[at] > step, rank[np.minimum(at + np.int32(step), n - 1)], np.int32(0))
            order = np.argsort(key)
            key = key[order]
            rank = np.zeros(n, np.int32)
            rank[at[order]] = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)], dtype=np.int32)
            known += step
        at = at[order]
        lcp = np.zeros(len(at), np.int8)
        same = np.arange(1, len(at), dtype=np.int32)
        for k in range(depth):
            a, b = at[same - 1], at[same]
            same = same[(room[a] > k) & (room[b] > k)]
            same = same[self.ids[at[same - 1] + k] == self.ids[at[same] + k]]
            lcp[same] = k + 1
        return at, lcp

    def phrases(self, shortest: int = 1, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, counts) of the phrases of each number of words: the intervals of the suffix array by their LCP, and for one
        word, whose order is that of the ids, its ids."""
        own = self.own
        if shortest == 1:
            place = np.flatnonzero(self.room[:own] > 0).astype(np.int32)
            words, some = self.ids[place], np.zeros(len(self.words), np.int32)
            some[words] = place
            count = np.bincount(words, minlength=len(some))
            yield 1, some[count > 0], count[count > 0]
            del place, words, some, count
            if longest == 1:
                return
        at, lcp = self.suffixes(longest, max(shortest, 2))
        mine = (at < own).astype(np.int64)  # places behind the stretch's own are in the order, but not counted
        for k in range(max(shortest, 2), longest + 1):
            first = np.flatnonzero(lcp < k)
            count = np.add.reduceat(mine, first) if len(first) else first
            place = at[first]
            some = (self.room[place] >= k) & (count > 0)
            yield k, place[some], count[some]

    def spelled(self, places: np.ndarray, k: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.ids[places + j])).cast(pa.large_binary()) for j in range(k)]
        return (pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]).cast(pa.large_string())


def runs(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words that begin at each place behind which k - 1 follow, from the hashes of the words."""
    out, n = mix64(w), max(len(w) - k + 1, 0)
    for j in range(1, k):
        out = mix64(out[:n] * _U(BASE) + w[j : n + j])
    return out[:n]


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, Shard]]:
    """(lang, shard) of rows (lang, text); texts of all languages that wait for a shard are at most twice `most` bytes and a text."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    waiting = 0

    def cut(lang: str) -> Iterator[tuple[str, Shard]]:
        data = bytes([END]).join(held.pop(lang)).translate(bytes(_MAP))
        size.pop(lang)
        for part, own in stretches(data, most):
            yield lang, Shard(part, own)

    for b in batches:
        langs = b.column(0).to_pylist()
        for at in range(0, b.num_rows, 256):
            for lang, text in zip(langs[at : at + 256], utf8(b.column(1).slice(at, 256)), strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                waiting += len(text) + 1
                for full in [lang] if size[lang] > most else list(held) if waiting > 2 * most else []:
                    waiting -= size[full]
                    yield from cut(full)
    for lang in list(held):
        yield from cut(lang)


def counted(docs: DataFrame, make, columns: str, most: int) -> DataFrame:
    """What make(lang, shard) gives for each shard, as rows."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards(batches, most):
            for arrays in make(lang, shard):
                n = len(arrays[0])
                for a in range(0, n, _ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * min(_ROWS, n - a), pa.string()), *(x.slice(a, _ROWS) for x in arrays)], names=names)

    return docs.mapInArrow(run, columns)


def hashed(phrases: DataFrame, k: int) -> DataFrame:
    """h, the hash that Shard.told looks up, of rows (lang, phrase) of k words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, _PLACES):
                lang, text = b.column(0).slice(a, _PLACES).dictionary_encode(), utf8(b.column(1).slice(a, _PLACES))
                s = Shard(bytes([END]).join(text), 0)
                langs = np.array([code(x) for x in lang.dictionary.to_pylist()], _U)[lang.indices.to_numpy()]
                h = runs(s.hashes()[s.ids], k)[::k] ^ langs
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


def bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """A map of 2 ** bits bits, of which those of the hashes (column h) are set: 2 ** (bits - 3) bytes, however many there are."""
    page = min(bits, 16)
    at = F.shiftrightunsigned("h", 64 - bits)
    pages = hashes.select(F.shiftright(at, page).cast("int").alias("page"), (at % (1 << page)).cast("int").alias("bit")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            number, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(number).tolist():
                one = np.zeros(1 << page, bool)
                one[bit[number == p]] = True
                out[p] = out[p] | np.packbits(one) if p in out else np.packbits(one)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["page", "map"])

    rows = pages.repartition(parallelism(hashes.sparkSession), "page").mapInArrow(run, "page int, map binary")
    full = np.zeros((1 << (bits - page), max(1, (1 << page) // 8)), np.uint8)
    for r in rows.toLocalIterator():  # a page comes from one task, as it is the key they are dealt by
        full[r.page] = np.frombuffer(r["map"], np.uint8)
    return full.ravel()


def is_set(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = h >> _U(64 - bits)
    return (bitmap[(at >> _U(3)).astype(np.int64)] >> (7 - (at & _U(7)).astype(np.uint8))) & 1 == 1


def phrase_counts(docs: DataFrame, least: int = 100, text: str = "text", lang: str = "lang", shard: int = 16 << 20, bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of the phrases of 1 to 5 words that occur `least` times, and (lang, n) with all words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null and text != ''")

    def often(name: str, shortest: int, longest: int, *maps) -> DataFrame:
        """(lang, phrase, words, f) of the frequent phrases whose words, pairs and triples the maps have, as far as they are there. Among
        the words, a row without a phrase has the number of all words of its language."""

        def make(lang: str, s: Shard) -> Iterator[list[pa.Array]]:
            if not len(s.words):
                return
            if shortest == 1:
                yield [pa.array([None], pa.string()), pa.array([1], pa.int32()), pa.array([s.own])]
            else:
                h = s.hashes()
                for k, (limit, m) in enumerate(zip((s.limit, s.limit_pairs, s.limit_triples), maps), 1):
                    limit(s.told(h, k, lang, m.value, bits))
                del h
            for k, place, n in s.phrases(shortest, longest):
                for a in range(0, len(place), _ROWS):
                    some = place[a : a + _ROWS]
                    yield [s.spelled(some, k).cast(pa.string()), pa.array(np.full(len(some), k, np.int32)), pa.array(n[a : a + _ROWS])]

        merged = counted(rows, make, "lang string, phrase string, words int, f long", shard).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
        return staged(merged.where((F.col("f") >= least) | F.col("phrase").isNull()), name)

    first = often("words", 1, 1)
    counts, maps = [first.where("phrase is not null")], []
    for name, shortest, longest in (("pairs", 2, 2), ("triples", 3, 3), ("phrases", 4, LONGEST)):
        maps.append(spark.sparkContext.broadcast(bit_map(hashed(counts[-1], shortest - 1), bits)))
        counts.append(often(name, shortest, longest, *maps))
    return reduce(DataFrame.union, counts), first.where("phrase is null and f > 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, **how: object) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of each language."""
    counts, sizes = phrase_counts(docs, least, **how)
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    # what a phrase of one word more holds
    within = lambda first: F.array_join(F.slice(F.split("phrase", " "), first, F.col("words") - 1), " ")
    parts = found.where("words > 2").select("lang", "a", F.explode(F.array(within(F.lit(1)), within(F.lit(2)))).alias("phrase"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(longer, ["lang", "phrase"], "left").where("longer is null or longer < a")
    # each place where it can be cut
    word = F.split("phrase", " ")
    cut = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    join = lambda first, n: F.array_join(F.slice(word, first, n), " ")
    cut = cut.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    named = lambda part, f: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    both = cut.join(named("left", "l"), ["lang", "left"]).join(named("right", "r"), ["lang", "right"]).join(sizes, "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n"))).cast("decimal(38,0)")
    scored = both.withColumn("score", F.call_function("div", top, (exact("l") * exact("r")).cast("decimal(38,0)")).cast("long"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]

    def first(df: DataFrame, *by: Column | str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)

    spread = first(worst.withColumn("_part", F.pmod(F.hash("phrase"), F.lit(64))), "lang", "_part").drop("rank", "_part")
    return first(spread, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

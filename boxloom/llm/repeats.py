"""Removal of repeated byte strings: a hash-compared suffix sort over the places where repeats can be.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a row of smaller doc_id, or before in the same text.

1. Anchors. Each window of `length` bytes points at one of its strings of `seed` bytes: the one of least hash, the leftmost of
   several. Equal windows point at equal strings, at the same place within. So only anchors whose string occurs more than once can
   stand for repeats; the others go, and the texts stay where they are.
2. Contexts. Around each anchor left, the stretch of text whose windows point at it is gathered by the anchor's hash.
3. Suffix sort. Within an anchor's group the contexts, and then the windows of the distinct ones, are sorted as suffixes by a
   mergesort. Two suffixes are compared by their common extension, which prefix polynomial hashes and a binary search give in a
   logarithmic number of steps. A suffix that is equal over its length to one of an earlier run is a repeat, and leaves the sort.
   All groups of a batch are merged side by side. Every equality is verified on the bytes; where a hash deceived, that group is done
   again on the bytes themselves.
4. Spans. Repeated windows become spans of each text, and the rest of the text is kept.

Each anchor's number of places is joined to them; the few anchors with more places than a task should hold, at most one for each task,
are broadcast instead. Of an anchor with over `block` contexts (a line that a third of all documents share, say) equal contexts come
first: each task that reads texts sends only the oldest of each, these meet by their hash, and one passes over them in the order of age, so
that a context of any number of copies leaves one. If more than `block` different ones are left, their windows are dealt one by one, by
the hash of their bytes, in the same way. So the work is linear in such an anchor: no two contexts are compared that have no window in
common, but in a group of at most `block`.

Null texts are empty; texts under `length` bytes lose nothing but may not be longer than 2 GB. A null doc_id comes before all others.
Rows of one id are told apart by the hash of their texts, in whose order they stand; rows equal in both are one document. Empty tables
give empty tables. Only the two columns named are read, so others may have any names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import BASE, BASE_INV, byte_codes, discard, mix64, parallelism, powers, release, staged, utf8

_CODES = byte_codes(11)
_tables: dict[str, np.ndarray] = {}
_NULL = -(2**63)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n + n // 4, 1 << 16)
        _tables.update(up=powers(BASE, size), down=powers(BASE_INV, size))
    return _tables["up"], _tables["down"]


class PrefixHashes:
    """Prefix polynomial hashes of bytes: at(i, n) is the hash of the n bytes from i, wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * up[: len(data)], out=self.sums[1:])

    def at(self, i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[i + n] - self.sums[i]) * self.down[i]

    def all(self, n: int) -> np.ndarray:
        """Of every string of n bytes."""
        return (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.data) - n + 1]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from x and from y are equal, most at the most: a binary search on hashes."""
        n = np.zeros(len(x), np.int64)
        step = 1 << max(int(most.max(initial=1)).bit_length() - 1, 0)
        while step:
            m = n + step
            ok = m <= most
            m = np.where(ok, m, 0)
            n = np.where(ok & (self.at(x, m) == self.at(y, m)), m, n)
            step >>= 1
        return n


def sliding(x: np.ndarray, w: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of every w neighbours."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = least(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, start: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its hash, first window, last window, text) for all windows of the texts that stand one behind the other in data,
    from start on. What an anchor is depends on the bytes of its windows alone."""
    w = length - seed + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    h = mix64(PrefixHashes(data).all(seed))
    least = sliding(h, w, np.minimum)  # of the strings of each window
    n = len(least)
    edge = np.zeros(w - 1, np.uint64)
    marks = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), w, np.maximum) == h)
    at = np.repeat(marks, np.diff(marks, prepend=-1))[:n]  # the next mark
    wrong = np.flatnonzero(h[at] != least)
    while len(wrong):  # marks of other windows stand between
        at[wrong] = marks[np.searchsorted(marks, at[wrong] + 1)]
        wrong = wrong[h[at[wrong]] != least[wrong]]
    text = np.repeat(np.arange(len(start)), np.diff(start, append=len(data)))
    whole = text[:n] == text[length - 1 :]  # windows that lie in one text
    edge = np.flatnonzero(np.diff(np.where(whole, at, -1), prepend=-2))
    first = edge[whole[edge]]
    last = np.append(edge[1:], n)[whole[edge]] - 1
    q = at[first]
    return q, h[q].view(np.int64), first, last, text[first]


def arenas(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, where each text starts) of runs of texts of about `most` bytes."""
    at, held = 0, 0
    for i, t in enumerate([*texts, None]):
        if i > at and (t is None or held + len(t) > most):
            size = np.fromiter((len(x) for x in texts[at:i]), np.int64, i - at)
            yield at, i, np.frombuffer(b"".join(texts[at:i]), np.uint8), np.cumsum(size) - size
            at, held = i, 0
        held += len(t or b"")


def merge_sort(hashes: PrefixHashes, item: np.ndarray, size: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """For suffixes `item` of `size` bytes, in the order of buckets and, within, of age: an older suffix of the same bucket that is
    equal over the size, or -1. Adjacent sorted runs are merged until each bucket is one; repeats leave as they are found."""
    full = hashes.at(item, size)
    same = np.full(len(item), -1, np.int64)
    live = np.arange(len(item))  # indices of suffixes, by bucket and run, sorted within runs
    run = np.arange(len(item)) - np.searchsorted(bucket, bucket)  # number of the run within its bucket
    while len(live):
        b = bucket[live]
        alone = np.ones(len(live), bool)  # buckets of one run are done
        new = np.flatnonzero((np.diff(b, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0))
        of_run = np.searchsorted(new, np.arange(len(live)), "right") - 1
        ends = np.append(new[1:], len(live))
        b_run = b[new]
        many = np.zeros(len(new), bool)
        many[1:] |= b_run[1:] == b_run[:-1]
        many[:-1] |= b_run[1:] == b_run[:-1]
        alone = ~many[of_run]
        if alone.all():
            break
        if alone.any():
            live, run = live[~alone], run[~alone]
            continue
        odd = np.flatnonzero(run & 1)
        prev = of_run[odd] - 1  # the run before, of the same bucket: numbers are consecutive
        low, high = new[prev].copy(), ends[prev].copy()
        x = live[odd]
        todo = np.arange(len(odd))
        hit = np.full(len(odd), -1, np.int64)
        while len(todo):  # the place of each suffix in the run before
            mid = (low[todo] + high[todo]) >> 1
            y, z = live[mid], x[todo]
            equal = (full[y] == full[z]) & (size[y] == size[z])
            hit[todo[equal]] = y[equal]
            rest = ~equal
            todo, mid, y, z = todo[rest], mid[rest], y[rest], z[rest]
            most = np.minimum(size[y], size[z])
            n = hashes.common(item[y], item[z], most)
            past = n >= most
            at_y, at_z = item[y] + np.where(past, 0, n), item[z] + np.where(past, 0, n)
            less = np.where(past, size[y] < size[z], hashes.data[at_y] < hashes.data[at_z])  # y before z
            low[todo[less]] = mid[less] + 1
            high[todo[~less]] = mid[~less]
            todo = todo[low[todo] < high[todo]]
        same[x] = hit
        stay = np.ones(len(live), bool)
        stay[odd[hit >= 0]] = False
        place = np.arange(len(live)) * 2 + 1
        place[odd] = low * 2
        # runs are merged in place: those of an even run keep their order, those of the odd one go before the place found
        keep = np.flatnonzero(stay)
        order = keep[np.argsort(place[keep], kind="stable")]
        live, run = live[order], run[order] >> 1
    return same


def copies(hashes: PrefixHashes, raw: bytes, a: np.ndarray, z: np.ndarray, anchor: np.ndarray, doc: np.ndarray, part: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the contexts a:z have an equal one in an older place (doc, part, place) among them."""
    key = mix64(hashes.at(a, z - a) + mix64((z - a).astype(np.uint64) << np.uint64(20) ^ anchor.astype(np.uint64)))
    order = np.lexsort((place, part, doc, key))
    run = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
    lead = order[np.searchsorted(run, run)]
    other = np.flatnonzero((doc[lead] != doc[order]) | (part[lead] != part[order]) | (place[lead] != place[order]))
    i, j = order[other], lead[other]
    out = np.zeros(len(a), bool)
    out[i] = np.fromiter((raw[p:q] == raw[r:s] for p, q, r, s in zip(a[i].tolist(), z[i].tolist(), a[j].tolist(), z[j].tolist(), strict=True)), bool, len(i)) & (anchor[i] == anchor[j])
    return out


def repeats(data: np.ndarray, size: np.ndarray, anchor: np.ndarray, group: np.ndarray, age: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last): the windows of contexts that occur in an older context of the group, or earlier in the same one.

    Contexts of the given sizes stand one behind the other in data, in the order of group and age; anchor is the anchor's place in
    each. Contexts of equal age are the same place of the same document."""
    start = np.cumsum(size) - size
    hashes, raw = PrefixHashes(data), data.tobytes()
    rows: list[np.ndarray] = []
    # whole contexts: equal ones repeat all their windows
    same = merge_sort(hashes, start, size, group)
    twin = np.flatnonzero(same >= 0)
    other = same[twin]
    true = np.fromiter((raw[i : i + n] == raw[j : j + n] for i, j, n in zip(start[twin].tolist(), start[other].tolist(), size[twin].tolist(), strict=True)), bool, len(twin))
    true &= anchor[twin] == anchor[other]
    same[twin[~true]] = -1
    twin = twin[true]
    again = age[twin] == age[same[twin]]  # the same place of the same document, in a repeated row
    double, twin = twin[again], twin[~again]
    rows.append(np.stack([twin, np.zeros(len(twin), np.int64), size[twin] - length]))
    # windows of the distinct contexts of groups that have several, or whose only one is longer than a window
    left = np.flatnonzero(same < 0)
    g = group[left]
    several = np.zeros(len(left), bool)
    several[1:] |= g[1:] == g[:-1]
    several[:-1] |= g[1:] == g[:-1]
    left = left[several]
    many = size[left] - length + 1
    row = np.repeat(left, many)
    t = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    bucket = group[row] * (length + 1) + anchor[row] - t  # only windows at the same distance from the anchor can be equal
    order = np.argsort(bucket, kind="stable")
    row, t, bucket = row[order], t[order], bucket[order]
    item = start[row] + t
    match = merge_sort(hashes, item, np.full(len(item), length, np.int64), bucket)
    found = np.flatnonzero(match >= 0)
    found = found[np.lexsort((t[found], row[found]))]
    r, k, shift = row[found], t[found], item[match[found]] - item[found]
    # neighbouring windows that repeat neighbouring ones are verified as one stretch
    differs = (np.diff(r) != 0) | (np.diff(k) != 1) | (np.diff(shift) != 0)
    new, stop = np.flatnonzero(np.append(True, differs)[: len(r)]), np.flatnonzero(np.append(differs, True)[: len(r)])
    begin, moved, n = item[found][new], shift[new], k[stop] - k[new] + length
    good = np.fromiter((raw[i : i + m] == raw[i + d : i + d + m] for i, d, m in zip(begin.tolist(), moved.tolist(), n.tolist(), strict=True)), bool, len(new))
    ends = np.append((np.diff(r) != 0) | (np.diff(k) != 1), True)[: len(r)]  # what is told goes on over such stretches
    begins = np.append(True, ends[:-1])[: len(r)]
    rows.append(np.stack([r[begins], k[begins], k[ends]]))
    out = np.concatenate(rows, axis=1)
    if not good.all():  # a hash deceived: these groups again, on the bytes
        bad = np.unique(group[r[new[~good]]])
        out = out[:, ~np.isin(group[out[0]], bad)]
        more = []
        for b in bad.tolist():
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(group == b).tolist():
                for j in range(size[i] - length + 1):
                    x = raw[start[i] + j : start[i] + j + length]
                    if seen.setdefault(x, i * (1 << 32) + j) != i * (1 << 32) + j and not (age[seen[x] >> 32] == age[i] and seen[x] >> 32 != i):
                        more.append((i, j, j))
        out = np.concatenate([out, np.array(more, np.int64).reshape(-1, 3).T], axis=1)
    for i in double.tolist():  # repeated rows lose what the first of them loses
        mine = out[:, out[0] == same[i]].copy()
        mine[0] = i
        out = np.concatenate([out, mine], axis=1)
    return out[0], out[1], out[2]


def pieces(groups: np.ndarray, context: pa.ChunkedArray, most: int) -> list[tuple[int, int]]:
    """Runs of whole groups of about `most` bytes, up to where the last group begins."""
    size = np.append(0, np.cumsum(pc.binary_length(context).to_numpy()))[groups]
    out, at = [], 0
    while at < len(groups) - 1:
        to = max(int(np.searchsorted(size, size[at] + most, "right")) - 1, at + 1)
        out.append((int(groups[at]), int(groups[to])))
        at = to
    return out


class Oldest:
    """The least place (doc, part, first) of each context, while they take no more than `most` bytes."""

    COLUMNS = "h long, doc long, part long, first int, anchor int, context binary, size int"
    NAMES = [c.split()[0] for c in COLUMNS.split(", ")]

    def __init__(self, most: int = 32 << 20):
        self.most, self.load, self.held, self.spans = most, 0, {}, []

    def add(self, h: int, anchor: int, context: bytes, size: int, place: tuple[int, int, int]) -> None:
        key, n = (h, anchor, context, size), len(self.held)
        old = self.held.setdefault(key, place)
        if place < old:
            self.held[key] = place
        if len(self.held) > n:
            self.load += len(context) + 300
        elif old != place:  # the younger one is a repeat
            self.spans.append((*max(old, place), len(context)))

    def full(self) -> bool:
        return self.load > self.most or len(self.spans) > 100_000

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The oldest ones, and a row without a context for each repeat."""
        rows = [(h, *place, anchor, context, size) for (h, anchor, context, size), place in self.held.items()]
        rows += [(hash(x) & 0x7FFFFFFFFFFFFFFF, *x[:3], x[2] + x[3], None, 1) for x in self.spans]
        self.load, self.held, self.spans = 0, {}, []
        for at in range(0, len(rows), 10_000):
            cols = zip(*rows[at : at + 10_000], strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=Oldest.NAMES)


def with_size(rows: DataFrame) -> DataFrame:
    """Adds how many rows have the same h, to those that share it with others.

    Of n rows in p parts at the most p keys have over n / p rows: these few are sent to their rows, which would else meet in one task."""
    sizes = staged(rows.groupBy("h").agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("size")).where("size > 1"), "sizes")
    often = F.broadcast(sizes.where(F.col("size") > rows.count() // parallelism(rows.sparkSession)))
    return rows.join(often, "h", "left_anti").join(sizes, "h").unionByName(rows.join(often, "h"))


def remove_repeats(docs: DataFrame, length: int = 100, seed: int = 32, block: int = 32_768, windows: int = 8_000_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) of each row."""
    spark = docs.sparkSession
    one_row_each = not docs.groupBy(key).count().where("count > 1").head(1)
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("doc"), (F.when(F.col(key).isNull(), -1).otherwise(0).cast("long") if one_row_each else F.coalesce(F.xxhash64(text), F.lit(0))).alias("part"), F.col(text).alias("text"), F.col(key).isNull().alias("nameless"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j, data, start in arenas(utf8(b.column(2))):
                q, h, _, _, text = anchors(data, start, length, seed)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc[i:j][text]), pa.array(part[i:j][text]), pa.array((q - start[text]).astype(np.int32))], names=["h", "doc", "part", "pos"])

    found = staged(docs.select("doc", "part", "text").mapInArrow(find, "h long, doc long, part long, pos int"), "anchors")
    places = staged(with_size(found).groupBy("doc", "part").agg(F.collect_list(F.struct("pos", "size")).alias("at")), "places")
    discard(found)

    # a row without a context is a span that is known to repeat already; its anchor column holds where it ends
    names = Oldest.NAMES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oldest = Oldest()
        for b in batches:
            doc, part, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for i, j, data, start in arenas(utf8(b.column(2))):
                q, h, first, last, text = anchors(data, start, length, seed)
                some = lists.slice(i, j - i)
                flat, of = some.flatten(), some.value_parent_indices().to_numpy()
                pos = flat.field("pos").to_numpy(zero_copy_only=False) + start[of]
                order = np.argsort(pos)
                pos, size = pos[order], flat.field("size").to_numpy(zero_copy_only=False)[order]
                at = np.minimum(np.searchsorted(pos, q), max(len(pos) - 1, 0))
                use = np.flatnonzero(pos[at] == q) if len(pos) else np.zeros(0, np.int64)
                if not len(use):
                    continue
                a, z, text, raw = first[use], last[use] + length, text[use], data.tobytes()
                d, p = doc[i:j][text], part[i:j][text]
                twin = copies(PrefixHashes(data), raw, a, z, q[use] - a, d, p, a - start[text])
                # copies within the batch are repeats already; neighbouring ones are told as one
                t = np.flatnonzero(twin)
                new = np.flatnonzero(np.append(True, (text[t][1:] != text[t][:-1]) | (a[t][1:] != z[t][:-1] - length + 1))[: len(t)])
                if len(t):
                    s, e = t[new], t[np.append(new[1:], len(t)) - 1]
                    spread = mix64(h[use][s].view(np.uint64) + s.astype(np.uint64)).view(np.int64)
                    none = pa.nulls(len(s), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(d[s]), pa.array(p[s]), pa.array((a[s] - start[text[s]]).astype(np.int32)), pa.array((z[e] - start[text[s]]).astype(np.int32)), none, pa.array(np.ones(len(s), np.int32))], names=names)
                hot = size[at[use]] > block
                for k in np.flatnonzero(~twin & hot).tolist():
                    oldest.add(int(h[use[k]]), int(q[use[k]] - a[k]), raw[a[k] : z[k]], int(size[at[use[k]]]), (int(d[k]), int(p[k]), int(a[k] - start[text[k]])))
                if oldest.full():
                    yield from oldest.flush()
                keep = np.flatnonzero(~twin & ~hot)
                ends = np.cumsum((z - a)[keep])
                body = b"".join([raw[x:y] for x, y in zip(a[keep].tolist(), z[keep].tolist(), strict=True)])
                contexts = pa.BinaryArray.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([pa.array(h[use][keep]), pa.array(d[keep]), pa.array(p[keep]), pa.array((a - start[text])[keep].astype(np.int32)), pa.array((q[use] - a)[keep].astype(np.int32)), contexts, pa.array(size[at[use]][keep])], names=names)

        yield from oldest.flush()

    contexts = docs.join(places, ["doc", "part"]).select("doc", "part", "text", "at").mapInArrow(cut, Oldest.COLUMNS)

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oldest = Oldest()
        for b in batches:
            for doc, part, first, context in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for k in range(len(context) - length + 1):
                    oldest.add(0, 0, context[k : k + length], block + 1, (doc, part, first + k))
                if oldest.full():
                    yield from oldest.flush()
        yield from oldest.flush()

    # what `sort` gives: spans that repeat, and with a context the oldest of equal contexts of anchors that have over `block`
    told = ["h", "doc", "part", "begin", "end", "anchor", "context"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        load = 0
        of, seen = None, {}

        def spans(doc: pa.Array, part: pa.Array, begin: pa.Array, end: pa.Array) -> pa.RecordBatch:
            n = len(doc)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), doc, part, begin, end, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=told)

        def collapse(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Rows in the order of hash and age: the first of equal contexts stays, the others are spans."""
            nonlocal of, seen
            stay, gone = [], []
            for i, (h, ck, doc, part, first, anchor, context) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6, 7)), strict=True)):
                if of != (h, ck):
                    of, seen = (h, ck), {}
                old = seen.setdefault((anchor, context), (i, doc, part, first))
                if old == (i, doc, part, first):
                    stay.append(i)
                elif old[1:] != (doc, part, first):
                    gone.append((doc, part, first, first + len(context)))
            seen = {k: (-1, *x[1:]) for k, x in seen.items()}  # numbers of rows begin again with the next batch
            if gone:
                yield spans(*(pa.array(c, k) for c, k in zip(zip(*gone, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)))
            rest = b.take(pa.array(stay, pa.int64()))
            end = pc.add(rest.column(5), pc.binary_length(rest.column(7)))
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(3), rest.column(4), rest.column(5), end, rest.column(6), rest.column(7)], names=told)

        def solve(rows: pa.Table) -> pa.RecordBatch:
            h, doc, part, first, anchor = (rows.column(k).to_numpy() for k in (0, 3, 4, 5, 6))
            text = rows.column(7).combine_chunks()
            text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
            ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset).astype(np.int64)
            data = np.frombuffer(text.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0])
            moved = lambda *cs: np.any([np.diff(c, prepend=c[:1]) != 0 for c in cs], axis=0)
            other = moved(h)
            group, age = np.cumsum(other), np.cumsum(other | moved(doc, part, first))
            i, a, z = repeats(data, np.diff(ends), anchor.astype(np.int64), group, age, length)
            return spans(pa.array(doc[i]), pa.array(part[i]), pa.array((first[i] + a).astype(np.int32)), pa.array((first[i] + z + length).astype(np.int32)))

        for b in batches:
            known = pc.is_null(b.column(7))
            if known.true_count:
                old = b.filter(known)
                yield spans(*(old.column(k) for k in (3, 4, 5, 6)))
                b = b.filter(pc.invert(known))
            hot = b.column(8)
            if hot.true_count:
                yield from collapse(b.filter(hot))
                b = b.filter(pc.invert(hot))
            held.append(b)
            load += b.column(7).nbytes
            if load < windows:
                continue
            rows = pa.Table.from_batches(held)
            cut_at = np.flatnonzero(np.diff(rows.column(0).to_numpy()) != 0) + 1
            if len(cut_at):  # whole groups; the last may go on
                for s, e in pieces(np.append(0, cut_at), rows.column(7), windows):
                    yield solve(rows.slice(s, e - s))
                held = rows.slice(int(cut_at[-1])).to_batches()
                load = sum(x.column(7).nbytes for x in held)
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield solve(rows)

    def sorted_out(rows: DataFrame, name: str) -> DataFrame:
        hot = F.col("context").isNotNull() & (F.col("size") > block)
        dealt = rows.withColumn("hot", hot).withColumn("ck", F.when(hot, F.xxhash64("anchor", "context")).otherwise(0))
        dealt = dealt.withColumn("b", F.pmod("ck", F.ceil(F.col("size") / F.lit(block)).cast("long"))).select("h", "b", "ck", "doc", "part", "first", "anchor", "context", "hot")
        ordered = dealt.repartition("h", "b").sortWithinPartitions("h", "b", "ck", "doc", "part", "first")
        return staged(ordered.mapInArrow(sort, "h long, doc long, part long, begin int, end int, anchor int, context binary"), name)

    most = sorted_out(contexts, "sorted")
    discard(places)
    # different contexts of hot anchors: few of an anchor are sorted now, of many each window meets its equals
    left = with_size(most.where("context is not null").select("h", "doc", "part", F.col("begin").alias("first"), "anchor", "context"))
    single = left.where(F.col("size") > block).select("doc", "part", "first", "context").mapInArrow(windows_of, Oldest.COLUMNS)
    single = single.withColumn("h", F.when(F.col("context").isNull(), F.col("h")).otherwise(F.xxhash64("context")))
    more = sorted_out(left.where(F.col("size") <= block).select(*Oldest.NAMES).unionByName(single), "windows")
    repeated = most.where("context is null").unionByName(more.where("context is null"))
    spans = staged(repeated.groupBy("doc", "part").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    discard(most)
    discard(more)
    release(spark)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                out: list[tuple] = []
                for x, s in zip(utf8(rows.column(2)), rows.column(3), strict=True):
                    if not s.is_valid:
                        out.append((len(x), 0, 0, x))
                        continue
                    begin, end = (s.values.field(k).to_numpy() for k in (0, 1))
                    order = np.argsort(begin, kind="stable")
                    begin, end = begin[order], np.maximum.accumulate(end[order])
                    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
                    a, z = begin[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist()
                    rest = b"".join(x[i:j] for i, j in zip([0, *z], [*a, len(x)], strict=True))
                    out.append((len(x), len(x) - len(rest), len(a), rest))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.binary()], strict=True))], names=["doc", "nameless", "n_bytes", "n_removed", "n_spans", "kept"])

    out = docs.join(spans, ["doc", "part"], "left").select("doc", "nameless", "text", "spans").mapInArrow(keep, "doc long, nameless boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(~F.col("nameless"), F.col("doc")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")

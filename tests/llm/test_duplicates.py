"""Near-duplicates, repeats, vectors, top-k and components, against brute force."""

import random
import re

import numpy as np
import pytest

from boxloom.llm import neardup, repeats
from boxloom.llm.common import Words
from boxloom.llm.components import components
from boxloom.llm.neardup_vectors import Forest, linked, near_duplicate_vectors, unit
from boxloom.llm.topk import bins, exact_scores, top_k
from tests.llm.helpers import documents, odd_rows, prose, with_clashes


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def test_words_and_shingles():
    w = Words([b"A b\tc", b"", b"a  B c d"])
    assert w.first.tolist() == [0, 3, 3, 7] and (w.hashes[:3] == w.hashes[3:6]).all()
    h, at = w.shingles(4)
    assert at.tolist() == [0, 1, 1, 2]  # the first text is a sequence of three
    h, at = w.shingles(2)
    assert at.tolist() == [0, 2, 2, 5] and h[0] == h[2] and h[1] == h[3]


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2050)] + [(7, 7), (None, 3)]
    s = Sets()
    for a, b in links:
        if a is not None and a != b:
            s.join(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: s.find(x) for x in s.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def varied(n=60):
    rows, r = [], random.Random(8)
    for g in range(n // 6):
        base = prose(100 + g, r.choice([3, 4, 30, 120])).split()
        for k in range(6):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                words[r.randrange(len(words))] = f"w{r.randrange(99)}"
            rows.append((g * 100 + k, " ".join(words), "en", "a", 1))
    return rows


@pytest.mark.parametrize(("words", "block", "heavy"), [(4, 4096, 2_000_000), (5, 3, 2_000_000), (4, 4096, 150)])
def test_near_duplicates(spark, words, block, heavy):
    rows = [r for r in odd_rows() if r[0] is not None] + varied()
    sets = [(r[0], shingles(r[1], words)) for r in rows]
    s = Sets()
    for i, (a, x) in enumerate(sets):
        s.find(a)
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                s.join(a, b)
    got = neardup.near_duplicates(with_clashes(documents(spark, rows)), words=words, block=block, heavy=heavy).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == s.find(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((a, len(x)) for a, x in sets)


def test_near_duplicates_without_ids_or_rows(spark):
    got = neardup.near_duplicates(documents(spark)).where("doc_id is null").collect()
    assert [(r.component_id, r.kept) for r in got] == [(None, True)] * 2
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def brute_repeats(rows, length):
    seen, out = set(), {}
    for doc, text in rows:
        x = (text or "").encode()
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if x[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(x[p : p + length])
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.setdefault(doc, []).append((len(x), sum(gone), spans, bytes(c for c, g in zip(x, gone, strict=True) if not g)))
    return out


def repeat_rows():
    r = random.Random(4)
    shared = [prose(50 + i, 30) for i in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(200 + i, 25), r.choice(shared), prose(300 + i, 5), r.choice(shared)[r.randrange(40) :], "ab" * r.choice([0, 0, 80]), "z" * r.choice([0, 0, 250])]
        r.shuffle(parts)
        rows.append((i * 3 % 41, " ".join(parts), "en", "a", 1))
    return rows + [(100, None, "en", "a", 1), (101, "", "en", "a", 1), (102, "short", "en", "a", 1), (103, rows[0][1], "en", "a", 1), (104, "é漢😀" * 60, "en", "a", 1), (105, "q" * 3000, "en", "a", 1)]


@pytest.mark.parametrize(("block", "windows"), [(32_768, 8_000_000), (5, 500)])
def test_repeats(spark, block, windows):
    rows = repeat_rows()
    want = brute_repeats(sorted((r[0], r[1]) for r in rows), 100)
    got = repeats.remove_repeats(with_clashes(documents(spark, rows)), block=block, windows=windows).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))] == want[r.doc_id], r.doc_id


def test_an_anchor_of_many_copies_and_many_neighbours(spark):
    """A line that a third of the rows share, among different texts, and rows that are copies: more places than a block holds."""
    line, r = prose(77, 18), random.Random(6)
    rows = [(i, f"{prose(1000 + i, 20)} {line} {prose(2000 + i, 20)}" if i % 3 == 0 else prose(3000, 40) if i % 3 == 1 else f"{line} {prose(4000 + i % 5, 9)}", "en", "a", 1) for i in range(90)]
    r.shuffle(rows)
    want = brute_repeats(sorted((x[0], x[1]) for x in rows), 100)
    for block in (7, 40):
        got = repeats.remove_repeats(documents(spark, rows).repartition(5), block=block).collect()
        assert {x.doc_id: [(x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept))] for x in got} == want


def test_the_oldest_of_each_context_stays():
    o = repeats.Oldest()
    for place in [(3, 0, 5), (1, 0, 9), (2, 0, 0), (1, 0, 9)]:
        o.add(7, 2, b"abc", 50, place)
    o.add(7, 1, b"abc", 50, (0, 0, 0))  # another distance from the anchor
    rows = [tuple(x.values()) for b in o.flush() for x in b.to_pylist()]
    assert [x for x in rows if x[5]] == [(7, 1, 0, 9, 2, b"abc", 50), (7, 0, 0, 0, 1, b"abc", 50)]
    assert sorted(x[1:5] for x in rows if not x[5]) == [(2, 0, 0, 3), (3, 0, 5, 8)] and not list(o.flush())


def test_repeats_of_rows_that_tie(spark):
    text = prose(9, 60)
    rows = [(1, text, "", "", 0), (1, text, "", "", 0), (None, text, "", "", 0), (2, text, "", "", 0)]
    got = {(r.doc_id, r.n_removed == r.n_bytes) for r in repeats.remove_repeats(documents(spark, rows)).collect()}
    assert got == {(None, False), (1, True), (2, True)}
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_deceived_hashes_are_found_out(monkeypatch):
    """With a hash that calls all strings equal, results come from the bytes."""
    a, b = b"a" * 150, b"ab" * 75
    data = np.frombuffer(a + b + a, np.uint8)
    size, anchor, group, age = np.array([150] * 3), np.array([60] * 3), np.array([1] * 3), np.array([1, 2, 3])
    monkeypatch.setattr(repeats, "_CODES", np.zeros(256, np.uint64))
    row, first, last = repeats.repeats(data, size, anchor, group, age, 100)
    gone = {(int(r), k) for r, i, j in zip(row, first, last, strict=True) for k in range(i, j + 1)}
    assert gone == {(0, k) for k in range(1, 51)} | {(1, k) for k in range(2, 51)} | {(2, k) for k in range(51)}


def test_suffix_sort_is_a_sort():
    r = random.Random(2)
    data = np.array([r.choice(b"ab") for _ in range(600)], np.uint8)
    h = repeats.PrefixHashes(data)
    x, y = np.arange(0, 280), np.arange(280, 560)
    n = h.common(x, y, np.full(280, 40))
    raw = data.tobytes()
    for i, j, k in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
        assert raw[i : i + k] == raw[j : j + k] and (k == 40 or raw[i + k] != raw[j + k])
    same = repeats.merge_sort(h, np.arange(560), np.full(560, 8), np.zeros(560, np.int64))
    seen = {}
    for i in range(560):
        first = seen.setdefault(raw[i : i + 8], i)
        assert (same[i] == -1) == (first == i) and (same[i] == -1 or raw[same[i] : same[i] + 8] == raw[i : i + 8])


def vectors():
    rng = np.random.default_rng(1)
    rows, base = [], rng.standard_normal((30, 16))
    for i in range(300):
        v = base[i % 30] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.1, 0.3])
        rows.append((i * 10, (v * rng.choice([1, 1, 3])).astype("f4").tolist(), i % 3))
    odd = [(5, None, 0), (6, [0.0] * 16, 0), (7, [float("nan")] * 16, 0), (8, [float("inf")] + [1.0] * 15, 0), (9, [1.0, None] + [0.0] * 14, 0), (11, [], 0), (12, [1.0, 2.0], 0), (13, rows[0][1], 0), (None, rows[0][1], 0)]
    return rows + odd


VECTORS = "vec_id long, embedding array<float>, label int"


def good(rows):
    return [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all()]


@pytest.mark.parametrize(("leaf", "block"), [(400, 2048), (30, 20)])
def test_vectors(spark, leaf, block):
    rows = vectors()
    u = [(i, v / np.linalg.norm(v)) for i, v in good(rows) if v.any()]
    m = np.array([x for _, x in u])
    hit = m @ m.T >= 0.95
    np.fill_diagonal(hit, False)
    s, n = Sets(), {}
    for k, (i, _) in enumerate(u):
        n[i] = int(hit[k].sum())
        for j in np.flatnonzero(hit[k]):
            s.join(i, u[j][0])
    got = near_duplicate_vectors(spark.createDataFrame(rows, VECTORS), leaf=leaf, block=block).collect()
    assert len(got) == len(rows)
    links = sum(r.n_links for r in got)
    assert links <= hit.sum() and links >= 0.99 * hit.sum()
    if leaf == 400:
        for r in got:
            assert r.n_links == n.get(r.vec_id, 0) and r.component_id == (None if r.vec_id is None else s.find(r.vec_id)) and r.kept == (r.vec_id == r.component_id)
    assert near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_forest_finds_near_pairs_below_the_fitted_levels():
    r = np.random.default_rng(3)
    middle = unit(r.standard_normal((2000, 64)))
    x = unit(np.concatenate([middle, middle + 0.035 * r.standard_normal((2000, 64))]))
    f = Forest(x[r.choice(len(x), 512, replace=False)], trees=4, depth=10, spill=0.25 * (0.1 / 64) ** 0.5, seed=1)
    assert f.fitted == 5
    row, leaf = f.leaves(x)
    of = [set() for _ in x]
    for i, k in zip(row.tolist(), leaf.tolist(), strict=True):
        of[i].add(k)
    near = (x[:2000] * x[2000:]).sum(axis=1) >= 0.9
    assert near.sum() > 1000 and np.mean([bool(of[i] & of[i + 2000]) for i in np.flatnonzero(near)]) >= 0.9
    assert np.unique(leaf, return_counts=True)[1].max() < 200
    # what a row's leaves are does not depend on the rows beside it
    for i in (0, 7, 3999):
        assert set(f.leaves(x[i : i + 1])[1].tolist()) == of[i]


def test_links_at_the_threshold():
    x = unit(np.random.default_rng(1).standard_normal((50, 8)))
    least = float((x[3] * x[9]).sum())
    hit = linked(x, least)
    assert hit[3, 9] and hit[9, 3] and (hit == hit.T).all() and not hit.diagonal().any()


@pytest.mark.parametrize(("rings", "block"), [(8, 2048), (3, 7)])
def test_top_k(spark, rings, block):
    from pyspark.sql import functions as F

    rows = vectors()
    x = [(i, np.floor(1024 * v)) for i, v in good(rows)]
    want = set()
    for q, v in x:
        if q % 100 == 0:
            best = sorted(((-int(v @ y), i) for i, y in x if i != q))[:10]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = top_k(spark.createDataFrame(rows, VECTORS), F.col("id") % 100 == 0, rings=rings, pivots=10, block=block)
    assert {tuple(r) for r in got.collect()} == want
    few = top_k(spark.createDataFrame(rows[:4], VECTORS), F.col("id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2), (0, 3)]
    assert top_k(spark.createDataFrame([], VECTORS), F.col("id") % 100 == 0).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_top_k_of_repeated_rows(spark, block):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=4).tolist()) for i in range(150)]
    rows = rows * 2 + [rows[7]] * 150 + [(8, r.normal(size=4).tolist()) for _ in range(100)]
    x = [(i, np.floor(1024 * np.float32(v).astype(float))) for i, v in rows]
    want = set()
    for q, v in {i: min((y for j, y in x if j == i), key=lambda y: y.astype("<f8").tobytes()) for i in (0, 100)}.items():
        score = {}
        for i, y in x:
            if i != q:
                score[i] = max(score.get(i, -(2**62)), int(v @ y))
        want |= {(q, k + 1, i, s) for k, (i, s) in enumerate(sorted(score.items(), key=lambda e: (-e[1], e[0]))[:10])}
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 100 == 0, pivots=3, rings=2, block=block)
    assert {tuple(g) for g in got.collect()} == want


def test_bins_hold_neighbouring_annuli():
    many = np.array([3, 4, 2, 25, 1, 9, 10, 1])
    first, count = bins(many, 10)
    assert count.tolist() == [1, 1, 1, 3, 1, 1, 1, 1] and first.tolist() == [0, 0, 0, 1, 4, 4, 5, 6]
    load = {}
    for f, c, n in zip(first.tolist(), count.tolist(), many.tolist(), strict=True):
        for b in range(f, f + c):
            load[b] = load.get(b, 0) + n / c
    assert max(load.values()) <= 10 and sorted(load) == list(range(7))
    assert bins(np.zeros(0), 10)[0].tolist() == []


def test_large_scores_are_exact():
    q, v = np.array([[2.0**40, 1.0]]), np.array([[2.0**22, 1.0], [2.0**30, 0.0]])
    assert exact_scores(q, v).tolist() == [[2**62 + 1, 2**63 - 1]]

"""Collocations against counts of every phrase, and shards against texts cut in many ways."""

import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction
from math import floor

import pyarrow as pa
import pytest

from boxloom.llm import collocations as co
from tests.llm.helpers import odd_rows, prose, with_clashes

MARKS = "[.,;:!?\n\x0b\x0c\r]"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split(MARKS, lowered(text or ""))]


def brute(rows, least, most):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        for w in pieces(text):
            sizes[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    c = counts.setdefault(lang or "und", Counter())
                    c[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        mine = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((floor(Fraction(1000 * a * sizes[lang], c[p[:k]] * c[p[k:]])), k) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], sizes[lang], -x[0]) for i, x in enumerate(sorted(mine)[:most])]
    return sorted(out)


def corpus(seed=1, n=150):
    r = random.Random(seed)
    words = "new york city Hall the of and a hot dog stand é 漢".split()
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ". ", "\n", ""]) for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "en", "de", None]), text()) for _ in range(n)]
    return rows + [("en", "The United States of America. "), ("en", None), ("en", ""), (None, "  \n , "), ("fr", "seul"), ("en", " ".join(["new york city hall"] * 300)), ("en", "x" * 5000 + " y"), *[("en", "said the united states of america")] * 12]


@pytest.mark.parametrize(("least", "most", "how"), [(5, 2000, {}), (5, 3, {"most": 64}), (2, 2000, {"bits": 4}), (12, 50, {"bits": 12, "most": 500})])
def test_collocations(spark, least, most, how):
    rows = corpus()
    df = with_clashes(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    counts = {"size": how["most"]} if "most" in how else {}
    got = co.collocations(df, least, most, **{k: v for k, v in how.items() if k != "most"}, **({"shard": counts["size"]} if counts else {}))
    assert sorted(map(tuple, got.collect())) == brute(rows, least, most)


def test_odd_documents(spark):
    rows = [(r[2], r[1]) for r in odd_rows()] * 2
    got = co.collocations(spark.createDataFrame(rows, "lang string, text string"), 4, 100)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 100)


def test_no_rows(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(df).count() == 0 and co.collocations(spark.createDataFrame([("en", None), ("en", " .")], "lang string, text string")).count() == 0


def test_shards_cut_anywhere():
    r = random.Random(2)
    for _ in range(150):
        texts = ["".join(r.choices(["a ", "b ", "c ", "aa ", "B ", "é ", ".", ", ", "\n", "\t", "a"], k=r.randint(0, 60))) for _ in range(r.randint(1, 6))]
        data = bytes([co.END]).join(x.encode() for x in texts).translate(bytes(co._MAP))
        got, want = Counter(), Counter()
        for part, own in co.stretches(data, r.choice([7, 20, 50, 10_000])):
            s = co.Shard(part, own)
            for k, p, n in s.phrases():
                got.update(dict(zip(s.spelled(p, k).to_pylist(), n.tolist(), strict=True)))
        for x in texts:
            for w in pieces(x):
                for k in range(1, 6):
                    want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
        assert got == want


def test_suffixes_are_sorted():
    s = co.Shard(prose(3, 400).encode() + b"\xff" + prose(3, 50).encode(), 10**6)
    at, lcp = s.suffixes()
    text = [tuple(s.ids[i : i + min(s.room[i], 5)].tolist()) for i in at]
    assert len({t for t in text}) == len([1 for i in range(len(at)) if i == 0 or text[i] != text[i - 1]])  # equal suffixes stand together
    for i in range(1, len(at)):
        a, b = text[i - 1], text[i]
        assert lcp[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_each_phrase_is_sent_by_one_reading(spark, monkeypatch):
    rows, sent, real = [("en", "new york city hall in new york")] * 6 + [("de", "new york city hall in new york")] * 2 + [("de", "in new")] * 9, [], co.counted
    monkeypatch.setattr(co, "counted", lambda *a: sent.append(real(*a)) or sent[-1])
    counts, sizes = co.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), 5)
    found = [{(r.lang, r.phrase) for r in x.where("phrase is not null").collect()} for x in sent]
    assert [{len(p.split(" ")) for _, p in x} for x in found] == [{1}, {2}, {3}, {4, 5}]
    assert {p for lang, p in found[1] if lang == "de"} == {"in new"} and not [p for lang, p in found[2] | found[3] if lang == "de"]  # frequent in en only
    assert counts.where("words = 5 and lang = 'en' and f = 6").count() == 3 and {(r.lang, r.n) for r in sizes.collect()} == {("en", 42), ("de", 32)}


def test_memory_of_a_shard():
    """Hashes take slices and eight bytes or so a word, suffixes at most 80 bytes a word."""
    r = random.Random(5)
    for data in (" ".join("%x" % r.getrandbits(40) for _ in range(150_000)), " ".join(r.choices("the of and to in is was".split(), k=250_000)), "x" * 2_000_000):
        shard = co.Shard(data.encode(), len(data))
        tracemalloc.start()
        try:
            assert len(shard.hashes()) == len(shard.words)
            assert tracemalloc.get_traced_memory()[1] < 16 * 10**6 + 24 * len(shard.words)
            tracemalloc.reset_peak()
            assert sum(int(n.sum()) for k, _, n in shard.phrases() if k == 1) == len(shard.ids)
            assert tracemalloc.get_traced_memory()[1] < 80 * len(shard.ids) + 10**6
        finally:
            tracemalloc.stop()


def test_texts_of_many_languages_do_not_pile_up():
    read = 0

    def batches():
        nonlocal read
        for i in range(2000):
            read += 100
            yield pa.RecordBatch.from_arrays([pa.array([f"l{i % 300}"]), pa.array(["word " * 20])], names=["lang", "text"])

    got, before = Counter(), 0
    for lang, shard in co.shards(batches(), 5000):
        got[lang] += shard.own
        assert read - 5 * (sum(got.values()) - shard.own) <= 2 * 5000 + 400
    assert got == Counter({f"l{i}": 20 * len(range(i, 2000, 300)) for i in range(300)})


def test_words_that_no_slice_of_hashes_holds(monkeypatch):
    words = ["a", "b" * 40, "c" * 7, "d" * 8, "e" * 9, "é", "b" * 41]
    whole = co.Shard(" ".join(words).encode(), 10**6).hashes().tolist()
    monkeypatch.setattr(co, "_BYTES", 8)
    some = [co.Shard(" ".join(w).encode(), 10**6).hashes().tolist() for w in (words, words[::-1])]
    assert some[0] == some[1][::-1] and len(set(some[0])) == len(words)
    assert [x == y for x, y in zip(whole, some[0], strict=True)] == [len(w.encode()) <= 8 for w in words]

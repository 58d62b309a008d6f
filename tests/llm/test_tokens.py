"""Token files, and BPE by forced boundaries, against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxloom.llm import tokenfile as tf
from boxloom.llm.bpe import ForcedBpe, LibraryBpe, encode_decode
from tests.llm.helpers import documents, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoders():
    return ForcedBpe(PATH), LibraryBpe(PATH)


PIECES = list("ab '\n\t.,!19é漢😀\x1c\x85\x0b<|s") + ["　", "<|endoftext|>", "'re", " the", "​", "̀", "՘", "  ", " \n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_ids_of_any_text(encoders, library, parts):
    text = "".join(parts)
    want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for e in encoders:
        assert e.encode(text) == want
    assert encoders[0].decode(want) == library.decode(np.frombuffer(want, "<u4").tolist(), skip_special_tokens=False)


def test_long_fragments(encoders, library):
    for text in ("a" * 30_000, "ab" * 9_000 + "abc" * 999, "".join(random.Random(1).choices("aeiou", k=20_000))):
        assert encoders[0].encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_cuts_are_forced(encoders):
    e = encoders[0]
    for token in e.vocab:
        assert e.fragments(token) == [token]


def test_tables_stay_small(encoders):
    e = ForcedBpe(PATH)
    e.KEPT = 50
    for i in range(40):
        e.encode(" ".join(f"w{i}x{j}" for j in range(20)))
    assert len(e.words) < 200


def test_encode_decode_rows(spark, library):
    docs = documents(spark)
    rows = encode_decode(with_clashes(docs), PATH).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in docs.collect():
        by.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in by[r.doc_id] and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert encode_decode(docs.limit(0), PATH).count() == 0


def expected(docs, library):
    rows = sorted(docs.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    start = 0
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        yield r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def test_token_files(spark, library):
    docs = documents(spark)
    rows = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tf.token_files(with_clashes(docs), PATH, 2).collect()]
    assert sorted(rows, key=lambda r: r[1]) == list(expected(docs, library))
    assert tf.token_files(docs.limit(0), PATH, 2).collect() == []


def test_small_blocks(spark, library, tmp_path):
    docs = documents(spark)
    path = f"file://{tmp_path}/ids"
    tf.write_tokens(docs, PATH, 2, path, block_tokens=64, every=7)
    assert spark.read.parquet(f"{path}/blocks").count() > 10
    # the files, in the order of their names, hold the blocks in that of the keys
    files = sorted((tmp_path / "ids" / "blocks").glob("*.parquet"))
    starts = [s for f in files for s in pq.read_table(f).column("start").to_pylist()]
    assert len(files) > 1 and starts == sorted(starts)
    rows = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tf.read_tokens(spark, path).collect()]
    assert sorted(rows, key=lambda r: r[1]) == list(expected(docs, library))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=200), st.integers(8, 20))
def test_code_lengths_are_optimal_within_the_limit(counts, limit):
    bits = tf.code_lengths(np.array(counts), limit)
    assert bits.max() <= limit and (len(counts) == 1 or sum(2.0 ** -int(b) for b in bits) == 1.0)
    if limit == 20 and len(counts) > 1:  # no limit bites: Huffman's cost
        import heapq

        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        longest_possible = bits.max() < 20
        assert not longest_possible or int((bits * np.array(counts)).sum()) == cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=600), st.integers(1, 50))
def test_blocks_round_trip(ids, every):
    seen = np.unique(np.array(ids or [1], np.int64))
    code = tf.Code(seen, tf.code_lengths(np.bincount(np.searchsorted(seen, np.array(ids or [1]))), 18))
    block = tf.pack(np.array(ids, np.int64), *code.writer(), every)
    table, size = code.reader()
    assert tf.unpack(block, table, size, code.longest).tolist() == ids


def test_damaged_blocks_are_refused():
    with pytest.raises(ValueError):
        tf.unpack(b"nope" + bytes(40), np.zeros(2, np.uint32), np.ones(2, np.int64), 1)


def test_many_fragments_are_merged_as_each_is(encoders):
    """New words were merged one by one, which was most of the time that a worker's first texts took."""
    from boxloom.llm.bpe import joined

    e, r = encoders[0], random.Random(5)
    some = [bytes(r.choice(b"abcde aeioutnsr\xc3\xa4\xb6") for _ in range(r.choice([1, 2, 3, 8, 30, 98, 99, 100, 101, 300]))) for _ in range(3000)]
    some += [b"a" * k for k in range(1, 110)] + [b"ab" * k for k in range(1, 60)]
    ids, size = e.merge_many(*joined(some))
    want = [e.merge(f) for f in some]
    assert ids.tolist() == [i for ids in want for i in ids] and size.tolist() == [len(ids) for ids in want]
    words = ["".join(r.choice(" abcdeäöüßéŁжстоnrtiou") for _ in range(r.choice([1, 2, 5, 9, 20]))) for _ in range(3000)]
    ids, size = e.letters(words)
    want = [e._token(x) for x in words]
    assert ids.tolist() == [i for ids in want for i in ids] and size.tolist() == [len(ids) for ids in want]
    assert [x.tolist() for x in e.letters([])] == [[], []]


def test_runs_of_ids_are_spelled_at_once(encoders):
    e, r = encoders[0], random.Random(6)
    runs = [[r.randrange(len(e.table)) for _ in range(k)] for k in (0, 3, 0, 50, 1, 0)]
    data, size = e.spelled_out(np.array([i for x in runs for i in x], "<u4"), np.array(list(map(len, runs))))
    assert data.tobytes() == b"".join(e.table[i] for x in runs for i in x) and size.tolist() == [sum(len(e.table[i]) for i in x) for x in runs]

"""Token counts against the libraries on whole texts."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxloom.llm.token_counts import Counter, between, token_counts
from tests.llm.helpers import documents, odd_rows, with_clashes

PARTS = [" ", " ", "a", "b", "it", "'s", "é", "\n", "\n", "漢", "<|endoftext|>", "<s>", ".", ",", ";", "\t", "ɐ", "ȿ", "́", "1", "▁", " ", "​", "x" * 90]


def library(name):
    if name.endswith(".model"):
        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        return lambda t: len(sp.encode(t))
    tk = Tokenizer.from_file(public_tokenizers.path(name))
    tk.no_truncation()
    tk.no_padding()
    return lambda t: len(tk.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_of_odd_texts(name):
    r, count = random.Random(4), Counter(public_tokenizers.path(name))
    texts = ["", " ", "a  b", " a", "a ", "<|endoftext|> x <|endoftext|>", "a \n b", "\na\n", *("".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(3000))]
    own = library(name)
    want = [own(t) for t in texts]
    assert count.counts(pa.array(texts)).tolist() == want
    assert count.counts(pa.array([*texts, None]).slice(7, 900)).tolist() == want[7:907]  # what is known already, and a part of an array
    count.KEPT = 10
    assert count.counts(pa.array(texts[::2])).tolist() == want[::2]


@pytest.mark.parametrize("most", [1, 4 << 20])
def test_token_counts(spark, most):
    df = with_clashes(documents(spark))
    own = library("byte_bpe_50k.json")
    got = token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), limit=100, most=most)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r[0], len((r[1] or "").encode()), own(r[1] or ""), own(r[1] or "") > 100) for r in odd_rows()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    other = df.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("body"))
    assert token_counts(other, public_tokenizers.path("byte_bpe_50k.json"), text="body", key="id").agg(F.sum("n_tokens")).first()[0] == sum(w[2] for w in want)


def test_parts_of_long_texts_are_short():
    import numpy as np

    data = np.frombuffer(("word " * 1000 + "ähnlich ́x  y").encode(), np.uint8)
    cuts = between(data, 32)
    assert len(cuts) == 1000 and (data[cuts] == 32).all() and (np.diff(cuts) == 5).all()

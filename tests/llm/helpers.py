"""Documents that try operators: nulls, empty and long texts, ties, repeated rows, columns whose names clash."""

import random

WORDS = "the of and to in is was for on that by this with from they are be at one have".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("" if r.random() < 0.4 else "".join(r.choices("abcdefgh", k=3))) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (5, base, "en", "a", 1), (3, base, "en", "a", 2), (9, " ".join(near), "en", "b", 3), (7, None, None, None, None), (8, "", "en", "a", 0), (11, "  \n\t ", "en", "b", 5),
        (12, "one", "de", "b", 3), (13, "One two three", "de", None, 3), (None, prose(2, 80), "en", "a", 7), (None, base, "en", "b", 7), (20, prose(3, 20_000), "en", "c", 9), (21, "x" * 5000, "en", "c", 9),
        (22, "naïve \U0001f600 漢字 <|endoftext|> don't  stop \n\n end ", "en", "a", 9), (5, base, "en", "a", 1), (30, prose(4, 200), "en", "b", 1), (31, prose(4, 200).upper(), "en", "b", 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def with_clashes(df):
    """The same with columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = "key ids n_tokens start size target place pieces score predicted row source_size component_id kept print sketch shard order hits h part doc decoded shard_ value rep".split()
    return df.select("*", *[F.lit(f"old {n}").alias(n) for n in names])

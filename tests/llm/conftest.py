import random

import pytest
from frames import frame


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, long, repeated, nearly equal and odd texts, with one row of each id."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared, long = text(120), text(70), text(30_000)
    lined = "\n".join(f"{text(6)}." for _ in range(12))
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \t\n\r ", "word", "Word", "one two three", "ONE two three", base, base,
        " ".join(near), base.upper(), f"{text(20)} {shared} {text(20)}", f"{shared} {text(60)}",
        f"{text(80)}\n{shared}", long, long, lined, f"{lined}\n{text(5)}", f"a\n\n{lined}\n \nb",
        "same line here\n" * 9, "same line here\n" * 4, "é ÀÉ ß İ 日本語 　   x",
        "<|endoftext|> a<|startoftext|>b it's   two  blanks", "x" * 5000, "#" * 60 + " $ % & | <>",
        "a b a b a b a b a b", text(49), text(50), "\x00 \x1c y\x85z", base + " " + shared,
    ]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows, extra=True).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    """The documents of the smallest test tables, as a dictionary too."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return table, {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}

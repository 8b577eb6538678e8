"""The field of toxic words against enumeration, and what it learns on held-out documents."""

import itertools
import random

import numpy as np
import pytest
from frames import frame
from pyspark.sql import functions as F

from floodlens.llm import toxic_spans
from floodlens.llm.queries import _crc_is

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def field():
    rng = np.random.default_rng(1)
    return toxic_spans.Field(rng.normal(size=1 << toxic_spans.BITS), rng.normal(size=(2, 2)),
                             rng.normal(size=2))


def taggings(field, features):
    """All taggings of one text with their probabilities."""
    scores = field.weights[features].sum(axis=1)
    every = list(itertools.product((0, 1), repeat=len(features)))
    weights = np.array([np.exp(
        field.first[y[0]] + sum(s for s, tag in zip(scores, y) if tag)
        + sum(field.move[a, b] for a, b in zip(y, y[1:]))) for y in every])
    return np.array(every), weights / weights.sum()


def texts_of(begins):
    at = np.append(np.flatnonzero(begins), len(begins))
    return list(zip(at, at[1:]))


def test_marginals_are_those_of_all_taggings(field):
    features = np.random.default_rng(2).integers(0, 1 << toxic_spans.BITS, (14, 4))
    begins = np.isin(np.arange(14), [0, 5, 6])
    toxic, pairs = field.marginals(features, begins)
    for a, b in texts_of(begins):
        every, p = taggings(field, features[a:b])
        assert np.allclose(toxic[a:b], p @ every)
        for t in range(1, b - a):
            for i, j in itertools.product((0, 1), repeat=2):
                both = (every[:, t - 1] == i) & (every[:, t] == j)
                assert np.isclose(pairs[i, j, a + t], p[both].sum())


def test_scan_in_runs_equals_one_by_one():
    m = np.random.default_rng(3).random((4, 70_001)) ** 8
    assert np.allclose(toxic_spans.scan(m), toxic_spans._sequential(m))
    assert toxic_spans.scan(m[:, :0]).shape == (2, 0)


def test_gradient_is_the_slope_of_the_likelihood(field):
    rng = np.random.default_rng(4)
    features = rng.integers(0, 30, (9, 3))
    begins = np.isin(np.arange(9), [0, 4])
    tags = rng.integers(0, 2, 9).astype(float)

    def likelihood():
        total = 0.0
        for a, b in texts_of(begins):
            every, p = taggings(field, features[a:b])
            total += np.log(p[(every == tags[a:b]).all(axis=1)][0])
        return total

    found = toxic_spans.gradient(field, features, begins, tags)
    for part, slope in zip((field.weights, field.move, field.first), found):
        for at in list(np.ndindex(part.shape))[:30]:
            kept, sides = part[at], []
            for shift in (1e-5, -1e-5):
                part[at] = kept + shift
                sides.append(likelihood())
            part[at] = kept
            assert np.isclose((sides[0] - sides[1]) / 2e-5, slope[at], atol=1e-4)


def test_words_have_offsets_in_characters():
    text = "É 日本! \"Trash!!\" ... x"
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    tokens = toxic_spans.tokens_of(raw, np.array([0, len(raw)]))
    assert [text[a:b] for a, b in zip(tokens.char_starts, tokens.char_ends)] == [
        "É", "日本", "Trash", "...", "x"]


def planted(spark, copies=0):
    """Texts of random words; toxic ones have a few of three words, anywhere."""
    rng = random.Random(3)
    words = [f"{rng.choice('bcdfg')}{i}word" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["Vile!", "nasty", "CRUEL"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    once = " ".join(f"once{n}" for n in range(20))
    for i in range(600, 600 + copies):  # one text, often, always labelled toxic
        rows.append((i, once))
        labels.append((i, 1, 1))
    return frame(spark, rows, extra=True).repartition(4), spark.createDataFrame(labels, LABELS)


def test_planted_words_are_found(spark):
    docs, labels = planted(spark)
    found = {r["doc_id"]: r for r in toxic_spans.score(docs, labels, _crc_is(3, 1)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(found) == 600
    for i, row in found.items():
        assert row["predicted"] == int(i % 4 == 0)
        words = {w for s in row["spans"] for w in texts[i][s["start"]:s["end"]].split()}
        if i % 4 == 0:
            assert {w.strip("!").lower() for w in words} & {"vile", "nasty", "cruel"}
        else:
            assert not words


def test_copies_are_no_evidence(spark):
    docs, labels = planted(spark, copies=300)
    known = toxic_spans.known_labels(labels)
    labelled = docs.select("doc_id", "text").join(known, "doc_id")
    marked = {r["unit"] for r in toxic_spans.marks(labelled).collect()}

    def unit(word):
        raw = np.frombuffer(word.encode(), dtype=np.uint8)
        return int(toxic_spans.signed(toxic_spans.tokens_of(
            raw, np.array([0, len(raw)])).units())[0, 0])

    assert {unit("vile"), unit("nasty"), unit("cruel")} <= marked
    assert not {unit(f"once{n}") for n in range(20)} & marked


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    table = toxic_spans.score(docs, labels, _crc_is(3, 1)).join(labels, "doc_id").where(
        "held_out").select("score", "predicted", "toxic").toPandas()
    assert table[table.toxic == 1].predicted.mean() > 0.85
    assert table[table.toxic == 0].predicted.mean() < 0.01
    rank = table["score"].rank()
    n, m = (table.toxic == 1).sum(), (table.toxic == 0).sum()
    assert (rank[table.toxic == 1].sum() - n * (n + 1) / 2) / (n * m) > 0.95


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = planted(spark)
    held = _crc_is(3, 1)
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r["doc_id"]: r["score"] for r in toxic_spans.score(docs, x, held).collect()}
              for x in (labels, flipped)]
    assert scores[0] == pytest.approx(scores[1])


def test_odd_texts_and_labels(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame(
        [(1, 1, 1), (1, 1, 0), (None, 1, 1), (7, None, None), (8, 1, 0), (9, 0, 1)], LABELS)
    rows = toxic_spans.score(odd, labels, _crc_is(3, 1)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(dict(odd_rows))
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = toxic_spans.score(odd, labels.limit(0), _crc_is(3, 1))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert toxic_spans.score(empty, labels, _crc_is(3, 1)).count() == 0

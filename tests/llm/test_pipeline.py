"""The pipeline stage by stage against plain Python, on the smallest tables."""

import brute
import pytest
from frames import frame

import corpus_pipeline
from floodlens.llm import quality_rules
from floodlens.llm.packing import CAPACITY

SF_DIR = "/root/testdata/sf0.01"


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """The output of every stage."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF_DIR).cache())
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert dict(df.dtypes) == dict(stages[0].dtypes)


def test_rules(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    judged = quality_rules.judge(stages[0], labels)
    kept = {r["doc_id"] for r in judged.where("kept").collect()}
    before, after = texts_of(stages[0]), texts_of(stages[1])
    assert after == {i: before[i] for i in kept}


def test_lines(stages):
    before, after = texts_of(stages[1]), texts_of(stages[2])
    want = {}
    for i, gone in brute.repeated_lines(before, 3, 10).items():
        text = brute.without_lines(before[i], gone)
        if not gone or brute.words(text):
            want[i] = text if gone else before[i]
    assert after == want


def test_near_duplicates(stages):
    before, after = texts_of(stages[2]), texts_of(stages[3])
    parts = brute.near_components(before, size=5)
    assert after == {i: t for i, t in before.items() if parts[i] == i}


def test_passages(stages):
    before, after = texts_of(stages[3]), texts_of(stages[4])
    want = {}
    for i, gone in brute.repeated_words(before, 50).items():
        text = brute.without_words(before[i], gone) if any(gone) else before[i]
        if not any(gone) or brute.words(text):
            want[i] = text
    assert after == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect()
               if r["text"] != before[r["doc_id"]])


def test_packing(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts_of(stages[4]))
    filled: dict[int, int] = {}
    for row in rows:
        filled[row["sequence_id"]] = filled.get(row["sequence_id"], 0) + row["length"]
    assert max(filled.values()) <= CAPACITY
    assert len(filled) <= sum(filled.values()) / CAPACITY + 2


def test_odd_and_empty_tables(spark, odd_rows):
    rows = [*odd_rows, (None, "null id"), (7, odd_rows[7][1]), (7, "another text")]
    docs = frame(spark, rows).selectExpr(
        "doc_id", "text", "cast(null as string) as lang", "'s' as source",
        "cast(length(text) as long) as n_chars", "'x' as n_words")
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF_DIR).cache()
        table.collect()

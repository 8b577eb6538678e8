"""From raw documents to packed training sequences: five stages, each working on what the one
before it kept.

A stage takes (session, documents, table folder) and returns a DataFrame; `run` writes it as
Parquet in the shared folder and reads it back as the documents of the next stage. All stages but
the last return the columns of `documents`. Rows with a null id are left out in the first stage,
and of rows with the same id one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.llm import line_dedup, near_dup, packing, quality_rules, substring_dedup
from floodlens.llm.documents import one_row_per_id
from floodlens.session import ship_package, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned quality rules accept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(one_row_per_id(docs, COLUMNS), labels, COLUMNS)


def _with_texts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """`docs` with the texts that `kept` (doc_id, kept_text, null if unchanged) gives them;
    documents left without a word go."""
    changed = kept.where("kept_text is not null").select("doc_id", "kept_text")
    text = F.coalesce("kept_text", "text")
    return (docs.join(changed.hint("merge"), "doc_id", "left")
            .withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars"))
                        .otherwise(F.length("kept_text")))
            .withColumn("text", text)
            .where(F.col("kept_text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
            .select(*COLUMNS))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of three lines or ten words that occur earlier."""
    return _with_texts(docs, line_dedup.dedup(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (80 percent of shingles of five words), the one
    with the smallest id."""
    kept = near_dup.near_duplicates(docs, shingle=5).where("kept").select("doc_id")
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that occur in one with a smaller id."""
    return _with_texts(docs, substring_dedup.dedup(docs, joined=False))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", drop_passages),
    ("packing", pack),
]

#: Verdicts and packings are learned or searched for, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

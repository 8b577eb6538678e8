"""The registered queries: against SQL where there is some, and their columns."""

import pytest

import __spark_entry__ as contract
import oracle
from floodlens.llm import queries as corpus

SF_DIR = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_topk_search": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
                         "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
                         "kept boolean",
    "op3_near_dup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                   "sequence_id bigint, offset bigint",
    "op5_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op7_hmm_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
                  "train_tokens bigint, base_score double, score double",
    "op9_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, "
                              "form_n bigint",
    "op12_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op13_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, "
                            "n_links bigint, n_best bigint, count_sum bigint, "
                            "groups_sha256 string",
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_all_are_registered():
    found = contract.queries()
    assert set(corpus.QUERIES) | {"pipeline"} <= set(found)
    assert {name.split("_")[0] for name in corpus.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(corpus.ORACLE_SQL) <= set(corpus.QUERIES)


@pytest.mark.parametrize("name", corpus.ORACLE_SQL)
def test_sql(name, spark, con):
    result = contract.queries()[name](spark, SF_DIR)
    assert oracle.differences(result, con, contract.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(name, spark):
    kinds = dict(contract.queries()[name](spark, SF_DIR).dtypes)
    for column in COLUMNS[name].split(", "):
        column, kind = column.split(" ")
        assert kinds[column] == kind

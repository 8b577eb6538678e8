"""Top-k search and quotation linking on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.llm import quotations, topk_search
from floodlens.llm.components import components


def brute_topk(rows, asked, k):
    whole = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * float(np.float32(x))) for x in v]
        whole[i] = min(whole.get(i, q), q)
    out = []
    for i in whole:
        if asked(i):
            best = sorted((-sum(a * b for a, b in zip(whole[i], q)), j)
                          for j, q in whole.items() if j != i and len(q) == len(whole[i]))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,query_block", [(40, 16), (10_000, 4096)])
def test_topk(spark, shard_rows, query_block):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).astype("float32").tolist(), "x") for i in range(300)]
    rows += [(i, rows[5][1], "x") for i in range(300, 450)]  # a third of all are equal
    rows += [(500, None, "x"), (501, [1.0, None, 1.0, 1.0], "x"), (502, [], "x"),
             (503, [1.0, math.nan, 0.0, 0.0], "x"), (504, [math.inf, 0.0, 0.0, 0.0], "x"),
             (505, [1.0, 2.0], "x"), (520, [3.0, 1.0], "x"), (None, [1.0, 1.0, 1.0, 1.0], "x"),
             (7, rows[7][1], "x"), (7, [-9.0, 0.0, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    found = topk_search.search(df, F.col("vec_id") % 20 == 0, 20, shard_rows=shard_rows,
                               query_block=query_block)
    assert sorted(map(tuple, found.collect())) == brute_topk(rows, lambda i: i % 20 == 0, 20)


def test_large_components_keep_their_values_or_raise(spark):
    rows = [(i, [float(2 ** 22 + i), -1.5]) for i in range(0, 100, 10)]
    schema = "vec_id long, embedding array<float>"
    search = lambda rows: topk_search.search(
        spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(map(tuple, search(rows))) == brute_topk(rows, lambda i: i % 20 == 0, 20)
    with pytest.raises(Exception, match="too large for 64-bit scores"):
        search([*rows, (101, [1e30, 0.0])])


def test_topk_of_few_and_of_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (40, [-1.0])], schema)
    found = topk_search.search(few, F.col("vec_id") % 20 == 0, 20).collect()
    assert len(found) == 6
    none = spark.createDataFrame([], schema)
    assert topk_search.search(none, F.col("vec_id") % 20 == 0, 20).collect() == []


def test_tree_leaves_most_items_out_of_a_clustered_search():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(32, 8)) * 40
    vectors = np.floor(centres[rng.integers(0, 32, 4000)] + rng.normal(size=(4000, 8)))
    tree = topk_search.Tree.build(np.arange(4000), vectors, leaf=64)
    scores = vectors @ vectors[17]
    order = sorted((-s, i) for i, s in enumerate(scores) if i != 17)[:5]
    assert tree.search(17, vectors[17], 5, None) == order
    visited = []
    real = tree.bounds
    tree.bounds = lambda *a: visited.append(a) or real(*a)
    tree.search(17, vectors[17], 5, order[-1])
    assert len(visited) < len(tree.begin) / 4


@pytest.mark.parametrize("leaf", [4, 64, 10_000])
def test_queries_together_find_what_each_finds_alone(leaf):
    rng = np.random.default_rng(leaf)
    centres = rng.normal(size=(12, 6)) * 30
    vectors = np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)))
    vectors[100:300] = vectors[5]  # many equal ones: ties go by id
    ids = rng.permutation(5000)[:900].astype(np.int64)
    tree = topk_search.Tree.build(ids, vectors, leaf)
    asked = np.arange(0, 900, 7)
    alone = [tree.search(int(ids[i]), vectors[i], 10, None) for i in asked]
    row, score, item = tree.search_all(ids[asked], vectors[asked], 10)
    assert [(r, -s, i) for r, s, i in zip(row.tolist(), score.tolist(), item.tolist())] == [
        (r, int(s), int(i)) for r, found in enumerate(alone) for s, i in found]
    kth = (np.array([-f[4][0] for f in alone], np.int64), np.array([f[4][1] for f in alone]))
    row, score, item = tree.search_all(ids[asked], vectors[asked], 10, kth)
    assert [(r, -s, i) for r, s, i in zip(row.tolist(), score.tolist(), item.tolist())] == [
        (r, int(s), int(i)) for r, found in enumerate(alone) for s, i in found[:4]]


def test_queries_together_leave_most_leaves_of_clusters_alone():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(32, 8)) * 40
    vectors = np.floor(centres[rng.integers(0, 32, 4000)] + rng.normal(size=(4000, 8)))
    tree = topk_search.Tree.build(np.arange(4000), vectors, leaf=64)
    scored = []
    asked = np.arange(0, 4000, 40)
    tree.vectors = Counted(tree.vectors, scored)
    tree.search_all(asked, vectors[asked], 5)
    assert sum(scored) < 0.2 * len(asked) * 4000


class Counted:
    """Item vectors that count the products they take part in."""

    def __init__(self, vectors, scored):
        self.vectors, self.scored = vectors, scored

    def __getitem__(self, part):
        outer = self

        class Part:
            @property
            def T(self):  # noqa: N802
                return self

            def __rmatmul__(self, queries):
                held = outer.vectors[part]
                outer.scored.append(len(queries) * len(held))
                return queries @ held.T

            __array_ufunc__ = None

        return Part()


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 9), (20, 20), (5, 4), (4, 3), (100, 99)]
    links += [(i, i + 1) for i in range(1000, 1100)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 1 for i in range(1, 6)} | {8: 8, 9: 8, 99: 99, 100: 99}
    want |= {i: 1000 for i in range(1000, 1101)}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows],
                               "msg_id string, sent long, text string, key string, level string")
    return {r["msg_id"]: r for r in quotations.conversations(df).collect()}


def test_quotations(spark):
    rows = [
        ("a", 1, "First  words\nmore"),
        ("b", 2, "> first words\n> MORE\n\nAn answer"),
        ("c", 3, "> > First words\n> > more\n> An answer\n\nAgreed\n"),
        ("d", 4, ">> first words\n>>more\n> nobody wrote this\nOnly the outer one is known"),
        ("e", 5, "> An answer\nfirst\n\n> first words\n> more\nsecond"),
        ("f", 6, "> What comes later\nhm"),
        ("g", 7, "What comes later"),
        ("h", 8, "First words\nmore"),
        ("i", 9, None), ("j", None, ""), ("k", 9, "> > \n> \n"),
        ("l", 10, "> First words\nin line\n> more\nend"),
    ]
    found = linked(spark, rows)
    parents = {i: r["parent_id"] for i, r in found.items()}
    assert parents == {"a": None, "b": "a", "c": "b", "d": "a", "e": "b", "f": None, "g": None,
                       "h": None, "i": None, "j": None, "k": None, "l": None}
    assert {i: (r["thread_id"], r["depth"]) for i, r in found.items() if i in "abcde"} == {
        "a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 1), "e": ("a", 2)}
    texts = {i: r["own_text"] for i, r in found.items()}
    assert texts["b"] == "An answer" and texts["c"] == "Agreed" and texts["e"] == "first\n\nsecond"
    assert texts["i"] == texts["j"] == texts["k"] == "" and texts["l"] == "in line\nend"
    assert found["d"]["n_quoted"] == 3


def test_long_conversations_do_not_run_into_the_next(spark):
    """Turns beyond a thousand sort before the next conversation, and link to the turn before."""
    turns = [(c, t, "user", f"text {c} {t}") for c in (1, 2) for t in (0, 1, 999, 1000, 1001, 5000,
                                                                       5001)]
    turns.append((2, 1002, "user", "text 1 5000"))
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    messages = quotations.quoting_messages(df)
    sent = {tuple(map(int, r["msg_id"].split("-")[:2])): r["sent"] for r in messages.collect()}
    assert sorted(sent, key=sent.get) == sorted(sent)
    found = {tuple(map(int, r["msg_id"].split("-")[:2])): r["parent_id"]
             for r in quotations.conversations(messages).collect()}
    assert found[1, 1001].startswith("1-1000-") and found[1, 5001].startswith("1-5000-")
    assert found[2, 1000].startswith("2-999-") and found[2, 999] is None


def test_very_long_message_and_a_passage_that_many_quote(spark):
    long = "\n".join(f"line {i} of a long message" for i in range(20_000))
    rows = [("a", 1, long), ("b", 2, "\n".join("> " + x for x in long.split("\n")) + "\n\nyes")]
    rows += [(f"h{i:04}", 10 + i, "> yes\n\nme too" if i else "yes") for i in range(1500)]
    found = linked(spark, rows)
    assert found["b"]["parent_id"] == "a" and found["b"]["n_quoted"] == 20_000
    assert all(found[f"h{i:04}"]["parent_id"] == "b" for i in range(1, 1500))


def test_long_chain_and_hot_message(spark):
    rows = [("m0000", 0, "text 0")]
    rows += [(f"m{i:04}", i, f"> text {i - 1}\ntext {i}") for i in range(1, 70)]
    rows += [(f"r{i:04}", 100 + i, "> text 0\nme too") for i in range(300)]
    found = linked(spark, rows)
    assert {r["thread_id"] for r in found.values()} == {"m0000"}
    assert found["m0069"]["depth"] == 69
    assert all(found[f"r{i:04}"]["parent_id"] == "m0000" for i in range(300))


def test_repeated_and_missing_messages(spark):
    found = linked(spark, [("a", 2, "b"), ("a", 1, "z"), ("a", 1, "z"), (None, 1, "q")])
    assert set(found) == {"a"} and found["a"]["own_text"] == "z"
    assert linked(spark, []) == {}


def test_quotations_run_without_python(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = quotations.conversations(quotations.quoting_messages(turns))._jdf.queryExecution()
    assert not any(word in plan.toString() for word in ("Python", "Arrow", "Pandas"))

"""Operators on texts against plain Python, on the smallest tables and on odd texts."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from frames import frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from floodlens.llm import (
    boosted_quality,
    bpe,
    hmm_lm,
    line_dedup,
    near_dup,
    packing,
    quality_rules,
    substring_dedup,
)
from floodlens.llm.queries import _crc_is, _vocabulary

LABELS = "doc_id long, quality int, toxic int"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Quality rules and classifier -----------------------------------------------------------------

def test_base_counts(spark, odd, odd_rows, documents):
    labels = spark.createDataFrame([], LABELS)
    for df, texts in ((odd, dict(odd_rows)), documents):
        found = by_id(quality_rules.judge(df, labels))
        assert set(found) == set(texts)
        for i, text in texts.items():
            want = brute.base_counts(text)
            assert {n: found[i][n] for n in want} == want
            failed = (want["n_words"] < 50
                      or 100 * want["n_repeat_words"] > 50 * want["n_words"])
            assert found[i]["base_failed"] == failed
            assert found[i]["kept"] == (not failed)  # nothing was learned


def test_rules_separate_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    judged = quality_rules.judge(docs, labels).join(labels, "doc_id").toPandas()
    passed = judged[~judged.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.99
    assert passed[passed.quality == 0].kept.mean() < 0.1


def test_rule_in_spark_and_numpy_agree(spark, documents):
    counts = quality_rules.with_counts(documents[0]).cache()
    rules = quality_rules.DecisionList((
        quality_rules.Rule((quality_rules.Condition("marks", True, 0.2),
                            quality_rules.Condition("n_words", False, 300.0))),
        quality_rules.Rule((quality_rules.Condition("distinct", False, 0.5),))))
    table = counts.withColumn("rule", rules.column()).toPandas()
    x = quality_rules.feature_matrix({n: table[n].to_numpy() for n in quality_rules.COUNTS})
    first, second = (rule.holds(x) for rule in rules.rules)
    assert table["rule"].tolist() == np.where(first, 1, np.where(second, 2, 0)).tolist()


def test_learning_finds_a_planted_conjunction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    bad = (x[:, 3] > 0.7) & (x[:, 5] <= 0.4)
    rules = quality_rules.learn_rules(x, bad)
    caught = np.logical_or.reduce([r.holds(x) for r in rules.rules])
    assert (caught == bad).mean() > 0.97
    assert quality_rules.learn_rules(x, np.zeros(3000, bool)).rules == ()


def test_labels_that_say_nothing(spark, documents):
    labels = spark.createDataFrame(
        [(None, 0, 0), (1, None, 0), (2, 0, 0), (2, 1, 0), (10 ** 9, 0, 0)], LABELS)
    counts = quality_rules.with_counts(documents[0])
    assert quality_rules.fit(counts, labels).rules == ()


def test_classifier_scores_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    scored = boosted_quality.score(docs, labels, _crc_is(5, 0))
    table = scored.join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    assert table.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0
                                       for i in table.doc_id]
    held = table[table.held_out]
    rank = held.score.rank()
    good = held.quality == 1
    auc = (rank[good].mean() - (good.sum() + 1) / 2) / (~good).sum()
    assert auc > 0.97
    assert ((held.score >= 0.3) == (held.predicted == 1)).all()


def test_classifier_on_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([], LABELS)
    found = by_id(boosted_quality.score(odd, labels, _crc_is(5, 0)))
    assert set(found) == set(dict(odd_rows))
    assert {r["score"] for r in found.values()} == {0.5}
    assert boosted_quality.score(empty, labels, _crc_is(5, 0)).collect() == []
    assert quality_rules.judge(empty, labels).collect() == []


def test_trees_walk_as_their_arrays_say():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    trees = boosted_quality.fit_trees(x, (x[:, 0] + x[:, 2] > 0).astype(float), rounds=7, depth=3)
    raw = []
    for row in x:
        total = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - 7]
        raw.append(total)
    assert np.allclose(trees.raw(x), raw)


# Duplicates -----------------------------------------------------------------------------------

def test_near_duplicates(odd, odd_rows, documents, empty):
    for df, texts in ((odd, dict(odd_rows)), documents):
        found = by_id(near_dup.near_duplicates(df))
        want = brute.near_components(texts)
        assert {i: r["component_id"] for i, r in found.items()} == want
        assert {i: r["n_shingles"] for i, r in found.items()} == {
            i: len(brute.shingles(t)) for i, t in texts.items()}
        assert all(r["kept"] == (i == want[i]) for i, r in found.items())
    assert near_dup.near_duplicates(empty).collect() == []


def test_near_duplicates_in_a_large_group(spark):
    """Hundreds of edited copies: regions are split, and chains of links hold them together."""
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(700):
        text = list(base)
        for _ in range(int(rng.integers(0, 4))):
            text[int(rng.integers(0, 60))] = f"e{int(rng.integers(0, 5))}"
        rows.append((i, " ".join(text)))
    found = by_id(near_dup.near_duplicates(frame(spark, rows)))
    assert {i: r["component_id"] for i, r in found.items()} == brute.near_components(dict(rows))


def test_near_duplicates_in_a_template_group(spark):
    """Pages that share a template and are alike at 79 percent; far apart in every order of them,
    pairs that are just over 80."""
    template, pages = " ".join(f"t{i}" for i in range(103)), 10_000
    own = [[f"p{i}w{k}" for k in range(13)] for i in range(pages)]
    twins = {i: i + 6000 for i in range(0, 4000, 50)}
    for a, b in twins.items():
        own[b][:1] = own[a][:1]
    rows = [(i, f"{template} {' '.join(words)}") for i, words in enumerate(own)]
    assert 0.79 < 100 / 126 < 0.8 < 101 / 125
    found = by_id(near_dup.near_duplicates(frame(spark, rows).repartition(8)))
    want = {i: i for i in range(pages)} | {b: a for a, b in twins.items()}
    assert {i: r["component_id"] for i, r in found.items()} == want


def test_set_join_finds_all_alike_pairs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        text = [f"t{k}" for k in range(int(rng.integers(30, 40)))]
        for _ in range(int(rng.integers(0, 4))):
            text[int(rng.integers(0, len(text)))] = f"e{int(rng.integers(0, 5))}"
        rows.append((i, " ".join(text)))
    texts = frame(spark, rows).selectExpr("doc_id", "text", "doc_id % 9 as component")
    found = {(r["a"], r["b"]) for r in near_dup.dense_pairs(texts).collect()}
    sets = {i: brute.shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and a % 9 != b % 9
            and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want and want <= found and all(a < b and a % 9 != b % 9 for a, b in found)


def test_dense_runs_across_batches():
    values = np.repeat([0, 1, 2, 3, 4], [3, 9, 2, 5, 4])[:, None]
    rows = {"values": values, "tree": np.zeros(len(values), int), "doc_id": np.arange(len(values))}
    for size in (1, 2, 5, 7, 40):
        runs, out = near_dup._DenseRuns(4), []
        for at in range(0, len(values), size):
            out += runs.add({n: x[at:at + size] for n, x in rows.items()})
        out += runs.end()
        assert np.concatenate(out).tolist() == [*range(3, 12), *range(14, 19)]


@pytest.mark.parametrize("window,shortest", [(50, 20), (50, 6), (16, 4), (7, 7)])
def test_substrings(spark, odd, odd_rows, window, shortest):
    texts = dict(odd_rows)
    want = brute.repeated_words(texts, window)
    joined = by_id(substring_dedup.dedup(odd, window, shortest))
    cut = by_id(substring_dedup.dedup(odd, window, shortest, joined=False))
    assert set(joined) == set(texts)
    for i, gone in want.items():
        kept = [w for w, g in zip(brute.words(texts[i]), gone) if not g]
        row = joined[i]
        assert (row["n_words"], row["n_removed"]) == (len(gone), sum(gone))
        digest = row["digest"] if row["kept_text"] is None else brute.sha(row["kept_text"])
        assert digest == brute.sha(" ".join(kept))
        if any(gone):
            assert cut[i]["kept_text"] == brute.without_words(texts[i], gone)
        else:
            assert cut[i]["kept_text"] is None


def test_substrings_of_the_documents(documents, empty):
    df, texts = documents
    found = by_id(substring_dedup.dedup(df))
    assert {i: r["n_removed"] for i, r in found.items()} == {
        i: sum(gone) for i, gone in brute.repeated_words(texts, 50).items()}
    assert substring_dedup.dedup(empty).collect() == []


def _line_texts():
    """Texts of few different lines of one to twelve words, some whole and short, some copied."""
    rng = np.random.default_rng(11)
    lines = [" ".join(f"w{k}" for k in rng.integers(0, 9, n)) for n in (1, 1, 2, 3, 3, 4, 6, 9, 12)]
    texts = {i: "\n".join(rng.choice(lines, rng.integers(0, 7))) for i in range(150)}
    return texts | {150: texts[3], 151: "one long line of more than ten words stands here alone now",
                    152: "a\n one long line of more than ten words stands here alone now\nb",
                    153: "short text", 154: " short text \n", 155: "short text\nand more"}


@pytest.mark.parametrize("run,least", [(1, 1000), (2, 1000), (3, 10), (5, 7), (2, 4), (3, 1)])
def test_lines(spark, odd, odd_rows, run, least):
    made = _line_texts()
    frames = ((odd, dict(odd_rows)), (frame(spark, list(made.items())).repartition(3), made))
    for df, texts in frames:
        compare_lines(by_id(line_dedup.dedup(df, run, least)), texts, run, least)


def test_one_long_line_and_a_whole_short_document_count():
    texts = _line_texts()
    gone = brute.repeated_lines(texts, 3, 10)
    assert gone[152] == [1] and gone[154] == [0] and gone[155] == [] and gone[151] == []


def test_a_line_that_a_third_of_the_documents_hold(spark):
    """One line everywhere, with the lines around it shared by pairs of documents."""
    line = "this very common line of more than ten words is in every document"
    texts = {i: f"own {i // 2} before\n{line}\nown {i // 2} behind" if i % 3 else f"alone {i}"
             for i in range(900)}
    found = by_id(line_dedup.dedup(frame(spark, list(texts.items())).repartition(4)))
    compare_lines(found, texts, 3, 10)


def compare_lines(found, texts, run, least):
    assert set(found) == set(texts)
    for i, gone in brute.repeated_lines(texts, run, least).items():
        assert list(found[i]["removed"]) == gone and found[i]["n_removed"] == len(gone)
        want = brute.without_lines(texts[i], gone) if gone else None
        assert found[i]["kept_text"] == want


def test_lines_of_an_empty_table(empty):
    assert line_dedup.dedup(empty).collect() == []


def test_repeated_ids_count_once(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = frame(spark, [(1, text), (1, text), (1, "zz"), (2, text), (None, text), (None, None)])
    assert [(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(docs)
            .orderBy("doc_id").collect()] == [(1, 1), (2, 1)]
    assert [(r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup(docs)
            .orderBy("doc_id").collect()] == [(1, 0), (2, 80)]
    assert [(r["doc_id"], r["n_removed"]) for r in line_dedup.dedup(docs, 1)
            .orderBy("doc_id").collect()] == [(1, 0), (2, 1)]


# Tokens ---------------------------------------------------------------------------------------

def test_bpe_equals_the_library(odd, odd_rows, documents):
    path = _vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df, texts in ((odd, dict(odd_rows)), documents):
        found = by_id(bpe.decode(bpe.encode(df, path), path))
        digests = by_id(bpe.round_trip(df, path))
        for i, text in texts.items():
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert list(found[i]["ids"]) == ids
            decoded = library.decode(ids, skip_special_tokens=False)
            assert found[i]["decoded"] == decoded
            assert digests[i]["n_tokens"] == len(ids)
            assert digests[i]["ids_sha256"] == brute.sha(",".join(map(str, ids)))
            assert digests[i]["decoded_sha256"] == brute.sha(decoded)


def test_decoding_of_bytes_that_are_no_text(spark):
    path = _vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(1, [ids]) for ids in range(150, 250, 7)] + [(2, []), (3, None), (4, [50256, 300])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    for row in bpe.decode(df, path).collect():
        assert row["decoded"] == library.decode(row["ids"] or [], skip_special_tokens=False)


def test_bpe_of_an_empty_table_and_null_ids(spark, empty):
    path = _vocabulary("byte_bpe_50k.json")
    assert bpe.round_trip(empty, path).collect() == []
    again = frame(spark, [(None, "a b"), (None, "a b")])
    assert [r["n_tokens"] for r in bpe.round_trip(again, path).collect()] == [2, 2]


def test_pieces_equal_the_library(odd, odd_rows, documents):
    path = _vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df, texts in ((odd, dict(odd_rows)), documents):
        pieces: dict[int, dict[int, object]] = {}
        for row in packing.pieces(df, path, with_ids=True).collect():
            pieces.setdefault(row["doc_id"], {})[row["piece"]] = row
        assert set(pieces) == set(texts)
        for i, text in texts.items():
            ids = library.encode(text or "", add_special_tokens=False).ids + [1]
            cuts = [ids[k:k + 4096] for k in range(0, len(ids), 4096)]
            assert sorted(pieces[i]) == list(range(len(cuts)))
            for k, cut in enumerate(cuts):
                row = pieces[i][k]
                assert list(row["ids"]) == cut
                assert (row["start"], row["length"]) == (4096 * k, len(cut))
                assert row["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())


def check_packing(rows, capacity):
    placed: dict[int, list] = {}
    for row in rows:
        placed.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for items in placed.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_packing_in_many_blocks(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(1, 101, 3000)] + [100] * 50
    items = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)],
                                  "doc_id long, length long")
    rows = packing.pack(items, capacity=100, block=400).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    least = packing.lower_bound(np.array(lengths), 100)
    assert check_packing(rows, 100) <= least * 1.02  # blocks of few pieces cost a little


def test_packing_of_repeats_and_of_nothing(spark, empty):
    items = spark.createDataFrame([(None, 60)] * 7 + [(1, 100)], "doc_id long, length long")
    rows = packing.pack(items, capacity=100, block=2).collect()
    assert check_packing(rows, 100) == 8
    assert packing.pack(empty.selectExpr("doc_id", "0L as length")).collect() == []


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(7)

    def fewest(lengths, capacity):
        best = len(lengths)

        def place(n, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if n == len(lengths):
                best = len(rooms)
                return
            for k in {room: k for k, room in enumerate(rooms) if room >= lengths[n]}.values():
                place(n + 1, [r - lengths[n] * (j == k) for j, r in enumerate(rooms)])
            place(n + 1, [*rooms, capacity - lengths[n]])

        place(0, [])
        return best

    for _ in range(60):
        lengths = sorted(rng.integers(8, 60, int(rng.integers(1, 11))).tolist(), reverse=True)
        sequence, _ = packing.pack_lengths(np.array(lengths), 100)
        want = fewest(lengths, 100)
        assert packing.lower_bound(np.array(lengths), 100) <= want
        assert sequence.max() + 1 == want


# Language model ---------------------------------------------------------------------------------

def test_expected_counts_and_forward_over_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    part = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape))
    model = hmm_lm.Model(part(3), part(3, 3), part(3, 5))
    classes, first = rng.integers(0, 5, 9), np.array([0, 4, 5, 9])
    sums = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))]
    logs = []
    for a, b in zip(first, first[1:]):
        total, own = 0.0, [np.zeros_like(s) for s in sums]
        for path in product(range(3), repeat=b - a):
            p = model.first[path[0]] * math.prod(
                model.move[path[t - 1], path[t]] for t in range(1, b - a)) * math.prod(
                model.emit[z, c] for z, c in zip(path, classes[a:b]))
            total += p
            own[0][path[0]] += p
            for t in range(1, b - a):
                own[1][path[t - 1], path[t]] += p
            for z, c in zip(path, classes[a:b]):
                own[2][z, c] += p
        sums = [s + o / total for s, o in zip(sums, own)]
        logs.append(math.log10(total))
    for got, want in zip(hmm_lm.expected_counts(model, classes, first, 100), sums):
        assert np.allclose(got, want)
    assert np.allclose(hmm_lm.forward(model, classes, first), logs)


def test_segments_of_a_long_text_count_as_the_whole_text(documents):
    texts = sorted((t or "" for t in documents[1].values()), key=len)[-3:]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    tokens, first = hmm_lm.tokens_of(data, offsets)
    classes = hmm_lm.classes_of(tokens, 64)
    model = hmm_lm.Model.untrained(4, 65)
    for _ in range(2):  # the model, and what one round makes of it
        whole = hmm_lm.expected_counts(model, classes, first, len(classes))
        parts = hmm_lm.expected_counts(model, classes, first, 100)
        assert np.allclose(whole[0], parts[0], atol=0.02)  # first states: of the three texts only
        assert math.isclose(parts[0].sum(), 3)
        assert math.isclose(parts[1].sum(), len(classes) - 3, rel_tol=1e-9)  # every move once
        for a, b in zip(whole[1:], parts[1:]):
            assert np.abs(a - b).sum() < 0.01 * a.sum()
        model = hmm_lm.Model(*(x / x.sum(-1, keepdims=True) for x in (
            whole[0] + 0.1, whole[1] + 0.1, whole[2] + 0.01)))


def test_language_model(documents):
    df, texts = documents
    rows = by_id(hmm_lm.score(df, _crc_is(7, 2), bucket_bytes=1 << 17))
    tokens = {i: [*brute.words((t or "").translate(brute.LOWER)), None]
              for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i in texts if not held[i] for w in tokens[i])
    total = sum(counts.values())
    for i, row in rows.items():
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens[i])
        assert math.isclose(row["base_score"], base, rel_tol=1e-9)
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (
            held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), total)
    assert set(rows) == set(texts)
    held_rows = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held_rows) > sum(r["base_score"] for r in held_rows)


def test_class_and_word_probabilities_sum_to_one(spark):
    """With one state and one class besides the end, scores follow from counts alone."""
    docs = frame(spark, [(1, "a a b"), (2, "B c"), (3, None), (3, None), (None, "zzz")])
    rows = by_id(hmm_lm.score(docs, F.lit(False), states=1, classes=1, rounds=8))
    # Classes: 5 words and 3 ends; words of the class: a 2, b 2, c 1, one unseen: 5 + 3 + 1.
    words, ends = 5 + 0.01, 3 + 0.01
    for i, found in ((1, [2, 2, 2]), (2, [2, 1]), (3, [])):
        want = math.log10(ends / (words + ends)) + sum(
            math.log10(words / (words + ends)) + math.log10((n + 1) / 9) for n in found)
        assert math.isclose(rows[i]["score"], want, rel_tol=1e-9)
    assert set(rows) == {1, 2, 3}


def test_language_model_on_odd_rows(odd, odd_rows, empty):
    rows = by_id(hmm_lm.score(odd, _crc_is(7, 2), rounds=1))
    assert set(rows) == set(dict(odd_rows))
    assert all(math.isfinite(r["score"]) for r in rows.values())
    assert hmm_lm.score(empty, _crc_is(7, 2), rounds=1).collect() == []

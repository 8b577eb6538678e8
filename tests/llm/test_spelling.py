"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from frames import frame

from floodlens.llm import spelling

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(docs):
    found = Counter()
    for i, text in docs.items():
        for run in RUN.findall(text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near_sets(words):
    """Near words of each word, by the words without one code point."""
    holes, sets = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1:]
            holes.setdefault((less, i), []).append(w)
            if less in sets:
                sets[w].add(less)
                sets[less].add(w)
    for same in holes.values():
        for w in same:
            sets[w].update(same)
    return {w: found - {w} for w, found in sets.items()}


def grouped(words):
    out = {}
    for w, near in near_sets(words).items():
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * words[w] else None
        out[w] = [form, None, words[w], len(near), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
            for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_brute_force_agrees_with_the_definition():
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(2, 5))) for _ in range(300)]
    words = dict.fromkeys(words, 1)
    want = {w: {v for v in words if one_edit(w, v)} for w in words}
    assert near_sets(words) == want


@pytest.mark.parametrize("letters,longest", [("ab", 12), ("abcdeéÿ", 9), ("a", 40)])
def test_both_directions_find_every_pair_once(letters, longest):
    rng = random.Random(longest)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(7, longest)))
                    for _ in range(1200)})
    every = np.ones(len(words), dtype=bool)
    found = []
    for forward in (True, False):
        asking, other = spelling.near_words(words, every, every, forward, block=100)
        found += list(zip(asking.tolist(), other.tolist()))
    assert len(found) == len(set(found))
    want = near_sets(words)
    assert {(words[a], words[b]) for a, b in found} == {(a, b) for a in want for b in want[a]}


def test_runs_and_typos():
    text = "Straße ÀÉÎÕÜÝß naïveté×÷ħabcdefgh x" + "Y" * 30 + " abc\u0300defghijk \u0100abcdefg"
    lowered = text.encode().translate(spelling._LOWER)
    want = [r.translate(brute.LOWER) for r in RUN.findall(text)]
    assert [r.decode() for r in spelling.runs_of(lowered)] == [r for r in want if len(r) >= 7]
    assert spelling.with_typo("àbc".encode(), 31) == "àc"
    assert spelling.with_typo(b"abc", 32) == "abc"


def test_documents(spark, documents):
    table, texts = documents
    want = grouped(counted(texts))
    assert len(want) > 300
    assert rows(spelling.group(table)) == want


def chain(spark):
    rng = random.Random(9)
    base = "abcdefghij"
    forms = {base: 3000, "abcdefghix": 250, "abcdefgyix": 20, "abcdzfgyix": 2, "abcdefghi": 4,
             "zzzzzzzzz": 5, "zzzzzzzz": 50, "zzzzzzz": 500, "qqqqqqq": 3, "qqqqqqx": 30,
             "qqqqqqy": 30, "short": 99, "onlyonce": 1}
    for _ in range(300):  # words that share one half
        forms["abcde" + "".join(rng.choice("fgh") for _ in range(5))] = rng.randint(2, 30)
    words = [w for w, n in forms.items() for _ in range(n)]
    rng.shuffle(words)
    docs = {i: " ".join(words[i::40]) for i in range(40)} | {40: None, 41: "", 42: "x" * 20_000,
                                                             43: "x" * 20_000}
    return docs


@pytest.mark.parametrize("shard_words", [1_000_000, 37])
def test_chains_ties_and_split_halves(spark, shard_words):
    docs = chain(spark)
    df = frame(spark, list(docs.items()), extra=True).repartition(3)
    want = grouped(counted(docs))
    assert rows(spelling.group(df, shard_words)) == want
    assert want["abcdzfgyix"][1] == "abcdefghij" and want["qqqqqqq"][0] == "qqqqqqx"


def test_odd_texts(spark, odd, odd_rows):
    assert rows(spelling.group(odd)) == grouped(counted(dict(odd_rows)))


def test_null_ids_and_empty_table(spark, empty):
    assert spelling.group(empty).count() == 0
    df = frame(spark, [(None, "something something"), (None, None)])
    assert spelling.group(df).count() == 0

"""Cross-tokenizer alignment against plain Python over whole texts."""

from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import sentencepiece
from frames import frame
from tokenizers import Tokenizer

from floodlens.llm import token_alignment
from floodlens.llm.bpe import byte_letters
from floodlens.llm.queries import _vocabulary

A_PATH, B_PATH = _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "\n", " a ", "a\tb \n c  d\n\n", "日本語 \U0001F600\U0001F9FF x", "a▁b ok",
       "\x00 \x1c y\x85z a\u3000b", "é" * 300 + "\r\n\r\n;\r x", "<|endoftext|> <s></s> <0x41>",
       "it's  'll  don't x   y ", "𝔘𝔫𝔦 n\u0303 ñ\u0301 ก็ \U0001F469\u200d\U0001F469 ካ",
       "a\x1cb !\x1c? \u180e \u200b x\u2028y\u2029 \x0b\x0c z", "x" * 3000, "=" * 777 + "-" * 501,
       "word, word; (word) \"word\" 3.5% a_b ²x² d\u0308. end."]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def aligned(text, models):
    """Token ids of both sides by group; none where the bytes differ."""
    a, b = models
    if not text:
        return []
    letters = byte_letters()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    left = [(i, len(a.id_to_token(i))) for i in ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i)
                      else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if (bytes(letters[c] for i in ids for c in a.id_to_token(i)) != whole
            or b"".join(p for _, p in right) != whole):
        return []
    ends_a = np.cumsum([n for _, n in left]).tolist()
    ends_b = np.cumsum([len(p) for _, p in right]).tolist()
    groups, cuts = [([], [])], set(ends_a) & set(ends_b)
    rest = list(zip(right, ends_b))[::-1]
    for (i, _), end in zip(left, ends_a):
        groups[-1][0].append(i)
        if end in cuts:
            while rest and rest[-1][1] <= end:
                groups[-1][1].append(rest.pop()[0][0])
            groups.append(([], []))
    return groups[:-1]


def expected(texts, models):
    """The rows of the operator for texts by id."""
    groups = {i: aligned(t, models) for i, t in texts.items()}
    links = {i: Counter((x, y) for a, b in g for x in a for y in b) for i, g in groups.items()}
    docs = Counter(pair for found in links.values() for pair in found)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    return {i: (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g),
                links[i].total(),
                sum(n for p, n in links[i].items() if docs[p] == most[p[0]]),
                sum(n * docs[p] for p, n in links[i].items()),
                brute.sha(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b))
                                   for a, b in g)) if g else "") for i, g in groups.items()}


def rows(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_odd_texts(spark, models):
    texts = dict(enumerate(ODD))
    df = frame(spark, list(texts.items()), extra=True).repartition(3)
    found = rows(token_alignment.align(df, A_PATH, B_PATH))
    assert found == expected(texts, models)
    assert sum(1 for r in found.values() if r[0] == 0) == 3  # null, empty, and the piece mark


def test_rows_of_the_fixture(spark, odd, odd_rows, models):
    assert rows(token_alignment.align(odd, A_PATH, B_PATH)) == expected(dict(odd_rows), models)


def test_small_chunks_and_documents(spark, documents, models):
    table, texts = documents
    few = {i: t for i, t in texts.items() if t is not None and len(t) < 1500}
    df = frame(spark, list(few.items())).repartition(5)
    want = expected(few, models)
    assert rows(token_alignment.align(df, A_PATH, B_PATH)) == want
    assert rows(token_alignment.align(df, A_PATH, B_PATH, chunk_bytes=4000)) == want


def test_forgetting_units_changes_nothing(documents):
    texts = [t for t in documents[1].values()][:60]
    known, few = (token_alignment.Aligned(A_PATH, B_PATH, n) for n in (400_000, 50))
    whole = token_alignment.align_texts(known, texts)
    for i, text in enumerate(texts):
        sizes, digests, links = token_alignment.align_texts(few, [text])
        assert sizes[0].tolist() == whole[0][i].tolist() and digests[0] == whole[1][i]
        mine = whole[2][0] == i
        assert links[1].tolist() == whole[2][1][mine].tolist()
        assert links[2].tolist() == whole[2][2][mine].tolist()


def test_wide_groups_are_counted_not_listed(monkeypatch):
    texts = ["x" * 3000, "=" * 777 + "-" * 501, "日本" * 50, "\U0001F9FF" * 40]
    usual = token_alignment.align_texts(token_alignment.Aligned(A_PATH, B_PATH), texts)
    monkeypatch.setattr(token_alignment, "WIDE_GROUP", 0)
    wide = token_alignment.align_texts(token_alignment.Aligned(A_PATH, B_PATH), texts)
    assert usual[1] == wide[1]
    for x, y in zip(usual[2], wide[2]):
        assert x.tolist() == y.tolist()


def test_ragged_spans_are_refined():
    # One character of four bytes in three tokens, whose spans all end at its end; then one more.
    base = np.array([0, 5, 7])
    ends = token_alignment.refined_ends(np.array([5, 5, 5, 7]), np.array([2, 1, 2, 2]),
                                        np.array([0, 0, 0, 1]), base)
    assert ends.tolist() == [2, 3, 5, 7]


def test_empty_table(spark, empty):
    assert token_alignment.align(empty, A_PATH, B_PATH).count() == 0

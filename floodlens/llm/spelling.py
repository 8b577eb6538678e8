"""Spelling variants: words one edit apart, found in an FM-index, and the form each goes back to.

Two words are near if one inserted, deleted or replaced code point makes them equal. The error then
lies in one half of the word and the other half is matched exactly, so two search schemes find all:
the first half exactly and on to the right with one error, or the second half exactly and on to the
left. The index serves both directions: backward search over the delimited vocabulary extends to
the left, over the reversed one to the right. A state of the search is an interval of suffix ranks;
all words of a shard are searched at once, one code point at a time, with numpy.

Words that can meet share a half, so words are dealt to shards by their halves: a word is indexed
under the two halves that a word of any length one off can ask for, and asks under one. Halves that
more words share than a shard holds are split: indexed words go to one part each, questions to all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.words import row_pieces
from floodlens.session import staged

SHORTEST = 7            # code points of a word
LEAST = 2               # occurrences of a word
FACTOR = 10             # how many times more frequent than a word its form is
TYPOS = 31              # a run whose checksum this divides loses a code point
SHARD_WORDS = 120_000
HELD = 400_000          # distinct words a task counts before it sends them
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Runs of a-z and U+00C0 to U+00FF, as UTF-8, of at least SHORTEST code points.
_RUN = re.compile(rb"(?<![a-z\x80-\xbf])(?:[a-z]|\xc3[\x80-\xbf]){%d,}+" % SHORTEST)
_RUN_BEHIND = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


# Words and their counts --------------------------------------------------------------------------

def runs_of(lowered: bytes) -> list[bytes]:
    """Maximal runs of letters with at least SHORTEST code points."""
    if lowered.isascii():
        return _RUN.findall(lowered)
    return [r for r in _RUN_BEHIND.findall(lowered)
            if len(r) >= SHORTEST and len(r) - r.count(b"\xc3") >= SHORTEST]


def with_typo(run: bytes, checksum: int) -> str:
    """The run, without one code point if the checksum says so."""
    word = run.decode()
    if checksum % TYPOS:
        return word
    at = checksum % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): all words of at least SHORTEST code points and LEAST occurrences in `docs`
    (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            words = pa.array(list(found), pa.string())
            counts = pa.array(list(found.values()), pa.int64())
            found.clear()
            return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

        for batch in batches:
            for part, data, offsets in row_pieces(batch, "text"):
                lowered, at = data.tobytes().translate(_LOWER), offsets.tolist()
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), at, at[1:]):
                    start = zlib.crc32(b"%d:" % doc_id)
                    for word, n in Counter(runs_of(lowered[a:b])).items():
                        word = with_typo(word, zlib.crc32(word, start))
                        if len(word) >= SHORTEST:
                            found[word] += n
                if len(found) > HELD:
                    yield sent()
        yield sent()

    rows = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) as doc_id", "text")
    return (rows.mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))


# Index and search --------------------------------------------------------------------------------

class Index:
    """FM-index of `$w0$w1$...$` for distinct words in order; `$` has code 0 and rank before all.

    The rank of a symbol before a row, plus all smaller symbols, is one binary search over the
    (symbol, row) pairs of the transformed text, in order.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, symbols: int) -> None:
        words = len(lengths)
        ends = np.cumsum(lengths + 1)               # place of the delimiter behind each word
        text = np.zeros(int(ends[-1]) + 1 if words else 1, dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[0] = False
        inside[ends] = False
        text[inside] = codes
        # The delimiter before word j has rank j + 1, the last one rank 0; then prefix doubling.
        rank = text + words + 1
        rank[np.append(0, ends)] = np.append(np.arange(1, words + 1), 0)
        step = 1
        while True:
            ahead = np.zeros(len(text), dtype=np.int64)
            ahead[:-step] = rank[step:]
            keys = rank * (rank.max() + 1) + np.where(inside, ahead, 0)
            order = np.argsort(keys, kind="stable")
            new = np.append(False, keys[order][1:] != keys[order][:-1])
            rank = np.empty(len(text), dtype=np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == len(text) - 1 or step >= len(text):
                break
            step *= 2
        self.symbols = symbols
        self.turned = text[order - 1]               # the symbol before each suffix
        self.rows = len(text)
        self.keys = np.sort(self.turned * self.rows + np.arange(self.rows))
        self.delimiters = words + 1

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes with one more symbol in front."""
        base = symbol * self.rows
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def ahead(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol): all letters that stand in front of some suffix of each interval."""
        size = high - low
        small = size <= self.symbols
        few = np.flatnonzero(small)
        of = np.repeat(few, size[few])
        rows = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(size[few]) - size[few],
                                                        size[few])
        pairs = np.unique(of * self.symbols + self.turned[rows])
        many = np.flatnonzero(~small)
        every = (many[:, None] * self.symbols + np.arange(self.symbols)).ravel()
        pairs = np.concatenate([pairs, every])
        state, symbol = pairs // self.symbols, pairs % self.symbols
        return state[symbol > 0], symbol[symbol > 0]

    def near(self, query: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of `query`, word): all words at one edit from words of equal length, whose last
        `exact` symbols are matched as they are. Each pair is found once: of edits that lead to
        the same word, the one furthest to the left counts."""
        length = query.shape[1]
        at = np.arange(len(query))
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.delimiters)
        for t in range(1, exact + 1):
            at, low, high = self._step(query[:, -t], at, low, high)
        once = (at[:0], low[:0], high[:0])          # states with the error behind them
        for t in range(exact + 1, length + 1):
            here = query[:, -t]
            state, symbol = self.ahead(low, high)
            other = symbol != here[at[state]]
            state, symbol = state[other], symbol[other]
            changed = self._found(at[state], *self.extend(low[state], high[state], symbol))
            once = tuple(map(np.concatenate, zip(once, changed)))       # as insertions
            once = self._step(here, *once)
            last = here[at] != query[at, -t - 1] if t < length else np.ones(len(at), bool)
            deleted = (at[last], low[last], high[last])
            once = tuple(map(np.concatenate, zip(once, changed, deleted)))
            at, low, high = self._step(here, at, low, high)
        state, symbol = self.ahead(low, high)
        changed = self._found(at[state], *self.extend(low[state], high[state], symbol))
        once = tuple(map(np.concatenate, zip(once, changed)))
        row, low, _ = self._step(np.zeros(len(query), np.int64), *once)
        return row, low - 1

    def _step(self, symbols: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states that go on with their query's own symbol."""
        return self._found(at, *self.extend(low, high, symbols[at]))

    @staticmethod
    def _found(at: np.ndarray, low: np.ndarray, high: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = high > low
        return at[some], low[some], high[some]


def near_words(words: list[str], asks: np.ndarray, holds: np.ndarray, forward: bool,
               block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(asking, held): places in `words` (distinct, in code point order) of all near pairs whose
    first half is matched exactly (`forward`) or whose second half is and not the first. `asks`
    and `holds` say which words are searched for and which are indexed."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    alphabet, codes = np.unique(codes, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    starts = np.cumsum(lengths) - lengths

    def picked(which: np.ndarray, turn: bool) -> np.ndarray:
        """Codes of some words in a row, each from its end if `turn`."""
        size = lengths[which]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if turn:
            inside = np.repeat(size, size) - 1 - inside
        return codes[np.repeat(starts[which], size) + inside]

    held = np.flatnonzero(holds)
    if forward:  # the reversed words in their own order
        turned = [words[i][::-1] for i in held]
        held = held[sorted(range(len(held)), key=turned.__getitem__)]
    index = Index(picked(held, forward), lengths[held], len(alphabet) + 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for length in np.unique(lengths[asks]).tolist():
        every = np.flatnonzero(asks & (lengths == length))
        first = length // 2
        for i in range(0, len(every), block):
            which = every[i:i + block]
            query = picked(which, forward).reshape(len(which), length)
            row, word = index.near(query, first if forward else length - first)
            asking, other = which[row], held[word]
            if not forward:  # the first halves differ, else the other direction has the pair
                fits = lengths[other] >= first
                same = np.zeros(len(other), dtype=bool)
                both = codes[starts[other[fits]][:, None] + np.arange(first)] == \
                    codes[starts[asking[fits]][:, None] + np.arange(first)]
                same[fits] = both.all(axis=1)
                asking, other = asking[~same], other[~same]
            found.append((asking, other))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


_ANSWERS = "word string, n long, n_near long, form string, form_n long"


def _search(shard: pa.Table) -> pa.Table:
    """Near words of the asking words of a shard: their number, and the most frequent one."""
    table = shard.group_by("word").aggregate(
        [("n", "max"), ("asks", "max"), ("holds", "max")]).sort_by("word")
    words, n = table.column("word").to_pylist(), table.column("n_max").to_numpy()
    asks = table.column("asks_max").to_numpy().astype(bool)
    asking, other = near_words(words, asks, table.column("holds_max").to_numpy().astype(bool),
                               shard.column("side")[0].as_py() == 0)
    order = np.lexsort((other, -n[other], asking))
    asking, other = asking[order], other[order]
    first = np.flatnonzero(np.append(True, asking[1:] != asking[:-1])[:len(asking)])
    best = np.full(len(words), -1)
    best[asking[first]] = other[first]
    counts = np.bincount(asking, minlength=len(words))
    which = np.flatnonzero(asks)
    none = best[which] < 0
    pick = pa.array(best[which], mask=none)
    column = table.column("word").combine_chunks()
    return pa.table({"word": column.take(pa.array(which)), "n": n[which],
                     "n_near": counts[which], "form": column.take(pick),
                     "form_n": pa.array(n).take(pick)})


def near_counts(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row of `words` (word, n): word, n, n_near, form and form_n, the most frequent near
    word, ties to the smallest."""
    half = F.expr("cast(length(word) div 2 as int)")
    keyed = []
    for side in (0, 1):
        # A word asks under its half; words one code point shorter or longer ask under the next.
        own = half if side == 0 else F.length("word") - half
        odd = F.length("word") % 2 == 1
        if side == 0:
            next_ = F.when(odd, half + 1).otherwise(half - 1)
        else:
            next_ = F.when(odd, own - 1).otherwise(own + 1)
        for size, asks in ((own, 1), (next_, 0)):
            key = (F.expr("word").substr(F.lit(1), size) if side == 0
                   else F.expr("word").substr(F.length("word") - size + 1, size))
            keyed.append(words.select("word", "n", F.lit(side).alias("side"), key.alias("key"),
                                      F.lit(asks).alias("asks"), F.lit(1).alias("holds")))
    rows = keyed[0].unionByName(keyed[1]).unionByName(keyed[2]).unionByName(keyed[3])
    count = words.count()
    shards = max(1, math.ceil(4 * count / shard_words))
    hot = staged(rows.groupBy("side", "key").count().where(F.col("count") > shard_words)
                 .select("side", "key", F.ceil(F.col("count") / shard_words).cast("int")
                         .alias("parts")), "spelling-hot")
    if not hot.isEmpty():
        rows = rows.join(hot, ["side", "key"], "left").withColumn(
            "parts", F.coalesce("parts", F.lit(1)))
        mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
        other = rows.where("asks = 1 and parts > 1").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(
            F.col("part") != mine).withColumn("holds", F.lit(0))
        # A part is a shard of its own: none of its words is there under another half too.
        rows = rows.withColumn("part", mine).unionByName(other).withColumn(
            "part", F.when(F.col("parts") > 1, F.concat_ws(":", "part", "key")))
    else:
        rows = rows.withColumn("part", F.lit(None).cast("string"))
    shard = F.pmod(F.xxhash64("side", "key"), F.lit(shards)).cast("string")
    rows = rows.withColumn("shard", F.coalesce("part", shard))
    answers = rows.select("side", "shard", "word", "n", "asks", "holds").repartition(
        2 * shards, "side", "shard").groupBy("side", "shard").applyInArrow(_search, _ANSWERS)
    best = F.min(F.when(F.col("form").isNotNull(),
                        F.struct((-F.col("form_n")).alias("less"), "form")))
    return answers.groupBy("word", "n").agg(
        F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n", "n_near", F.col("best.form").alias("form"),
        (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last. A form is FACTOR times more
    frequent than its word, so chains are short; each round doubles how far a root is."""
    known = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = known.join(ahead, "root")
        if further.isEmpty():
            return known
        known = staged(known.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def group(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per word of `docs` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, some with a typo that the
    document's id decides on; those with at least SHORTEST code points and LEAST occurrences
    count. A word's form is its most frequent near word if that is FACTOR times as frequent, else
    null; its root is where the forms lead, or the word itself. Rows with a null id and null or
    empty texts have no words; repeated rows count each; other columns play no part; an empty
    table gives an empty result.
    """
    words = staged(word_counts(docs), "spelling-words")
    enough = F.col("form_n") >= FACTOR * F.col("n")
    found = staged(near_counts(words, shard_words).select(
        "word", "n", "n_near", F.when(enough, F.col("form")).alias("form"),
        F.when(enough, F.col("form_n")).alias("form_n")), "spelling-near")
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

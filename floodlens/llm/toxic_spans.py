"""Toxicity: a linear-chain conditional random field tags toxic words, and its marginals give the
offending offsets and the score of a document.

Labels say which documents are toxic, not which words. Words are labelled from them first: a word
(or the beginning of a word) is a mark of toxic documents if it stands there in many different
surroundings and far more often than elsewhere. Copies of a document share their surroundings, so
a group of copies is no evidence. These statistics cover all labelled documents.

The field has two tags. Its features are the word, how it begins and ends, and its neighbours,
hashed into one table of weights; it is fitted by its gradient on a bounded sample of segments
(`sample_words` words of each label). Forward and backward vectors of a whole batch of texts come
from a scan over two-by-two matrices, in which a text's first word cuts off what is before it.

A document's highest marginal and the expected number of its toxic words go into a logistic
function fitted on labelled documents (about `sample_rows`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.llm.sampling import hashed_sample
from floodlens.llm.words import _lower_value, mix, row_pieces, signed, span_hashes, words_of
from floodlens.session import staged

THRESHOLD = 0.7
SAMPLE_WORDS = 200_000      # words of either label that the field is fitted on
SAMPLE_ROWS = 40_000        # documents that the scores are calibrated on
SEGMENT = 256               # words of a segment of the sample
BITS = 18                   # weights of the field: 2 ** BITS
BEGINNINGS = (4, 5, 6)      # code points of the beginnings of words that statistics look at
SURROUNDINGS = 5            # different ones that a mark of toxic documents has at least
SURE = 3.0                  # by how much its evidence exceeds that of the best of as many words
STEPS = 60
PIECE_BYTES = 3 << 19      # text whose words are in memory at once
_FILTER_BITS = 22
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# Words and their features ------------------------------------------------------------------------

@dataclass
class Tokens:
    """Words of some rows without the marks around them: spans in bytes and characters, hashes of
    the words and of their beginnings, and the first word of each row (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    char_starts: np.ndarray
    char_ends: np.ndarray
    word: np.ndarray
    beginnings: list[np.ndarray]
    ending: np.ndarray
    first: np.ndarray

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The words before and after each word of the same row, else zero."""
        before = np.append(np.uint64(0), self.word)[:-1]
        after = np.append(self.word, np.uint64(0))[1:]
        inner = self.first[(self.first > 0) & (self.first < len(self.word))]
        before[inner] = 0
        after[inner - 1] = 0
        return before, after

    def units(self) -> np.ndarray:
        """[word, kind]: what statistics are kept of."""
        kinds = [self.word, *self.beginnings]
        return np.stack([mix(h + np.uint64(k)) for k, h in enumerate(kinds)], axis=1)

    def features(self) -> np.ndarray:
        """[word, feature]: places in the table of weights; place 0 is every word's."""
        before, after = self.neighbours()
        kinds = [self.word, *self.beginnings, self.ending, before, after]
        table = np.zeros((len(self.word), len(kinds) + 1), dtype=np.int64)
        for k, hashes in enumerate(kinds):
            table[:, k + 1] = mix(hashes + np.uint64(101 + k)) >> np.uint64(64 - BITS)
        return table


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """The words of rows data[offsets[i]:offsets[i + 1]]."""
    words = words_of(data, offsets)
    starts, ends = words.starts, words.ends
    place = np.arange(len(data))
    ahead = np.minimum.accumulate(np.where(_PLAIN[data], place, len(data))[::-1])[::-1]
    behind = np.maximum.accumulate(np.where(_PLAIN[data], place, -1))
    if len(starts):
        core = ahead[starts] < ends  # a word of marks alone stays as it is
        starts, ends = (np.where(core, ahead[starts], starts),
                        np.where(core, behind[ends - 1] + 1, ends))
    lead = (data & 0xC0) != 0x80
    letters = np.append(np.flatnonzero(lead), len(data))
    number = np.append(0, np.cumsum(lead))
    row_chars = number[offsets[:-1]][words.row_of()] if len(starts) else number[:0]
    values = _lower_value[data]

    def cut(size: int) -> np.ndarray:
        return np.minimum(letters[np.minimum(number[starts] + size, len(letters) - 1)], ends)

    tail = np.maximum(letters[np.maximum(number[ends] - 3, 0)], starts)
    return Tokens(starts, ends, number[starts] - row_chars, number[ends] - row_chars,
                  span_hashes(values, starts, ends),
                  [span_hashes(values, starts, cut(size)) for size in BEGINNINGS],
                  span_hashes(values, tail, ends), words.first)


# The field ---------------------------------------------------------------------------------------

def _sequential(m: np.ndarray) -> np.ndarray:
    out = np.empty((2, m.shape[1]))
    a, b = 0.5, 0.5
    for t, (m00, m01, m10, m11) in enumerate(m.T.tolist()):
        a, b = a * m00 + b * m10, a * m01 + b * m11
        total = a + b
        a, b = a / total, b / total
        out[0, t], out[1, t] = a, b
    return out


def scan(m: np.ndarray, step: int = 64) -> np.ndarray:
    """Row vectors v[t] = v[t - 1] M[t], each scaled to sum one, from v = (1/2, 1/2) on, for
    matrices m[:, t] = (M00, M01, M10, M11). Runs of `step` matrices are multiplied side by side,
    the products scanned in turn, and the runs gone through from where each begins."""
    n = m.shape[1]
    if n <= 4 * step:
        return _sequential(m)
    runs = -(-n // step)
    padded = np.zeros((4, runs * step))
    padded[0], padded[3] = 1, 1
    padded[:, :n] = m
    by_time = np.ascontiguousarray(padded.reshape(4, runs, step).transpose(2, 0, 1))
    p = by_time[0].copy()
    for m00, m01, m10, m11 in by_time[1:]:
        p = np.stack([p[0] * m00 + p[1] * m10, p[0] * m01 + p[1] * m11,
                      p[2] * m00 + p[3] * m10, p[2] * m01 + p[3] * m11])
        p /= p.sum(axis=0)
    v = np.concatenate([np.full((2, 1), 0.5), scan(p, step)[:, :-1]], axis=1)
    out = np.empty((step, 2, runs))
    for t, (m00, m01, m10, m11) in enumerate(by_time):
        v = np.stack([v[0] * m00 + v[1] * m10, v[0] * m01 + v[1] * m11])
        v /= v.sum(axis=0)
        out[t] = v
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


@dataclass
class Field:
    """Weights of features for the toxic tag, of moves between tags, and of the first tag."""

    weights: np.ndarray
    move: np.ndarray
    first: np.ndarray

    @staticmethod
    def untrained() -> Field:
        weights = np.zeros(1 << BITS)
        weights[0] = -5
        return Field(weights, np.zeros((2, 2)), np.zeros(2))

    def marginals(self, features: np.ndarray, begins: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the toxic tag of every word, and of each pair of tags [2, 2, word] of a
        word and the one before it. `begins` marks the first word of each text."""
        toxic = np.exp(np.clip(self.weights[features].sum(axis=1), -30, 30))
        move, first = np.exp(self.move), np.exp(self.first)
        m = np.empty((4, len(toxic)))
        m[0] = np.where(begins, first[0], move[0, 0])
        m[1] = np.where(begins, first[1], move[0, 1]) * toxic
        m[2] = np.where(begins, first[0], move[1, 0])
        m[3] = np.where(begins, first[1], move[1, 1]) * toxic
        alpha = scan(m)
        beta = np.full((2, len(toxic)), 0.5)
        beta[:, :-1] = scan(m[[0, 2, 1, 3]][:, ::-1])[:, ::-1][:, 1:]
        both = alpha * beta
        before = np.concatenate([np.full((2, 1), 0.5), alpha[:, :-1]], axis=1)
        pairs = before[:, None] * m.reshape(2, 2, -1) * beta[None]
        return both[1] / both.sum(axis=0), pairs / pairs.sum(axis=(0, 1))


def gradient(field: Field, features: np.ndarray, begins: np.ndarray, tags: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log likelihood of the tags: observed less expected features, moves, first tags."""
    toxic, pairs = field.marginals(features, begins)
    rest = np.repeat(tags - toxic, features.shape[1])
    weights = np.bincount(features.ravel(), rest, len(field.weights))
    later = np.flatnonzero(~begins)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[later - 1].astype(int), tags[later].astype(int)), 1)
    first = (tags - toxic)[begins].sum()
    return weights, seen - pairs[:, :, later].sum(axis=2), np.array([-first, first])


def fit_field(features: np.ndarray, begins: np.ndarray, tags: np.ndarray, steps: int = STEPS,
              rate: float = 0.2, shrink: float = 0.1) -> Field:
    """Field for tagged words, by steps along the gradient with a scale of its own per weight."""
    field = Field.untrained()
    if not len(tags):
        return field
    parts = [field.weights, field.move, field.first]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        found = gradient(field, features, begins, tags)
        for part, g, m, s in zip(parts, found, mean, square):
            g = g - shrink * part
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            part += rate * (m / (1 - 0.9 ** step)) / (
                np.sqrt(s / (1 - 0.98 ** step)) + 1e-3)
    return field


# Words of toxic documents --------------------------------------------------------------------------

_SPLIT = r"[^\x20\x09-\x0D]+"


def _words_in(rows: DataFrame) -> int:
    """Words of all rows (text)."""
    return rows.agg(F.sum(F.regexp_count("text", F.lit(_SPLIT)))).first()[0] or 0


def _unit_rows(rows: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(unit, n, mask) of `rows` (text): occurrences, and 64 bits marked by the surroundings.
    Units that `wanted` (bits of a filter) does not have are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in row_pieces(batch, "text", PIECE_BYTES):
                tokens = tokens_of(data, offsets)
                units = tokens.units()
                before, after = tokens.neighbours()
                bit = np.uint64(1) << (mix(before * np.uint64(3) + after) >> np.uint64(58))
                flat, bits = units.ravel(), np.repeat(bit, units.shape[1])
                if wanted is not None:
                    keep = wanted[(flat >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
                    flat, bits = flat[keep], bits[keep]
                order = np.argsort(flat, kind="stable")
                flat, bits = flat[order], bits[order]
                at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[:len(flat)])
                counts = np.diff(np.append(at, len(flat)))
                masks = np.bitwise_or.reduceat(bits, at) if len(at) else bits
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(flat[at])), pa.array(counts), pa.array(signed(masks))],
                    names=["unit", "n", "mask"])

    return (rows.select("text").mapInArrow(run, "unit long, n long, mask long")
            .groupBy("unit").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask")))


def marks(labelled: DataFrame) -> DataFrame:
    """(unit): the words and beginnings of words that mark the toxic rows of `labelled` (text,
    label)."""
    toxic, clean = labelled.where("label = 1"), labelled.where("label = 0")
    many = staged(_unit_rows(toxic).where(F.bit_count("mask") >= SURROUNDINGS), "toxic-units")
    # A filter of fixed size keeps most other units of the clean rows out of the shuffle.
    slot = F.shiftrightunsigned("unit", 64 - _FILTER_BITS).cast("int")
    wanted = np.zeros(1 << _FILTER_BITS, dtype=bool)
    wanted[many.select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    elsewhere = _unit_rows(clean, wanted).select("unit", F.col("n").alias("elsewhere"))
    words, others = _words_in(toxic), _words_in(clean)
    share = F.col("n") / (F.col("n") + F.coalesce("elsewhere", F.lit(0)))
    evidence = F.bit_count("mask") * F.log(share * (words + others + 2) / (words + 1))
    return (many.join(elsewhere, "unit", "left")
            .where((share >= 0.5) & (evidence >= math.log(words + 1) + SURE)).select("unit"))


# Fitting and scoring -------------------------------------------------------------------------------

def _segments(labelled: DataFrame, sample_words: int) -> DataFrame:
    """(text): segments of the rows of `labelled` (doc_id, text, label), about `sample_words`
    words of either label, chosen by a hash; label as it is."""
    part = {label: min(1.0, sample_words / max(1, _words_in(labelled.where(f"label = {label}"))))
            for label in (0, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in row_pieces(batch, "text", PIECE_BYTES):
                words = words_of(data, offsets)
                ids = rows.column("doc_id").to_numpy().astype(np.uint64)
                labels = rows.column("label").to_numpy()
                limit = np.array([part[x] for x in labels.tolist()]) * 2.0 ** 32
                counts = -(-np.diff(words.first) // SEGMENT)
                row = np.repeat(np.arange(len(ids)), counts)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                key = mix(mix(ids[row]) + inside.astype(np.uint64)) >> np.uint64(32)
                take = np.flatnonzero(key < limit[row])
                begin = words.first[row[take]] + inside[take] * SEGMENT
                end = np.minimum(begin + SEGMENT, words.first[row[take] + 1])
                texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(
                    words.starts[begin].tolist(), words.ends[end - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(row[take])), pa.array(inside[take]),
                     pa.array(labels[row[take]]), pa.array(texts, pa.string())],
                    names=["doc_id", "number", "label", "text"])

    return labelled.mapInArrow(run, "doc_id long, number long, label int, text string")


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return (np.frombuffer(b"".join(raw), dtype=np.uint8),
            np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def _begins(first: np.ndarray, words: int) -> np.ndarray:
    begins = np.zeros(words, dtype=bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    return begins


def fit(labelled: DataFrame, sample_words: int = SAMPLE_WORDS) -> Field:
    """Field for `labelled` (doc_id, text, label)."""
    sample = staged(_segments(labelled, sample_words), "toxic-sample")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in row_pieces(batch, "text", PIECE_BYTES):
                found = np.unique(tokens_of(data, offsets).units())
                yield pa.RecordBatch.from_arrays([pa.array(signed(found))], names=["unit"])

    occurring = sample.where("label = 1").select("text").mapInArrow(units, "unit long").distinct()
    marked = marks(labelled).join(occurring, "unit").toPandas()["unit"].to_numpy(np.int64)
    rows = sample.toPandas().sort_values(["doc_id", "number", "text"])
    tokens = tokens_of(*_flat(rows["text"].tolist()))
    label = rows["label"].to_numpy()[np.repeat(np.arange(len(rows)), np.diff(tokens.first))]
    hit = np.isin(signed(tokens.units()), marked).any(axis=1)
    return fit_field(tokens.features(), _begins(tokens.first, len(tokens.word)),
                     (hit & (label == 1)).astype(np.float64))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                             ("probability", pa.float64())]))
_TAGGED = ("doc_id long, held_out boolean, n_words long, highest double, expected double, "
           "spans array<struct<start: long, end: long, probability: double>>")


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of `docs` (doc_id, held_out, text): doc_id, held_out, n_words, highest (marginal of
    a word), expected (number of toxic words), spans (runs of words with a marginal from one half
    up: first code point, the one behind the last, highest marginal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in row_pieces(batch, "text", PIECE_BYTES):
                tokens = tokens_of(data, offsets)
                sizes = np.diff(tokens.first)
                begins = _begins(tokens.first, len(tokens.word))
                toxic = (field.marginals(tokens.features(), begins)[0] if len(begins)
                         else np.empty(0))
                highest, expected = np.zeros(len(sizes)), np.zeros(len(sizes))
                some = np.flatnonzero(sizes)
                if len(some):
                    at = tokens.first[:-1][some]
                    highest[some] = np.maximum.reduceat(toxic, at)
                    expected[some] = np.add.reduceat(toxic, at)
                on = toxic >= 0.5
                opens = np.flatnonzero(on & (begins | ~np.append(False, on)[:-1]))
                ends_text = np.append(begins, True)[1:] if len(begins) else begins
                closes = np.flatnonzero(on & (ends_text | ~np.append(on, False)[1:]))
                peaks = [float(toxic[a:b + 1].max()) for a, b in zip(opens, closes)]
                spans = pa.StructArray.from_arrays(
                    [pa.array(tokens.char_starts[opens]), pa.array(tokens.char_ends[closes]),
                     pa.array(peaks, pa.float64())], names=["start", "end", "probability"])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(opens, tokens.first).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(sizes),
                     pa.array(highest), pa.array(expected), lists.cast(_SPANS)],
                    names=["doc_id", "held_out", "n_words", "highest", "expected", "spans"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _TAGGED)


def logistic(x: np.ndarray, label: np.ndarray, shrink: float = 0.1) -> np.ndarray:
    """Weights of the columns of `x` and, last, of one, by Newton's method. Without rows zero."""
    x = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    for _ in range(30 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (label - p) - shrink * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(weights))
        weights = weights + np.linalg.solve(bend, slope)
    return weights


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label): ids with one label; null ids and other labels take no part."""
    return (labels.where("toxic in (0, 1) and doc_id is not null")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").alias("high"))
            .where("label = high").select("doc_id", "label"))


def score(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD,
          sample_words: int = SAMPLE_WORDS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` up),
    n_words, and the columns of `tag`.

    `held_out` is a condition on doc_id; labels of such documents are not learned from, and it is
    false for a null id. A null text is empty and scored like a text without toxic words; repeated
    rows are scored one by one; other columns of `docs` play no part. Without labels every score
    is one half.
    """
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text")
    held = F.coalesce(held_out, F.lit(False))
    known = known_labels(labels)
    labelled = staged(rows.where(~held & F.col("doc_id").isNotNull()).join(
        known.hint("merge"), "doc_id"), "toxic-labelled")
    field = fit(labelled, sample_words)
    tagged = staged(tag(rows.withColumn("held_out", held), field), "toxic-tagged")
    sample = hashed_sample(tagged.where("not held_out").join(
        known.hint("merge"), "doc_id"), "doc_id", ["highest", "expected", "label"], sample_rows)

    def evidence(highest: np.ndarray, expected: np.ndarray) -> np.ndarray:
        p = np.clip(highest, 1e-5, 1 - 1e-5)
        return np.column_stack([np.log(p / (1 - p)) / 4, np.log1p(expected)])

    weights = logistic(evidence(sample["highest"].to_numpy(np.float64),
                                sample["expected"].to_numpy(np.float64)),
                       sample["label"].to_numpy(np.float64)).tolist()
    p = F.least(F.greatest("highest", F.lit(1e-5)), F.lit(1 - 1e-5))
    odds = (weights[0] * F.log(p / (1 - p)) / 4 + weights[1] * F.log1p("expected") + weights[2])
    return (tagged.withColumn("score", 1 / (1 + F.exp(-odds)))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "n_words", "highest", "expected",
                    "spans"))

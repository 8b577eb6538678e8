"""Hidden Markov language model, trained by Baum-Welch and scored by the forward recursion.

A text is its words, A-Z lower-cased, and one end token. Latent states emit word classes (a fixed
number of hash classes, the end among them), and a class emits its words by their counts:

    P(text) = sum over paths of  pi(z1) prod A(z, z') B(z, class(w)) * (c(w) + 1) / N(class)

where N(class) also leaves room for one unseen word. Word counts come from all training texts.
The states are trained on all training texts as well: each partition runs forward and backward
over its texts and sends its expected counts, which Spark adds up; a round needs no more of the
driver than the two small tables. So that long and short texts are worked on side by side, texts are
cut into segments. A segment is run through with `OVERLAP` more tokens on either side, which carry the
state across the cut but are counted by their own segment: every move is counted once, and first
states only where a text begins.

For scoring, texts are dealt to buckets of bounded size, and a bucket is given the counts of the
words that occur in it. No table of all words is ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.llm.documents import one_per_id
from floodlens.llm.words import mix, row_pieces, signed, words_of
from floodlens.session import staged

STATES = 6
STAY = 0.95         # probability of keeping a state, to start training with
CLASSES = 1024      # word classes; the end token has one more of its own
ROUNDS = 5
SEGMENT = 224
OVERLAP = 32
PIECE_BYTES = 3 << 20
_STEPS = 1 << 16    # expected counts travel as whole numbers of this fraction
BUCKET_BYTES = 24 << 20
_END = np.uint64(0x5851F42D4C957F2D)  # stands for the end token among word hashes


@dataclass(frozen=True)
class Model:
    """First-state, transition and class probabilities."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def untrained(states: int, classes: int) -> Model:
        """States that tend to stay, each with its own fixed preferences among the classes."""
        spread = mix(np.arange(1, states * classes + 1, dtype=np.uint64)) / 2.0 ** 64
        emit = 0.1 + 1.8 * spread.reshape(states, classes)
        move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
        np.fill_diagonal(move, STAY if states > 1 else 1)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def classes_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    """Class of every token hash; the end token has the last one."""
    return np.where(hashes == _END, classes, (hashes >> np.uint64(7)) % np.uint64(classes)
                    ).astype(np.int64)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of rows, an end token after each, and where each row begins (one more)."""
    words = words_of(data, offsets, lower=True)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], _END, dtype=np.uint64)
    out[np.arange(len(words.hashes)) + words.row_of()] = words.hashes
    return out, first


# Training --------------------------------------------------------------------------------------

def expected_counts(model: Model, classes: np.ndarray, first: np.ndarray, segment: int,
                    overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, moves and emissions of rows of tokens, cut into segments. Where a
    segment and the overlap begin inside a text, states are as likely as they are in the long
    run."""
    states = len(model.first)
    sizes = np.diff(first)
    parts = -(-sizes // segment)
    row = np.repeat(np.arange(len(sizes)), parts)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[row] + inside * segment
    end = np.minimum(begin + segment, first[row + 1])
    start = np.maximum(begin - overlap, first[row])
    length = np.minimum(end + overlap, first[row + 1]) - start
    order = np.argsort(-length, kind="stable")
    row, begin, end, start, length = (x[order] for x in (row, begin, end, start, length))
    initial, moves = np.zeros(states), np.zeros((states, states))
    emissions = np.zeros((model.emit.shape[1], states))
    if not len(start):
        return initial, moves, emissions.T
    opens = start == first[row]
    low, high = begin - start, end - start  # the segment's own tokens
    prior = np.where(opens[:, None], model.first, _long_run(model.move))
    table = np.ascontiguousarray(model.emit.T)
    live = [int(np.searchsorted(-length, -t)) for t in range(int(length[0]))]  # longer than t
    alphas, seen = [], []
    for t, n in enumerate(live):
        at = classes[start[:n] + t]
        alpha = table[at] * (prior if t == 0 else alphas[-1][:n] @ model.move)
        alpha /= alpha.sum(axis=1, keepdims=True)
        alphas.append(alpha)
        seen.append(at)
    beta = np.ones((len(start), states))
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        own = ((low[:n] <= t) & (t < high[:n])).astype(np.float64)[:, None]
        gamma = alphas[t] * beta[:n]
        gamma *= own / gamma.sum(axis=1, keepdims=True)
        for k in range(states):
            emissions[:, k] += np.bincount(seen[t], gamma[:, k], len(emissions))
        if t == 0:
            initial += gamma[opens[:n]].sum(axis=0)
            break
        # Both ends of each move into place t, scaled so that its expected count sums to one.
        ahead = table[seen[t]] * beta[:n]
        back = ahead @ model.move.T
        scale = (alphas[t - 1][:n] * back).sum(axis=1, keepdims=True)
        moves += alphas[t - 1][:n].T @ (ahead * (own / scale)) * model.move
        beta[:n] = back / scale
    return initial, moves, emissions.T


def _long_run(move: np.ndarray) -> np.ndarray:
    """Share of each state after many moves."""
    share = np.full(len(move), 1 / len(move))
    for _ in range(200):
        share = share @ move
    return share / share.sum()


def train(docs: DataFrame, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS,
          segment: int = SEGMENT, overlap: int = OVERLAP) -> Model:
    """Baum-Welch over all rows of `docs` (text)."""
    model = Model.untrained(states, classes + 1)
    shape = (states, states + 1 + classes + 1)

    for _ in range(rounds):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape)
            for batch in batches:
                for _, data, offsets in row_pieces(batch, "text", PIECE_BYTES):
                    tokens, first = tokens_of(data, offsets)
                    initial, moves, emissions = expected_counts(
                        now, classes_of(tokens, classes), first, segment, overlap)
                    sums += np.concatenate([initial[:, None], moves, emissions], axis=1)
            # Whole numbers have the same sum in whatever order they come.
            steps = np.rint(sums.ravel() * _STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(sums.size)), pa.array(steps)], names=["cell", "value"])

        found = (docs.select("text").mapInArrow(run, "cell long, value long")
                 .groupBy("cell").agg(F.sum("value").alias("value")).toPandas())
        sums = np.zeros(states * shape[1])
        sums[found["cell"]] = found["value"] / _STEPS
        initial, moves, emissions = np.split(sums.reshape(shape), [1, 1 + states], axis=1)
        initial, moves, emissions = initial[:, 0] + 0.1, moves + 0.1, emissions + 0.01
        model = Model(initial / initial.sum(), moves / moves.sum(1, keepdims=True),
                      emissions / emissions.sum(1, keepdims=True))
    return model


def forward(model: Model, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of the classes of each row: the scaled forward recursion, all rows one
    token at a time, the longest rows first."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    start, sizes = first[:-1][order], sizes[order]
    table = np.ascontiguousarray(model.emit.T)
    logs = np.zeros(len(start))
    alpha = np.zeros((len(start), len(model.first)))
    live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0))
    for t, n in enumerate(live.tolist()):
        alpha = table[classes[start[:n] + t]] * (model.first if t == 0
                                                 else alpha[:n] @ model.move)
        total = alpha.sum(axis=1, keepdims=True)
        alpha /= total
        logs[:n] += np.log10(total[:, 0])
    out = np.empty(len(start))
    out[order] = logs
    return out


# Counting and scoring ----------------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(token, known): how often each token occurs in `docs` (text). Repeats are added up before
    they leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in row_pieces(batch, "text", 8 << 20):
                values, counts = np.unique(tokens_of(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)],
                                                 names=["token", "known"])

    return (docs.select("text").mapInArrow(run, "token long, known long")
            .groupBy("token").agg(F.sum("known").alias("known")))


def _bucket_words(rows: DataFrame) -> DataFrame:
    """(bucket, token): the distinct tokens of every bucket."""

    def run(texts: pa.Table) -> pa.Table:
        found = []
        for batch in texts.to_batches():
            for _, data, offsets in row_pieces(batch, "text"):
                found.append(np.unique(tokens_of(data, offsets)[0]))
        tokens = np.unique(np.concatenate(found))
        bucket = texts.column("bucket")[0].as_py()
        return pa.table({"bucket": np.full(len(tokens), bucket), "token": signed(tokens)})

    return rows.groupBy("bucket").applyInArrow(run, "bucket long, token long")


def score(docs: DataFrame, held_out: Column, states: int = STATES, classes: int = CLASSES,
          rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per distinct doc_id: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigram), score (the model's log10 probability of the text).

    `held_out` is a condition on doc_id; such texts are not learned from. A null or empty text is
    the end token alone; rows with a null id take no part; of rows with the same id the one with
    the smallest text counts. Other columns play no part. An empty table gives an empty result.
    """
    rows = one_per_id(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    training = rows.where("not held_out").select("text")
    model = train(training, states, classes, rounds)
    counts = staged(word_counts(training), "lm-counts")

    end = int(signed(np.array([_END]))[0])
    of_class = counts.select("known", F.when(F.col("token") == end, classes).otherwise(
        F.pmod(F.shiftrightunsigned("token", 7), F.lit(classes))).alias("class")
    ).groupBy("class").agg(F.sum("known").alias("tokens"), F.count("*").alias("types")).toPandas()
    total, distinct = int(of_class["tokens"].sum()), int(of_class["types"].sum())
    room = np.ones(classes + 1)  # every word of a class and one unseen word, once beyond its count
    room[of_class["class"]] += of_class["tokens"] + of_class["types"]

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    given = _bucket_words(dealt).join(counts, "token").select("bucket", "token", "known")
    return _scored(dealt, given, model, classes, room, total, distinct)


def _scored(rows: DataFrame, given: DataFrame, model: Model, classes: int, room: np.ndarray,
            total: int, distinct: int) -> DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("token").to_numpy())
        sorted_tokens = known.column("token").to_numpy()[order]
        sorted_counts = known.column("known").to_numpy()[order]
        out: list[pa.RecordBatch] = []
        for batch in texts.to_batches():
            for part, data, offsets in row_pieces(batch, "text", 8 << 20):
                tokens, first = tokens_of(data, offsets)
                key = signed(tokens)
                count = np.zeros(len(key), dtype=np.int64)
                if len(sorted_tokens):
                    at = np.minimum(np.searchsorted(sorted_tokens, key), len(sorted_tokens) - 1)
                    count = np.where(sorted_tokens[at] == key, sorted_counts[at], 0)
                of = classes_of(tokens, classes)

                def per_row(values: np.ndarray, first: np.ndarray = first) -> np.ndarray:
                    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else values[:0]

                word = np.where(of == classes, 0, np.log10((count + 1) / room[of]))
                base = np.log10((count + 1) / (total + distinct + 1))
                sizes = np.diff(first)
                out.append(pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(sizes),
                     pa.array(per_row((count > 0).astype(np.int64))),
                     pa.array(np.full(len(sizes), total)), pa.array(per_row(base)),
                     pa.array(per_row(word) + forward(model, of, first))], names=names))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()),
                            ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                            ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                            ("score", pa.float64())])
        return pa.Table.from_batches(out, schema)

    return (rows.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double"))

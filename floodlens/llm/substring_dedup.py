"""Exact substring dedup across documents by level-wise doubling of repeated windows.

Words covered by a window of `window` words are removed if the same words in a row also start in a
document with a smaller id. Windows are found level by level: the lengths double up to `window`,
and only places where all windows of one length inside are repeated in another document are
extended to twice that length.

At the first level not every place is looked at: of any run of places that a window of the next
length spans, the one with the smallest hash is enough, as both copies of a repeated passage pick
the same one. Documents that repeat a whole earlier document are settled before. Windows are
compared by 128-bit hashes of their words; only hashes travel, and texts of documents that still
have candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.documents import one_per_id
from floodlens.llm.words import (
    Words,
    row_pieces,
    signed,
    span_hashes,
    window_hashes,
    words_of,
)
from floodlens.session import staged

WINDOW = 50
SHORTEST = 20


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths, each at most twice the one before it, up to `window`."""
    out = [window]
    while out[0] // 2 >= shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def _window_minima(hashes: np.ndarray, row: np.ndarray, span: int) -> np.ndarray:
    """Places that hold the smallest (of equals the first) of `span` hashes in a row, ascending."""
    if len(hashes) < span:
        return np.empty(0, dtype=np.int64)
    best = np.arange(len(hashes))  # place of the smallest hash in [i, i + width)
    width = 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(hashes[right] < hashes[left], right, left)
        width += step
    found = np.zeros(len(hashes), dtype=bool)
    found[best[row[:len(best)] == row[span - 1:]]] = True
    return np.flatnonzero(found)


def _starts(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place where `size` words of one row follow, and its row."""
    row = words.row_of()
    if len(row) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(row[size - 1:] == row[:len(row) - size + 1])
    return at, row[at]


def _lists(row: np.ndarray, rows: int, values: np.ndarray) -> pa.ListArray:
    """Values grouped by ascending row."""
    counts = np.bincount(row, minlength=rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                    pa.array(values))


def _scan(docs: DataFrame, window: int, first: int, following: int) -> DataFrame:
    """Per document: its words' number, hashes and digest, and the first level's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_pieces(batch, "text"):
                words = words_of(data, offsets)
                begin, end = words.first[:-1], words.first[1:]
                at, row = _starts(words, first)
                hashes = window_hashes(words.hashes, at, first)
                picked = _window_minima(hashes, row, following - first + 1)
                picked = picked[(end - begin)[row[picked]] >= window]
                flat, edges = data.tobytes(), offsets.tolist()
                digests = [hashlib.sha256(b" ".join(flat[a:b].split())).hexdigest()
                           for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(end - begin),
                     pa.array(signed(span_hashes(words.hashes, begin, end))),
                     pa.array(signed(span_hashes(words.hashes, begin, end, 1))),
                     pa.array(digests),
                     _lists(row[picked], part.num_rows, signed(hashes[picked])),
                     _lists(row[picked], part.num_rows,
                            (at[picked] - begin[row[picked]]).astype(np.int32))],
                    names=["doc_id", "n_words", "whole_a", "whole_b", "digest", "hashes",
                           "places"])

    return docs.mapInArrow(
        run, "doc_id long, n_words long, whole_a long, whole_b long, digest string, "
             "hashes array<long>, places array<int>")


def _candidate_windows(docs: DataFrame, size: int, shorter: int, picked: bool) -> DataFrame:
    """Windows of `size` words that the repeated ones of `shorter` words in `docs` (doc_id, text,
    places) allow: those that hold one, if it was picked as smallest of all inside, else those
    that begin and end with one."""
    more = size - shorter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_pieces(batch, "text"):
                words = words_of(data, offsets)
                at, row = _starts(words, size)
                places = part.column("places")
                owner = np.repeat(np.arange(part.num_rows),
                                  places.value_lengths().to_numpy(zero_copy_only=False))
                mark = words.first[owner] + places.flatten().to_numpy(zero_copy_only=False)
                if picked:  # a running sum of the starts that each place opens and closes
                    turns = np.zeros(len(words.hashes) + 1, dtype=np.int32)
                    np.add.at(turns, np.maximum(mark - more, words.first[owner]), 1)
                    np.add.at(turns, mark + 1, -1)
                    chosen = np.cumsum(turns)[at] > 0
                else:
                    marked = np.zeros(len(words.hashes), dtype=bool)
                    marked[mark] = True
                    chosen = marked[at] & marked[at + more]
                at, row = at[chosen], row[chosen]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array((at - words.first[row]).astype(np.int32)),
                     pa.array(signed(window_hashes(words.hashes, at, size))),
                     pa.array(signed(window_hashes(words.hashes, at, size, 1)))],
                    names=["doc_id", "place", "hash_a", "hash_b"])

    return docs.mapInArrow(run, "doc_id long, place int, hash_a long, hash_b long")


def _repeated(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur in two documents or more, with the smallest of them."""
    return (windows.groupBy(*keys)
            .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
            .where("first_id < last_id").select(*keys, "first_id"))


def _by_document(windows: DataFrame) -> DataFrame:
    return windows.groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def find_repeats(docs: DataFrame, scanned: DataFrame, window: int, shortest: int) -> DataFrame:
    """doc_id, text, places of documents that have windows repeated from a smaller id; `docs` and
    `scanned` hold documents that are no whole copies."""
    sizes = levels(window, shortest)
    keys = ["hash_a"]
    windows = scanned.select("doc_id", F.explode(F.arrays_zip("hashes", "places")).alias("w")
                             ).selectExpr("doc_id", "w.hashes as hash_a", "w.places as place")
    texts = docs
    for level, size in enumerate(sizes):
        # Written first: the join below then meets two plain tables, a small one is broadcast, and the
        # places of a very common window are split over tasks.
        found = staged(_repeated(windows, keys), f"repeated-{size}")
        last = level == len(sizes) - 1
        met = windows.join(found, keys).where("doc_id > first_id" if last else "true")
        texts = staged(texts.select("doc_id", "text").join(_by_document(met), "doc_id"),
                       f"repeats-{size}")
        if last:
            break
        following = sizes[level + 1]
        windows = staged(_candidate_windows(texts, following, size, level == 0),
                         f"windows-{following}")
        keys = ["hash_a", "hash_b"]
    return texts


Cut = Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], bytes]


def _joined_words(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """Kept words with one blank between."""
    return b" ".join(text[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist()))


def _cut_spans(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the removed words and the white space behind each of them."""
    upto = np.append(starts[1:], len(text))
    out, at = [], 0
    first = np.flatnonzero(gone & ~np.append(False, gone[:-1]))
    last = np.flatnonzero(gone & ~np.append(gone[1:], False))
    for a, b in zip(starts[first].tolist(), upto[last].tolist()):
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _cut(repeats: DataFrame, window: int, cut: Cut) -> DataFrame:
    """doc_id, n_removed, kept_text of documents with repeated windows at `places`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            places = batch.column("places")
            at = 0
            for part, data, offsets in row_pieces(batch, "text"):
                words = words_of(data, offsets)
                flat = data.tobytes()
                for i in range(part.num_rows):
                    a, b = words.first[i], words.first[i + 1]
                    turns = np.zeros(b - a + 1, dtype=np.int32)
                    starts = places[at + i].values.to_numpy(zero_copy_only=False)
                    np.add.at(turns, starts, 1)
                    np.add.at(turns, starts + window, -1)
                    gone = np.cumsum(turns)[:-1] > 0
                    removed.append(int(gone.sum()))
                    kept.append(cut(flat[offsets[i]:offsets[i + 1]], words.starts[a:b] - offsets[i],
                                    words.ends[a:b] - offsets[i], gone).decode())
                at += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["doc_id", "n_removed", "kept_text"])

    return repeats.mapInArrow(run, "doc_id long, n_removed long, kept_text string")


def dedup(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST,
          joined: bool = True) -> DataFrame:
    """Per distinct doc_id: doc_id, n_words, digest (SHA-256 of its words joined by blanks),
    n_removed, and kept_text: null where nothing was removed, else what is left, as words joined
    by one blank or, if not `joined`, as the text with the repeats cut out.

    Null and empty texts have no words and lose none; rows with a null id take no part; of rows
    with the same id the one with the smallest text counts. Other columns play no part.
    """
    docs = one_per_id(docs)
    scanned = staged(_scan(docs, window, *(levels(window, shortest) * 2)[:2]), "substring-scan")
    firsts = scanned.where(F.col("n_words") >= window).groupBy(
        "n_words", "whole_a", "whole_b").agg(F.min("doc_id").alias("original"))
    seen = scanned.drop("hashes", "places").join(
        firsts, ["n_words", "whole_a", "whole_b"], "left").select(
        "doc_id", "n_words", "digest", (F.col("doc_id") > F.col("original")).alias("copied"))
    seen = staged(seen, "substring-copies")
    own = seen.where("not copied").select("doc_id")  # null for short texts, which hold no window
    repeats = find_repeats(docs, scanned.select("doc_id", "hashes", "places")
                           .join(own, "doc_id", "left_semi"), window, shortest)
    cut = _cut(repeats, window, _joined_words if joined else _cut_spans)
    return seen.join(cut, "doc_id", "left").select(
        "doc_id", "n_words", "digest",
        F.when(F.col("copied"), F.col("n_words")).otherwise(
            F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


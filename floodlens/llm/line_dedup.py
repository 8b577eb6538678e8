"""Line dedup by winnowing: repeated runs of lines stay where they occur first.

A run counts if it has at least `run` lines or at least `words` words, so one long line is enough;
of documents with less than that, the whole document counts. The shortest runs that count, ahead of
every line and behind it, are the windows: any longer run is covered by windows inside it. Of the
lines of a window the one with the smallest hash is its fingerprint, so two copies of a window have
the same fingerprint at the same place. Positions of fingerprints, a few for every window, are
joined; where one occurs at two positions or more, the match is extended both ways: each window
around the position is looked up, and one that also occurs at an earlier position (smaller id, or
further up in the same document) is a match. Matched windows that overlap or touch make up one
maximal run, which is deleted.

Positions with the same fingerprint are never listed against each other: each learns the first
position of its window from one aggregate. Both joins are of two written tables, so that Spark
knows their sizes, broadcasts a small one and splits the partitions of a very common line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.documents import one_per_id
from floodlens.llm.words import (
    _byte_value,
    row_pieces,
    signed,
    span_hashes,
    words_of,
)
from floodlens.session import staged

RUN = 3
WORDS = 10
_WHOLE = np.uint64(0x9FB21C651E98DF25)  # sets whole short documents apart from windows


def _lines(data: np.ndarray, offsets: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word, without the white space around them: start, end, row, and where the
    whole line starts."""
    filled = offsets[:-1][np.diff(offsets) > 0]
    begin = np.union1d(filled, np.flatnonzero(data == 10) + 1)
    begin = begin[begin < len(data)]
    words = words_of(data, offsets)
    first = np.searchsorted(words.starts, begin)
    after = np.append(first[1:], len(words.starts))
    held = np.flatnonzero(after > first)
    start, end = words.starts[first[held]], words.ends[after[held] - 1]
    return start, end, np.searchsorted(offsets, start, "right") - 1, begin[held]


def _windows(words: np.ndarray, row: np.ndarray, run: int, least: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, number of lines, and whether it is a whole short document, of all windows of
    lines with so many words in so many rows, in order of the first line."""
    n = len(row)
    line = np.arange(n)
    first = np.searchsorted(row, row, "left")
    behind = np.searchsorted(row, row, "right")
    total = np.concatenate([[0], np.cumsum(words)])
    # The end of the shortest run from each line on, and the start of the shortest up to it.
    ends = np.minimum(np.searchsorted(total, total[:-1] + least, "left"), line + run)
    ahead = ends <= behind
    starts = np.maximum(np.searchsorted(total, total[1:] - least, "right") - 1, line + 1 - run)
    back = starts >= first
    found = np.unique(np.concatenate([
        line[ahead] * (run + 1) + (ends - line)[ahead],
        starts[back] * (run + 1) + (line + 1 - starts)[back]]))
    top = np.flatnonzero(first == line)  # first lines of rows
    short = top[(behind[top] - top < run) & (total[behind[top]] - total[top] < least)]
    start = np.concatenate([found // (run + 1), short])
    size = np.concatenate([found % (run + 1), behind[short] - short])
    whole = np.arange(len(start)) >= len(found)
    order = np.argsort(start, kind="stable")
    return start[order], size[order], whole[order]


def _scan(docs: DataFrame, run: int, least: int) -> DataFrame:
    """Per document: the number of lines, and of each window its first line, size, hash (128
    bits), smallest line (`prints`) and its place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_pieces(batch, "text"):
                start, end, row, _ = _lines(data, offsets)
                hashes = span_hashes(_byte_value[data], start, end)
                found = words_of(data, offsets).starts
                words = np.searchsorted(found, end) - np.searchsorted(found, start)
                lines = np.bincount(row, minlength=part.num_rows)
                at, size, whole = _windows(words, row, run, least)
                smallest = at.copy()
                for k in range(1, run):
                    other = np.minimum(at + k, len(hashes) - 1)
                    smallest = np.where((k < size) & (hashes[other] < hashes[smallest]), other,
                                        smallest)
                keys = [span_hashes(hashes, at, at + size, which) ^ np.where(
                    whole, _WHOLE, np.uint64(0)) for which in (0, 1)]
                windows = np.bincount(row[at], minlength=part.num_rows)
                begins = pa.array(np.concatenate([[0], np.cumsum(windows)]), pa.int32())
                top = (np.cumsum(lines) - lines)[row[at]]
                lists = [pa.ListArray.from_arrays(begins, pa.array(values)) for values in (
                    (at - top).astype(np.int32), size.astype(np.int32), signed(keys[0]),
                    signed(keys[1]), signed(hashes[smallest]), (smallest - top).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lines), *lists],
                    names=["doc_id", "n_lines", "starts", "sizes", "keys_a", "keys_b", "prints",
                           "places"])

    return docs.mapInArrow(scan, "doc_id long, n_lines long, starts array<int>, sizes array<int>, "
                                 "keys_a array<long>, keys_b array<long>, prints array<long>, "
                                 "places array<int>")


def _matches(scanned: DataFrame) -> DataFrame:
    """doc_id and spans (start, size): the windows of every document that also occur earlier."""
    minima = scanned.select("doc_id", F.inline(F.array_distinct(
        F.arrays_zip(F.col("prints").alias("print"), F.col("places").alias("place")))))
    position = F.struct("doc_id", "place")
    shared = staged(minima.groupBy("print").agg(
        F.min(position).alias("low"), F.max(position).alias("high"))
        .where("low <> high").select("print"), "line-prints")
    windows = scanned.select("doc_id", F.inline(F.arrays_zip(
        F.col("starts").alias("start"), F.col("sizes").alias("size"),
        F.col("keys_a").alias("key_a"), F.col("keys_b").alias("key_b"),
        F.col("prints").alias("print"))))
    near = staged(windows.join(shared, "print", "left_semi").select(
        "key_a", "key_b", F.struct("doc_id", "start").alias("position"), "size"), "line-matches")
    keys = ["key_a", "key_b"]
    first = staged(near.groupBy(*keys).agg(
        F.min("position").alias("first"), F.max("position").alias("last"))
        .where("first <> last").select(*keys, "first"), "line-firsts")
    return (near.join(first, keys).where("position > first")
            .groupBy("position.doc_id")
            .agg(F.collect_list(F.struct("position.start", "size")).alias("spans")))


def _without(docs: DataFrame) -> DataFrame:
    """Texts of (doc_id, text, spans) without the matched lines; a removed line goes up to the
    start of the next one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kept, removed, numbers, at = [], [], [], [], 0
            for part, data, offsets in row_pieces(batch, "text"):
                _, _, row, begin = _lines(data, offsets)
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                flat = data.tobytes()
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    spans = batch.column("spans")[at + i].values
                    start, size = (spans.field(k).to_numpy() for k in (0, 1))
                    lines = first[i + 1] - first[i]
                    edges = (np.bincount(start, minlength=lines + 1)
                             - np.bincount(start + size, minlength=lines + 1))
                    gone = np.cumsum(edges[:-1]) > 0
                    text = flat[offsets[i]:offsets[i + 1]]
                    out, upto = [], 0
                    for number in np.flatnonzero(gone):
                        a = int(begin[first[i] + number] - offsets[i])
                        b = text.find(b"\n", a)
                        out.append(text[upto:a])
                        upto = len(text) if b < 0 else b + 1
                    out = b"".join([*out, text[upto:]])
                    if upto == len(text) and not text.endswith(b"\n") and out.endswith(b"\n"):
                        out = out[:-1]  # the last line is gone and so is the break before it
                    ids.append(doc_id)
                    kept.append(out.decode())
                    removed.append(int(gone.sum()))
                    numbers.append(np.flatnonzero(gone).astype(np.int32))
                at += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(numbers, pa.list_(pa.int32())), pa.array(kept, pa.string())],
                names=["doc_id", "n_removed", "removed", "kept_text"])

    return docs.mapInArrow(
        cut, "doc_id long, n_removed long, removed array<int>, kept_text string")


def dedup(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """Per distinct doc_id: doc_id, n_lines, n_removed, removed (numbers of the removed lines,
    from 0, counting lines with a word), kept_text (null where nothing was removed).

    Lines are split at \\n and compared without the white space around them; lines without a word
    do not count and stay. A line is removed if some run of lines that holds it, of at least `run`
    lines or `words` words, also starts at an earlier position. A document that has less than
    that as a whole is removed whole if its lines are those of another such document with a
    smaller id. Null, empty and blank texts lose nothing; rows with a null id take no part; of
    rows with the same id the one with the smallest text counts. Other columns play no part.
    """
    docs = one_per_id(docs)
    scanned = staged(_scan(docs, run, words), "line-windows")
    cut = _without(docs.join(_matches(scanned), "doc_id"))
    return scanned.select("doc_id", "n_lines").join(cut, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "kept_text")

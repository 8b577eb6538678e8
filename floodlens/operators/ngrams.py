"""Byte n-grams of payloads and word counts.

N-grams are counted with numpy inside the tasks, straight on the Arrow buffers. For n up to 2 a task
keeps one table; for larger n it keeps sorted runs of distinct n-grams with their counts and merges
runs of like size, so a task gives one row per distinct n-gram as long as these fit its bound of
memory, and hands over what it has where they do not. Spark sums those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.functions.summaries import rank_first
from floodlens.session import staged

# The services of the n-gram chart and their filters.
SERVICES = {
    "all": "",
    "ssh": "tcp:22",
    "smtp": "tcp:25",
    "dns": "udp:53",
    "http": "tcp:80",
    "https": "tcp:443",
}
_TABLE_UP_TO = 2  # counted in one table per group instead of by distinct values
PIECE_BYTES = 256  # an Arrow batch is 10,000 rows by default, so some 2.6 MB however much a task reads
_CHUNK_BYTES = 256 * 1024  # some 25 bytes are held for each of them
HELD_NGRAMS = 4_000_000  # distinct n-grams a task holds, 16 bytes each


def service_filter(text: str) -> Column:
    """`tcp:port` / `udp:port` as a condition on either side's port; empty text matches all."""
    if not text:
        return F.lit(True)
    protocol, port = text.lower().split(":")
    if protocol not in ("tcp", "udp"):
        return F.lit(True)
    sides = [F.col(f"{protocol}_{side}") == int(port) for side in ("sport", "dport")]
    return F.coalesce(sides[0], F.lit(False)) | F.coalesce(sides[1], F.lit(False))


def _chunks(payloads: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of bounded size with their bytes and payload lengths, without copies."""
    wide = pa.types.is_large_binary(payloads.type)
    _, offsets_buffer, data_buffer = payloads.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64 if wide else np.int32)
    offsets = offsets[payloads.offset:payloads.offset + len(payloads) + 1].astype(np.int64)
    data = (np.frombuffer(data_buffer, np.uint8) if data_buffer is not None
            else np.zeros(0, np.uint8))
    row = 0
    while row < len(payloads):
        stop = int(np.searchsorted(offsets, offsets[row] + _CHUNK_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(payloads))
        yield row, stop, data[offsets[row]:offsets[stop]], np.diff(offsets[row:stop + 1])
        row = stop


def _codes(data: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram starting at every byte, and which starts count.

    A start counts if n more bytes follow it, so the last n-gram of a payload is left out.
    """
    codes = np.zeros(len(data), np.uint64 if n > 4 else np.uint32)
    for i in range(n):
        codes[:len(data) - i] <<= 8
        codes[:len(data) - i] |= data[i:]
    starts = np.ones(len(data), bool)
    ends = np.cumsum(lengths)
    for back in range(1, n + 1):
        starts[(ends - back)[lengths >= back]] = False
    return codes, starts


class Runs:
    """Counts of codes as sorted runs. A new run is merged with the one before it as long as that is
    not much larger, so every code is merged a logarithmic number of times."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Count these codes. Where more than `limit` distinct ones would be held, all counts so
        far are returned and forgotten."""
        self.runs.append(np.unique(codes, return_counts=True))
        while len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
            self._merge()
        if sum(len(codes) for codes, _ in self.runs) <= self.limit:
            return None
        while len(self.runs) > 1:
            self._merge()
        return self.take() if len(self.runs[0][0]) > self.limit else None

    def _merge(self) -> None:
        (a, n), (b, m) = self.runs.pop(), self.runs.pop()
        codes, counts = np.concatenate([b, a]), np.concatenate([m, n])
        order = np.argsort(codes, kind="stable")  # two ascending runs are merged in one pass
        codes, counts = codes[order], counts[order]
        new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])
        self.runs.append((codes[new], np.add.reduceat(counts, new) if len(new) else counts))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All codes in order with their counts; nothing is held after that."""
        while len(self.runs) > 1:
            self._merge()
        found = self.runs[0] if self.runs else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.runs = []
        return found


def _counter(n: int, groups: list[str], held: int = HELD_NGRAMS) -> Callable[[Iterable[pa.RecordBatch]],
                                                    Iterator[pa.RecordBatch]]:
    """Arrow function: (payload, one boolean per group) to (group, ngram, count) partial counts."""
    dense = n <= _TABLE_UP_TO

    def rows(group: str, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(group, pa.string()), len(grams)),
             pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))],
            names=["group", "ngram", "count"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {g: np.zeros(256 ** n, np.int64) for g in groups} if dense else {}
        runs = {} if dense else {g: Runs(held // len(groups)) for g in groups}
        for batch in batches:
            payloads = batch.column(0).fill_null(b"")
            members = {g: np.asarray(batch.column(i + 1).to_numpy(zero_copy_only=False), bool)
                       for i, g in enumerate(groups)}
            for row, stop, data, lengths in _chunks(payloads):
                codes, starts = _codes(data, lengths, n)
                for group in groups:
                    member = members[group][row:stop]
                    if not member.any():
                        continue
                    chosen = starts if member.all() else starts & np.repeat(member, lengths)
                    if dense:
                        totals[group] += np.bincount(codes[chosen], minlength=256 ** n)
                    elif full := runs[group].add(codes[chosen]):
                        yield rows(group, *full)
        for group, counted in runs.items():
            yield rows(group, *counted.take())
        for group, total in totals.items():
            present = np.flatnonzero(total)
            yield rows(group, present, total[present])

    return count


def _pieces(df: DataFrame, n: int) -> DataFrame:
    """Long payloads cut into pieces, so that an Arrow batch has a bounded size.

    A piece reaches n bytes into the next one: its starts are exactly its own bytes.
    """
    starts = F.greatest(F.octet_length("payload") - n, F.lit(1))
    cut = df.select("*", F.explode(F.sequence(
        F.lit(0), F.floor((starts - 1) / PIECE_BYTES).cast("int"))).alias("_piece"))
    piece = F.substring("payload", F.col("_piece") * PIECE_BYTES + 1, F.lit(PIECE_BYTES + n))
    return cut.withColumn("payload", piece).drop("_piece")


def _ngram_counts(df: DataFrame, payload_col: str, n: int, groups: dict[str, str]) -> DataFrame:
    if not 1 <= n <= 7:
        raise ValueError("n must be between 1 and 7")
    names = list(groups)
    wanted = df.select(
        F.col(payload_col).cast("binary").alias("payload"),
        *[service_filter(text).alias(f"member_{i}") for i, text in enumerate(groups.values())])
    if all(groups.values()):
        anywhere = F.lit(False)
        for i in range(len(names)):
            anywhere = anywhere | F.col(f"member_{i}")
        wanted = wanted.filter(anywhere)
    partial = _pieces(wanted, n).mapInArrow(
        _counter(n, names), "group string, ngram bigint, count bigint")
    return partial.groupBy("group", "ngram").agg(F.sum("count").alias("count"))


def _with_zeros(counts: DataFrame, n: int, groups: list[str]) -> DataFrame:
    """All 256^n n-grams of every group, also those that do not occur."""
    grid = counts.sparkSession.range(256 ** n).select(
        F.col("id").alias("ngram"), F.explode(F.array(*map(F.lit, groups))).alias("group"))
    return grid.join(counts, ["group", "ngram"], "left").select(
        "group", "ngram", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def payload_ngrams(df: DataFrame, payload_col: str, filter: str = "", n: int = 1,
                   zeros: bool = False) -> DataFrame:
    """Occurrences of each byte n-gram (n from 1 to 7, as a number), most significant byte first.

    With `zeros`, all 256^n n-grams are rows, also those that do not occur.
    """
    counts = _ngram_counts(df, payload_col, n, {filter: filter})
    if zeros:
        counts = _with_zeros(counts, n, [filter])
    return counts.select(F.col("group").alias("filter"), "ngram", "count")


def top_ngrams(df: DataFrame, payload_col: str, k: int, filter: str = "", n: int = 3) -> DataFrame:
    """The `k` most frequent n-grams with their exact counts, ties to the smaller n-gram.

    The counts of every task are written once. A bound on the k-th count comes from the best of
    each task; an n-gram below its share of that bound in every task cannot reach it, so only the
    others are summed. A second bound from these sums leaves the few whose exact counts are added
    up. What is shuffled depends on how uneven the counts are, not on how many n-grams there are.
    """
    wanted = df.select(F.col(payload_col).cast("binary").alias("payload"),
                       service_filter(filter).alias("member")).where("member")
    local = staged(_pieces(wanted, n).mapInArrow(
        _counter(n, [filter]), "group string, ngram bigint, count bigint").select(
        F.spark_partition_id().alias("task"), "ngram", "count").groupBy(
        "task", "ngram").agg(F.sum("count").alias("count")), "ngram-counts")
    tasks = local.select("task").distinct().count()
    if not tasks or k < 1:
        return local.select("ngram", "count").limit(0)

    def kth(sums: DataFrame) -> int:
        """The k-th largest count, 0 if there are fewer."""
        best = sums.orderBy(F.col("count").desc()).limit(k).agg(
            F.count("*").alias("n"), F.min("count").alias("least")).first()
        return best["least"] if best["n"] == k else 0

    own = Window.partitionBy("task").orderBy(F.col("count").desc(), "ngram")
    first = kth(local.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= k)
                .groupBy("ngram").agg(F.sum("count").alias("count")))
    share = first / tasks  # below it in every task: below the bound
    sums = staged(local.where(F.col("count") >= share).groupBy("ngram").agg(
        F.sum("count").alias("count"), F.count("*").alias("seen")), "ngram-bounds")
    second = kth(sums)
    candidates = staged(sums.where(
        F.col("count") + (tasks - F.col("seen")) * F.lit(share) >= second).select("ngram"),
        "ngram-candidates")
    return (local.join(candidates, "ngram").groupBy("ngram").agg(F.sum("count").alias("count"))
            .orderBy(F.col("count").desc(), "ngram").limit(k))


def ngrams_by_service(df: DataFrame, payload_col: str) -> DataFrame:
    """Byte counts of all payloads and of each service's, in one pass."""
    counts = _with_zeros(_ngram_counts(df, payload_col, 1, SERVICES), 1, list(SERVICES))
    return counts.withColumnRenamed("group", "service")


def ngram_cube(ngrams: DataFrame, side: int = 8) -> DataFrame:
    """3-gram counts folded into cells of `side` byte values; x is the last byte, z the first.
    All cells are rows, also empty ones."""
    def axis(shift: int) -> Column:
        byte = F.shiftright("ngram", shift).bitwiseAND(F.lit(255))
        return F.floor(byte / side).cast("int")

    folded = ngrams.groupBy(axis(0).alias("x"), axis(8).alias("y"), axis(16).alias("z")).agg(
        F.sum("count").alias("count"))
    cells = -(-256 // side)
    grid = ngrams.sparkSession.range(cells ** 3).select(
        (F.col("id") % cells).cast("int").alias("x"),
        F.floor(F.col("id") / cells % cells).cast("int").alias("y"),
        F.floor(F.col("id") / cells ** 2).cast("int").alias("z"))
    return grid.join(folded, ["x", "y", "z"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("long")))


# Fixed value: what a word is.
WORD = "[a-zA-Z][a-zA-Z0-9]*"


def word_count(df: DataFrame, text_col: str) -> DataFrame:
    """Occurrences per lower-cased word, most first."""
    words = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    return (
        df.select(F.explode(words).alias("word"))
        .groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
        .orderBy(*rank_first("n", "word"))
    )

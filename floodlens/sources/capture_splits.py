"""Large uncompressed capture files, read by many tasks.

Records can only be found one after the other, so a task that starts inside a file has to guess
where a record begins. The guess is checked, not trusted: every range reports where it began and
where the last record it owns ended, and a range is used only if it began exactly where the range
before it ended. The ranges with wrong guesses are walked again from the right places, all of a file
in one pass.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from floodlens.schemas import CAPTURED
from floodlens.session import ship_package, staged
from floodlens.sources.capture import (
    FILE_HEADER,
    HEADERS,
    RECORD_HEADER,
    Wanted,
    _filesystem,
    byte_order,
    read_range,
)

SPLIT_BYTES = 256 * 1024 * 1024
# Fixed value: the largest record a capture tool writes.
MAX_CAPTURED = 262144
# A guessed record lies within this many seconds of the first one.
_SPAN = 366 * 86400
_SEARCH = 4 * MAX_CAPTURED
_NEAR_SEARCH = 64 * 1024  # searched first: most records are small
_CHAIN = 16
_WALK = 32 * 1024 * 1024
_RANGE = "path string, number bigint, low bigint, high bigint, size bigint"
_WALKED = f"{_RANGE}, start bigint, end bigint"


def _first_second(file, order: str) -> int:
    file.seek(FILE_HEADER)
    head = file.read(4)
    return struct.unpack(order + "I", head)[0] if len(head) == 4 else 0


def _guesses(file, order: str, low: int, size: int) -> Iterator[int]:
    """Places at or after `low` from which a chain of plausible records starts; none of them lies on
    the chain of another."""
    first_second = _first_second(file, order)
    seen: set[int] = set()
    for search in (_NEAR_SEARCH, _SEARCH):
        file.seek(low)
        data = np.frombuffer(file.read(min(search, size - low)), np.uint8)
        count = len(data) - RECORD_HEADER + 1
        if count <= 0:
            return

        def word(at: int) -> np.ndarray:
            parts = [data[at + i:at + i + count].astype(np.uint32) for i in range(4)]
            if order == "<":
                parts.reverse()
            return parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]

        captured = word(8)
        near = np.abs(word(0).astype(np.int64) - first_second) <= _SPAN
        plausible = (near & (word(4) < 1_000_000_000) & (captured > 0)
                     & (captured <= MAX_CAPTURED))
        for first in np.flatnonzero(plausible[:MAX_CAPTURED + RECORD_HEADER]).tolist():
            chain = []
            at = first
            while at < count and plausible[at] and at not in seen:
                chain.append(at)
                at += RECORD_HEADER + int(captured[at])
            if at in seen:
                seen.update(chain)
            elif len(chain) >= _CHAIN or low + at == size:
                seen.update(chain)
                yield low + first
        if low + len(data) == size:
            return


def _walk(file, order: str, start: int, high: int, size: int, strict: bool = False,
          stop: bool = True) -> int | None:
    """The first record boundary at or after `high`.

    A record that the end of the file cuts off ends it, and so does a broken one, which raises
    unless `stop`. With `strict` an implausible one gives None instead.
    """
    record = struct.Struct(order + "IIII").unpack_from
    first_second = _first_second(file, order) if strict else 0
    at = start
    while at < high:
        file.seek(at)
        block = file.read(min(_WALK, high - at + RECORD_HEADER, size - at))
        used = 0
        while at + used < high and used + RECORD_HEADER <= len(block):
            second, fraction, captured, _ = record(block, used)
            if strict and (abs(second - first_second) > _SPAN or fraction >= 1_000_000_000
                           or not 0 < captured <= MAX_CAPTURED):
                return None
            if at + used + RECORD_HEADER + captured > size:
                if not (strict or stop) and captured > MAX_CAPTURED:
                    raise ValueError("a record claims more bytes than a frame can have; "
                                     "read with bad_records='stop' to keep what is before it")
                return None if strict else size
            used += RECORD_HEADER + captured
        if used == 0:
            return None if strict else size
        at += used
    return at


def _find(file, order: str, low: int, high: int, size: int) -> tuple[int | None, int | None]:
    """The first guess whose records stay plausible up to the end of the range."""
    for start in _guesses(file, order, low, size):
        end = _walk(file, order, start, high, size, strict=True)
        if end is not None:
            return start, end
    return None, None


def _range_walker(stop: bool) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Start (guessed where none is given) and end of each range."""

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for row in rows.itertuples(index=False):
                filesystem, inner = _filesystem(row.path)
                with filesystem.open_input_file(inner) as file:
                    order = byte_order(file.read(FILE_HEADER), row.path)
                    if row.number > 0 and pd.isna(row.start):
                        start, end = _find(file, order, row.low, row.high, row.size)
                    else:
                        start = FILE_HEADER if row.number == 0 else int(row.start)
                        end = _walk(file, order, start, row.high, row.size, stop=stop)
                found.append((row.path, row.number, row.low, row.high, row.size, start, end))
            frame = pd.DataFrame(found, columns=[
                "path", "number", "low", "high", "size", "start", "end"])
            yield frame.astype({"start": "Int64", "end": "Int64"})

    return walk


def _corrector(stop: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The ranges of one file, those that do not begin where the one before ended walked again."""

    def correct(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        path, size = rows["path"].iloc[0], int(rows["size"].iloc[0])
        starts, ends, due = [], [], FILE_HEADER
        filesystem, inner = _filesystem(path)
        with filesystem.open_input_file(inner) as file:
            order = byte_order(file.read(FILE_HEADER), path)
            for high, start, end in zip(rows["high"], rows["start"], rows["end"]):
                # A range that begins beyond its own bytes owns no record.
                if pd.isna(start) or int(start) != due:
                    end = _walk(file, order, due, int(high), size, stop=stop)
                starts.append(due)
                ends.append(due := int(end))
        return rows.assign(start=np.array(starts, np.int64), end=np.array(ends, np.int64))

    return correct


def _range_reader(strict: bool, wanted: Wanted
                  ) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_range(row["path"], row["start"], row["end"], strict, wanted)

    return read


def _one_task_each(ranges: DataFrame) -> DataFrame:
    """Spread the few, heavy range rows evenly over the cores."""
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(4 * cores, "path", "number")


def boundaries(spark: SparkSession, files: list[tuple[str, int]],
               split_bytes: int = SPLIT_BYTES, stop: bool = True) -> DataFrame:
    """Ranges of the files with exact record boundaries (`start`, `end`).

    Guesses that turn out wrong, of which there are usually none, are corrected file by file; only
    their bytes are read again.
    """
    sized = spark.createDataFrame(files, "path string, size bigint")
    step = F.lit(split_bytes).cast("long")
    ranges = (
        sized.select("path", "size", F.explode(F.sequence(
            F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step))).alias("number"))
        .select("path", "number", (F.col("number") * step).alias("low"),
                F.least((F.col("number") + 1) * step, F.col("size")).alias("high"), "size",
                F.lit(None).cast("long").alias("start"))
    )
    walked = staged(_one_task_each(ranges).mapInPandas(_range_walker(stop), _WALKED),
                    "capture-ranges")
    before = F.lag("end").over(Window.partitionBy("path").orderBy("number"))
    due = F.when(F.col("number") == 0, F.lit(FILE_HEADER).cast("long")).otherwise(before)
    # An unknown end is due to an unknown start, which is wrong already.
    wrong = walked.withColumn("due", due).filter(
        F.col("due").isNotNull() & ~F.col("due").eqNullSafe(F.col("start")))
    files_wrong = staged(wrong.select("path").distinct(), "capture-wrong")
    if files_wrong.isEmpty():
        return walked
    torn = walked.join(files_wrong, "path", "left_semi").repartition(
        4 * spark.sparkContext.defaultParallelism, "path")
    fixed = torn.groupBy("path").applyInPandas(_corrector(stop), _WALKED)
    kept = walked.join(files_wrong, "path", "left_anti")
    return staged(kept.select(*walked.columns).unionByName(fixed), "capture-ranges")


def packet_scan_large(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES,
                      bad_records: str = "raise", columns: Sequence[str] | None = None
                      ) -> DataFrame:
    """Packets of one uncompressed capture file, or several separated by commas. A broken record
    raises, or ends its file with `bad_records="stop"`, as in `packet_scan_pcap`; `columns` too."""
    if bad_records not in ("raise", "stop"):
        raise ValueError("bad_records is raise or stop")
    stop = bad_records == "stop"
    wanted = HEADERS if columns is None else Wanted(tuple(columns))
    ship_package(spark)
    files = []
    for part in path.split(","):
        filesystem, inner = _filesystem(part)
        files.append((part, filesystem.get_file_info(inner).size))
    ranges = boundaries(spark, files, split_bytes, stop).filter(F.col("start") < F.col("end"))
    return _one_task_each(ranges).select("path", "start", "end").mapInArrow(
        _range_reader(not stop, wanted), StructType([CAPTURED[n] for n in wanted.columns]))

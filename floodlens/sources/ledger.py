"""A store that a job commits to as a whole, and that keeps one row per key.

Tasks write Parquet files of their own. A job is committed by one small file, its manifest, which
lists the files of the attempts that Spark has accepted; files of failed attempts and of jobs that
never ended are in no manifest and are never read. A manifest is named by its job, so a job that is
run again replaces what it wrote before. Readers take the files of all manifests and, of rows with the
same key, the one of the job committed last.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from floodlens.session import ship_package
from floodlens.sources.capture import _filesystem

_MANIFESTS, _ROWS = "_manifests", "rows"


@dataclass
class Accepted(WriterCommitMessage):
    file: str | None


class LedgerWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str) -> None:
        self.path, self.job = path.rstrip("/"), job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Accepted:
        """One file per attempt with rows, under a name of its own."""
        filesystem, inner = _filesystem(self.path)
        folder = posixpath.join(inner, _ROWS)
        filesystem.create_dir(folder, recursive=True)
        name, writer = f"{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if writer is None:
                out = filesystem.open_output_stream(posixpath.join(folder, name))
                writer = pq.ParquetWriter(out, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return Accepted(None)
        writer.close()
        out.close()
        return Accepted(name)

    def commit(self, messages: list[Accepted | None]) -> None:
        """The manifest, moved into place whole: the moment at which the job's rows exist."""
        filesystem, inner = _filesystem(self.path)
        folder = posixpath.join(inner, _MANIFESTS)
        filesystem.create_dir(folder, recursive=True)
        files = sorted(m.file for m in messages if m is not None and m.file)
        pending = posixpath.join(folder, f"_{uuid.uuid4().hex}")
        with filesystem.open_output_stream(pending) as out:
            out.write(json.dumps({"files": files, "at": time.time_ns()}).encode())
        filesystem.move(pending, posixpath.join(folder, f"{self.job}.json"))

    def abort(self, messages: list[Accepted | None]) -> None:
        """Nothing to take back: no manifest names the files."""


class LedgerSource(DataSource):
    """Options `path` and `job`: letters, digits, `-`, `.` and `_`, the same for every attempt."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema: StructType, overwrite: bool) -> LedgerWriter:
        job = self.options["job"]
        if not job or job[0] in "._" or not job.replace("-", "").replace(".", "").replace(
                "_", "").isalnum():
            raise ValueError(f"{job!r} is not the name of a job")
        return LedgerWriter(self.options["path"], job)


def register_ledger(spark: SparkSession) -> None:
    """Make the `ledger` format known to the session."""
    ship_package(spark)
    spark.dataSource.register(LedgerSource)


def ledger_write(df: DataFrame, path: str, job: str) -> None:
    """Commit `df` as what `job` has to say; a repeated job replaces its earlier rows."""
    register_ledger(df.sparkSession)
    df.write.format("ledger").option("job", job).mode("append").save(path)


def ledger_read(spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str]
                ) -> DataFrame:
    """One row per key of the committed rows: that of the job committed last, and of its rows with
    the same key the largest."""
    filesystem, inner = _filesystem(path)
    folder = posixpath.join(inner, _MANIFESTS)
    found = []
    if filesystem.get_file_info(folder).type == fs.FileType.Directory:
        for info in filesystem.get_file_info(fs.FileSelector(folder)):
            if info.base_name.endswith(".json") and not info.base_name.startswith("_"):
                with filesystem.open_input_stream(info.path) as file:
                    found.append(json.loads(file.read()))
    found.sort(key=lambda m: m["at"])
    files = [(f"{path.rstrip('/')}/{_ROWS}/{name}", order)
             for order, manifest in enumerate(found) for name in manifest["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    orders = spark.createDataFrame([(f.rsplit("/", 1)[1], o) for f, o in files],
                                   "_file string, _order int")
    rows = spark.read.schema(schema).parquet(*[f for f, _ in files])
    columns = rows.columns
    held = rows.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1)).join(
        orders, "_file")
    return held.groupBy(*keys).agg(F.max(F.struct(
        "_order", *[c for c in columns if c not in keys])).alias("_row")).select(*[
            F.col(c) if c in keys else F.col(f"_row.{c}") for c in columns])

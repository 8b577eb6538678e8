"""A growing folder of capture files as a stream of packets.

Capture tools rotate: they write one file after the other and move each into place when it is
complete. The reader keeps a numbered log of the files it has taken, as small JSON files in a shared
folder. An offset is a number in that log, so a batch that is repeated after a failure reads the same
files, whatever has been added since, and a query that is started again goes on behind its last batch.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.types import StructType

from floodlens.schemas import CAPTURED, PACKETS
from floodlens.session import ship_package
from floodlens.sources.capture import CaptureFile, Wanted, _filesystem, list_files, read_capture


class FileLog:
    """Numbered lists of files. An entry is moved into place whole and never changes."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def _entries(self) -> tuple[fs.FileSystem, str, list[int]]:
        filesystem, inner = _filesystem(self.folder)
        filesystem.create_dir(inner, recursive=True)
        found = filesystem.get_file_info(fs.FileSelector(inner))
        numbers = [int(f.base_name[:-5]) for f in found
                   if f.base_name.endswith(".json") and f.base_name[:-5].isdigit()]
        return filesystem, inner, sorted(numbers)

    def last(self) -> int:
        """Number of the newest entry, 0 if there is none."""
        return max(self._entries()[2], default=0)

    def files(self, after: int, to: int) -> list[str]:
        """Files of the entries behind `after` up to `to`, which must all be there."""
        filesystem, inner, numbers = self._entries()
        missing = set(range(after + 1, to + 1)).difference(numbers)
        if missing:
            raise ValueError(f"the log in {self.folder} has lost entries {sorted(missing)}")
        out: list[str] = []
        for number in range(after + 1, to + 1):
            with filesystem.open_input_stream(posixpath.join(inner, f"{number}.json")) as file:
                out.extend(json.loads(file.read()))
        return out

    def add(self, files: Sequence[str]) -> None:
        """A new entry with these files."""
        filesystem, inner, numbers = self._entries()
        pending = posixpath.join(inner, f"_{uuid.uuid4().hex}")
        with filesystem.open_output_stream(pending) as out:
            out.write(json.dumps(list(files)).encode())
        filesystem.move(pending, posixpath.join(inner, f"{max(numbers, default=0) + 1}.json"))


class CaptureStreamReader(DataSourceStreamReader):
    """Takes new files in the order of their names, at most `files_per_batch` an entry."""

    def __init__(self, path: str, log: str, strict: bool, columns: tuple[str, ...],
                 files_per_batch: int) -> None:
        self.path, self.log = path, FileLog(log)
        self.strict, self.wanted, self.files_per_batch = strict, Wanted(columns), files_per_batch

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        known = self.log.last()
        taken = set(self.log.files(0, known))
        new = sorted(f for f in list_files(self.path) if f not in taken)
        for at in range(0, len(new), self.files_per_batch):
            self.log.add(new[at:at + self.files_per_batch])
        return {"entry": self.log.last()}

    def partitions(self, start: dict, end: dict) -> list[CaptureFile]:
        return [CaptureFile(f) for f in self.log.files(start["entry"], end["entry"])]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        return read_capture(partition.path, self.strict, self.wanted)

    def commit(self, end: dict) -> None:
        """Entries stay: they say which files are known."""


class CaptureStream(DataSource):
    """Options: `path`, `log` (a shared folder of this query alone), `badRecords` as for `capture`,
    `filesPerEntry` (100)."""

    @classmethod
    def name(cls) -> str:
        return "capture-stream"

    def schema(self) -> StructType:
        return PACKETS

    def streamReader(self, schema: StructType) -> CaptureStreamReader:
        return CaptureStreamReader(
            self.options["path"], self.options["log"],
            self.options.get("badRecords", "raise") == "raise", tuple(schema.names),
            int(self.options.get("filesPerEntry", "100")))


def _registered(spark: SparkSession) -> str:
    """Make the format known to the session; its name there. A name that the first session of the
    application holds cannot be used in another one, which then gets one of its own."""
    try:
        spark.dataSource.register(CaptureStream)
        return CaptureStream.name()
    except AnalysisException as error:
        if error.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
    name = f"{CaptureStream.name()}-{uuid.uuid4().hex}"
    spark.dataSource.register(
        type("CaptureStream", (CaptureStream,), {"name": classmethod(lambda _: name)}))
    return name


def packet_stream_pcap(spark: SparkSession, path: str, log: str, bad_records: str = "raise",
                       columns: Sequence[str] | None = None) -> DataFrame:
    """Packets of the capture files in a folder and of those that are added to it, as a stream.

    A file must be complete when it appears (moved into place); files that begin with `_` or `.`
    are passed over, and a file that is changed later is not read again. `log` is a folder that
    the whole cluster shares; every query has its own, kept as long as its checkpoint. Other
    arguments as in `packet_scan_pcap`.
    """
    if bad_records not in ("raise", "stop"):
        raise ValueError("bad_records is raise or stop")
    ship_package(spark)
    reader = (spark.readStream.format(_registered(spark)).option("path", path).option("log", log)
              .option("badRecords", bad_records))
    if columns is not None:
        reader = reader.schema(StructType([CAPTURED[name] for name in columns]))
    return reader.load()

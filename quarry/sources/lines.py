"""Growing text files as a stream of whole lines: a Python data source whose offsets are bytes after a line end.

``spark.dataSource.register(Lines)``, then ``spark.readStream.format("lines").option("path", folder)`` gives (file, offset,
line). A line appears once its line end is written, never half, and once only: what was read is kept by file as the
byte after the last whole line, in the stream's own checkpoint. Files are reached through pyarrow's file systems (local or
shared folders, HDFS, object stores); executors read the byte ranges, the driver looks only for the last line end of each file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

STEP = 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


def stable_end(stream, start: int, size: int, step: int = STEP) -> int:
    """The byte after the last line end in [start, size), looked for from the back; ``start`` if there is none."""
    at = size
    while at > start:
        low = max(start, at - step)
        stream.seek(low)
        found = stream.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


def lines(stream, start: int, stop: int, step: int = STEP) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the whole lines that begin in [start, stop), without their ends; a line may end beyond ``stop``."""
    at, rest = start, b""
    stream.seek(start)
    while at < stop:
        block = stream.read(step)
        rest += block
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if at >= stop:
                return
            yield at, line
            at += len(line) + 1
        if not block:
            return


class Lines(DataSource):
    """Options: path; suffix (of file names, .jsonl if not given, empty for all); rangebytes (most of a task's range, 64 MB if
    not given); shrunk (fail, or restart: a file that is shorter than what was read is read again from its start)."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "file string, offset bigint, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return Reader(self.options)


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.most, self.shrunk = int(options.get("rangebytes", 64 << 20)), options.get("shrunk", "fail")
        if self.shrunk not in ("fail", "restart"):
            raise ValueError("shrunk is fail or restart")
        self.last: dict[str, int] = {}

    def _files(self):
        at = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        return pyarrow.fs.FileSystem.from_uri(at)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """The stable end of every file. Only the part beyond the last one known is looked at."""
        system, top = self._files()
        out = {}
        for f in system.get_file_info(pyarrow.fs.FileSelector(top, recursive=True, allow_not_found=True)):
            if f.is_file and f.base_name.endswith(self.suffix) and not f.base_name.startswith((".", "_")):
                before = self.last.get(f.path, 0)
                with system.open_input_file(f.path) as stream:
                    out[f.path] = stable_end(stream, before if before <= f.size else 0, f.size)
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """Ranges that begin after a line end; a line belongs to the range where it begins, so inner cuts fall on line ends too."""
        system, _ = self._files()
        out = []
        for file, stop in sorted(end.items()):
            at = start.get(file, 0)
            if at > stop:
                if self.shrunk == "fail":
                    raise ValueError(f"{file} is shorter than what was read of it: {stop} < {at}")
                at = 0
            if at < stop:
                with system.open_input_file(file) as stream:
                    while at < stop:
                        cut = min(at + self.most, stop)
                        if cut < stop:
                            found = stable_end(stream, at, cut)
                            cut = found if found > at else self._next(stream, cut, stop)
                        out.append(Range(file, at, cut))
                        at = cut
        return out

    @staticmethod
    def _next(stream, at: int, stop: int) -> int:
        while at < stop:
            stream.seek(at)
            block = stream.read(min(STEP, stop - at))
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block)
        return stop

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = self._files()
        rows: tuple[list, list] = [], []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(rows[0])), pa.array(rows[0], pa.int64()), pa.array([x.decode("utf-8", "replace") for x in rows[1]], pa.string())], names=["file", "offset", "line"])

        with system.open_input_file(partition.file) as stream:
            for at, line in lines(stream, partition.start, partition.stop):
                rows[0].append(at), rows[1].append(line)
                size += len(line)
                if size > 4 * STEP:
                    yield batch()
                    rows, size = ([], []), 0
        if rows[0]:
            yield batch()


def messages(rows: DataFrame, schema: str) -> DataFrame:
    """file, offset, the fields of ``schema`` and broken: the line itself where it is no JSON object of that schema, else null. Blank lines go."""
    own = rows.where(F.trim("line") != "")
    read = own.withColumn("_m", F.from_json("line", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    object_ = F.col("line").rlike(r"^\s*\{")
    return read.select("file", "offset", "_m.*", object_.alias("_object"), "line").withColumn("broken", F.when(F.col("_broken").isNotNull() | ~F.col("_object"), F.col("line"))).drop("_broken", "_object", "line")

"""A connector that writes, reads with filters and streams: a journal of committed segments in a folder all executors share.

A write adds segments (Parquet files, one for each task) and then one commit file that names them with the bounds of
their columns. Only named segments exist: what a failed task or job leaves no reader looks at; the task and `abort` remove it,
and `Folder.vacuum` what lost executors leave. Readers skip segments whose bounds exclude a filter, and drop rows that a filter excludes. A stream's offset is the
number of commits, so a restarted one goes on after the last commit it has seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that a task holds, and of what a filter tests: whether a segment's bounds can hold a match, and whether a value does.
BATCH = 10_000
_TESTS = {
    EqualTo: (lambda low, high, v: low <= v <= high, pc.equal),
    GreaterThan: (lambda low, high, v: high > v, pc.greater),
    GreaterThanOrEqual: (lambda low, high, v: high >= v, pc.greater_equal),
    LessThan: (lambda low, high, v: low < v, pc.less),
    LessThanOrEqual: (lambda low, high, v: low <= v, pc.less_equal),
}


@dataclass
class Segment(InputPartition):
    name: str
    rows: int
    bounds: dict[str, list[Any]] = field(default_factory=dict)


@dataclass
class Written(WriterCommitMessage):
    segment: Segment | None


class Folder:
    """The files of a journal, by a path or URI that Arrow can open."""

    def __init__(self, path: str):
        self.path = path

    def at(self, name: str = "") -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        return system, f"{base.rstrip('/')}/{name}"

    def commits(self) -> list[str]:
        """The names of the commits, oldest first."""
        system, base = self.at("commits")
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def segments(self, first: int = 0, last: int | None = None) -> list[Segment]:
        """The segments of the commits from number first to before last."""
        out = []
        for name in self.commits()[first:last]:
            system, path = self.at(f"commits/{name}")
            with system.open_input_stream(path) as f:
                out += [Segment(**s) for s in json.loads(f.read())]
        return out

    def commit(self, segments: list[Segment]) -> None:
        """Writers of one journal come one after another; the commit file appears whole, by a rename."""
        system, base = self.at("commits")
        system.create_dir(base)
        name = f"{len(self.commits()):012d}.json"
        held = f"{base}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(held) as f:
            f.write(json.dumps([asdict(s) for s in segments]).encode())
        system.move(held, f"{base}/{name}")

    def remove(self, segment: Segment) -> None:
        system, path = self.at(segment.name)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_file(path)

    def vacuum(self) -> int:
        """Remove segments that no commit names, and say how many; only while nobody writes."""
        named = {s.name for s in self.segments()}
        system, base = self.at("segments")
        loose = [f for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f"segments/{f.base_name}" not in named]
        for f in loose:
            system.delete_file(f.path)
        return len(loose)

    def read(self, segment: Segment, schema: StructType, filters: Iterable[Filter] = ()) -> Iterator[pa.RecordBatch]:
        system, path = self.at(segment.name)
        arrow = to_arrow_schema(schema)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(BATCH):
                for one in filters:
                    batch = batch.filter(_TESTS[type(one)][1](batch.column(one.attribute[0]), pa.scalar(one.value)))
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(arrow.field(n).type) for n in arrow.names], schema=arrow)


def _bounds(table: pa.Table | pa.RecordBatch) -> dict[str, list[Any]]:
    """The least and greatest value of the columns of integers and strings that have any; nulls match no comparison."""
    out = {}
    for name, column in zip(table.schema.names, table.columns, strict=True):
        if pa.types.is_integer(column.type) or pa.types.is_string(column.type):
            low, high = pc.min_max(column).as_py().values()
            if low is not None:
                out[name] = [low, high]
    return out


class JournalWriter(DataSourceArrowWriter):
    def __init__(self, folder: Folder):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A segment of the task's rows; bounds are folded batch by batch, so a task holds one batch."""
        segment, writer, sink = Segment(f"segments/{uuid.uuid4().hex}.parquet", 0), None, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    system, path = self.folder.at(segment.name)
                    system.create_dir(path.rpartition("/")[0])
                    sink = system.open_output_stream(path)
                    writer = pq.ParquetWriter(sink, batch.schema)
                writer.write_batch(batch)
                segment.rows += batch.num_rows
                for name, (low, high) in _bounds(batch).items():
                    a, b = segment.bounds.get(name, (low, high))
                    segment.bounds[name] = [min(a, low), max(b, high)]
        except BaseException:
            if writer is not None:
                writer.close()
                sink.close()
            self.folder.remove(segment)
            raise
        if writer is None:
            return Written(None)
        writer.close()
        sink.close()
        return Written(segment)

    def commit(self, messages: list[Written | None]) -> None:
        found = [m.segment for m in messages if m is not None and m.segment is not None]
        if found:
            self.folder.commit(found)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.segment is not None:
                self.folder.remove(m.segment)


class JournalReader(DataSourceReader):
    def __init__(self, folder: Folder, schema: StructType):
        self.folder, self.table, self.filters = folder, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take comparisons of a column of integers or strings with a value; Spark keeps the others (floating point among them, where NaN is the largest)."""
        whole = {f.name for f in self.table.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "string")}
        for one in filters:
            if type(one) in _TESTS and len(one.attribute) == 1 and one.attribute[0] in whole and isinstance(one.value, (int, str)):
                self.filters.append(one)
            else:
                yield one

    def _wanted(self, segment: Segment) -> bool:
        return all(f.attribute[0] not in segment.bounds or _TESTS[type(f)][0](*segment.bounds[f.attribute[0]], f.value) for f in self.filters)

    def partitions(self) -> list[Segment]:
        return [s for s in self.folder.segments() if self._wanted(s)] or [Segment("", 0)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if partition.rows:
            yield from self.folder.read(partition, self.table, self.filters)


class JournalStream(DataSourceStreamReader):
    def __init__(self, folder: Folder, schema: StructType):
        self.folder, self.table = folder, schema

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(self.folder.commits())}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return self.folder.segments(start["commits"], end["commits"])

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from self.folder.read(partition, self.table)


class Journal(DataSource):
    """Format `journal`: option `path`; append writes, batch reads with filters, and streams. Reads need the schema that was written."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def _folder(self) -> Folder:
        return Folder(self.options["path"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return JournalReader(self._folder(), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return JournalStream(self._folder(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a journal is only appended to")
        return JournalWriter(self._folder())

"""One file from many tasks: a data source that writes sorted parts and joins them at commit.

``write_lines`` sorts a table by its order columns over range partitions; each task writes
its lines beside the file, under a name of its own attempt, and the commit copies the
parts of the successful attempts one after another, in blocks, behind the byte order
mark and the header. A failed job leaves no file, and one that is there stays until the new one is whole.
It writes through Arrow's file systems: a local path must be shared by the executors.

Cases: null lines are left out; no lines give the mark and the header alone; lines are written as they are, whatever they hold.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_BLOCK = 4 << 20


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str


class LineWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.eol, self.job = options["path"], options.get("eol", "\n"), options.get("job") or uuid.uuid4().hex
        self.head = ("\ufeff" if options.get("mark", "false").lower() == "true" else "") + (options["header"] + self.eol if "header" in options else "")

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = self._system()
        part = f"{path}.{self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        with system.open_output_stream(part, compression=None) as out:
            for row in iterator:
                if row[0] is not None:
                    out.write((row[0] + self.eol).encode())
        return _Part(context.partitionId(), part)

    def commit(self, messages):
        system, path = self._system()
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        whole = f"{path}.{self.job}"
        with system.open_output_stream(whole, compression=None) as out:
            out.write(self.head.encode())
            for part in parts:
                with system.open_input_stream(part.path, compression=None) as source:
                    while block := source.read(_BLOCK):
                        out.write(block)
        system.move(whole, path)
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        """Remove the parts of all attempts of this job."""
        from pyarrow import fs

        system, path = self._system()
        for found in system.get_file_info(fs.FileSelector(path.rpartition("/")[0] or ".")):
            if f".{self.job}" in found.base_name:
                system.delete_file(found.path)


class LineSink(DataSource):
    """A column of lines to one file. Options: path, eol, mark, header."""

    @classmethod
    def name(cls):
        return "corpuslines"

    def schema(self):
        return "line string"

    def writer(self, schema, overwrite):
        return LineWriter(self.options)


def write_lines(rows: DataFrame, path: str, order: list[str], eol: str = "\n", mark: bool = False, header: str | None = None) -> None:
    """rows (line and the order columns) -> one file at path."""
    rows.sparkSession.dataSource.register(LineSink)
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line")
    to = sorted_.write.format("corpuslines").option("path", path).option("eol", eol).option("mark", mark).mode("append")
    (to if header is None else to.option("header", header)).save()

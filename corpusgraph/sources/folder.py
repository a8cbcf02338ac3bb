"""From a folder to an index in one call: a data source for folders, archives by their directories, and the parsers.

``spark.read.format("corpusfolder")`` lists folders in tasks, one partition a folder of
the first two levels, and never enters an ignored one. It reads through Arrow's file systems, so a
root may be local, hdfs:// or s3://; a local root must be mounted on all executors.
Contents are read in the task that lists them, and only where a column asks for them
(option ``content``); a file over the size bound keeps its row without content.

Archives are planned from their central directories alone, by range reads: a row an
entry. Entries are then dealt to tasks by size, and each is inflated up to the bound,
so that neither a large archive nor one that inflates without end fills a task's memory.

Cases: a marker of a file that is still in the cloud has size 0, no content and
placeholder true under the file's own name; folders deeper than ``depth`` are left
out; a file that cannot be read keeps its row with an error; an archive that is none
has one row with an error; a missing root is an error; an empty one gives no rows.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import assembly
from . import inventory as inv

DEPTH, MAX_BYTES = 12, inv.MAX_BYTES
SCHEMA = "path string, size long, modified_ms long, placeholder boolean, content binary, error string"
# fixed values: the shorter lists that hold inside archives
ARCHIVE_FOLDERS = (".git", ".obsidian", ".trash", "node_modules", "__macosx", ".svn")
ARCHIVE_FILES = (".ds_store", "thumbs.db", "desktop.ini")
_VISIBLE = re.compile(inv.VISIBLE_HIDDEN)


def skipped(name: str, folder: bool, folders=inv.IGNORED_FOLDERS, files=inv.IGNORED_FILES) -> bool:
    n = name.lower()
    if folder:
        return n in folders or n.startswith(".")
    return n in files or n.startswith(".") and not _VISIBLE.search(n)


def marker(name: str) -> str | None:
    """The file's own name, where this one marks a file that is still in the cloud."""
    m = re.fullmatch(r"(?i)\.(.+)\.icloud", name)
    return m[1] if m else None


@dataclass
class _Folder(InputPartition):
    path: str
    prefix: str
    level: int
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.depth = options["path"].rstrip("/") or "/", int(options.get("depth", DEPTH))
        self.content, self.most = options.get("content", "true").lower() == "true", int(options.get("maxbytes", MAX_BYTES))

    def _listed(self, path: str):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        found = sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda x: x.base_name)
        return system, [(x, x.type == fs.FileType.Directory) for x in found]

    def partitions(self):
        """The root's own files, those of each folder in it, and each folder below with all that it holds."""
        out = [_Folder(self.root, "", 0, False)]
        for info, folder in self._listed(self.root)[1]:
            if folder and not skipped(info.base_name, True) and self.depth >= 1:
                path, prefix = f"{self.root}/{info.base_name}", f"{info.base_name}/"
                out.append(_Folder(path, prefix, 1, False))
                if self.depth >= 2:
                    below = (x.base_name for x, inner in self._listed(path)[1] if inner and not skipped(x.base_name, True))
                    out += [_Folder(f"{path}/{name}", f"{prefix}{name}/", 2, True) for name in below]
        return out

    def read(self, partition):
        todo = [(partition.path, partition.prefix, partition.level)]
        while todo:
            path, prefix, level = todo.pop()
            system, found = self._listed(path)
            for info, folder in found:
                name = info.base_name
                if folder:
                    if partition.deep and level < self.depth and not skipped(name, True):
                        todo.append((f"{path}/{name}", f"{prefix}{name}/", level + 1))
                elif (own := marker(name)) is not None:
                    yield (prefix + own, 0, 0, True, None, None)
                elif not skipped(name, False):
                    modified = int(info.mtime.timestamp() * 1000) if info.mtime else 0
                    content, error = None, None
                    if self.content and info.size <= self.most:
                        try:
                            with system.open_input_stream(info.path, compression=None) as stream:
                                content = stream.read()
                        except OSError as problem:
                            error = str(problem)
                    yield (prefix + name, info.size, modified, False, content, error)


class FolderSource(DataSource):
    """Files below a folder. Options: path, depth, content, maxbytes."""

    @classmethod
    def name(cls):
        return "corpusfolder"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FolderReader(self.options)


def scan(spark: SparkSession, root: str, depth: int = DEPTH, content: bool = True) -> DataFrame:
    """path (below root), size, modified_ms, placeholder, content, error."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("corpusfolder").option("path", root).option("depth", depth).option("content", content).load()


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(inner)


def _kept(names: list[str]) -> list[str]:
    inside = lambda n: any(skipped(p, True, ARCHIVE_FOLDERS, ARCHIVE_FILES) for p in n.split("/")[:-1])
    return [n for n in names if not n.endswith("/") and not inside(n) and not skipped(n.rsplit("/", 1)[-1], False, ARCHIVE_FOLDERS, ARCHIVE_FILES)]


def common_root(names: list[str]) -> str:
    """The folder that holds all of two entries or more, with its slash; else nothing."""
    first = {n.split("/")[0] for n in names}
    return next(iter(first)) + "/" if len(names) > 1 and len(first) == 1 and "" not in first and all("/" in n for n in names) else ""


def planned(archives: DataFrame) -> DataFrame:
    """archives (archive: where it lies, path: its name) -> archive, path, entry, zip_path, size, error: only central directories are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, path in zip(batch["archive"], batch["path"]):
                try:
                    with _opened(archive) as file, zipfile.ZipFile(file) as z:
                        sizes = {i.filename: i.file_size for i in z.infolist()}
                    names = _kept(list(sizes))
                    cut = len(common_root(names))
                    rows = [(archive, path, n, n[cut:], sizes[n], None) for n in names]
                except Exception as error:  # the other archives can still be read
                    rows = [(archive, path, None, None, 0, str(error) or type(error).__name__)]
                yield pd.DataFrame(rows, columns=["archive", "path", "entry", "zip_path", "size", "error"])

    return archives.select("archive", "path").mapInPandas(run, "archive string, path string, entry string, zip_path string, size long, error string")


def entries(plan: DataFrame, parts: int | None = None, most: int = MAX_BYTES) -> DataFrame:
    """Rows of planned -> path (archive's/entry's), size, modified_ms, placeholder, content, error: each entry is read on its own and inflated up to a bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                content, error = None, None if pd.isna(row.error) else row.error
                if error is None:
                    try:
                        with _opened(row.archive) as file, zipfile.ZipFile(file) as z, z.open(row.entry) as stream:
                            content = stream.read(most + 1)  # what the directory says of the size may be untrue
                        if len(content) > most:
                            content, error = None, "over the size bound"
                    except Exception as problem:
                        content, error = None, str(problem) or type(problem).__name__
                path = row.path if pd.isna(row.zip_path) else f"{row.path}/{row.zip_path}"
                size = int(row.size) if content is None else len(content)
                yield pd.DataFrame([(path, size, 0, False, content, error)], columns=["path", "size", "modified_ms", "placeholder", "content", "error"])

    dealt = plan.repartition(parts or 2 * plan.sparkSession.sparkContext.defaultParallelism, F.xxhash64("archive", "entry"))
    return dealt.mapInPandas(run, SCHEMA)


def files(spark: SparkSession, root: str, depth: int = DEPTH) -> DataFrame:
    """All files below root, those inside archives too."""
    found = scan(spark, root, depth, content=False)
    packed = inv.is_zip(F.col("path")) & ~F.col("placeholder")
    inner = entries(planned(found.where(packed).select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("archive"), "path")))
    return scan(spark, root, depth).where(~packed).unionByName(inner)


def index(spark: SparkSession, root: str, depth: int = DEPTH, readers: dict | None = None, extra_stop=()) -> DataFrame:
    """The index of a folder: a row per file, whatever its bytes are, with its links."""
    return assembly.assembled(assembly.parsed(files(spark, root, depth), readers), extra_stop)

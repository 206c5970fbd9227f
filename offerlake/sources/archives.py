"""Archives of page files as a data source: a partition for each archive, pages in natural order, names filtered while reading."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

# Beginnings of names that archives made on other systems carry, and endings of images.
IGNORED = ("__MACOSX/", "._", ".DS_Store")
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tiff", ".tif")
#: Bytes of pages in one batch at most, but for single pages that are larger.
BATCH = 32 << 20
SCHEMA = "archive string, name string, page int, size long, data binary"


def ignored(name: str) -> bool:
    """Whether a name is of another system's notes or hidden, in any folder."""
    name = name.replace("\\", "/")
    return name.rpartition("/")[2].startswith(".") or any(name.startswith(p) or f"/{p}" in name for p in IGNORED)


def natural(name: str) -> list:
    """Sorts page2 before page10: the name without folder and ending, its digits as numbers; then the whole name."""
    stem = name.rpartition("/")[2]
    stem = stem.rpartition(".")[0] or stem
    parts = re.split(r"(\d+)", stem)
    return [*(int(p) if i % 2 else p.lower() for i, p in enumerate(parts))], name


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if re.match(r"\w+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
    return fs.LocalFileSystem(), path


class _Seekable(io.RawIOBase):
    """A file of any file system, as zipfile expects it: a place before the beginning is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + (0, self.file.tell(), self.file.size())[whence]
        if to < 0:
            raise OSError("before the beginning")
        self.file.seek(to)
        return to

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)


@dataclass
class _Archive(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.images = options["path"], options.get("images", "true").lower() == "true"
        self.prefixes: list[str] = []
        self.archive: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Beginnings of names, and one archive, are looked for here; what else is asked stays with Spark."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.prefixes.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("archive",) and self.archive is None:
                self.archive = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Names of archives only; none is opened on the driver."""
        system, path = file_system(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.Directory:
            listed = system.get_file_info(fs.FileSelector(path, recursive=True))
            paths = sorted(x.path for x in listed if x.is_file and x.path.lower().endswith(".zip") and not ignored(x.path[len(path) :].lstrip("/")))
        else:
            paths = [path] if found.is_file else []
        return [_Archive(p) for p in paths if self.archive is None or p.rpartition("/")[2] == self.archive]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        system, _ = file_system(self.path)
        archive, rows, size = partition.path.rpartition("/")[2], [], 0
        with system.open_input_file(partition.path) as file, zipfile.ZipFile(io.BufferedReader(_Seekable(file), 1 << 20)) as members:
            infos = [x for x in members.infolist() if not x.is_dir() and not ignored(x.filename) and (not self.images or x.filename.lower().endswith(IMAGES))]
            for page, info in enumerate(sorted(infos, key=lambda x: natural(x.filename)), 1):
                if not all(info.filename.startswith(p) for p in self.prefixes):
                    continue
                rows.append((archive, info.filename, page, info.file_size, members.read(info)))
                size += info.file_size
                if size >= BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([("archive", pa.string()), ("name", pa.string()), ("page", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class PageArchives(DataSource):
    """Format `page_archives`: option path (a folder or an archive), option images (false reads files of any kind)."""

    @classmethod
    def name(cls) -> str:
        return "page_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def pages(spark: SparkSession, path: str, images: bool = True) -> DataFrame:
    """(archive, name, page, size, data) of the pages in the archives below path: one task an archive, which holds one batch of
    pages. page counts from 1 in natural order of all pages, before any filter. Hidden files and other systems' notes are left
    out. Filters on the beginning of name, and on archive, are applied before pages are read. A file that is no archive fails
    the task that reads it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageArchives)
    return spark.read.format("page_archives").option("images", str(images).lower()).load(path)


def write_archives(files: DataFrame, path: str) -> DataFrame:
    """(archive, n): writes files (archive, name, data) into zip archives below path, each in one task, file after file. An
    archive that is written again is replaced."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(path)
        system.create_dir(folder, recursive=True)
        at, out, zipped, n, done = None, None, None, 0, []
        for batch in batches:
            for archive, name, data in zip(*(batch.column(c).to_pylist() for c in ("archive", "name", "data"))):
                if archive != at:
                    if zipped:
                        zipped.close()
                        out.close()
                        done.append((at, n))
                    at, n, out = archive, 0, system.open_output_stream(f"{folder}/{archive}")
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                zipped.writestr(name, data)
                n += 1
        if zipped:
            zipped.close()
            out.close()
            done.append((at, n))
        yield pa.RecordBatch.from_pydict({"archive": [a for a, _ in done], "n": [c for _, c in done]}, schema=pa.schema([("archive", pa.string()), ("n", pa.int64())]))

    return files.select("archive", "name", F.col("data").cast("binary").alias("data")).repartition("archive").sortWithinPartitions("archive", "name").mapInArrow(write, "archive string, n long")

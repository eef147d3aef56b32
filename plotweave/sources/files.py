"""A Spark data source that writes rows as single files under paths of their own.

Spark's writers name their files themselves. Here a row is (path, content), and the file
stands at that path below the target folder. Tasks write to folders of their own under
``_writing``, with a list of the paths. Only when all tasks have ended well are the files moved
into place, task by task, so tasks that fail, are killed or run twice leave nothing there. The
driver moves names, as Spark's own file committer does; contents never pass through it.

The target is any folder that pyarrow can open on the executors: a path they share or the
address of a store. Files already there under the same paths are replaced.
"""

from __future__ import annotations

import posixpath
import uuid
from itertools import batched
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from plotweave.session import cut


_MOVERS = 32
#: Moves that the driver has in hand at a time.
_PORTION = 1024
#: Bytes of contents that a reading task has in hand at a time, unless one file is larger.
_READ = 8 << 20


def _opened(target: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (pafs.LocalFileSystem(), target)


def _checked(path: str | None) -> str:
    """A relative path that stays below the target."""
    plain = posixpath.normpath(path or "")
    if not path or plain.startswith(("/", "..")) or plain.split("/")[0] in (".", "_writing"):
        raise ValueError(f"not a path below the target: {path!r}")
    return plain


@dataclass
class _Written(WriterCommitMessage):
    """The folder that holds one task's files."""

    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, target: str):
        self.target = target
        self.job = f"_writing/{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, root = _opened(self.target)
        own = f"{self.job}/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{own}", recursive=True)
        paths = []
        for number, row in enumerate(rows):
            paths.append(_checked(row["path"]))
            if row["content"] is None:
                raise ValueError(f"no content for {paths[-1]}")
            with store.open_output_stream(f"{root}/{own}/{number}") as out:
                out.write(bytes(row["content"]))
        with store.open_output_stream(f"{root}/{own}/paths") as out:
            out.write("\n".join(paths).encode())
        return _Written(own)

    def _listed(self, messages: list) -> Iterator[tuple[str, str]]:
        """(where a file was written, where it belongs) of the tasks that ended well."""
        store, root = _opened(self.target)
        for message in messages:
            if message is not None:
                with store.open_input_stream(f"{root}/{message.folder}/paths") as held:
                    names = held.read().decode()
                for number, name in enumerate(names.split("\n") if names else []):
                    yield f"{root}/{message.folder}/{number}", f"{root}/{name}"

    def _clear(self) -> None:
        store, root = _opened(self.target)
        if store.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")

    def commit(self, messages: list) -> None:
        store, _ = _opened(self.target)

        def move(pair: tuple[str, str]) -> None:
            store.create_dir(posixpath.dirname(pair[1]), recursive=True)
            store.move(*pair)

        with ThreadPoolExecutor(_MOVERS) as pool:
            for portion in batched(self._listed(messages), _PORTION):
                for _ in pool.map(move, portion):
                    pass
        self._clear()

    def abort(self, messages: list) -> None:
        # Nothing has been moved, unless a commit broke off: what is no longer here is there.
        store, _ = _opened(self.target)
        for here, there in self._listed(messages):
            if store.get_file_info(here).type == pafs.FileType.NotFound and store.get_file_info(there).type == pafs.FileType.File:
                store.delete_file(there)
        self._clear()


class NamedFiles(DataSource):
    """``df.write.format("named_files").mode("append").save(folder)`` for (path, content) rows."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        names = {f.name for f in schema.fields}
        if not {"path", "content"} <= names:
            raise ValueError("named files need the columns path and content")
        return _Writer(self.options["path"])


def write_named(files: DataFrame, folder: str) -> None:
    """Write (path, content) rows as files below ``folder``."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(NamedFiles)
    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    rows.write.format("named_files").mode("append").save(folder)


def _hidden(name: str) -> bool:
    """Names that Spark's file readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _lister(target: str):
    """Folders (path) to what stands in them (path, size); a folder has no size."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(target)
        for batch in batches:
            for folder in batch["path"].to_pylist():
                found = [x for x in store.get_file_info(pafs.FileSelector(f"{root}/{folder}" if folder else root)) if not _hidden(x.base_name)]
                sizes = [None if x.type == pafs.FileType.Directory else x.size for x in found]
                paths = [posixpath.join(folder, x.base_name) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return listed


def _reader(target: str):
    """Files (path) to (path, content)."""

    def batch_of(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], ["path", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(target)
        rows, held = [], 0
        for batch in batches:
            for path in batch["path"].to_pylist():
                with store.open_input_stream(f"{root}/{path}") as stream:
                    rows.append((path, stream.read()))
                held += len(rows[-1][1])
                if held >= _READ:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return read


def read_named(spark: SparkSession, folder: str) -> DataFrame:
    """All files below ``folder`` as (path, content), paths relative to it; unfinished ones are left out.

    Tasks list the folders, level by level, and read the files: no list of them passes through the
    driver. As with Spark's file readers, empty files have no row.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, files = spark.createDataFrame([("",)], "path string"), None
    while files is None or not level.isEmpty():
        found = cut(level.repartition(parts).mapInArrow(_lister(folder), "path string, size long"))
        here = found.filter("size > 0").select("path")
        files = here if files is None else files.unionByName(here)
        level = found.filter("size IS NULL").select("path")
    return files.repartition(parts).mapInArrow(_reader(folder), "path string, content binary")

"""A data source that writes one file for each row, df.write.format("text-files").save(folder), and a reader of such folders."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files of tasks that aren't finished, within the folder; its name keeps Spark's readers out.
PENDING = "_pending"
#: Names that are dealt to tasks together, and bytes of texts that a reader holds before it hands them on.
DEALT, HELD = 100, 1 << 23


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


@dataclass
class Written(WriterCommitMessage):
    files: int


class FilesWriter(DataSourceWriter):
    """A task writes each file in a folder of its own and then moves it to its final place.

    So a reader never sees half a file, and a task that is repeated, or runs
    twice, puts the same text in the same place. What lost tasks left is
    deleted at the end, and _SUCCESS tells that all files are there.
    """

    def __init__(self, folder: str, overwrite: bool):
        self.folder = folder
        system, path = self.place()
        if overwrite and system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir_contents(path)
        system.create_dir(f"{path}/{PENDING}", recursive=True)

    def place(self) -> tuple[fs.FileSystem, str]:
        return opened(self.folder)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, path = self.place()
        count, own = 0, f"{path}/{PENDING}/{uuid.uuid4().hex}"
        system.create_dir(own)  # tasks don't wait for each other's turn in one folder
        for name, text in iterator:
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"{name!r} can't be a file's name")
            pending = f"{own}/{name}"
            with system.open_output_stream(pending) as out:
                out.write((text or "").encode())
            system.move(pending, f"{path}/{name}")
            count += 1
        return Written(count)

    def commit(self, messages: list) -> None:
        system, path = self.place()
        system.delete_dir(f"{path}/{PENDING}")
        with system.open_output_stream(f"{path}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list) -> None:
        system, path = self.place()
        system.delete_dir(f"{path}/{PENDING}")


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text-files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, folder: str) -> None:
    """rows of name and text, names unique, as files in a folder, which is emptied first.

    The folder is one that pyarrow can open everywhere: a shared local path, hdfs://, s3:// or gs://.
    """
    rows.sparkSession.dataSource.register(TextFiles)
    rows.select("name", "text").write.format("text-files").mode("overwrite").save(folder)


def _names(folder: str) -> Iterator[str]:
    """The folder's files; a local folder's names are never held together."""
    system, path = opened(folder)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as found:
            yield from (f.name for f in found if f.is_file())
    else:
        yield from (f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File)


def _listed(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _ in range(part.num_rows):
                for names in batched((n for n in _names(folder) if not n.startswith(("_", "."))), DEALT):
                    yield pa.record_batch([pa.array([list(names)], pa.list_(pa.string()))], names=["names"])

    return listed


def _read(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for part in parts:
            for names in part.column(0):
                done, texts, held = [], [], 0
                for name in names.as_py():
                    with system.open_input_stream(f"{path}/{name}") as file:
                        texts.append(file.read())
                    done.append(name)
                    held += len(texts[-1])
                    if held > HELD:
                        yield pa.record_batch([pa.array(done, pa.string()), pa.array(texts, pa.binary())], names=["name", "text"])
                        done, texts, held = [], [], 0
                yield pa.record_batch([pa.array(done, pa.string()), pa.array(texts, pa.binary())], names=["name", "text"])

    return read


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of the files in a folder that write_files() can write, hidden ones left out.

    Spark's own reader lists them on the driver and plans a task for every
    few files. Here one task lists names alone, and a fixed number of tasks
    reads what is dealt to them, so that neither the driver nor the number of
    tasks grows with the files.
    """
    names = spark.range(1, numPartitions=1).mapInArrow(_listed(folder), "names array<string>")
    dealt = names.repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(_read(folder), "name string, text binary").select("name", F.col("text").cast("string").alias("text"))

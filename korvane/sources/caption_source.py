"""WebVTT files as a data source of Spark, for batches and for streams.

    spark.dataSource.register(CaptionSource)
    spark.read.format("webvtt").option("first", 10).load("/mnt/videos")
    spark.readStream.format("webvtt").load("/mnt/videos")

A partition is a file, and tasks read the files; the planner lists the folder only. Rows are (video_id, file, value) with
the whole file, which ``transcript.cues`` turns into captions. A folder without such files, an empty file and one that
doesn't begin as WebVTT are errors. The store must be one that pyarrow opens, a mounted folder or a URI.

A stream's offset is the last path that it has read, so later files need later names, as those with a number or a date
have; ``files_per_batch`` bounds a batch. What a checkpoint has been through isn't read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from korvane.operators.transcript import cues

SCHEMA = "video_id string, file string, value string"
FILES_PER_BATCH = 1000


class CaptionFile(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


def caption_files(folder: str) -> list[str]:
    """The paths of all WebVTT files right in a folder, in their order."""
    store, path = _opened(folder)
    infos = store.get_file_info(pa_fs.FileSelector(path))
    return sorted(f.path for f in infos if f.type == pa_fs.FileType.File and f.path.endswith(".vtt"))


def _opened(path: str) -> tuple[pa_fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pa_fs.LocalFileSystem(), path
    return pa_fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def whole_file(folder: str, file: str) -> tuple[str, str, str]:
    """(video_id, file, value) of a file, checked."""
    with _opened(folder)[0].open_input_stream(file) as stream:
        value = stream.read().decode("utf-8-sig")
    if not value.strip():
        raise ValueError(f"empty: {file}")
    if not value.startswith("WEBVTT"):
        raise ValueError(f"not WebVTT: {file}")
    return file.rpartition("/")[2].removesuffix(".vtt"), file, value


class CaptionReader(DataSourceReader):
    def __init__(self, folder: str, first: int | None):
        self.folder, self.first = folder, first

    def partitions(self) -> Sequence[InputPartition]:
        found = caption_files(self.folder)
        if not found:
            raise ValueError(f"{self.folder} has no WebVTT files")
        return [CaptionFile(f) for f in (found if self.first is None else found[: self.first])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield whole_file(self.folder, partition.file)


class CaptionStreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, files_per_batch: int):
        self.folder, self.files_per_batch = folder, files_per_batch
        self.planned = ""  # the end of the last batch that was planned here

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        new = [f for f in caption_files(self.folder) if f > self.planned][: self.files_per_batch]
        self.planned = new[-1] if new else self.planned
        return {"after": self.planned}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.planned = max(self.planned, end["after"])
        return [CaptionFile(f) for f in caption_files(self.folder) if start["after"] < f <= end["after"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield whole_file(self.folder, partition.file)

    def commit(self, end: dict) -> None:
        pass


class CaptionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webvtt"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        first = self.options.get("first")
        return CaptionReader(self.options["path"], None if first is None else int(first))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptionStreamReader(self.options["path"], int(self.options.get("files_per_batch", FILES_PER_BATCH)))


def caption_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The captions of a folder's files as they come."""
    spark.dataSource.register(CaptionSource)
    return cues(spark.readStream.format("webvtt").option("files_per_batch", files_per_batch).load(path))

"""All-or-nothing output: tasks write files of their own, and one manifest file publishes them.

A table is a folder with data/ (Parquet files) and manifests/ (numbered JSON files). Tasks of a
write put their rows in new files under data/; the driver lists them in the next manifest only
after every task has ended, and a manifest appears under its name by one move. Readers take the
files of the manifest with the greatest number. So a killed task or job, or one that fails half
way, leaves the table as it was, and a reader that began before a write goes on with its own
files. Reading is Spark's Parquet source on the listed files.

One writer at a time is assumed: two at once may publish under one number, and the later stays.
Folders are opened with pyarrow.fs (a local path or a URI of a store that it knows).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tessera_published"
#: Rows of a file's row group at most, and rows that one file holds at most.
GROUP_ROWS, FILE_ROWS = 1 << 17, 1 << 22


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def manifests(path: str) -> list[str]:
    """The manifests of a table, oldest first."""
    store, root = _opened(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".json"))


def manifest(path: str, version: int | None = None) -> dict:
    """A manifest: version, schema (JSON) and files (names under data/); the newest one if no version is given. None there: version 0."""
    store, _ = _opened(path)
    for name in reversed(manifests(path)):
        if version is None or int(name.rpartition("/")[2][:-5]) == version:
            with store.open_input_stream(name) as f:
                return json.loads(f.read())
    if version:
        raise FileNotFoundError(f"{path} has no version {version}")
    return {"version": 0, "schema": None, "files": []}


@dataclass
class Staged(WriterCommitMessage):
    files: list[str]


class PublishedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.run = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = _opened(self.path)
        store.create_dir(f"{root}/data", recursive=True)
        files, out, rows = [], None, 0
        try:
            for batch in iterator:
                if out is None or rows >= FILE_ROWS:
                    if out:
                        out.close()
                    files.append(f"{self.run}-{uuid.uuid4().hex}.parquet")
                    out, rows = pq.ParquetWriter(f"{root}/data/{files[-1]}", batch.schema, filesystem=store), 0
                out.write_batch(batch, row_group_size=GROUP_ROWS)
                rows += batch.num_rows
        finally:
            if out:
                out.close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _opened(self.path)
        last = manifest(self.path)
        if not self.overwrite and last["schema"] and StructType.fromJson(json.loads(last["schema"])).simpleString() != self.schema.simpleString():
            raise ValueError(f"{self.path} has other columns: {last['schema']}")
        files = ([] if self.overwrite else last["files"]) + [f for m in messages if m for f in m.files]
        body = {"version": last["version"] + 1, "schema": self.schema.json(), "files": files}
        store.create_dir(f"{root}/manifests", recursive=True)
        hidden = f"{root}/manifests/.{self.run}"
        with store.open_output_stream(hidden) as f:
            f.write(json.dumps(body).encode())
        store.move(hidden, f"{root}/manifests/{body['version']:012d}.json")

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = _opened(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/data/{f}")


class Published(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PublishedWriter:
        return PublishedWriter(self.options["path"], schema, overwrite)


def publish(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """df as the table's next version, in place of its rows or added to them."""
    df.sparkSession.dataSource.register(Published)
    df.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of one that is named."""
    told = manifest(path, version)
    if told["schema"] is None:
        raise FileNotFoundError(f"{path} has no version")
    schema = StructType.fromJson(json.loads(told["schema"]))
    files = [f"{path.rstrip('/')}/data/{f}" for f in told["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def remove_unlisted(path: str, keep: int = 1) -> int:
    """Deletes all manifests but the newest `keep` and data files that none of those lists; run it while nothing writes or reads older versions."""
    store, root = _opened(path)
    names = manifests(path)
    listed = set()
    for name in names[-keep:]:
        with store.open_input_stream(name) as f:
            listed |= set(json.loads(f.read())["files"])
    for name in names[:-keep]:
        store.delete_file(name)
    gone = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if f.path.rpartition("/")[2] not in listed]
    for f in gone:
        store.delete_file(f)
    return len(gone)

"""A transactional Parquet sink for draws and results: a Spark data source writer with two-phase commit.

Tasks write their own files under a name of their own and report them; only when all
have is a manifest of the version written, which names its files. Readers go by the
newest manifest, so a run that fails or is aborted leaves the version before as it was,
and files of task attempts that didn't report are never read. A run that is repeated
under its name changes nothing.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MANIFESTS, FILES = "_manifests", "files"


@dataclass
class Written(WriterCommitMessage):
    """What one task reports: its file and rows; no file without rows."""

    file: str | None
    rows: int


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a uri or a plain path, and the path there."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def manifests(uri: str) -> list[dict]:
    """All committed versions, oldest first."""
    files, at = _open(uri)
    infos = files.get_file_info(fs.FileSelector(posixpath.join(at, MANIFESTS), allow_not_found=True))
    out = []
    for info in infos:
        if info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    return sorted(out, key=lambda m: m["version"])


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.uri, self.run, self.overwrite = options["path"], options.get("run") or uuid.uuid4().hex, overwrite
        self.schema = to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = _open(self.uri)
        name, rows, out = f"{FILES}/{self.run}-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(posixpath.join(at, FILES), recursive=True)
                out = pq.ParquetWriter(posixpath.join(at, name), self.schema, filesystem=files)
            out.write_table(pa.Table.from_batches([batch]).cast(self.schema))
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _open(self.uri)
        known = manifests(self.uri)
        if any(m["run"] == self.run for m in known):  # this run is there already
            self.abort(messages)
            return
        own = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.file]
        last = known[-1] if known else {"version": 0, "files": []}
        made = {"version": last["version"] + 1, "run": self.run, "files": own if self.overwrite else last["files"] + own}
        files.create_dir(posixpath.join(at, MANIFESTS), recursive=True)
        final = posixpath.join(at, MANIFESTS, f"{made['version']:012d}.json")
        with files.open_output_stream(f"{final}.{self.run}") as f:
            f.write(json.dumps(made).encode())
        files.move(f"{final}.{self.run}", final)  # a reader sees all of it or none

    def abort(self, messages: list[Written | None]) -> None:
        files, at = _open(self.uri)
        for m in messages:
            if m is not None and m.file:
                files.delete_file(posixpath.join(at, m.file))


class Store(DataSource):
    """df.write.format("draw_store").option("run", name).mode("append" or "overwrite").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "draw_store"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return StoreWriter(self.options, schema, overwrite)


def write(rows: DataFrame, uri: str, run: str, mode: str = "append") -> None:
    """rows as a new version of the store: added to the last one's, or in its place (overwrite)."""
    spark = rows.sparkSession
    spark.dataSource.register(Store)
    rows.write.format("draw_store").option("run", run).mode(mode).save(uri)


def read(spark: SparkSession, uri: str, version: int | None = None) -> DataFrame | None:
    """The rows of the newest version, or of a given one; None without any."""
    own = [m for m in manifests(uri) if version is None or m["version"] == version]
    names = [posixpath.join(uri, x["file"]) for x in own[-1]["files"]] if own else []
    return spark.read.parquet(*names) if names else None

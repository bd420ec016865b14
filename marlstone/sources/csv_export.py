"""CSV exports as a Python data source: `df.write.format("csv_export")`, one final file by a commit protocol.

Every task attempt writes under a key of its own and tells the driver how many rows and bytes it wrote; an attempt that fails or is
repeated leaves nothing that counts. The commit joins the parts named by the messages, in the order of partitions, to a file under a temporary key, takes its size and
SHA-256 on the way, moves it to its final name and puts a manifest beside it. An abort removes what attempts left.

One file is one stream: its bytes pass the committing process a piece at a time. Exports are made for people and bounded by their `max_rows`;
`sinks.write_csv` writes those that are not, as many files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ready
from . import stores
from .sinks import BOM, ExportColumn, export_lines


@dataclass
class Part(WriterCommitMessage):
    """What one attempt wrote."""

    partition: int
    key: str
    rows: int
    bytes: int


class CsvWriter(DataSourceArrowWriter):
    """Writes a frame of one column of lines; options: path (the final file), header, job (names the attempts' folder)."""

    def __init__(self, options: dict):
        self.path, self.header, self.job = options["path"], options.get("header", ""), options["job"]

    def _attempts(self) -> str:
        return f"{self.path}.attempts-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        store, folder = stores.opened(self._attempts())
        store.create_dir(folder, recursive=True)
        key, rows, size = f"{folder}/{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}", 0, 0
        with store.open_output_stream(key) as out:
            for batch in batches:
                data = "".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode()
                out.write(data)
                rows, size = rows + batch.num_rows, size + len(data)
        return Part(context.partitionId(), key, rows, size)

    def commit(self, messages: list[Part | None]) -> None:
        store, final = stores.opened(self.path)
        _, folder = stores.opened(self._attempts())
        store.create_dir(folder, recursive=True)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        digest, size, temporary = hashlib.sha256(), 0, f"{folder}/whole"
        with store.open_output_stream(temporary) as out:
            for piece in self._bytes(store, parts):
                digest.update(piece)
                size += len(piece)
                out.write(piece)
        store.move(temporary, final)
        manifest = {"file": final, "bytes": size, "rows": sum(m.rows for m in parts), "sha256": digest.hexdigest()}
        with store.open_output_stream(f"{final}.manifest.json") as out:
            out.write(json.dumps(manifest).encode())
        store.delete_dir(folder)

    def _bytes(self, store, parts: list[Part]) -> Iterator[bytes]:
        yield (BOM + self.header + "\n").encode()
        for part in parts:
            seen = 0
            for piece in stores.pieces(store, part.key):
                seen += len(piece)
                yield piece
            if seen != part.bytes:
                raise OSError(f"{part.key} holds {seen} bytes, {part.bytes} were written")

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = stores.opened(self._attempts())
        if store.get_file_info(folder).type != stores.fs.FileType.NotFound:
            store.delete_dir(folder)


class CsvExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_export"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("csv_export writes one column of lines")
        return CsvWriter(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session."""
    ready(spark).dataSource.register(CsvExport)
    return spark


def write_file(rows: DataFrame, columns: list[ExportColumn], order: list[Column], path: str, zone: str = "UTC", max_rows: int | None = None) -> DataFrame:
    """Write an export to one file and return its manifest: file, bytes, rows, sha256."""
    spark = register(rows.sparkSession)
    head, lines = export_lines(rows, columns, order, zone, max_rows)
    lines.write.format("csv_export").mode("append").option("path", path).option("header", head).option("job", uuid.uuid4().hex).save()
    return spark.read.schema("file string, bytes long, rows long, sha256 string").json(f"{path}.manifest.json")

"""A sink that adds a version of an object to the catalogue when all of its files are there, and leaves nothing behind if not.

    spark.dataSource.register(CataloguedSink)
    df.write.format("catalogued").mode("append").options(root=..., object_name=..., bucket=..., prefix=..., metadata="{}").save()

Each task writes a Parquet file of its own into the folder of the version, which nobody reads before the catalogue
names it. The commit drops files of repeated attempts and then adds the catalogue's row, in one file that is
moved into place; the abort removes the folder. Catalog.store writes through it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROW = pa.schema([
    ("bucket", pa.string()), ("prefix", pa.string()), ("object_name", pa.string()), ("path", pa.string()), ("format", pa.string()),
    ("custom", pa.map_(pa.string(), pa.string())), ("version", pa.int64()), ("deleted", pa.bool_()),
])


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class CataloguedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogued"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return CataloguedWriter(schema, dict(self.options))


class CataloguedWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str]):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)
        self.root = options["root"].rstrip("/")
        self.bucket, self.prefix = options.get("bucket", "default"), options.get("prefix", "")
        self.name = options["object_name"]
        # options reach the writer in lower case, the metadata's keys as they are
        self.custom = {k: str(v) for k, v in json.loads(options.get("metadata", "{}")).items()}
        self.folder = "/".join(x for x in (self.root, self.bucket, self.prefix, f"{self.name}.{uuid.uuid4().hex}.parquet") if x)

    def _place(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self._place(self.folder)
        system.create_dir(folder, recursive=True)
        file, rows = f"part-{uuid.uuid4().hex}.parquet", 0
        with system.open_output_stream(f"{folder}/{file}") as out, pq.ParquetWriter(out, self.arrow) as writer:
            for batch in iterator:
                rows += batch.num_rows
                writer.write_table(pa.Table.from_batches([batch]).cast(self.arrow))
        return Written(file, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = self._place(self.folder)
        kept = {m.file for m in messages if m}
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name not in kept:
                system.delete_file(info.path)
        if not kept:
            system.create_dir(folder, recursive=True)
            pq.write_table(self.arrow.empty_table(), f"{folder}/part-empty.parquet", filesystem=system)
        system, log = self._place(f"{self.root}/_catalog")
        system.create_dir(log, recursive=True)
        known = [i.path for i in system.get_file_info(fs.FileSelector(log)) if i.base_name.endswith(".parquet") and not i.base_name.startswith((".", "_"))]
        versions = [max(v.to_pylist(), default=0) for v in (pq.read_table(p, columns=["version"], filesystem=system)["version"] for p in known)]
        row = (self.bucket, self.prefix, self.name, self.folder, "parquet", list(self.custom.items()), max(versions, default=0) + 1, False)
        table = pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, ROW.types, strict=True)], schema=ROW)
        hidden = f"{log}/.{uuid.uuid4().hex}"
        pq.write_table(table, hidden, filesystem=system)
        system.move(hidden, f"{log}/part-{uuid.uuid4().hex}.parquet")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = self._place(self.folder)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)

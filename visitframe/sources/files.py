"""Reading and writing files: format by extension, NULL as the only missing value."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

TEXT_LIKE = frozenset("txt md py js html css xml yml yaml".split())


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN becomes NULL; other columns pass untouched."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FloatType | DoubleType)}
    return df.select(
        *[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]
    )


def with_row_id(df: DataFrame, order: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """A last tie-break for order-dependent operators: a hash of the natural key, or, without
    one, an id by position in the input."""
    if order:
        return df.withColumn(name, F.xxhash64(*order))
    return df.withColumn(name, F.monotonically_increasing_id())


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()


def read_csv(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", schema: StructType | None = None
) -> DataFrame:
    """Delimited text; the separator follows the extension unless given."""
    reader = spark.read.option("header", True).option("sep", sep or ("\t" if extension(path) == "tsv" else ","))
    reader = reader.option("encoding", encoding).option("nanValue", "NaN")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def decimal_comma(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers written with a decimal comma become doubles; what isn't a number becomes NULL."""
    return df.withColumns({c: F.regexp_replace(c, ",", ".").try_cast("double") for c in columns})


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Tabular files by extension; text-like files as one row; anything else as raw bytes."""
    kind = extension(path)
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, **options)
    if kind == "json":
        return nan_to_null(spark.read.option("multiLine", True).json(path))
    if kind in ("parquet", "pq"):
        return nan_to_null(spark.read.parquet(path))
    if kind in ("xlsx", "xls"):
        return read_excel(spark, path)
    if kind in TEXT_LIKE:
        return spark.read.text(path, wholetext=True)
    return spark.read.format("binaryFile").load(path)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, schema: StructType | None = None) -> DataFrame:
    """A sheet of a workbook (the first by default, `*` for all), read on the executors: see sources.workbook."""
    from visitframe.sources.workbook import WorkbookSource

    if extension(path) == "xls":
        raise ValueError("binary .xls files aren't read: save the workbook as .xlsx")
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook")
    reader = reader.option("sheet", sheet) if sheet else reader
    return (reader.schema(schema) if schema else reader).load(path)


#: Rows of a table that write_single takes at most.
MOST_SINGLE = 1_000_000


def write_single(df: DataFrame, path: str, first: list[str] | None = None, last: list[str] | None = None, most: int = MOST_SINGLE) -> None:
    """One named file for a report or summary: csv (with a header), json (a list of records) or txt (aligned columns), by
    extension, columns in the order of `first`, the others, `last`. Reports are small: over `most` rows raise an error."""
    from visitframe.operators.ordering import order_columns

    ordered = order_columns(df, first or [], last or [])
    table = ordered.limit(most + 1).toPandas()
    if len(table) > most:
        raise ValueError(f"over {most} rows: write a folder")
    kind = extension(path)
    if kind == "csv":
        table.to_csv(path, index=False)
    elif kind == "json":
        table.to_json(path, orient="records", date_format="iso", indent=1)
    elif kind == "txt":
        with open(path, "w", encoding="utf-8") as out:
            out.write(table.to_string(index=False) + "\n")
    else:
        raise ValueError(f"no single-file writer for .{kind}")


def write_pair(df: DataFrame, path: str, first: list[str] | None = None) -> tuple[str, str]:
    """A report as <path>.csv and <path>.json."""
    made = (f"{path}.csv", f"{path}.json")
    for p in made:
        write_single(df, p, first)
    return made


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content): members of ZIP files, an archive per task."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame(
                                {"archive": [archive], "member": [info.filename], "content": [z.read(info)]}
                            )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "archive string, member string, content binary")


def extract_zip(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(archive, member, line_no, line): the lines of the delimited members of ZIP files, with
    latin-1 where a member isn't valid in `encoding`."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                try:
                    text = row.content.decode(encoding)
                except UnicodeDecodeError:
                    text = row.content.decode("latin-1")
                own = text.splitlines()
                yield pd.DataFrame(
                    {"archive": row.archive, "member": row.member, "line_no": range(len(own)), "line": own}
                )

    tabular = zip_members(spark, path).where(F.lower("member").rlike(r"\.(csv|tsv|txt)$"))
    return tabular.mapInPandas(lines, "archive string, member string, line_no long, line string")


def write(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists", **options) -> None:
    """csv (with a header), json or parquet; anything Spark has a writer for."""
    writer = df.write.mode(mode).options(**options)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)

"""A metadata catalogue: a table of file documents next to the files, found by predicates.

Each entry has bucket, prefix, object_name, path, format and `custom`, a map of strings.
The catalogue is a Parquet folder of appended entries; the newest entry of an object counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitframe.session import materialize
from visitframe.sources import files

SCHEMA = (
    "bucket string, prefix string, object_name string, path string, format string, "
    "custom map<string,string>, version long, deleted boolean"
)


def predicate(query: Mapping[str, object], custom: str = "custom") -> Column:
    """All conditions hold. A key is a column or custom.<name>; a list of values means IN."""
    found = F.lit(True)
    for key, value in query.items():
        column = F.col(custom)[key.removeprefix("custom.")] if key.startswith("custom.") else F.col(key)
        wanted = [str(v) for v in value] if isinstance(value, list | tuple | set) else [str(value)]
        found = found & F.coalesce(column.cast("string").isin(wanted), F.lit(False))
    return found


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/_catalog")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def entries(self) -> DataFrame:
        w = Window.partitionBy("bucket", "prefix", "object_name").orderBy(F.col("version").desc())
        newest = self._log().withColumn("__no", F.row_number().over(w)).where("__no = 1 and not deleted")
        return newest.drop("__no", "deleted")

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/_catalog")

    def _next(self) -> int:
        return (self._log().agg(F.max("version")).first()[0] or 0) + 1

    def upload(
        self,
        df: DataFrame,
        object_name: str,
        bucket: str = "default",
        prefix: str = "",
        metadata: Mapping[str, str] | None = None,
        file_format: str = "parquet",
        **options,
    ) -> str:
        """Write df and register it; an object of that name is replaced."""
        version = self._next()
        path = "/".join(x for x in (self.root, bucket, prefix, f"{object_name}.v{version}.{file_format}") if x)
        files.write(df, path, file_format, **options)
        custom = {k: str(v) for k, v in (metadata or {}).items()}
        self._append([(bucket, prefix, object_name, path, file_format, custom, version, False)])
        return path

    def store(
        self, df: DataFrame, object_name: str, bucket: str = "default", prefix: str = "", metadata: Mapping[str, str] | None = None
    ) -> None:
        """Write df and register it in one transaction: if a task fails, neither file nor version stays."""
        from visitframe.sources.catalogued import CataloguedSink

        self.spark.dataSource.register(CataloguedSink)
        options = {"root": self.root, "object_name": object_name, "bucket": bucket, "prefix": prefix, "metadata": json.dumps(dict(metadata or {}))}
        df.write.format("catalogued").mode("append").options(**options).save()

    def publish_reversed(self, df: DataFrame, file_code: str, file_name: str, prefix: str = "synthetic/reversed", level: str = "reversed") -> str:
        """Store a table whose encodings were reversed under the name of its source with `_reversed`; returns that name."""
        name = versioned_name(file_name, "_reversed")
        self.store(df, name, prefix=prefix, metadata={"file_code": file_code, "level": level})
        return name

    def upload_file(self, path: str, object_name: str, bucket: str = "default", prefix: str = "", metadata: Mapping[str, str] | None = None) -> str:
        """Copy a file as it is, of any kind, and register it; the bytes go through Arrow's file systems in pieces."""
        from pyarrow import fs

        version = self._next()
        kind = files.extension(path)
        target = "/".join(x for x in (self.root, bucket, prefix, f"{object_name}.v{version}" + (f".{kind}" if kind else "")) if x)
        system, place = fs.FileSystem.from_uri(target)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        fs.copy_files(path, target)
        custom = {k: str(v) for k, v in (metadata or {}).items()}
        self._append([(bucket, prefix, object_name, target, kind, custom, version, False)])
        return target

    def search(self, query: Mapping[str, object], bucket: str | None = None) -> DataFrame:
        found = self.entries().where(predicate(query))
        return found.where(F.col("bucket") == bucket) if bucket else found

    def metadata(self, object_name: str, bucket: str = "default", prefix: str = "") -> DataFrame:
        return self.search({"object_name": object_name, "bucket": bucket, "prefix": prefix})

    def update_metadata(self, object_name: str, changes: Mapping[str, str], bucket: str = "default", prefix: str = "") -> None:
        row = self.metadata(object_name, bucket, prefix).first()
        if row is None:
            raise KeyError(object_name)
        custom = dict(row["custom"] or {}) | {k: str(v) for k, v in changes.items()}
        self._append([(bucket, prefix, object_name, row["path"], row["format"], custom, self._next(), False)])

    def delete(self, object_name: str, bucket: str = "default", prefix: str = "") -> None:
        """The entry goes; the files stay for readers that have begun."""
        self._append([(bucket, prefix, object_name, "", "", {}, self._next(), True)])

    def load(self, query: Mapping[str, object]) -> dict[str, DataFrame]:
        """Every matching object by name. What is collected are the catalogue's rows."""
        return {r["object_name"]: self._read(r) for r in self.search(query).orderBy("bucket", "prefix", "object_name").collect()}

    def load_first(self, query: Mapping[str, object]) -> DataFrame:
        row = self.search(query).orderBy("bucket", "prefix", "object_name").first()
        if row is None:
            raise LookupError(f"nothing matches {dict(query)}")
        return self._read(row)

    def load_pair(self, file_code: str, level: str) -> tuple[DataFrame, DataFrame]:
        """A real table and its synthetic counterpart, by the naming rule."""
        return tuple(
            self.load_first({"custom.file_code": code, "custom.level": level}) for code in (file_code, file_code + "synthetic")
        )

    def _read(self, row) -> DataFrame:
        if row["format"] == "csv":
            return files.read_csv(self.spark, row["path"])
        if row["format"] not in ("parquet", "json", "orc"):
            return files.read_any(self.spark, row["path"])
        return files.nan_to_null(self.spark.read.format(row["format"]).load(row["path"]))


def load_typed(tables: Mapping[str, DataFrame], dates: Sequence[str], strings: Sequence[str]) -> dict[str, DataFrame]:
    """Dates parsed leniently, version-like columns as strings."""
    out = {}
    for name, df in tables.items():
        changes = {c: F.try_to_timestamp(F.col(c).cast("string")).cast("date") for c in dates if c in df.columns}
        out[name] = df.withColumns(changes | {c: F.col(c).cast("string") for c in strings if c in df.columns})
    return out


def dataset_type(name: str, codes: Sequence[str]) -> str | None:
    """The first code contained in the upper-cased name."""
    return next((c for c in codes if c in name.upper()), None)


def dataset_type_column(name: Column, codes: Sequence[str]) -> Column:
    out = None
    for c in codes:
        hit = F.contains(F.upper(name), F.lit(c))
        out = F.when(hit, F.lit(c)) if out is None else out.when(hit, F.lit(c))
    return out


def versioned_name(file_name: str, suffix: str) -> str:
    """A trailing _<digits> goes, the suffix stands before the extension."""
    stem, dot, ext = file_name.rpartition(".")
    if not dot:
        stem, ext = file_name, ""
    return re.sub(r"_\d+$", "", stem) + suffix + dot + ext


def combination_name(combination: Mapping[str, object]) -> str:
    """Keys sorted; dots and slashes become dashes; values joined by underscores."""
    return "_".join(re.sub(r"[./]", "-", str(combination[k])) for k in sorted(combination) if combination[k] is not None)


def combination_column(columns: Sequence[str]) -> Column:
    return F.concat_ws("_", *[F.translate(F.col(c).cast("string"), "./", "--") for c in sorted(columns)])


def combinations(values: Mapping[str, Sequence[object]]) -> list[dict[str, object]]:
    """The product of the value lists; an empty list stands for no filter."""
    keys = sorted(values)
    return [dict(zip(keys, c, strict=True)) for c in product(*[values[k] or [None] for k in keys])]


def first_match(
    listing: DataFrame, names: DataFrame, text: str, part: str, order: Sequence[str], most_names: int = 100_000
) -> DataFrame:
    """Rows of listing whose `text` contains a `part` of names, with the first such row by
    `order`; the others drop out. names is a dimension table: Spark compares every listing
    row against it where it lies (a broadcast nested loop), so more than most_names raise an error."""
    if names.limit(most_names + 1).count() > most_names:
        raise ValueError(f"over {most_names} names: pass a larger most_names if they fit an executor")
    w = Window.partitionBy("__row").orderBy(*order)
    marked = materialize(listing.withColumn("__row", F.monotonically_increasing_id()))
    found = marked.join(F.broadcast(names), F.contains(F.col(text), F.col(part)))
    return found.withColumn("__no", F.row_number().over(w)).where("__no = 1").drop("__no", "__row")


def build_metadata(
    columns: Sequence[str], settings: Mapping[str, object], predictors: Sequence[str], cofactors: Sequence[str],
    combination: Mapping[str, object], exclude: Sequence[str] = (),
) -> dict[str, object]:
    """What describes a merged result: settings, predictors and cofactors of the columns that
    are there, and the filters it was made with."""
    present = [c for c in columns if c not in set(exclude)]
    return {
        "predictors": [c for c in predictors if c in present],
        "cofactors": [c for c in cofactors if c in present],
        "settings": {c: s for c, s in settings.items() if c in present},
        "filters": {k: v for k, v in combination.items() if v is not None},
    }

"""Stored tables: declared schemas, full refresh, keyed replace, point lookup, exports."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from paisaflow.schemas import BASE_TRANSACTIONS, TABLES
from paisaflow.session import cut

PARTITIONED = ("forecaster_metrics",)


class Store:
    """Parquet tables under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def load(self, table: str) -> DataFrame:
        """The table's rows; none before the first report of a table partitioned by its key."""
        if table in PARTITIONED and not self._exists(table):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(self.path(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Full refresh with the table's columns, all or nothing.

        The new rows are written beside the table and take its place when all are there, so a
        failed job leaves the old table and a table can be refreshed from itself.
        """
        beside = f"{self.path(table)}.{uuid.uuid4().hex}"
        self._conform(table, rows).write.parquet(beside)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        old, new, gone = path(self.path(table)), path(beside), path(f"{beside}.old")
        files = new.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(old) and not files.rename(old, gone):
            raise OSError(f"cannot set aside {old}")
        if not files.rename(new, old):
            files.rename(gone, old)
            raise OSError(f"cannot put {new} in place")
        files.delete(gone, True)

    def append(self, table: str, rows: DataFrame) -> None:
        self._conform(table, rows).write.mode("append").parquet(self.path(table))

    def replace_key(self, table: str, rows: DataFrame, key: str) -> None:
        """Replace only the key values present in ``rows``; the table is partitioned by it."""
        self._conform(table, rows).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(key).parquet(self.path(table))

    def refresh_base(self, rows: DataFrame) -> None:
        """New base data; the index derived from the old data goes with it."""
        self.replace("base_transactions", rows)
        self.clear("record_embeddings")

    def clear(self, table: str) -> None:
        self.replace(table, self.spark.createDataFrame([], TABLES[table]))

    def init(self) -> None:
        """Create every table that does not exist yet, empty."""
        for table, schema in TABLES.items():
            empty = self.spark.createDataFrame([], schema)
            if table in PARTITIONED:
                continue  # exists with its first report
            empty.write.mode("ignore").parquet(self.path(table))

    def lookup(self, table: str, key: str, value: str) -> DataFrame:
        """At most one row, the first by all columns if the key repeats; the predicate reaches the
        file scan."""
        order = [f.name for f in TABLES[table].fields if not isinstance(f.dataType, T.MapType)]
        return self.load(table).filter(F.col(key) == value).orderBy(*order).limit(1)

    def _exists(self, table: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    @staticmethod
    def _conform(table: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[
            F.col(f.name).cast(f.dataType) for f in TABLES[table].fields
        ])


def export_base_csv(base: DataFrame, path: str) -> None:
    """The 23 columns in their fixed order, with header."""
    base.select(*BASE_TRANSACTIONS.names).write.mode("overwrite").option(
        "header", True
    ).option("escape", '"').csv(path)


def read_base_csv(spark: SparkSession, path: str) -> DataFrame:
    """Training data; a cell that cannot be read fails the job instead of becoming null."""
    return spark.read.schema(BASE_TRANSACTIONS).options(
        header=True, quote='"', escape='"', mode="FAILFAST"
    ).csv(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


class JsonRows(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def read_json(spark: SparkSession, path: str, schema: T.StructType, array_file: bool) -> JsonRows:
    """The rows that fit the schema, and the raw text of those that do not; parsed once and stored."""
    broken = T.StructField("_broken", T.StringType())
    read = cut(spark.read.schema(T.StructType([*schema.fields, broken])).options(
        multiLine=array_file, columnNameOfCorruptRecord="_broken"
    ).json(path))
    return JsonRows(
        read.filter("_broken is null").select(*schema.names),
        read.filter("_broken is not null").select(F.col("_broken").alias("raw")),
    )


def strict(read: JsonRows) -> DataFrame:
    """The rows, or an error that shows a bad one."""
    bad = read.rejects.orderBy("raw").limit(1).first()
    if bad is not None:
        raise ValueError(f"not a row of the table: {bad['raw'][:200]}")
    return read.rows


def read_json_rows(spark: SparkSession, path: str, table: str, array_file: bool = True) -> JsonRows:
    """Rows of a JSON file: one array of objects, or (splittable) one object per line."""
    return read_json(spark, path, TABLES[table], array_file)

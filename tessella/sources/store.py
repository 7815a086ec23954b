"""Versioned Parquet tables, the user-data file, and the list of libraries."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

MOST_USER_DATA = 256 << 20
FORMAT = 1


class Refused(ValueError):
    """A file of a newer format, too large, or damaged."""


class Store:
    """Tables as folders of versions; a version is written under a name of its own and becomes current by one rename of a small pointer,
    so a reader sees a whole version and a failed job leaves the last one current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointer(self, table: str) -> str:
        return f"{self.root}/{table}/CURRENT"

    def current(self, table: str) -> str | None:
        fs, p = self._fs(self._pointer(table))
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def read(self, table: str, schema: StructType | None = None) -> DataFrame:
        """The current version; columns that an older one lacks are null."""
        version = self.current(table)
        if version is None:
            if schema is None:
                raise Refused(f"no table {table}")
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema) if schema else self.spark.read
        return read.parquet(f"{self.root}/{table}/{version}")

    def write(self, table: str, df: DataFrame) -> str:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{table}/{version}")
        fs, temp = self._fs(f"{self.root}/{table}/.{version}")
        out = fs.create(temp, True)
        out.write(bytearray(version.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(context.makeQualified(temp), context.makeQualified(self._fs(self._pointer(table))[1]), how)
        return version

    def backup(self, tables: list[str], to: str) -> None:
        """The current versions of tables as a store of their own."""
        other = Store(self.spark, to)
        for t in tables:
            other.write(t, self.read(t))


def write_user_data(rows: DataFrame, path: str) -> None:
    """One JSON object a line, the first its format."""
    head = rows.sparkSession.createDataFrame([(json.dumps({"format": FORMAT}),)], "value string")
    body = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    head.withColumn("o", F.lit(0)).unionByName(body.withColumn("o", F.lit(1))).repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def read_user_data(spark: SparkSession, path: str) -> DataFrame:
    """(key, tags) of a user-data file; entries that are no such thing are dropped, a newer format is refused."""
    lines = spark.read.text(path)
    form = lines.select(F.get_json_object("value", "$.format").cast("int").alias("f")).agg(F.max("f")).first()[0]
    if form is None or form > FORMAT:
        raise Refused(f"format {form}")
    parsed = lines.select(F.from_json("value", "key string, tags array<string>").alias("x")).filter("x.key IS NOT NULL")
    return parsed.select("x.key", F.filter(F.coalesce("x.tags", F.array().cast("array<string>")), lambda t: (F.length(F.trim(t)) > 0) & (F.char_length(t) <= 100)).alias("tags"))


def read_libraries(text: str | None) -> list[dict]:
    """The list of known libraries; damaged text is refused rather than taken for an empty list."""
    if text is None:
        return []
    try:
        told = json.loads(text)
        return [{"id": str(x["id"]), "root": str(x["root"])} for x in told["libraries"]]
    except (ValueError, KeyError, TypeError) as e:
        raise Refused("damaged list of libraries") from e

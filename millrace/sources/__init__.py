"""Readers and writers: one table per name in a folder, in any of Spark's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv")


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """``folder/name.fmt``. Text formats need a schema, so that no extra pass over the data infers one."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        if schema is None:
            raise ValueError(f"{fmt} needs a schema")
        reader = reader.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{folder}/{name}.{fmt}")


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {', '.join(FORMATS)}")
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{folder}/{name}.{fmt}")

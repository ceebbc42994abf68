"""Column functions: Spark's own expressions, and a few vectorised Python ones at the end."""

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if either array is null or holds a null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def exact_sum(value: Column, scale: int = 2) -> Column:
    """Sum through decimals: the same bits whatever the order of the rows. Each value is first rounded to ``scale`` digits."""
    return F.sum(value.cast(f"decimal(18,{scale})")).cast("double")


def naive(timestamp: Column) -> Column:
    """A timestamp without a zone."""
    return timestamp.cast("timestamp_ntz")


def initials(text: Column) -> Column:
    """First letters of the blank-separated words, by a vectorised Python function; null stays null."""

    def take(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else "".join(w[0] for w in t.split(" ") if w) for t in column.to_pylist()], pa.string())

    return F.arrow_udf(take, "string")(text)


def spread(value: Column) -> Column:
    """Largest less smallest value of a group, by a vectorised Python aggregate; null for none. A group's values are in one task."""

    def width(values: pd.Series) -> float:
        return float(values.max() - values.min())

    return F.pandas_udf(width, "double")(value)


def composed(text: Column) -> Column:
    """Text in Unicode's composed normal form (NFC), for which Spark has no function, by a vectorised Python one; null stays null. Texts of any length are composed whole."""

    def compose(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in column.to_pylist()], pa.string())

    return F.arrow_udf(compose, "string")(text)


def absolute_deviation(value: Column) -> Column:
    """Median distance of a group's values from their median, by a vectorised Python aggregate, as it needs the median before it can start; null for none. Null and NaN don't count. A group's values are in one task."""

    def spread_(values: pd.Series) -> float:
        known = values.dropna()
        return float((known - known.median()).abs().median()) if len(known) else None

    return F.pandas_udf(spread_, "double")(value)


def json_totals(rows: DataFrame, by: str, json_col: str) -> DataFrame:
    """(by, totals, n): for each key that the JSON objects of a group hold, whatever the keys are, the sum of its whole numbers, as a map in the order of keys; n counts the rows.

    Objects are read as variants and their fields exploded, so that keys need
    not be known and are summed map-side. What is malformed or no object adds
    nothing, nor do fields that are null, nested or no whole number; a group
    without any number has an empty map.
    """
    spark = rows.sparkSession
    read = rows.select(F.col(by).alias("g"), F.try_parse_json(json_col).alias("v"))
    objects = read.where("schema_of_variant(v) LIKE 'OBJECT%'")
    fields = spark.sql("SELECT g, t.key AS key, try_variant_get(t.value, '$', 'long') AS value FROM {o}, LATERAL variant_explode(v) AS t WHERE schema_of_variant(t.value) = 'BIGINT'", o=objects)
    sums = fields.groupBy("g", "key").agg(F.sum("value").alias("total"))
    maps = sums.groupBy("g").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "total")))).alias("m")).withColumnRenamed("g", "h")
    counts = read.groupBy("g").agg(F.count("*").alias("n"))
    met = counts.join(maps, F.col("g").eqNullSafe(F.col("h")), "left")
    return met.select(F.col("g").alias(by), F.coalesce("m", F.create_map().cast("map<string,bigint>")).alias("totals"), "n")


def register_divisors(spark: SparkSession, name: str = "divisors") -> None:
    """A table function in SQL: a row (n) for every divisor of its argument."""

    class Divisors:
        def eval(self, number: int):
            for n in range(1, (number or 0) + 1):
                if number % n == 0:
                    yield (n,)

    spark.udtf.register(name, F.udtf(Divisors, returnType="n int"))

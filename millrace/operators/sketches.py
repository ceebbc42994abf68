"""Stored daily sketches of distinct values and quantiles, united for any span of days without the rows they were made of."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct sketch (relative error about 1.04 / sqrt(2**LOG_K) = 1.6 %), and K of a quantile sketch (rank error about 1 %).
LOG_K, K = 12, 200
SCHEMA = "n long, ids binary, amounts binary, day date, part string"


def add_days(rows: DataFrame, table: str, part: str, at: str, id_col: str, amount_col: str) -> None:
    """Sketches the rows by day, map-side first, and adds them to ``table`` as ``part``: only these rows are read.

    A part that is added again replaces itself, so that a repeated batch counts
    once; parts of one day are united when they are asked for. Rows without a
    time belong to no day; null ids and null or NaN amounts are left out of
    their sketches but count as rows. An amount is taken as a double.
    """
    day = F.to_date(F.col(at))
    amount = F.col(amount_col).cast("double")
    found = rows.select(day.alias("day"), F.col(id_col).cast("string").alias("id"), F.when(~F.isnan(amount), amount).alias("amount")).where("day IS NOT NULL")
    daily = found.groupBy("day").agg(F.count("*").alias("n"), F.hll_sketch_agg("id", F.lit(LOG_K)).alias("ids"), F.kll_sketch_agg_double("amount", F.lit(K)).alias("amounts"))
    daily = daily.select("n", "ids", "amounts", "day", F.lit(part).alias("part"))
    # a part owns its folder: what an earlier write of it left goes, days that it no longer has too
    daily.drop("part").write.mode("overwrite").partitionBy("day").parquet(f"{table}/part={part}")


def sketched(spark: SparkSession, table: str) -> DataFrame:
    """The stored sketches; the day is a partition, so that a span reads its own days only."""
    return spark.read.schema(SCHEMA).option("basePath", table).parquet(table)


def span_totals(sketches: DataFrame, first: date | str, last: date | str, at: list[float], by: Column | None = None) -> DataFrame:
    """(span, n, ids, quantiles) of the days from ``first`` to ``last``, both included: rows, estimated distinct ids and estimated quantiles, by ``by`` (an expression of the day; all days as one without). A span without days has no rows."""
    some = sketches.where(F.col("day").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))
    key = by if by is not None else F.lit("all")
    united = some.groupBy(key.cast("string").alias("span")).agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("amounts").alias("amounts"))
    ranks = F.array(*[F.lit(float(q)) for q in at])
    known = F.kll_sketch_get_n_double("amounts") > 0
    return united.select("span", "n", F.hll_sketch_estimate("ids").alias("ids"), F.when(known, F.kll_sketch_get_quantile_double("amounts", ranks)).alias("quantiles"))

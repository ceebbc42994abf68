"""Structured Streaming over a folder of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, delay: str = "10 minutes", at: str = "ts", pattern: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Events as they arrive; ``at`` becomes a zoned timestamp, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def tumbling(events: DataFrame, size: str, keys: tuple[str, ...] = (), at: str = "ts") -> DataFrame:
    """Events and their values per window; late rows beyond the watermark are dropped by Spark."""
    return events.groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def session_counts(events: DataFrame, by: str, gap: str, at: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def without_repeats(events: DataFrame, key: str) -> DataFrame:
    """The first of rows with equal ``key``, as long as the watermark remembers it."""
    return events.dropDuplicatesWithinWatermark([key])


def matched_within(left: DataFrame, right: DataFrame, by: str, at: str, span: str, how: str = "inner") -> DataFrame:
    """Stream-stream join: right rows at most ``span`` after a left row of the same key; state older than that is let go.

    With ``how`` "leftOuter" a left row that nothing matches comes out with
    nulls once the watermark, which is the lower one of both sides, has passed
    the last moment of a match.
    """
    r = right.select(F.col(by).alias("__by"), F.col(at).alias("__at"), *[F.col(c).alias(f"next_{c}") for c in right.columns if c not in (by, at)])
    near = (F.col(by) == F.col("__by")) & (F.col("__at") >= F.col(at)) & (F.col("__at") <= F.col(at) + F.expr(f"interval {span}"))
    return left.join(r, near, how).drop("__by").withColumnRenamed("__at", f"next_{at}")


def with_static(events: DataFrame, table: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Stream-static join: each event with the matching rows of a table; no state is kept."""
    return events.join(table, F.col(left_key) == F.col(right_key))


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, exactly once, into Parquet files; a later call goes on from the checkpoint.

    In complete mode the sink holds the latest whole result, in a folder per
    batch, so that a repeated batch replaces itself; read it with ``latest``.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", sink)
    else:
        writer = writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{sink}/batch={n:09d}"))
    writer.start().awaitTermination()


def latest(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """What the last batch of a stream in complete mode left; empty if there was none. A batch whose write was cut off doesn't count."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sink)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in fs.listStatus(path)) if fs.exists(path) else []
    whole = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{n}/_SUCCESS"))]
    return spark.read.schema(schema).parquet(whole[-1]) if whole else spark.createDataFrame([], schema)

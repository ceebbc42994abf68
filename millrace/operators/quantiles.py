"""Exact quantiles without a group in one task: rank narrowing by histograms that are summed map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import stored

#: Buckets of a histogram, and distinct values that a rank's bucket may hold when it is sorted.
BUCKETS, FEW = 256, 4096
#: Rounds of narrowing at most; a round makes a range of doubles BUCKETS times narrower, and there are 2**64 of them.
ROUNDS = 200


def exact_quantiles(df: DataFrame, by: list[str], value: str, at: list[float], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(by, q, n, quantile): for each group and each q of ``at`` the value at rank q (n - 1), interpolated between its two neighbours, as ``percentile`` gives it.

    A group starts with the range of its values. In each round a histogram of
    the range of every rank sought counts, map-side, how many values fall into
    each of its buckets, and the bucket that holds the rank is the next range,
    from its smallest to its largest value. A range of few distinct values is
    then counted value by value. So a task sees ``buckets`` rows or ``few`` values of
    a rank, however many rows a group has, and however often one value repeats.
    Rounds are as many as the values' spread needs: two or three for evenly
    spread ones. Each reads the table once.

    Null and NaN values don't count; groups without any other have no rows.
    Infinite values count and may be a result. Null keys are a group of their
    own. Repeated rows count each; other columns are ignored; an empty table
    gives an empty result. Without ``by`` all rows are one group.
    """
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rows = rows.withColumn("key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))).select("key", "v")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    exact = F.col("q") * (F.col("n") - 1)
    wanted = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(exact), F.ceil(exact)))))
    # below: how many values of the group are less than lo
    sought = stored(wanted.select("key", "rank", "n", "lo", "hi", F.lit(0).cast("long").alias("below")).distinct(), "quantile-ranks")
    groups, done = stored(wanted.select("key", "q", "n").distinct(), "quantile-groups"), []
    finite = lambda c: F.greatest(F.lit(-1.7976931348623157e308), F.least(F.lit(1.7976931348623157e308), F.col(c)))
    # halves first, so that no difference overflows
    part = (finite("v") / 2 - finite("lo") / 2) / (finite("hi") / 2 - finite("lo") / 2)
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(part * buckets)))).otherwise(0).cast("int")
    running = Window.partitionBy("key", "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(ROUNDS):
        ranges = sought.select("key", "rank", "n", "lo", "hi", "below")
        inside = rows.join(ranges.select("key", "lo", "hi").distinct(), "key").where("v BETWEEN lo AND hi")
        counted = inside.groupBy("key", "lo", "hi", bucket.alias("bucket")).agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last"), F.approx_count_distinct("v").alias("kinds"))
        met = counted.join(ranges, ["key", "lo", "hi"]).withColumn("before", F.col("below") + F.coalesce(F.sum("c").over(running), F.lit(0)))
        next_ = met.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        next_ = stored(next_.select("key", "rank", "n", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("before").alias("below"), "kinds"), "quantile-ranges")
        done.append(next_.where((F.col("lo") == F.col("hi")) | (F.col("kinds") <= few)).drop("kinds"))
        sought = next_.where((F.col("lo") < F.col("hi")) & (F.col("kinds") > few)).drop("kinds")
        if sought.isEmpty():
            break
    ends = done[0]
    for more in done[1:]:
        ends = ends.union(more)
    values = rows.join(ends.select("key", "lo", "hi").distinct(), "key").where("v BETWEEN lo AND hi").groupBy("key", "lo", "hi", "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("key", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.join(ends, ["key", "lo", "hi"]).withColumn("upto", F.col("below") + F.sum("c").over(upto))
    found = placed.where("rank < upto").groupBy("key", "rank").agg(F.min("v").alias("v"))
    both = groups.withColumn("exact", exact).withColumn("rank", F.explode(F.array(F.floor("exact"), F.ceil("exact"))))
    both = both.join(found, ["key", "rank"]).groupBy("key", "q", "n", "exact").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    share = F.col("exact") - F.floor("exact")
    result = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - share) + F.col("b") * share)
    return both.select(*[F.col(f"key.{k}").alias(c) for c, k in zip(by, keys, strict=True)], "q", "n", result.alias("quantile"))

"""Operators that Spark SQL has no keyword for, as compositions of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, by: str, at: str, value_cols: list[str], prefix: str = "last_", slices: Column | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of the same ``by`` whose ``at`` is not later.

    Both sides go through one sort by (by, at) and a running last value: one
    shuffle, no pairs, linear in the rows of a key. At equal times right rows
    come first, of several the last by their values. Null keys and times match
    nothing and don't go through the sort, however many there are. Left rows
    without a match get nulls. Repeated rows stay.

    ``slices``, an expression of ``at`` that never falls as it rises (such as
    its day), deals a key's rows out by slice, so that no key is one task. Each
    slice starts with the last right row of the slices before it, which come
    from one row for each key and slice, made map-side.
    """
    slot = F.struct(*value_cols)
    slice_ = slices if slices is not None else F.lit(0)
    marked = left.withColumn("__left", F.lit(True)).withColumn("__value", F.lit(None).cast(right.select(slot.alias("v")).schema["v"].dataType))
    extra = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (by, at) else F.col(f.name) for f in left.schema]
    sorted_, plain = F.col(by).isNotNull() & F.col(at).isNotNull(), F.col(by).isNull() | F.col(at).isNull()
    feed = right.where(sorted_).select(*extra, F.lit(False).alias("__left"), slot.alias("__value"))
    rows = marked.where(sorted_).union(feed).withColumn("__slice", slice_).withColumn("__carried", F.lit(False))
    if slices is not None:
        # a slice with left rows alone needs what came before it too
        last = rows.groupBy(F.col(by), F.col("__slice")).agg(F.max(F.when(~F.col("__left"), F.struct(F.col(at).alias("t"), F.col("__value").alias("v")))).alias("x"))
        before = Window.partitionBy(by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.withColumn("x", F.last("x", ignorenulls=True).over(before)).where("x IS NOT NULL")
        given = {by: F.col(by), at: F.col("x.t"), "__left": F.lit(False), "__value": F.col("x.v"), "__slice": F.col("__slice"), "__carried": F.lit(True)}
        rows = rows.union(carried.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]))
    order = Window.partitionBy(by, "__slice").orderBy(F.desc("__carried"), at, F.col("__left"), "__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.last("__value", ignorenulls=True).over(order)
    rest = marked.where(plain).withColumn("__known", F.col("__value"))
    found = rows.withColumn("__known", known).where("__left").drop("__slice", "__carried").union(rest)
    return found.select(*left.columns, *[F.col(f"__known.{c}").alias(f"{prefix}{c}") for c in value_cols])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with all ranges [low, high) that hold them: both sides meet in buckets of ``width``, then are compared.

    A range is copied into each bucket that it touches, so ``width`` should be
    about the usual length of a range. Null bounds and points match nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = ranges.where(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("__b", bucket(at)).join(cut, "__b").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__b")


def overlap_join(left: DataFrame, right: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Pairs of rows whose closed ranges [low, high] overlap, as structs ``l`` and ``r``; the bounds are numbers of the same name on both sides.

    A range belongs to the first level whose buckets, ``width`` times a power
    of two, are at least as long as it; so it touches two of them at most. It
    is also copied into the two buckets of each wider level that occurs, to
    meet the longer ranges there. A pair meets at the wider level of the two,
    in the first bucket that both touch, and nowhere else. The work is that of
    the ranges that share a bucket, and long ranges don't multiply short ones.

    Ranges with a null or NaN bound, or whose end is before their start,
    overlap nothing. Repeated rows pair each.
    """

    def sized(df: DataFrame) -> DataFrame:
        good = df.where((F.col(low) <= F.col(high)) & ~F.isnan(F.col(high).cast("double"))).select(F.struct("*").alias("row"), F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi"))
        length = F.col("hi") - F.col("lo")
        return good.withColumn("level", F.when(length <= width, 0).otherwise(F.ceil(F.log2(length / width)).cast("int")))

    a, b = sized(left), sized(right)
    levels = sorted(r.level for r in a.select("level").union(b.select("level")).distinct().collect())  # some dozens: powers of two

    def placed(df: DataFrame, name: str) -> DataFrame:
        each = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>"), lambda x: x >= F.col("level")))
        at = df.withColumn("at", each).withColumn("size", F.lit(width) * F.pow(F.lit(2.0), F.col("at")))
        at = at.withColumn("first", F.floor(F.col("lo") / F.col("size"))).withColumn("bucket", F.explode(F.sequence(F.col("first"), F.floor(F.col("hi") / F.col("size")))))
        return at.select("at", "bucket", F.struct("row", "lo", "hi", "level", "first").alias(name))

    x, y = F.col("x"), F.col("y")
    met = placed(a, "x").join(placed(b, "y"), ["at", "bucket"]).where((F.col("at") == F.greatest(x["level"], y["level"])) & (F.col("bucket") == F.greatest(x["first"], y["first"])))
    return met.where((x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"])).select(x["row"].alias("l"), y["row"].alias("r"))


def theta_join(left: DataFrame, right: DataFrame, condition: Column, most: int = 8 << 20) -> DataFrame:
    """Pairs that meet any condition. ``right`` is measured and broadcast; if it has over ``most`` bytes (as JSON text), in parts of about that size.

    The work is that of all comparisons, and ``left`` is read once for each
    part, so an equality or a range belongs into a join of its own
    (``range_join``, ``overlap_join``). Nulls match as the condition says;
    repeated rows pair each, and those of ``right`` go into one part.
    """
    size = right.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    parts = -(-size // most) if size > most else 1
    if parts == 1:
        return left.join(F.broadcast(right), condition)
    part = F.pmod(F.xxhash64(*right.columns), F.lit(parts))
    found = [left.join(F.broadcast(right.where(part == i)), condition) for i in range(parts)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def sessions(events: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """Rows per session: (by, start, end, n), where a gap longer than ``gap`` starts a new one."""
    window = F.session_window(F.col(at).cast("timestamp"), gap)
    grouped = events.where(F.col(by).isNotNull()).groupBy(by, window.alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("start"), F.max(at).alias("end"))
    return grouped.select(by, "start", "end", "n")

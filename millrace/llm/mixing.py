"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target, divided by its words, is the number of copies r that each
of its documents is due. floor(r * weight) copies are certain. The fraction
that is left is a document's inclusion probability p, and a Pareto order
sample fills what the source still lacks: documents are ranked by the odds of
a random number divided by the odds of p, and the leading ones are taken until
their words reach the source's remainder (the last only if that brings the
sum nearer). The sample's size is fixed in words, which is what the target
fixes. Odds are unequal within a source where ``favour_long`` multiplies those
of p by the square root of a document's words, so that the remainder goes to
long documents rather than to scraps, and where ``weight_col`` makes the copies
due differ.

The ranking never sorts a source in one task: ranks fall into BINS bins, whose
words are summed map-side, and only the one bin of a source in which the
remainder runs out is ordered row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import WORD, stored

BINS = 4096
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_unit(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts alone: 52 bits of an MD5."""
    return _unit(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)))


def _unit(digest: Column) -> Column:
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = MAX_COPIES) -> DataFrame:
    """``sizes``: source, source_size. Adds target: ``share`` of all words, dealt by weight, at most ``cap`` times a source's size.

    Sources are ordered by code point (UTF-8 bytes), null last. Excess over a
    cap is dealt again by weight until none is above; that level is found in
    one pass: with sources in the order of cap / weight, what those from each
    one on would get per weight, if all before it were at their caps, rises to
    the level sought and falls after it. One row per source goes through the
    window, never a document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(by_name) - 1
    dealt = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    dealt = dealt.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * float(share)
    dealt = dealt.withColumn("left", total - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("level", F.col("left") / F.sum("w").over(after))
    level = F.max("level").over(everything)
    return dealt.select("source", "source_size", F.least(F.col("most"), level * F.col("w")).alias("target"))


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    seed: int = 7,
    bins: int = BINS,
    favour_long: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, text_hash.

    Null texts have size 0 and are never taken; null sources are one source of
    their own, the last. Null or negative weights count as 0 (``weight_col``
    unset: 1 each). No document gets over 3 copies. Equal rows draw the same
    random number and are told apart by nothing, so either may be taken; their
    result rows differ only if the remainder runs out between them. Other
    columns are ignored; an empty table gives an empty result.
    """
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        weight.alias("weight"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text))).alias("draw"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    rows = stored(rows, "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("due"))
    due = stored(sums, "source-sizes")
    targets = source_targets(due.select("source", "source_size"), weights, share)
    targets = targets.join(due.select(F.col("source").alias("s"), "due"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = stored(targets, "targets")

    each = F.least(F.when(F.col("due") > 0, F.col("target") / F.col("due") * F.col("weight")).otherwise(0.0), F.lit(float(MAX_COPIES)))
    odds = lambda x: x / (1 - x)
    favour = F.sqrt(F.col("size").cast("double")) if favour_long else F.lit(1.0)
    ranked = (
        rows.withColumnRenamed("source", "s")
        .join(targets, F.col("s").eqNullSafe(F.col("source")))
        .drop("s")
        .withColumn("whole", F.floor(each).cast("long"))
        .withColumn("p", each - F.col("whole"))
        .withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), odds(_unit(F.col("draw"))) / (odds(F.col("p")) * favour)))
        .withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * bins), F.lit(bins - 1)).cast("int"))
    )
    per_bin = stored(
        ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain")),
        "bins",
    )
    sure = per_bin.groupBy("source").agg(F.sum("certain").alias("certain"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        per_bin.where("bin is not null")
        .withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        .join(targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .join(sure.select(F.col("source").alias("s"), F.col("certain").alias("sure")), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rest", F.col("target") - F.col("sure"))
        .where("before < rest")
        .groupBy("source")
        .agg(F.max_by(F.struct("bin", "before", "rest"), "bin").alias("end"))
    )
    ends = stored(ends.select(F.col("source").alias("s"), F.col("end.bin").alias("end_bin"), F.col("end.before").alias("before"), F.col("end.rest").alias("rest")), "ends")
    placed = ranked.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    cols = ["doc_id", "source", "size", "source_size", "target", "whole", "text_hash"]
    clear = placed.where("end_bin is null or bin is null or bin != end_bin").select(*cols, F.coalesce(F.col("bin") < F.col("end_bin"), F.lit(False)).alias("drawn"))
    order = Window.partitionBy("source").orderBy("q", "draw")
    last = placed.where("bin = end_bin").withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # taken while the sum is short of the remainder; the one that passes it only if the sum then lies nearer
    last = last.select(*cols, ((F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("size") < F.col("rest")) & (F.col("upto") - F.col("rest") < F.col("rest") - F.col("upto") + F.col("size")))).alias("drawn"))
    copies = F.col("whole") + F.col("drawn").cast("long")
    return clear.union(last).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "text_hash"
    )


_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 3.0::DOUBLE AS most
  FROM s),
l AS (
  SELECT *, most / w AS ratio,
         (sum(source_size) OVER () * 1.0::DOUBLE
          - coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size,
         least(most, max(level) OVER () * w) AS target
  FROM l),
r AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS each
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CAST(floor(each) AS BIGINT) AS whole,
         CASE WHEN each > floor(each) AND size > 0 THEN
           (u / (1 - u)) / ((each - floor(each)) / (1 - (each - floor(each))) * {favour}) END AS q
  FROM (SELECT *, (CAST(CAST('0x' || substr(draw, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u FROM r)),
c AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest,
         sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, draw ROWS UNBOUNDED PRECEDING) AS upto
  FROM q)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN q IS NOT NULL AND (upto <= rest OR (upto - size < rest AND upto - rest < rest - upto + size)) THEN 1 ELSE 0 END) * size AS taken
FROM c
"""


def mixture_sql(favour_long: bool) -> str:
    """The same rows in DuckDB SQL, for the default parameters and ``favour_long``."""
    return _SQL.replace("{favour}", "sqrt(CAST(size AS DOUBLE))" if favour_long else "1.0::DOUBLE")

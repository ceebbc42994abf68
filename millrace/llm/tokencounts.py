"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, count). A
text's content is normalised as its tokenizer does before anything else: not
at all for the byte-level file, so that counts stay exact; null is the empty
text. Digests are taken once and stored; they alone are joined with the cache.
What is missing there is encoded once, and its counts are appended. Texts only
move to bring together copies of those that are missing: a bitmap of the
missing digests (32 MB at most) keeps the others where they are, an exact join
drops what slips through, and copies meet within their map task first.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.encoding import encoder, tokenizer_version
from millrace.llm.shared import path_exists, stored
from millrace.llm.wordhash import bitmap

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def cached_counts(spark, cache_path: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer; entries appended twice count once. A cache not yet written is empty."""
    if not path_exists(spark, cache_path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    found = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return found.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _encoded(rows: DataFrame, asked: DataFrame, content: str, cache_path: str) -> tuple[DataFrame, DataFrame]:
    """(digest, n_tokens) of the digests in ``asked``: those that the cache has, and those that are encoded now and appended to it. ``rows`` has their texts."""
    spark, version = rows.sparkSession, tokenizer_version(content)
    shared = spark.sparkContext.broadcast(content)  # one vocabulary file

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in batches:
            n = [len(ids) // 4 for ids in encode.batch(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    distinct = asked.distinct()
    known = spark.createDataFrame([], "digest binary, n_tokens long")
    if path_exists(spark, cache_path):
        distinct = stored(distinct, "asked-digests")
        known = stored(cached_counts(spark, cache_path, version).join(distinct, "digest", "left_semi"), "known-counts")
        missing = stored(distinct.join(known, "digest", "left_anti"), "missing-digests")
        near = spark.sparkContext.broadcast(bitmap(missing.select(F.xxhash64("digest").alias("h")), "h"))

        def may_miss(hashes: pa.Array) -> pa.Array:
            return pa.array(near.value.holds(hashes.to_numpy().view(np.uint64)))

        rows = rows.where(F.arrow_udf(may_miss, "boolean")(F.xxhash64("digest")))
        texts = rows.groupBy("digest").agg(F.max("text").alias("text")).join(missing, "digest", "left_semi")  # equal digests have equal texts
    else:
        texts = rows.groupBy("digest").agg(F.max("text").alias("text"))
    made = stored(texts.mapInArrow(count, "digest binary, n_tokens long"), "new-counts")
    made.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    return known, made


def fill_cache(docs: DataFrame, tokenizer_file: str, cache_path: str, text_col: str = "text") -> None:
    """Appends the counts of the texts of ``docs`` that the cache doesn't have."""
    rows = _rows(docs.select(F.lit(None).alias("id"), F.col(text_col).alias("text")), "id", "text").drop("doc_id")
    _encoded(rows, rows.select("digest"), Path(tokenizer_file).read_text(), cache_path)


def token_counts(docs: DataFrame, tokenizer_file: str, cache_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit. Misses are appended to the cache at once.

    Null texts count as empty (0 tokens); null and repeated ids keep their
    rows; texts of any length count whole, equal ones are encoded once. Of two
    writers at the same time both may append a text's count, which then counts
    once. Other columns are ignored; an empty table gives an empty result and
    leaves the cache as it is.
    """
    rows = _rows(docs, id_col, text_col)
    told = stored(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "text-digests")
    known, made = _encoded(rows.select("text", "digest"), told.select("digest"), Path(tokenizer_file).read_text(), cache_path)
    # a digest stands once in known or made, and nothing is summed between the shuffle and the join: hot digests can be split
    return told.join(known.union(made), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""A corpus pipeline over ``documents``: language, near copies, benchmark leaks, mixture, token-id files.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written
and read again as the next stage's ``docs``. All but the last return the
columns they were given, whatever else these hold beside doc_id, text, lang
and source.

Null texts have no language and go in the first stage; by themselves the other
stages take them as empty texts. Null ids are rows like any other. Texts of
any length are taken whole. Ties: of a group of near copies the smallest id
stays, then the smallest text hash. Of repeated rows (equal id and text) one
stays. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontamination import contaminated
from millrace.llm.langid import held_out, language_of, learn_prototypes
from millrace.llm.mixing import mixture
from millrace.llm.shared import scratch_path, stored, table
from millrace.llm.simhash import simhash_groups
from millrace.llm.tokenfiles import token_file_digests, write_token_files

#: Below this cosine with every language a text counts as none of them. Texts that share no 3-gram
#: with a language have cosines about 0 with a deviation of 1/sqrt(LANGUAGE_DIM) = 0.022.
LEAST_SCORE, LANGUAGE_DIM = 0.1, 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text is in one of the learned languages: not und, and near enough to a prototype."""
    langs, prototypes = learn_prototypes(docs.where(~held_out(F.col("doc_id"))), dim=LANGUAGE_DIM)
    told = language_of(F.col("text"), langs, prototypes)
    return docs.where((told["lang_pred"] != "und") & (told["score"] >= LEAST_SCORE))


def _whole(docs: DataFrame):
    """A row as one value, so that no column's name can meet those of a stage."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row_")


def _matched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row_, copies_) of the rows that ``wanted`` (id_, hash_, rows_, copies_) lists by id and text hash.

    Where it counts several rows for one entry they are repeated rows, of
    which one comes out; those alone take a second shuffle, if there are any.
    """
    rows = docs.select(F.col("doc_id").alias("doc_"), F.xxhash64("text").alias("text_hash_"), _whole(docs))
    both = lambda some: rows.join(some, F.col("doc_").eqNullSafe(F.col("id_")) & (F.col("text_hash_") == F.col("hash_")))
    found = both(wanted.where("rows_ = 1"))
    if not wanted.where("rows_ > 1").isEmpty():
        found = found.union(both(wanted.where("rows_ > 1")).dropDuplicates(["doc_", "text_hash_"]))
    return found.select("row_", "copies_")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked fingerprints: the smallest id, and of repeated rows one."""
    kept = simhash_groups(docs).where("kept").groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"))
    kept = stored(kept.agg(F.count("*").alias("rows_"), F.lit(1).alias("copies_")), "kept")
    return _matched(docs, kept).select("row_.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a copy of a benchmark item."""
    found = stored(contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("text_hash").alias("bad_")).distinct(), "leaks")
    rows = docs.select(F.xxhash64("text").alias("text_hash_"), _whole(docs))
    return rows.join(found, F.col("text_hash_") == F.col("bad_"), "left_anti").select("row_.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mixture takes it; rows that it doesn't take go."""
    due = mixture(docs).groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(F.count("*").alias("rows_"), F.sum("copies").alias("copies_"))
    taken = _matched(docs, stored(due.where("copies_ > 0"), "due"))
    return taken.select("row_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies_")))).select("row_.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token-id files and returns what they hold, by document."""
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_file_digests(spark, path)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("mix", mix),
    ("token_files", token_files),
]

#: SQL can express neither the language model nor XXH64 with a seed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

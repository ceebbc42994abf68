"""The operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import scratch_path, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontamination import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "start_word", "end_word", "seeds")


#: The table labels one kind of toxicity; its quality label is the chain's first link.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), CATEGORIES)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.licenses import license_spans

    return license_spans(table(spark, sf_dir, "documents"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.vectors import vector_groups

    return vector_groups(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"), favour_long=True).select("doc_id", "size", "source_size", "target", "taken")


def op8_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.tokenfiles import token_file_digests, write_token_files

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_file_digests(spark, path)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.pii import find_spans, span_digests

    return span_digests(find_spans(table(spark, sf_dir, "documents")))


def op10_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through a cache that an earlier call has filled with one half of the texts, by their CRC-32; the other half is missing there, is encoded and appended."""
    import public_tokenizers

    from millrace.llm.tokencounts import fill_cache, token_counts

    docs, file, cache = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-cache")
    fill_cache(docs.where(F.crc32(F.col("text").cast("binary")) % 2 == 0), file, cache)
    return token_counts(docs, file, cache)


#: The contract's list of hosts and paths, as patterns.
URL_LIST = [("||net/", "block"), ("||example.net/en/", "allow"), ("||example.com/de/", "block"), ("||org/fr/", "allow")]
#: Patterns that decide where the list doesn't; what none of them fits is allowed.
URL_PATTERNS = ["?utm_medium=spam", "||casino-*", "||adult-*", "||spam-*", "-pills.", "||ads-*", "-bets.", "/ads/"]

URL_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*((?s:.*))$', 1), '') AS rest FROM pages),
r AS (SELECT *, host || rest AS subject, '.' || host AS dotted,
  CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN contains(subject, '?utm_medium=spam') OR contains(dotted, '.casino-') OR contains(dotted, '.adult-') OR contains(dotted, '.spam-') OR contains(dotted, '.ads-')
         OR contains(subject, '-pills.') OR contains(subject, '-bets.') OR contains(subject, '/ads/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op11_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.urlrules import judge

    listed = [(p, v, 0) for p, v in URL_LIST] + [(p, "block", 1) for p in URL_PATTERNS]
    told = judge(table(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(listed, "pattern string, verdict string, rank int"))
    return told.select("page_id", "host", "path", F.expr("if(rank = 0, substring(pattern, 3), null)").alias("rule"), "verdict")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.alignment import alignments

    return alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.infill import digests, infill

    return digests(infill(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_toxicity": op2_toxicity,
        "op3_simhash": op3_simhash,
        "op4_langid": op4_langid,
        "op5_licenses": op5_licenses,
        "op6_vectors": op6_vectors,
        "op7_mixing": op7_mixing,
        "op8_tokenfiles": op8_tokenfiles,
        "op9_pii": op9_pii,
        "op10_tokencounts": op10_tokencounts,
        "op11_urlrules": op11_urlrules,
        "op12_alignment": op12_alignment,
        "op13_infill": op13_infill,
    }


def oracle_sql() -> dict[str, str]:
    from millrace.llm.infill import INFILL_SQL
    from millrace.llm.mixing import mixture_sql

    return {"op7_mixing": mixture_sql(True), "op11_urlrules": URL_SQL, "op13_infill": INFILL_SQL}

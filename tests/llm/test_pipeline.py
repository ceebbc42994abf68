from __future__ import annotations

import random

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_run_gives_the_last(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark_leaks", "mix", "token_files"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        counts.append(out.count())
    assert counts[1] >= 0.97 * counts[0]  # clean documents stay
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.fixture
def rows():
    rng = random.Random(1)
    return [(i, " ".join(f"the{rng.randint(0, 999)} and ing" for _ in range(40)), "en", rng.choice("abc")) for i in range(60)]


def test_decisions_take_effect(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    table = docs([*rows, (100, rows[5][1], "en", "a"), (101, "12 34", "en", "a"), (102, None, "en", "a"), (103, f"the and ing {bench}", "en", "b"), (5, rows[5][1], "en", rows[5][3])])
    known = {r.doc_id for r in corpus_pipeline.language(spark, table, SF).collect()}
    assert {101, 102} & known == set() and set(range(60)) <= known
    one = [r.doc_id for r in corpus_pipeline.near_copies(spark, table, SF).collect()]
    assert 100 not in one and one.count(5) == 1 and set(range(60)) <= set(one)
    clean = {r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, table, SF).collect()}
    assert clean == set(range(60)) | {100, 101, 102}


def test_texts_in_scripts_never_learned_go(spark, docs, rows):
    rng = random.Random(2)
    foreign = lambda first, last: " ".join("".join(chr(rng.randint(first, last)) for _ in range(rng.randint(2, 9))) for _ in range(300))
    odd = [(i, foreign(*[(0x430, 0x44F), (0x3B1, 0x3C9), (0x627, 0x64A), (0x4E00, 0x5000)][i % 4]), None, "a") for i in range(1000, 1080)]
    known = {r.doc_id for r in corpus_pipeline.language(spark, docs([*rows, *odd, (2000, "the", "en", "a")]), SF).collect()}
    assert known == set(range(60)) | {2000}


def test_mixing_repeats_rows_as_the_mixture_says(spark, docs, rows):
    from millrace.llm.mixing import mixture

    table = docs([*rows, (3, rows[3][1], "en", rows[3][3])])  # a repeated row
    want = {}
    for r in mixture(table).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    for r in corpus_pipeline.mix(spark, table, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}


def test_empty_documents(spark, docs):
    table = docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, SF).count() == 0

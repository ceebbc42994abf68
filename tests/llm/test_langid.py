from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.langid import DIM, bundles, held_out, identify, letter_vector


def slow_bundle(text, dim=DIM):
    """The method, letter by letter."""
    import unicodedata

    low = [c if unicodedata.category(c)[0] in "LM" else " " for c in f" {text.lower()} "]
    total = np.zeros(dim)
    for i in range(1, len(low) - 1):
        if low[i] != " ":
            a, b, c = (letter_vector(ord(x), dim).astype(int) for x in low[i - 1 : i + 2])
            total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_bundles_agree_with_the_method_letter_by_letter():
    texts = ["", "Hello, World", "  a\t\nbé ", "naïve é́x", "123 45", "中文字 mixed", "x" * 5000]
    got = bundles(texts, np.arange(len(texts)), len(texts))
    for t, v in zip(texts, got, strict=True):
        assert np.array_equal(v, slow_bundle(t)), t
    assert np.array_equal(bundles(texts, np.zeros(len(texts), int), 1)[0], sum(slow_bundle(t) for t in texts))


def test_a_large_alphabet_takes_the_other_way():
    rng = random.Random(1)
    text = "".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(900))
    assert np.array_equal(bundles([text], np.array([0]), 1)[0], slow_bundle(text))


def test_held_out_rows_by_crc(spark):
    got = spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
    assert spark.sql("SELECT cast(null AS long) AS id").select(held_out(F.col("id"))).first()[0]


def make(rng, lang, n=80):
    parts = {"en": ["the", "and", "ing", "tion", "wh"], "de": ["sch", "ein", "ung", "ü", "lich"], "fr": ["eau", "é", "oi", "que", "ç"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_edge_cases(docs, clash):
    rng = random.Random(4)
    rows = [(i, make(rng, lang := rng.choice(["en", "de", "fr"])), lang) for i in range(400)]
    truth = {i: lang for i, _, lang in rows}
    odd = [(1001, None, "en"), (1002, "", "en"), (1003, "12 34 .,", "de"), (None, make(rng, "de"), "de"), (1004, make(rng, "fr"), None), (1004, make(rng, "fr"), None), (1005, make(rng, "en", 60_000), "en")]
    got = identify(clash(docs(rows + odd))).collect()
    assert len(got) == len(rows) + len(odd)
    tested = [r for r in got if r.doc_id in truth and r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.99 * len(tested)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1001, 1002, 1003))
    assert by[None].lang_pred == "de" and by[None].held_out and by[1004].lang_pred == "fr" and by[1005].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from_and_nothing_to_tell(docs):
    assert identify(docs([])).count() == 0
    assert {r.lang_pred for r in identify(docs([(i, "some text", None) for i in range(4)])).collect()} == {"und"}


@pytest.mark.parametrize("scale", ["sf0.01"])
def test_accuracy_on_the_held_out_documents(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    got = identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 250 and right >= 0.98

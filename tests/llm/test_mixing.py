from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm.mixing import mixture, mixture_sql, source_targets


def watered(sizes, weights=(5, 2, 1), cap=3):
    """Targets by dealing excess again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, at_cap = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in at_cap]
        left = total - sum(at_cap.values())
        dealt = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: cap * sizes[s] for s in free if dealt[s] > cap * sizes[s]}
        if not over:
            return at_cap | dealt
        at_cap |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 7}, {"a": 1}, {"a": 0, "b": 9}, {"z": 3, "a": 3, "é": 4, "Z": 5, "b": 2000, "c": 1, "d": 1}])
def test_targets_are_what_dealing_again_gives(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = watered(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "d", None]
    return [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choices(sources, [10, 3, 2, 1, 1])[0]) for i in range(n)]


@pytest.mark.parametrize("bins", [4096, 2])
def test_sums_come_near_the_targets(docs, clash, bins):
    rows = rows_of(3000) + [(-1, None, "en", "a"), (-2, "", "en", None), (-3, " \n\t", "en", "b")]
    got = mixture(clash(docs(rows)).withColumn("source", F.col("source")), bins=bins).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)  # a document at most
    assert {(r.doc_id, r.taken) for r in mixture(docs(rows), bins=4096).collect()} == {(r.doc_id, r.taken) for r in got}


@pytest.mark.parametrize("favour", [False, True])
def test_agrees_with_sql(docs, favour):
    rows = rows_of(1500, seed=4)
    documents = docs(rows).toPandas()  # noqa: F841
    want = duckdb.connect().register("documents", documents).sql(mixture_sql(favour)).fetchall()
    got = mixture(docs(rows), favour_long=favour).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_weights_make_inclusion_unequal(docs, spark):
    rows = [(i, "a b c d", "en", "s") for i in range(2000)]
    df = docs(rows).withColumn("w", F.when(F.col("doc_id") < 1000, 3.0).when(F.col("doc_id") == 1999, F.lit(None).cast("double")).otherwise(1.0))
    got = mixture(df, weight_col="w", share=0.5).collect()
    heavy, light = (sum(r.copies for r in got if (r.doc_id < 1000) == h) for h in (True, False))
    assert abs(heavy + light - 1000) <= 1 and 650 < heavy < 850
    assert next(r.copies for r in got if r.doc_id == 1999) == 0


def test_long_documents_are_favoured_within_a_source(docs):
    """Half the words of one source: odds four times as high for texts of sixteen times the words, and the sum as near as before."""
    rows = [(i, " ".join(["w"] * (4 if i % 2 else 64)), "en", "s") for i in range(2000)]
    got = mixture(docs(rows), share=0.5, favour_long=True).collect()
    long_, short = (sum(r.copies for r in got if (r.size == 64) == x) for x in (True, False))
    assert abs(sum(r.taken for r in got) - got[0].target) <= 64 and 2 * short < long_ < 1000 and short > 100


def test_every_document_has_its_chance(docs):
    """Over many seeds each is taken about as often as its share says."""
    rows = [(i, "a b", "en", "s") for i in range(40)]
    times = defaultdict(int)
    for seed in range(8):
        for r in mixture(docs(rows), share=0.5, seed=seed).collect():
            times[r.doc_id] += r.copies
    assert sum(times.values()) == 8 * 20 and sum(0 < n < 8 for n in times.values()) >= 36


def test_repeated_rows_null_ids_and_empty(docs):
    rows = [(1, "a b c", "en", "x")] * 3 + [(None, "a b", "en", None), (None, None, "en", None)]
    got = mixture(docs(rows)).collect()
    assert len(got) == 5 and sum(r.size for r in got) == 11
    assert mixture(docs([])).count() == 0
    assert all(r.taken == 0 for r in mixture(docs([(1, None), (2, "")])).collect())

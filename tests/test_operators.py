from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import cosine, dot, initials, spread
from millrace.operators import as_of_join, range_join, sessions, theta_join, top_per_group
from millrace.sources import read_table, write_table


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_as_of_join_takes_the_latest_and_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, "a", 10, 0), (2, "a", 3, 0), (3, "b", 5, 0), (4, None, 5, 0), (5, "a", None, 0)], "id int, k string, at int, last_v int")
    right = spark.createDataFrame([("a", 4, 40), ("a", 10, 100), ("a", 10, 90), ("a", 12, 120), (None, 1, 7), ("b", None, 8)], "k string, at int, v int")
    got = {r.id: r[4] for r in as_of_join(left, right, "k", "at", ["v"], prefix="at_").collect()}
    assert got == {1: 100, 2: None, 3: None, 4: None, 5: None}


def test_as_of_join_by_slices_agrees_with_one_sort(spark):
    """Random rows with ties, nulls and repeated rows; slices without right rows, and keys without any."""
    import random

    rng = random.Random(3)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = spark.createDataFrame([(i, key(), rng.choice([None, *range(40)])) for i in range(150)] * 2, "id int, k string, at int").selectExpr("*", "1 AS x")
    right = spark.createDataFrame([(k, rng.choice([None, *range(0, 12), *range(30, 33)]), rng.randint(0, 9)) for k in (key() for _ in range(40)) if k != "c"], "k string, at int, v int")
    plain, sliced = (sorted((tuple(r) for r in as_of_join(left, right, "k", "at", ["v"], slices=s).collect()), key=str) for s in (None, F.floor(F.col("at") / 5)))
    assert plain == sliced and len(plain) == 300 and any(r[4] is not None and (r[2] or 0) > 20 for r in plain)


def test_as_of_join_on_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, at int, v int")
    assert as_of_join(empty, empty, "k", "at", ["v"]).count() == 0


def test_range_join_agrees_with_comparison(spark):
    points = spark.range(60).select((F.col("id") * 1.5 - 10).alias("x"))
    ranges = spark.createDataFrame([(0, -5.0, 3.0), (1, 2.0, 50.0), (2, 7.0, 7.0), (3, 9.0, 8.0), (4, None, 3.0)], "r int, lo double, hi double")
    got = sorted((r.x, r.r) for r in range_join(points, ranges, "x", "lo", "hi", 4.0).collect())
    want = sorted((p.x, r.r) for p in points.collect() for r in ranges.dropna().collect() if r.lo <= p.x < r.hi)
    assert got == want


@pytest.mark.parametrize("most", [100, 2])
def test_theta_join_in_one_part_and_in_several(spark, most):
    left, right = spark.range(9).toDF("a"), spark.createDataFrame([(3,), (5,), (5,), (None,), (8,)], "b long")
    got = sorted((r.a, r.b) for r in theta_join(left, right, F.col("a") * 2 < F.col("b"), most).collect())
    assert got == sorted((a, b) for a in range(9) for b in (3, 5, 5, 8) if a * 2 < b)


def test_vectorised_functions(spark):
    df = spark.createDataFrame([("a", "two words", 1.5), ("a", None, 4.0), ("b", "", 2.0), ("c", " x  y", None)], "k string, t string, v double")
    assert [r[0] for r in df.select(initials(F.col("t"))).collect()] == ["tw", None, "", "xy"]
    got = {r.k: r.w for r in df.where("v is not null").groupBy("k").agg(spread(F.col("v")).alias("w")).collect()}
    assert got == {"a": 2.5, "b": 0.0}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    from types import SimpleNamespace

    from millrace import scratch

    kept = scratch.stored(spark.range(5).toDF("a"), "test")
    assert kept.count() == 5 and scratch.scratch_root(spark)
    far = SimpleNamespace(sparkContext=SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="spark://far:7077"))
    with pytest.raises(ValueError):
        scratch.scratch_root(far)


def test_top_per_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), (None, 5)], "k string, v int")
    assert sorted((r.k or "", r.v) for r in top_per_group(df, ["k"], [F.desc("v")], 2).collect()) == [("", 5), ("a", 2), ("a", 3)]


def test_sessions_keep_an_exact_gap_together(spark):
    df = spark.createDataFrame([("u", at(0)), ("u", at(30)), ("u", at(61)), (None, at(0))], "k string, ts timestamp_ntz")
    assert sorted(r.n for r in sessions(df, "k", "ts", "30 minutes").collect()) == [1, 2]


def test_vector_functions(spark):
    r = spark.sql("SELECT array(1f, 2f) AS a, array(2f, 4f) AS b, array(0f, 0f) AS z").select(dot(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("z"))).first()
    assert r[0] == 10.0 and abs(r[1] - 1) < 1e-12 and r[2] is None


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_sources_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None)], "id long, s string, x double")
    write_table(df, str(tmp_path), "t", fmt)
    got = read_table(spark, str(tmp_path), "t", fmt, df.schema).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a,b", 1.5), (2, None, None)]


def test_sources_refuse_what_they_would_guess(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "t", "csv")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "t", "xml")


def test_overlap_join_agrees_with_all_pairs(spark):
    """Short, long, empty and touching ranges; each pair once."""
    import random

    from millrace.operators import overlap_join

    rng = random.Random(4)
    rows = [(i, s := rng.randint(-500, 500) / 2, s + rng.choice([0, 0, 1, 3, 10, 64, 700])) for i in range(150)]
    rows += [(900, None, 1.0), (901, 1.0, None), (902, 5.0, 4.0), (903, 1.0, float("nan")), (904, float("nan"), 2.0), (0, *rows[0][1:])]
    good = [r for r in rows if None not in r and r[1] <= r[2]]
    df = spark.createDataFrame(rows, "id long, low double, high double").selectExpr("*", "1 AS level", "2 AS bucket", "3 AS at", "4 AS row")
    got = overlap_join(df, df.where("id % 2 = 0"), "low", "high", 4.0)
    found = sorted((r.l.id, r.r.id) for r in got.collect())
    assert found == sorted((a[0], b[0]) for a in good for b in good if b[0] % 2 == 0 and a[1] <= b[2] and b[1] <= a[2])
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert overlap_join(df.limit(0), df, "low", "high", 4.0).count() == 0


def test_long_ranges_do_not_multiply(spark):
    """A range of a million widths is copied twice a level, not into a million buckets."""
    from millrace.operators import overlap_join

    df = spark.createDataFrame([(0, 0, 1_000_000)] + [(i, i * 1000, i * 1000) for i in range(1, 500)], "id long, low long, high long")
    assert overlap_join(df, df, "low", "high", 1.0).where("l.id < r.id").count() == 499


def test_theta_join_goes_by_bytes(spark):
    from millrace.operators import theta_join

    left = spark.createDataFrame([(i,) for i in range(20)], "a long")
    right = spark.createDataFrame([(i, "x" * 50) for i in range(0, 20, 2)] + [(4, "x" * 50), (None, "y")], "b long, wide string")
    for most in (1 << 20, 100):
        got = sorted((r.a, r.b) for r in theta_join(left, right, F.col("a") > F.col("b"), most=most).collect())
        assert got == sorted((a, b) for a in range(20) for b in [*range(0, 20, 2), 4] if a > b)


def test_exact_quantiles(spark):
    """Against numpy: skewed, repeated, tiny, huge and infinite values; with buckets so few that many rounds are needed."""
    import numpy as np

    from millrace.operators.quantiles import exact_quantiles

    gen = np.random.default_rng(5)
    inf = float("inf")
    groups = {
        "even": gen.uniform(0, 1, 700), "heavy": np.exp(gen.normal(size=700) * 40), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "same": np.full(300, 7.0), "hot": np.r_[np.full(600, 2.0), gen.normal(size=200)],
        "wide": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324]), "ends": np.array([-inf, -inf, 1.0, 2.0, 3.0, inf, inf]), None: gen.integers(0, 9, 200).astype(float),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").selectExpr("*", "1 AS key", "2 AS n", "3 AS rank", "4 AS q")
    for few, buckets in ((4096, 256), (4, 8)):
        got = {(r.g, r.q): (r.n, r.quantile) for r in exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.9, 1.0], few, buckets).collect()}
        assert len(got) == 5 * len(groups)
        for k, v in groups.items():
            v = np.sort(v)
            for q in (0.0, 0.1, 0.5, 0.9, 1.0):
                a, b, share = v[int(np.floor(q * (len(v) - 1)))], v[int(np.ceil(q * (len(v) - 1)))], q * (len(v) - 1) % 1
                assert got[k, q] == (len(v), pytest.approx(a if a == b else a * (1 - share) + b * share, rel=1e-12)), (k, q)
    assert [tuple(r) for r in exact_quantiles(df.where("g = 'two'"), [], "v", [0.25]).collect()] == [(0.25, 2, 1.25)]
    assert exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_json_totals_of_unknown_keys(spark):
    from millrace.functions import json_totals

    rows = [("a", '{"x": 1, "y": 2}'), ("a", '{"x": 10, "z": "7", "n": null, "o": {"x": 5}, "f": 1.5}'), ("a", '{"x": 1, "x'), ("a", "[1, 2]"), ("a", "5"), ("a", None), ("b", "{}"), ("b", "nonsense"), (None, '{"x": -3}'), (None, '{"": 4, "x": 9}')]
    df = spark.createDataFrame(rows, "u string, props string").selectExpr("*", "1 AS g", "2 AS key", "3 AS v")
    got = {r.u: (r.totals, r.n) for r in json_totals(df, "u", "props").collect()}
    assert got == {"a": ({"x": 11, "y": 2}, 6), "b": ({}, 2), None: ({"": 4, "x": 6}, 2)}
    assert json_totals(df.limit(0), "u", "props").count() == 0


def test_functions_that_spark_lacks(spark):
    from millrace.functions import absolute_deviation, composed

    df = spark.createDataFrame([("a", "é", 1.0), ("a", None, 2.0), ("a", "하", 9.0), ("b", "", None), ("c", "plain", float("nan")), ("c", "ﬁ", 4.0)], "k string, t string, v double")
    assert [r[0] for r in df.select(composed(F.col("t"))).collect()] == ["é", None, "하", "", "plain", "ﬁ"]
    assert {r.k: r.d for r in df.groupBy("k").agg(absolute_deviation(F.col("v")).alias("d")).collect()} == {"a": 1.0, "b": None, "c": 0.0}

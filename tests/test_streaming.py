from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace import streaming
from millrace.streaming.funnel import funnel

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, value double"


@pytest.fixture
def feed(spark, tmp_path):
    base = datetime(2024, 1, 1)

    def batch(n, rows):
        df = spark.createDataFrame([(i, u, base + timedelta(minutes=m), v) for i, u, m, v in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
        part = next((tmp_path / f"in{n}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{n}.parquet")

    batch(0, [(1, 7, 0, 1.0), (2, 7, 5, 2.0), (3, 8, 61, 4.0)])
    batch(1, [(1, 7, 1, 1.0), (4, 7, 130, 8.0)])  # event 1 again
    batch(2, [(6, 8, 300, 1.0)])
    batch(3, [(5, 7, 2, 100.0), (7, 8, 600, 1.0)])  # event 5 comes after its window was closed
    schema = spark.createDataFrame([], SCHEMA).schema
    return streaming.event_stream(spark, str(tmp_path / "in"), schema), tmp_path


def test_late_rows_are_dropped_and_windows_close_once(spark, feed):
    stream, tmp = feed
    streaming.run_once(streaming.tumbling(stream, "1 hour"), str(tmp / "out"), str(tmp / "cp"))
    got = {r.start.hour: (r.n, r.total) for r in spark.read.parquet(str(tmp / "out")).collect()}
    assert got[0] == (3, 4.0) and got[1] == (1, 4.0) and got[2] == (1, 8.0)
    streaming.run_once(streaming.tumbling(stream, "1 hour"), str(tmp / "out"), str(tmp / "cp"))
    starts = [r.start for r in spark.read.parquet(str(tmp / "out")).collect()]
    assert len(starts) == len(set(starts))


def test_repeats_are_dropped(spark, feed):
    stream, tmp = feed
    streaming.run_once(streaming.without_repeats(stream, "event_id"), str(tmp / "out"), str(tmp / "cp"))
    ids = sorted(r.event_id for r in spark.read.parquet(str(tmp / "out")).collect())
    assert ids.count(1) == 1 and {2, 3, 4, 6, 7} <= set(ids)


def test_sessions_in_a_stream(spark, feed):
    stream, tmp = feed
    streaming.run_once(streaming.session_counts(stream, "user_id", "30 minutes"), str(tmp / "out"), str(tmp / "cp"))
    got = sorted((r.user_id, r.n) for r in spark.read.parquet(str(tmp / "out")).collect())
    assert (7, 3) in got and (8, 1) in got


def test_stream_stream_join(spark, feed):
    stream, tmp = feed
    joined = streaming.matched_within(stream.where(F.col("value") == 1.0), stream.select("user_id", "ts", "value").withColumnRenamed("value", "v"), "user_id", "ts", "10 minutes")
    streaming.run_once(joined.select("event_id", "next_v"), str(tmp / "out"), str(tmp / "cp"))
    got = {(r.event_id, r.next_v) for r in spark.read.parquet(str(tmp / "out")).collect()}
    assert (1, 2.0) in got


def test_complete_mode_keeps_the_latest_whole_result(spark, feed):
    stream, tmp = feed
    counts = stream.groupBy("user_id").agg(F.count("*").alias("n"))
    streaming.run_once(counts, str(tmp / "out"), str(tmp / "cp"), "complete")
    got = {r.user_id: r.n for r in streaming.latest(spark, str(tmp / "out"), counts.schema).collect()}
    assert got == {7: 5, 8: 3}
    assert streaming.latest(spark, str(tmp / "none"), counts.schema).count() == 0


def test_stream_static_join(spark, feed):
    stream, tmp = feed
    names = spark.createDataFrame([(7, "seven"), (9, "nine")], "id long, name string")
    streaming.run_once(streaming.with_static(stream, names, "user_id", "id").select("event_id", "name"), str(tmp / "out"), str(tmp / "cp"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp / "out")).collect())
    assert got == [(i, "seven") for i in (1, 1, 2, 4, 5)]


EVENTS = "event_id long, user_id long, ts timestamp_ntz, event_type string"


@pytest.fixture
def typed(spark, tmp_path):
    """Appends a file of (event_id, user_id, minutes, event_type) to a folder and returns the stream over it."""
    base = datetime(2024, 1, 1)

    def put(n, rows):
        spark.createDataFrame([(i, u, None if m is None else base + timedelta(minutes=m), k) for i, u, m, k in rows], EVENTS).coalesce(1).write.parquet(str(tmp_path / f"f{n}"))
        (tmp_path / "typed").mkdir(exist_ok=True)
        next((tmp_path / f"f{n}").glob("*.parquet")).rename(tmp_path / "typed" / f"{n}.parquet")
        return streaming.event_stream(spark, str(tmp_path / "typed"), spark.createDataFrame([], EVENTS).schema)

    return put, tmp_path


def settled(rows, span, upto):
    """Funnels by brute force: start -> ids, for starts that ``upto`` (in minutes) has settled."""
    rows, out = sorted(r for r in rows if r[2] is not None and r[2] < upto), {}
    rows = sorted(((m, i, u, k) for i, u, m, k in rows if u is not None))
    for m, i, u, k in rows:
        if k != "view":
            continue
        ids, last = [i], (m, i)
        for step in ("click", "purchase"):
            after = [e for e in rows if e[2] == u and e[3] == step and e[:2] > last and e[0] <= m + span]
            if not after:
                break
            last = after[0][:2]
            ids.append(last[1])
        if len(ids) == 3 or m + span < upto:
            out[i] = ids
    return out


def test_funnel_with_timeouts_and_a_restart(spark, typed):
    import random

    put, tmp = typed
    rng, rows, at = random.Random(9), [], 0
    for i in range(240):
        at += rng.choice([0, 1, 7, 20])
        rows.append((i, rng.choice([1, 1, 1, 2, 3, None]), at - rng.choice([0, 0, 4]), rng.choice(["view", "click", "purchase", "error"])))
    rows += [(900, 1, None, "view"), (901, 1, at, None)]
    span = 60
    files = [rows[:90], rows[90:170], rows[170:]]
    for n, part in enumerate(files):
        stream = put(n, part)
        streaming.run_once(funnel(stream, "user_id", ("view", "click", "purchase"), span * 60), str(tmp / "out"), str(tmp / "cp"))  # from the checkpoint of the run before
        upto = max(r[2] for f in files[: n + 1] for r in f if r[2] is not None) - 10
        got = [(r.start_id, r.ids) for r in spark.read.parquet(str(tmp / "out")).collect()]
        want = settled([r for f in files[: n + 1] for r in f], span, upto)
        assert len(got) == len(want) and dict(got) == want
    assert {len(x) for x in want.values()} == {1, 2, 3}


def test_funnel_drops_what_is_late_and_takes_ties_by_id(spark, typed):
    put, tmp = typed
    put(0, [(5, 1, 0, "view"), (4, 1, 0, "click"), (6, 1, 0, "click"), (7, 1, 0, "purchase"), (8, 1, 30, "view")])
    put(1, [(9, 2, 500, "view")])
    stream = put(2, [(10, 1, 31, "click"), (11, 2, 1000, "error"), (12, 3, 1000, "view")])
    streaming.run_once(funnel(stream, "user_id", ("view", "click", "purchase"), 3600), str(tmp / "out"), str(tmp / "cp"))
    assert {r.start_id: r.ids for r in spark.read.parquet(str(tmp / "out")).collect()} == {5: [5, 6, 7], 8: [8], 9: [9]}


def test_funnel_keeps_steps_for_starts_that_come_after_them(spark, typed):
    """A start that is older than one already waiting, but not late, still gets the steps that came before it."""
    put, tmp = typed
    put(0, [(1, 9, 100, "error")])
    put(1, [(3, 1, 95, "click"), (2, 1, 98, "view")])
    put(2, [(4, 1, 92, "view"), (5, 1, 97, "purchase")])
    stream = put(3, [(6, 9, 1000, "error")])
    streaming.run_once(funnel(stream, "user_id", ("view", "click", "purchase"), 3600), str(tmp / "out"), str(tmp / "cp"))
    assert {r.start_id: r.ids for r in spark.read.parquet(str(tmp / "out")).collect()} == {4: [4, 3, 5], 2: [2]}


def test_funnel_calls_python_for_buckets_of_keys(spark, typed):
    """However many keys there are, states (and so calls) are no more than buckets in a slice; keys stay apart, of any type."""
    put, tmp = typed
    n = 2000
    put(0, [e for u in range(n) for e in ((3 * u, u, 1, "view"), (3 * u + 1, u, 2, "click"))])
    stream = put(1, [(3 * u + 2, u, 3, "purchase") for u in range(0, n, 2)]).withColumn("user_id", F.concat(F.lit("u"), "user_id"))
    run = lambda: streaming.run_once(funnel(stream, "user_id", ("view", "click", "purchase"), 86400), str(tmp / "out"), str(tmp / "cp"))
    run()
    assert 0 < spark.read.format("statestore").load(str(tmp / "cp")).count() <= 2 * 256  # a step belongs to two slices
    put(2, [(9999, 0, 5000, "error")])
    run()
    got = {r.user_id: r.ids for r in spark.read.parquet(str(tmp / "out")).collect()}
    assert got == {f"u{u}": [3 * u, 3 * u + 1, *([3 * u + 2] if u % 2 == 0 else [])] for u in range(n)}


def test_outer_join_releases_nulls_once_the_watermark_has_passed(spark, typed):
    put, tmp = typed

    def run(stream):
        left, right = (stream.where(F.col("event_type") == k).drop("event_type") for k in ("view", "purchase"))
        streaming.run_once(streaming.matched_within(left, right, "user_id", "ts", "1 hour", "leftOuter").select("event_id", "next_event_id"), str(tmp / "out"), str(tmp / "cp"))
        return sorted((tuple(r) for r in spark.read.parquet(str(tmp / "out")).collect()), key=str)

    assert run(put(0, [(1, 1, 0, "view"), (2, 1, 10, "view"), (3, 2, 20, "view"), (4, 1, 60, "purchase"), (13, None, 0, "view")])) == [(1, 4), (2, 4)]
    # an hour after view 3 hasn't passed yet, as the watermark is ten minutes behind
    assert run(put(1, [(5, 3, 85, "view")])) == [(1, 4), (13, None), (2, 4)]
    # a late purchase, still within the watermark, matches; one behind it doesn't, as the null has been released
    assert run(put(2, [(6, 2, 80, "purchase"), (7, 3, 160, "purchase")])) == [(1, 4), (13, None), (2, 4), (3, 6), (5, None)]
    assert run(put(3, [(8, 3, 86, "purchase"), (9, 9, 400, "error")])) == [(1, 4), (13, None), (2, 4), (3, 6), (5, None)]

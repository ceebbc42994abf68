"""Funnels in a stream: how far each start got through the steps that follow it, with timeouts, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State is kept for so many groups of keys in each slice of time; a stream's checkpoint holds to it.
BUCKETS = 256


def _followed(codes: np.ndarray, ts: np.ndarray, ids: np.ndarray, step: np.ndarray, sure: np.ndarray, steps: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of events sorted by key, time and id: a row for each start with the places of what it got to, and how many these are.

    These are the start and, of the ``sure`` ones, the first event of each next
    step after the one before, within ``span`` of the start.
    """
    n = len(ts)
    new = np.ones(n + 1, bool)
    new[1:n] = (np.diff(codes) != 0) | (np.diff(ts) != 0) | (np.diff(ids) != 0)
    firsts = np.flatnonzero(new)
    behind = firsts[np.searchsorted(firsts, np.arange(n), "right")]  # the first that is later, or of a larger id
    starts = np.flatnonzero(step == 0)
    found, reached = np.repeat(starts[:, None], steps, axis=1), sure[starts].astype(int)
    on, here = sure[starts], starts
    for s in range(1, steps):
        of = np.flatnonzero((step == s) & sure)
        place = np.append(of, n)[np.searchsorted(of, behind[here])]
        next_ = np.minimum(place, n - 1)
        on = on & (place < n) & (codes[next_] == codes[starts]) & (ts[next_] <= ts[starts] + span)
        here = np.where(on, next_, here)
        found[:, s] = here
        reached += on
    return found, reached


def funnel(events: DataFrame, by: str, steps: tuple[str, ...], seconds: int, at: str = "ts", id_col: str = "event_id", type_col: str = "event_type", buckets: int = BUCKETS) -> DataFrame:
    """(by, start_id, start_ts, reached, ids): a row for each event of the first of ``steps``, once it is settled.

    ``ids`` are the events that the start got to, one a step: of each next step
    the first after the one before (by time, then id), no later than
    ``seconds`` after the start. A start is settled when the watermark has
    passed its last step, or the end of its time; until then its events are
    kept as state, with a timer for the first moment that can settle one.
    Events behind the watermark of their batch are dropped, so that what
    was settled stays so.

    State is kept by slice of ``seconds`` and bucket of keys (of which there
    are ``buckets`` at most): a start belongs to its own slice, and what can
    follow it to that and the next one. So state ends with the slice, a key
    with very many events is spread over its slices, and Python is called for
    a bucket, whose keys it takes at once, not for each key. More buckets make
    states smaller.

    Null keys, times, ids and types and other types take no part, but move the
    watermark. Repeated ids count as often as they come: remove them before.
    Other columns are ignored; a stream without events gives nothing.
    """
    span = seconds * 1_000_000
    place = F.create_map(*[F.lit(x) for i, s in enumerate(steps) for x in (s, i)])
    rows = events.select(F.col(by).alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("ts"), F.col(id_col).cast("long").alias("id"), F.element_at(place, F.col(type_col)).alias("step"))
    own, takes_part = F.expr(f"ts div {span}"), F.expr("key is not null and at is not null and id is not null and step is not null")
    # not a filter, which Spark would put before the watermark: that is moved by events of all types
    rows = rows.withColumn("slice", F.explode(F.when(~takes_part, F.array().cast("array<bigint>")).when(F.col("step") == 0, F.array(own)).otherwise(F.array(own, own - 1))))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    columns = ["key", "ts", "id", "step"]

    def settle(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        parts = [pd.DataFrame(dict(zip(columns, state.get, strict=True)))] if state.exists else []
        if not state.hasTimedOut:
            parts += [b.loc[b["ts"] >= now, columns] for b in batches]
        rows = pd.concat([p for p in parts if len(p)] or [pd.DataFrame(columns=columns)], ignore_index=True)
        if rows.empty:
            if state.exists:
                state.remove()
            return
        codes, names = pd.factorize(rows["key"])
        ts, ids, step = (rows[c].to_numpy(np.int64) for c in columns[1:])
        order = np.lexsort((ids, ts, codes))
        codes, ts, ids, step = codes[order], ts[order], ids[order], step[order]
        found, reached = _followed(codes, ts, ids, step, ts < now, len(steps), span)
        starts = found[:, 0]
        done = (reached == len(steps)) | (ts[starts] + span < now)
        open_ = starts[~done]
        # a start that comes yet can't be before the watermark, and needs what follows from there
        first = np.full(len(names), now)
        np.minimum.at(first, codes[open_], ts[open_])
        keep = (step > 0) & (ts >= first[codes])
        keep[open_] = True
        if keep.any():
            state.update((names[codes[keep]].tolist(), ts[keep].tolist(), ids[keep].tolist(), step[keep].tolist()))
            lasts = ts[keep & (step == len(steps) - 1) & (ts >= now)]
            due = [(int(group[1]) + 2) * span] if not len(open_) else [ts[open_].min() + span, *([lasts.min()] if len(lasts) else [])]
            state.setTimeoutTimestamp(max(int(min(due)) // 1000, state.getCurrentWatermarkMs(), 1))
        elif state.exists:
            state.remove()
        if done.any():
            out, many = found[done], reached[done].tolist()
            got = [f[:k] for f, k in zip(ids[out].tolist(), many, strict=True)]
            yield pd.DataFrame({"key": names[codes[out[:, 0]]], "start_id": ids[out[:, 0]], "start_us": ts[out[:, 0]], "reached": many, "ids": got})

    kind = dict(rows.dtypes)["key"]
    shape = f"key {kind}, start_id long, start_us long, reached int, ids array<long>"
    kept = f"key array<{kind}>, ts array<long>, id array<long>, step array<int>"
    done = rows.groupBy("bucket", "slice").applyInPandasWithState(settle, shape, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(F.col("key").alias(by), "start_id", F.timestamp_micros("start_us").alias("start_ts"), "reached", "ids")

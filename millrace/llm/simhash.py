"""SimHash near-duplicates, with pigeonring filtering of the candidate pairs.

A 64-bit fingerprint is seen as a ring of 8 segments of 8 bits. If two
fingerprints differ in at most 3 bits, some segment starts a chain in which
the first l segments differ in at most l*3/8 bits, for every l (the pigeonring
principle). Rounded down, the budgets for l = 1..8 are 0 0 1 1 1 2 2 3: the
first two segments of the chain are equal, and of the next three at most one
differs. So the pair agrees on the first two and on two of the next three
segments of a chain: 8 starts x 3 choices = 24 keys of 32 bits each, on which
candidates meet. The rest of the chain's budgets prunes them before the full
Hamming distance is taken.

Plan: fingerprints are made once per row and reduced to distinct ones, so
exact copies never meet each other. Keys are shuffled once for counting (with
map-side sums) and once to bring equal keys together; a sorted stream compares
the members of a key and gives out a spanning forest, never all pairs. A key
with more than HOT members is split further along the ring: of the four
segments that it leaves open at least one is equal in any pair within 3 bits,
so its members meet on four longer keys of 40 bits. What is still hot then is
not compared pairwise at all: its fingerprints are linked through the points
that lie within 2 bits of one and within 1 bit of the other, which is exact
and linear in their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.shared import WORD, stored

BITS = 3
#: Budgets of the chains of 1 to 8 segments.
BUDGETS = [(n * BITS) // 8 for n in range(1, 9)]
#: Members of a key beyond which it is split, and of a longer key beyond which it is linked through neighbouring points.
HOT = 1024
CHOICES = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4))
_LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of ``text``: XXH64 with seed 42 over word shingles; 0 without any word."""
    import xxhash

    words = re.findall(WORD, (text or "").translate(_LOWER))
    if not words:
        return 0
    grams = [" ".join(g) for g in zip(*(words[i:] for i in range(shingle)))] if len(words) >= shingle else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g.encode(), 42) for g in grams), dtype="<u8", count=len(grams))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["id", "text_hash", "fp"])


def _rotated(fp, k: int):
    return fp if not k else F.shiftleft(fp, 8 * k).bitwiseOR(F.shiftrightunsigned(fp, 64 - 8 * k))


def ring_keys(fp) -> list:
    """The 24 keys of a fingerprint column: bits 32 and up hold start and choice, the lower 32 the segments."""
    keys = []
    for start in range(8):
        turned = _rotated(fp, start)
        for n, parts in enumerate(CHOICES):
            key = F.lit((start * len(CHOICES) + n) << 32)
            for place, part in enumerate(parts):
                byte = F.shiftrightunsigned(turned, 56 - 8 * part).bitwiseAND(F.lit(255).cast("long"))
                key = key.bitwiseOR(F.shiftleft(byte, 24 - 8 * place))
            keys.append(key)
    return keys


def longer_keys(fp, key) -> list:
    """The four keys of a fingerprint that split a key: from bit 37 on, which open segment it is and its value."""
    number = F.shiftrightunsigned(key, 32).cast("int")
    start, choice = F.floor(number / len(CHOICES)).cast("int"), number % len(CHOICES)
    # a shift by 64 is one by 0, so start 0 leaves the fingerprint as it is
    turned = F.call_function("shiftleft", fp, 8 * start).bitwiseOR(F.call_function("shiftrightunsigned", fp, 64 - 8 * start))
    keys = []
    for n, part in enumerate((4 - choice, F.lit(5), F.lit(6), F.lit(7))):  # CHOICES leave out 4, 3 or 2, and all from 5 on
        byte = F.call_function("shiftrightunsigned", turned, (56 - 8 * part).cast("int")).bitwiseAND(F.lit(255).cast("long"))
        keys.append(key.bitwiseOR(F.shiftleft(byte + (1 + n * 256), 37)))
    return keys


def within_ring(diff: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences (XOR of two fingerprints) keep every budget of the chain from ``start``, and 3 bits in all."""
    turn = (8 * start).astype(np.uint64)
    turned = (diff << turn) | np.where(turn > 0, diff >> ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
    ok = np.ones(diff.shape, dtype=bool)
    for n, budget in enumerate(BUDGETS, 1):
        ok &= np.bitwise_count(turned >> np.uint64(64 - 8 * n)) <= budget
    return ok


def _forest(fps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fps: runs x members that share a key; start: of each run. Edges that join what is linked within a run."""
    near = within_ring(fps[:, :, None] ^ fps[:, None, :], start[:, None, None])
    size = fps.shape[1]
    label = np.broadcast_to(np.arange(size), fps.shape).copy()
    while True:
        new = np.where(near, label[:, None, :], size).min(axis=2)
        if (new == label).all():
            break
        label = new
    run, member = np.nonzero(label != np.arange(size))
    return fps[run, member], fps[run, label[run, member]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), sorted: edges among the members of each key. A run never has more than HOT members."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def edges(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        for size in np.unique(sizes[sizes > 1]):
            runs = first[sizes == size]
            step = max(1, 1_000_000 // int(size * size))
            for at in range(0, len(runs), step):
                part = runs[at : at + step]
                start = (keys[part] >> 32 & 31) // len(CHOICES)
                a, b = _forest(fps[part[:, None] + np.arange(size)], start)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.r_[keys, batch.column(0).to_numpy()]
        fps = np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
        if len(keys):
            done = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            if done:
                yield from edges(keys[:done], fps[:done])
                keys, fps = keys[done:], fps[done:]
    if len(keys):
        yield from edges(keys, fps)


def _masks(bits: int) -> list[int]:
    found = [0]
    for n in range(1, bits + 1):
        found += [sum(1 << i for i in places) for places in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _hot_links(hot: DataFrame) -> DataFrame:
    """Edges among fingerprints of hot keys: each meets, at every point within 2 bits of it, one that is within 1 bit."""
    ball = lambda bits: hot.select("fp", F.explode(F.array(*[F.lit(m) for m in _masks(1)]) if bits == 1 else F.lit(_masks(bits))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask").cast("long")).alias("z"))
    near = ball(1).groupBy("z").agg(F.min("fp").alias("b"))
    return ball(2).join(near, "z").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def link_fingerprints(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """``fps``: distinct longs in column fp. Edges (a, b) whose components are those of all pairs within 3 bits."""
    def split(keyed: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        """Edges from the keys that aren't hot, and the rows of those that are."""
        heavy = stored(keyed.groupBy("key").count().where(F.col("count") > hot).select("key"), label)
        cold = keyed.join(heavy, "key", "left_anti").repartition("key").sortWithinPartitions("key", "fp")
        return cold.select("key", "fp").mapInArrow(_linked, "a long, b long"), keyed.join(heavy, "key", "left_semi")

    edges, hotter = split(fps.select("fp", F.explode(F.array(*ring_keys(F.col("fp")))).alias("key")), "hot-keys")
    hotter = stored(hotter.select("fp", "key"), "hot-rows")
    if hotter.isEmpty():
        return edges
    more, dense = split(hotter.select("fp", F.explode(F.array(*longer_keys(F.col("fp"), F.col("key")))).alias("key")), "hotter-keys")
    return edges.union(more).union(_hot_links(stored(dense.select("fp").distinct(), "dense")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, text_hash, kept.

    Null and wordless texts have fingerprint zero and link like any other.
    component_id is the smallest non-null id of the component (null if all are
    null). Repeated rows come out as often as they went in. kept marks the
    rows of the component's representative: the smallest (id, text_hash), null
    ids last. Other columns of ``docs`` are ignored; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    made = stored(rows.mapInArrow(_fingerprints, "id long, text_hash long, fp long"), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    each = stored(made.groupBy("fp").agg(F.min(order).alias("first")), "distinct-fingerprints")
    found = connected_components(link_fingerprints(each.select("fp"), hot))
    placed = each.join(found.toDF("fp", "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    labels = placed.join(heads, "root").select("fp", "head")
    return made.join(labels, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.id").alias("component_id"),
        "text_hash",
        (order == F.col("head")).alias("kept"),
    )

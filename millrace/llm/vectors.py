"""Embedding near-duplicates with an inverted multi-index.

Each half of the (unit) vectors has a codebook of its own; the product of the
two is a grid of cells, and every distinct vector is indexed in the cell of
its nearest codewords. A query visits cells by the multi-sequence algorithm:
in the order of the summed distances of its halves to the cell's codewords,
until the sum exceeds the nearest cell's by a slack. The slack is set so that
a partner at the very threshold falls into a visited cell with the target
recall, measured by turning sample vectors by the threshold's angle; closer
partners are found more surely, and a pair counts if either side finds it.
Candidates are verified by their cosine in double precision.

The codebooks and the slack come from at most SAMPLE vectors; the index and
the queries are all vectors. Equal vectors are one entry with a multiplicity.
A cell is compared in blocks of at most BLOCK entries and queries, so a cell
that holds a third of all vectors is many tasks, and a block gives out sums
and a spanning forest, not pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.shared import stored

SAMPLE, BLOCK, RECALL = 20_000, 2048, 0.98
#: Codewords of a half at most: a fifth of the sample, so that each has some vectors to stand for.
LARGEST = SAMPLE // 5
#: Distances to codewords that are held at once: 8 MB.
CELLS = 1 << 20


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of a column of arrays of one length."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([np.empty(0), *[c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in chunks]])
    return _unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), np.finfo(float).tiny)  # no square may overflow or vanish
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _slices(rows: int, words: int) -> Iterator[slice]:
    """Parts of ``rows`` whose distances to ``words`` codewords take CELLS numbers at most."""
    step = max(1, CELLS // max(1, words))
    for first in range(0, rows, step):
        yield slice(first, first + step)


def _codebook(v: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    words = v[rng.choice(len(v), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_distances(v[part], words).argmin(axis=1) for part in _slices(len(v), k)])
        order = np.argsort(near, kind="stable")
        used, first, sizes = np.unique(near[order], return_index=True, return_counts=True)
        words[used] = np.add.reduceat(v[order], first, axis=0) / sizes[:, None]
    return words


def _distances(v: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances, less the vectors' own squares."""
    return (words**2).sum(axis=1) - 2 * v @ words.T


class MultiIndex:
    """Two codebooks and a slack, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.k = max(1, min(k, len(sample)))
        self.words = (_codebook(sample[:, : self.half], self.k, rng), _codebook(sample[:, self.half :], self.k, rng))
        turn = rng.normal(size=sample.shape)
        turn -= (turn * sample).sum(axis=1, keepdims=True) * sample
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
        partner = threshold * sample + np.sqrt(1 - threshold**2) * turn
        gaps = []
        for part in _slices(len(sample), self.k):
            (a, b), (pa_, pb) = self.halves(sample[part]), self.halves(partner[part])
            n = np.arange(len(a))
            gaps.append(a[n, pa_.argmin(axis=1)] + b[n, pb.argmin(axis=1)] - a.min(axis=1) - b.min(axis=1))
        self.slack = float(np.quantile(np.concatenate(gaps), recall)) + 1e-12

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(v[:, : self.half], self.words[0]), _distances(v[:, self.half :], self.words[1])

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells in the order of the multi-sequence traversal, the vector's own first, up to the slack."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sa, sb, k = a[i].tolist(), b[j].tolist(), self.k
        most, out = sa[0] + sb[0] + self.slack, []
        heap, seen = [(sa[0] + sb[0], 0, 0)], {(0, 0)}
        while heap and heap[0][0] <= most:
            _, x, y = heapq.heappop(heap)
            out.append(int(i[x]) * k + int(j[y]))
            for nx, ny in ((x + 1, y), (x, y + 1)):
                if nx < k and ny < k and (nx, ny) not in seen:
                    seen.add((nx, ny))
                    heapq.heappush(heap, (sa[nx] + sb[ny], nx, ny))
        return out


def _matched(threshold: float, cells: int):
    """For the rows of one block (see ``link_vectors``): links (a, b) as a spanning forest and the numbers of links."""

    def links(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        cid, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        own = table.column("own").to_numpy()
        if not asks.any() or asks.all():
            return _rows([], [], [])
        v = _matrix(table.column("vec"))
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        near = (v[q] @ v[m].T >= threshold) & (cid[q][:, None] != cid[m][None, :])
        x, y = np.nonzero(near)
        if not len(x):
            return _rows([], [], [])
        visited = table.column("visited").take(pa.array(m))
        sizes = np.array([len(x) for x in visited])
        known = np.repeat(np.arange(len(m)), sizes) * cells + np.concatenate([c.flatten().to_numpy() for c in visited.chunks]).astype(np.int64)
        both = np.isin(y * cells + own[q[x]], known)  # then the other side counts for itself
        n_q = np.bincount(x, weights=copies[m[y]], minlength=len(q))
        n_m = np.bincount(y[~both], weights=copies[q[x[~both]]], minlength=len(m))
        label = np.r_[np.arange(len(q)), np.full(len(m), len(q))]
        while True:  # smallest query reachable, back and forth
            from_q = np.where(near, label[: len(q), None], len(q)).min(axis=0)
            to_m = np.minimum(label[len(q) :], from_q)
            to_q = np.minimum(label[: len(q)], np.where(near, to_m[None, :], len(q)).min(axis=1))
            new = np.r_[to_q, to_m]
            if (new == label).all():
                break
            label = new
        ids = np.r_[cid[q], cid[m]]
        tied = np.flatnonzero(label < len(q))
        a, b = ids[tied], cid[q][label[tied]]
        own_n = np.r_[n_q, n_m].astype(np.int64)
        some = np.flatnonzero(own_n)
        return _rows(np.r_[a[a != b], ids[some]], np.r_[b[a != b], own_n[some]], np.r_[np.ones((a != b).sum(), bool), np.zeros(len(some), bool)])

    return links


def _rows(a, b, edge) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "edge": pa.array(edge, pa.bool_())})


def link_vectors(classes: DataFrame, index: MultiIndex, threshold: float, block: int = BLOCK) -> DataFrame:
    """``classes``: cid, copies, vec. Rows (a, b, edge): edges, and for each vector a parts b of its number of links."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(index)  # at most 2 x LARGEST codewords
    kind = classes.schema["vec"].dataType.simpleString()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, cells = _matrix(batch.column(2)), []
                for part in _slices(len(v), shared.value.k):
                    cells += [shared.value.visits(x, y) for x, y in zip(*shared.value.halves(v[part]), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=["cid", "copies", "vec", "visited"])

    placed = stored(classes.select("cid", "copies", "vec").mapInArrow(visit, f"cid long, copies long, vec {kind}, visited array<int>"), "vector-cells")
    placed = placed.withColumn("own", F.element_at("visited", 1))
    entries = placed.groupBy("own").agg(F.count("*").alias("entries"))
    asks = placed.select(F.explode("visited").alias("cell")).groupBy("cell").agg(F.count("*").alias("asks"))
    # one row per cell that holds anything; blocks on either side
    sides = stored(entries.join(asks, entries["own"] == asks["cell"]).select("cell", *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("entries", "asks")]), "cells")
    turn = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = placed.select("cid", "copies", "vec", "own", F.explode("visited").alias("cell")).join(sides, "cell")
    queries = queries.select("cell", every("entries").alias("m"), turn("asks").alias("q"), F.lit(True).alias("asks"), "cid", "copies", "own", "vec", F.array().cast("array<int>").alias("visited"))
    members = placed.join(sides, placed["own"] == sides["cell"]).select("cell", turn("entries").alias("m"), every("asks").alias("q"), F.lit(False).alias("asks"), "cid", "copies", "own", "vec", "visited")
    return queries.union(members).groupBy("cell", "m", "q").applyInArrow(_matched(threshold, index.k**2), "a long, b long, edge boolean")


def vector_groups(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components link
    with nothing. Floats stay floats and all other numbers become doubles;
    cosines are taken in double precision, and one equal to the threshold is a
    link. Shorter vectors count as padded with zeros to the longest.
    Equal vectors are linked with each other, repeated rows too. component_id
    is the smallest non-null id of the component; a row without an id is never
    kept. Other columns are ignored; an empty table gives an empty result.
    """
    kind = "float" if table.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    good = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    width = rows.where(good).agg(F.max(F.size("vec"))).first()[0] or 0
    padded = F.when(good, F.concat("vec", F.array_repeat(F.lit(0.0).cast(kind), F.lit(width) - F.size("vec"))))
    rows = rows.select("vec_id", padded.alias("vec"))
    classes = rows.where("vec is not null").groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    if n:
        some = classes.orderBy(F.xxhash64("vec")).limit(sample).select("vec").collect()
        index = MultiIndex(_unit(np.array([r.vec for r in some], dtype=np.float64)), int(np.clip(np.sqrt(n) / 4, 2, LARGEST)), threshold, recall)
        found = stored(link_vectors(classes, index, threshold, block), "vector-links")
    else:
        found = classes.sparkSession.createDataFrame([], "a long, b long, edge boolean")
    roots = connected_components(found.where("edge").select("a", "b").distinct()).toDF("cid", "root")
    counts = found.where("not edge").groupBy("a").agg(F.sum("b").alias("n")).withColumnRenamed("a", "cid")
    placed = stored(classes.select("cid", "vec", "copies", "least").join(roots, "cid", "left").join(counts, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "vector-roots")
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(heads, "root").select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("good"))
    out = rows.join(labels, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

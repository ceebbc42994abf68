"""Nearest neighbours of every vector by a neighbour graph that improves in rounds.

The graph starts from a few random orders: vectors are sorted by the signs of
some random projections, and those that stand near each other are compared.
Then a neighbour of a neighbour is likely a neighbour: in each round the
vectors that a pivot is linked with, from either side, are compared with each
other, and every vector keeps its best. Rounds are jobs over edge tables; each
costs the number of vectors times the square of a list's length, however the
vectors lie, and they end when hardly any list changes.

Equal vectors are one node of the graph. A node keeps its smallest ids, as
many as any list can need, and lists are expanded at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import top_per_group
from millrace.scratch import stored

#: Random orders that the graph starts from, and signs that an order goes by.
ORDERS, SIGNS = 4, 14
#: Neighbours in an order that are compared at once; half of them again with the next half.
BLOCK = 128
#: Links of a node beyond the neighbours asked for.
SPARE = 30
#: Rounds at most, and the part of all links below which a round's new ones end them.
ROUNDS, SETTLED = 8, 0.005
SEED = 11
#: Cells of a matrix of similarities that is worked on at once.
CELLS = 1 << 20


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _order(vector: Column, which: int) -> Column:
    """Struct of a code of signs and a projection, by which similar vectors often come near each other."""

    def place(column: pa.Array) -> pa.Array:
        v = _unit(column)
        if not len(v):
            return pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.float64())], names=["code", "at"])
        shown = v @ np.random.default_rng([SEED, which]).normal(size=(v.shape[1], SIGNS + 1))
        code = (shown[:, :SIGNS] > 0) @ (1 << np.arange(SIGNS)[::-1])
        return pa.StructArray.from_arrays([pa.array(code.astype(np.int64)), pa.array(shown[:, SIGNS])], names=["code", "at"])

    return F.arrow_udf(place, "struct<code: long, at: double>")(vector)


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "s"])


def _nearby(links: int):
    """For batches of (node, vector) in an order: the best ``links`` of those within a block."""

    def compare(nodes: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        s = v @ v.T
        np.fill_diagonal(s, -2)
        n = min(links, len(nodes) - 1)
        best = np.argpartition(-s, n - 1, axis=1)[:, :n] if n else np.zeros((len(nodes), 0), int)
        return _edges(np.repeat(nodes, n), nodes[best].ravel(), np.take_along_axis(s, best, 1).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, v, done = np.empty(0, np.int64), None, False
        for batch in batches:
            if not len(batch):
                continue
            own = _unit(batch.column(1))
            nodes = np.concatenate([nodes, batch.column(0).to_numpy()])
            v = own if v is None else np.concatenate([v, own])
            while len(nodes) >= BLOCK:
                yield compare(nodes[:BLOCK], v[:BLOCK])
                nodes, v, done = nodes[BLOCK // 2 :], v[BLOCK // 2 :], True
        if v is not None and (len(nodes) > BLOCK // 2 or not done) and len(nodes) > 1:
            yield compare(nodes, v)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For batches of (pivot, node, vector, least), in the order of pivots: pairs of a pivot's nodes that are more similar than the first one's least."""

    def compare(pivot: np.ndarray, node: np.ndarray, v: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
        sizes = np.diff(np.r_[starts, len(pivot)])
        order, at = np.argsort(sizes, kind="stable"), 0
        while at < len(order):  # pivots of about equal size at once
            upto = at + 1
            while upto < len(order) and (upto + 1 - at) * sizes[order[upto]] * max(sizes[order[upto]], v.shape[1]) <= CELLS:
                upto += 1
            some = order[at:upto]
            m = int(sizes[some[-1]])
            slot = np.arange(m)[None, :]
            there = slot < sizes[some][:, None]
            place = np.where(there, starts[some][:, None] + slot, 0)
            x = v[place] * there[:, :, None]
            s = x @ x.transpose(0, 2, 1)
            good = (s > least[place][:, :, None]) & there[:, :, None] & there[:, None, :] & (node[place][:, :, None] != node[place][:, None, :])
            g, i, j = np.nonzero(good)
            yield _edges(node[place[g, i]], node[place[g, j]], s[g, i, j])
            at = upto

    rest = None
    for batch in batches:
        if not len(batch):
            continue
        now = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _unit(batch.column(2)), batch.column(3).to_numpy()
        if rest is not None:
            now = tuple(np.concatenate(both) for both in zip(rest, now, strict=True))
        whole = int(np.searchsorted(now[0], now[0][-1]))  # the last pivot may go on in the next batch
        if whole:
            yield from compare(*[x[:whole] for x in now])
        rest = tuple(x[whole:] for x in now)
    if rest is not None:
        yield from compare(*rest)


def _best(edges: DataFrame, links: int) -> DataFrame:
    """The most similar ``links`` of every node; an edge that came several times stands once, as of its first round."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("born").alias("born"))
    return top_per_group(once, ["a"], [F.desc("s"), F.asc("b")], links)


def neighbour_graph(nodes: DataFrame, links: int, rounds: int = ROUNDS) -> DataFrame:
    """(a, b, s): for each node the ``links`` others found most similar, with their cosine. ``nodes`` is (node, vector), of distinct nodes."""
    edge = "a long, b long, s double"
    starts = [nodes.withColumn("o", _order(F.col("vector"), i)).repartitionByRange("o.code", "o.at", "node").sortWithinPartitions("o.code", "o.at", "node").select("node", "vector").mapInArrow(_nearby(links), edge) for i in range(ORDERS)]
    found = starts[0]
    for more in starts[1:]:
        found = found.union(more)
    edges = stored(_best(found.withColumn("born", F.lit(0)), links), "graph")
    for n in range(1, rounds + 1):
        least = edges.groupBy("a").agg(F.min("s").alias("s"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.when(F.col("n") >= links, F.col("s")).otherwise(-2.0).alias("least"))
        known = nodes.join(least, "node", "left").select("node", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
        # the best of those that point at a node; a node that very many point at compares no more than others
        back = top_per_group(edges.select(F.col("b").alias("pivot"), F.col("a").alias("node"), "s"), ["pivot"], [F.desc("s"), F.asc("node")], links).select("pivot", "node")
        around = edges.select(F.col("a").alias("pivot"), F.col("b").alias("node")).union(back).union(nodes.select(F.col("node").alias("pivot"), "node")).distinct()
        met = around.join(known, "node").select("pivot", "node", "vector", "least").repartition("pivot").sortWithinPartitions("pivot").mapInArrow(_met, edge)
        edges = stored(_best(edges.union(met.withColumn("born", F.lit(n))), links), "graph")
        new, every = edges.select(F.count_if(F.col("born") == n), F.count("*")).first()
        if new <= SETTLED * every:
            break
    return edges.select("a", "b", "s")


def nearest(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """(id, neighbour, rank, cosine): for every vector the ``k`` others with the largest cosine that the graph finds, ranked from 1; equal ones by the smaller id.

    Vectors that are null, empty or zero or hold null or non-finite components
    neither have neighbours nor are any; nor have null ids. All vectors must
    have the same length. Of rows with the same id the one with the smallest
    vector counts. With fewer than k other vectors all are listed. Other
    columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.forall(F.col("vector"), finite) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & good)
    rows = stored(rows.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    nodes = stored(rows.groupBy("vector").agg(F.min("id").alias("node")), "nodes")
    members = stored(rows.join(nodes, "vector").select("id", "node"), "members")
    lead = top_per_group(members, ["node"], [F.asc("id")], k + 1)  # enough for its own members and for all others
    graph = neighbour_graph(nodes, k + SPARE, rounds)
    others = graph.join(lead.select(F.col("node").alias("b"), F.col("id").alias("neighbour")), "b").select(F.col("a").alias("node"), "neighbour", F.col("s").alias("cosine"))
    offered = top_per_group(others.union(lead.select("node", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"))), ["node"], [F.desc("cosine"), F.asc("neighbour")], 2 * k + 1)
    lists = offered.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour"))).alias("all"))
    # a member takes its node's list without itself
    own = members.join(lists, "node").select("id", F.slice(F.filter("all", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("all"))
    return own.select("id", F.posexplode("all").alias("pos", "x")).select("id", F.col("x.neighbour").alias("neighbour"), (F.col("pos") + 1).alias("rank"), (-F.col("x.far")).alias("cosine"))

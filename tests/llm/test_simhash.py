from __future__ import annotations

import random

import numpy as np
import pytest

from millrace.llm.components import connected_components
from millrace.llm.simhash import BUDGETS, fingerprint, link_fingerprints, simhash_groups, within_ring


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    """doc_id -> smallest id reachable, by comparing all pairs."""
    fps = [(i, fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 3]
    return roots([i for i, _ in fps], pairs)


def test_budgets():
    assert BUDGETS == [0, 0, 1, 1, 1, 2, 2, 3]


def test_fingerprint_by_hand():
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d", "b c d")][:2]
    want = sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > 2)
    assert fingerprint("A b\tC  d") == want
    assert fingerprint("x y") == xxhash.xxh64_intdigest("x y", 42)
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0
    assert fingerprint("É b c") == xxhash.xxh64_intdigest("É b c", 42)  # A-Z alone are lower-cased


def test_every_close_pair_keeps_some_ring():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        bits = rng.choice(64, rng.integers(0, 4), replace=False)
        diff = np.array([sum(1 << int(b) for b in bits)], dtype=np.uint64)
        assert any(within_ring(diff, np.array([s]))[0] for s in range(8))
    far = np.array([0b1111], dtype=np.uint64)
    assert not any(within_ring(far, np.array([s]))[0] for s in range(8))


@pytest.mark.parametrize("hot", [1024, 16, 4])
def test_links_agree_with_all_pairs(spark, hot):
    """Random fingerprints, chains, and a dense group; with a low bound for hot keys the other path does it."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    for base in list(fps)[:25]:
        x = base
        for _ in range(rng.randint(1, 4)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(8)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in connected_components(link_fingerprints(df, hot)).collect()}
    want = roots([signed(x) for x in fps], [(signed(x), signed(y)) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 3])
    assert {n: got.get(n, n) for n in want} == want


def test_many_fingerprints_in_one_key(spark):
    """They agree on four segments and are random in the others, but for some that are near."""
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 32, 20_000, dtype=np.uint64) | np.uint64(0xABCDEF01 << 32)
    near = fps[:300].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    fps = np.unique(np.r_[fps, near])
    pairs = []
    for at in range(0, len(fps), 500):
        a, b = np.nonzero(np.bitwise_count(fps[at : at + 500, None] ^ fps[None, :]) <= 3)
        pairs += [(int(x), int(y)) for x, y in zip(fps[at + a].view(np.int64), fps[b].view(np.int64)) if x < y]
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in connected_components(link_fingerprints(df)).collect()}
    want = roots([int(x) for x in fps.view(np.int64)], pairs)
    assert {n: got.get(n, n) for n in want} == want and len(pairs) >= 250


def test_groups_agree_with_all_pairs(docs, clash):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(15):
        base = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            if rng.random() < 0.7:
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "one"), (n + 4, "one two"), (n + 5, "w1 " * 50_000)]
    got = {r.doc_id: r for r in simhash_groups(clash(docs(rows))).collect()}
    want = brute(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.fingerprint == f"{fingerprint(dict(rows)[i]):016x}" for i, r in got.items())
    assert {i for i, r in got.items() if r.kept} == set(want.values())


def test_null_ids_repeated_rows_and_empty(docs):
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, "q r s t u"), (None, "q r s t u")]
    got = simhash_groups(docs(rows)).collect()
    assert len(got) == 5
    assert all(r.component_id == 3 for r in got if r.fingerprint == f"{fingerprint('a b c'):016x}")
    alone = [r for r in got if r.fingerprint == f"{fingerprint('q r s t u'):016x}"]
    assert [r.component_id for r in alone] == [None, None] and all(r.kept for r in alone)
    assert simhash_groups(docs([])).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, i) for i in range(1001, 1400)]
    df = spark.createDataFrame([*chain, *hub, (5, 5), (None, 3), (2000, None)], "x long, y long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1400)}
    assert connected_components(df.limit(0)).count() == 0

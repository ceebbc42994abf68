from __future__ import annotations

import random

import numpy as np
import pytest

from millrace.llm.toxicity import Corpus, fit_chain, predict_chain, toxicity
from millrace.llm.wordhash import word_hashes

CATEGORIES = {"rude": "rude", "threat": "threat"}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 60))]
        rude, threat = rng.random() < 0.3, False
        if rude:
            words += rng.sample(["clod", "oaf", "dolt", "boor"], 2)
            if threat := rng.random() < 0.5:
                words += ["beware"]
        elif rng.random() < 0.1:
            words += ["beware"]  # alone it is no threat
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(rude), int(threat)))
    return rows


def test_chain_on_held_out_rows(docs, clash, spark):
    rows = corpus(1500)
    odd = [(5000, None), (5001, ""), (5002, "..."), (None, "clod oaf dolt"), (5003, "clod oaf " * 20_000), (5004, "w1 w2"), (5004, "w1 w2")]
    labels = spark.createDataFrame([(i, r, t) for i, _, r, t in rows[:1000]] + [(1, None, 1), (None, 1, 1), (99_999, 1, 1)], "doc_id long, rude int, threat int")
    out = toxicity(clash(docs([(i, t) for i, t, _, _ in rows] + odd)), labels, CATEGORIES, threshold=0.5)
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    test = rows[1000:]
    assert np.mean([by[i].rude == bool(r) for i, _, r, _ in test]) >= 0.97
    assert np.mean([by[i].threat == bool(t) for i, _, _, t in test]) >= 0.93
    assert by[None].rude and by[5003].rude and not any(by[i].rude for i in (5000, 5001, 5002, 5004))
    assert all(0 <= r.p_rude <= 1 and 0 <= r.p_threat <= 1 for r in got)


def test_later_models_use_earlier_odds():
    """The second category is the first with noise in its words: the chain's second model leans on the first's odds."""
    rows = corpus(1200, seed=2)
    docs = [np.unique(word_hashes(t.split())) for _, t, _, _ in rows]
    y = np.array([[r, r] for _, _, r, _ in rows])
    chain = fit_chain(docs, y, np.arange(len(docs)) % 5)
    assert len(chain[1].weights) == len(chain[1].words) + 2 and chain[1].weights[-2] > 0.1
    assert len(predict_chain(chain, docs[0])) == 2


def test_out_of_fold_rows_are_not_seen():
    docs = [np.array([i], dtype=np.uint64) for i in range(40)]
    y = np.array([i % 2 for i in range(40)], dtype=float)
    model, p = Corpus(docs).fit(y, np.zeros((40, 0)), np.arange(40) < 20, 100, 1, 0.01)
    assert set(model.words.tolist()) <= set(range(20)) and np.ptp(p[20:]) < 1e-9


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_little_or_nothing_to_learn(docs, spark, labels):
    df = spark.createDataFrame(labels, "doc_id long, rude int, threat int")
    got = toxicity(docs([(1, "a b"), (2, None)]), df, CATEGORIES).collect()
    assert len(got) == 2 and all(0 <= r.p_rude <= 1 for r in got)
    assert toxicity(docs([]), df, CATEGORIES).count() == 0


def test_copies_share_a_fold_and_unknown_labels_teach_the_rest(docs, clash, spark):
    rows = corpus(900, seed=5)
    copies = [(10_000 + i, t, r, h) for i, t, r, h in rows[:300]]
    given = [(i, r if i % 3 else None, t) for i, _, r, t in rows + copies]
    labels = clash(spark.createDataFrame(given, "doc_id long, rude int, threat int"))
    got = {r.doc_id: r for r in toxicity(clash(docs([(i, t) for i, t, _, _ in rows + copies])), labels, CATEGORIES, threshold=0.5).collect()}
    assert np.mean([got[i].threat == bool(t) for i, _, _, t in rows]) >= 0.95
    assert np.mean([got[i].rude == bool(r) for i, _, r, _ in rows]) >= 0.95


def test_unknown_labels_are_left_out_of_one_fit():
    docs = [np.array([i % 4], dtype=np.uint64) for i in range(80)]
    y = np.array([[i % 2, (i % 4) // 2] for i in range(80)])
    gaps = y.copy()
    gaps[::5, 0] = -1
    whole, some = fit_chain(docs, y, np.arange(80) % 5, least=1), fit_chain(docs, gaps, np.arange(80) % 5, least=1)
    for d in docs[:4]:
        assert np.allclose(np.round(predict_chain(whole, d)), np.round(predict_chain(some, d)))

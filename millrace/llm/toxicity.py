"""Toxicity by a chain of linear classifiers over words.

The categories are predicted in order. The model of each is a logistic
regression over the presence of the words that tell it best (chi-squared, in
the rows it is fitted on) and over the log odds of the categories before it.
While fitting, those odds come from models that were fitted without the row's
fold, so that a later model sees them as good as they will be on new texts.
Folds go by the text, so copies of a text are in one fold.

Fitting takes at most SAMPLE labelled rows, chosen by a hash of their id.
Prediction is one scan of all texts without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.wordhash import text_hashes

SAMPLE, FOLDS, FEATURES, LEAST_DOCS, PENALTY = 12_000, 5, 512, 8, 1.0


def _clip(p: np.ndarray) -> np.ndarray:
    return np.clip(p, 1e-4, 1 - 1e-4)


def _odds(p: np.ndarray) -> np.ndarray:
    return np.log(_clip(p) / (1 - _clip(p)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Linear:
    """Logistic regression over word presence and the odds of earlier categories."""

    def __init__(self, words: np.ndarray, weights: np.ndarray):
        self.words, self.weights = words, weights  # words sorted; weights: words, earlier odds, intercept

    def score(self, hashes: np.ndarray, earlier: Sequence[float]) -> float:
        z = self.weights[-1] + float(np.dot(self.weights[len(self.words) : -1], earlier))
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            z += self.weights[np.unique(at[self.words[at] == hashes])].sum()
        return float(_sigmoid(np.array(z)))


class Corpus:
    """Distinct words of each text, as one column of small numbers (``word``) and its row (``row``)."""

    def __init__(self, docs: Sequence[np.ndarray]):
        flat = np.concatenate([*docs, np.empty(0, np.uint64)])
        self.rows = len(docs)
        self.row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.words, self.word = np.unique(flat, return_inverse=True)

    def fit(self, y: np.ndarray, earlier: np.ndarray, use: np.ndarray, features: int, least: int, penalty: float) -> tuple[Linear, np.ndarray]:
        """Fitted on the rows of ``use``; the probabilities of all rows."""
        on = use[self.row]
        seen = np.bincount(self.word[on], minlength=len(self.words)).astype(float)
        hit = np.bincount(self.word[on], weights=y[self.row[on]], minlength=len(self.words))
        n, k = max(1, int(use.sum())), float(y[use].sum())
        gap = hit * n - seen * k
        chi = np.where((seen >= least) & (seen < n), gap**2 * n / np.maximum(seen * (n - seen) * max(k * (n - k), 1e-9), 1e-9), 0)
        best = np.sort(np.lexsort((self.words, -chi))[:features])
        best = best[chi[best] > 0]
        place = np.full(len(self.words), -1)
        place[best] = np.arange(len(best))
        x = np.zeros((self.rows, len(best) + earlier.shape[1] + 1), dtype=np.float32)
        known = place[self.word] >= 0
        x[self.row[known], place[self.word[known]]] = 1
        x[:, len(best) : -1] = earlier
        x[:, -1] = 1
        w = _newton(x[use], y[use], penalty)
        return Linear(self.words[best], w), _sigmoid(x @ w)


def _newton(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 8) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        slope = x.T @ (y - p) - ridge * w
        bend = (x * np.maximum(p * (1 - p), 1e-5)[:, None].astype(np.float32)).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-2:
            break
    return w


def fit_chain(docs: Sequence[np.ndarray], labels: np.ndarray, fold: np.ndarray, features: int = FEATURES, least: int = LEAST_DOCS, penalty: float = PENALTY) -> list[Linear]:
    """One model per column of ``labels`` (0, 1, or -1 if unknown); docs: distinct word hashes of each row, fold: its fold."""
    corpus, chain = Corpus(docs), []
    odds = np.zeros((len(docs), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        known = y >= 0  # what isn't labelled in this category teaches nothing here, but has odds for the next
        model, _ = corpus.fit(y, odds, known, features, least, penalty)
        chain.append(model)
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(docs))
            for f in np.unique(fold):
                _, p = corpus.fit(y, odds, known & (fold != f), features, least, penalty)
                out[fold == f] = p[fold == f]
            odds = np.c_[odds, _odds(out)]
    return chain


def predict_chain(chain: Sequence[Linear], hashes: np.ndarray) -> list[float]:
    found: list[float] = []
    for model in chain:
        found.append(model.score(hashes, [float(_odds(np.array(p))) for p in found]))
    return found


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last column text becomes the distinct word hashes."""
    for batch in batches:
        words = [np.unique(h).view(np.int64) for h in text_hashes(batch.column(batch.num_columns - 1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.list_(pa.int64()))], names=batch.schema.names)


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, folds: int = FOLDS, **options) -> list[Linear]:
    """Fit a chain. ``categories``: name and SQL expression over ``labels`` (0 or 1), in the chain's order.

    A label that is null in a category teaches nothing about that category;
    labels without a document and null ids teach nothing. Of several documents
    of one id one counts. With no labelled row at all, every probability is 0.5.
    """
    names = list(categories)
    ys = [f"y{i}" for i in range(len(names))]
    rows = labels.select(F.col(id_col).cast("long").alias("id"), *[F.expr(e).cast("int").alias(y) for y, e in zip(ys, categories.values())])
    rows = rows.dropna(subset=["id"]).dropna(how="all", subset=ys).na.fill(-1, ys)
    rows = rows.orderBy(F.xxhash64("id"), *ys).limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # at most ``sample`` rows of a few numbers
    joined = texts.join(F.broadcast(rows), "id").groupBy("id", *ys).agg(F.max("text").alias("text")).select("id", *ys, F.xxhash64("text").alias("h"), "text")
    schema = "id long, " + "".join(f"{y} int, " for y in ys) + "h long, text array<long>"
    got = joined.mapInArrow(_distinct_words, schema).toArrow().sort_by([(c, "ascending") for c in ("id", *ys)])
    if not got.num_rows:
        return [Linear(np.empty(0, np.uint64), np.zeros(n + 1)) for n in range(len(names))]
    hashes = [np.asarray(x.values, dtype=np.int64).view(np.uint64) for x in got.column("text")]
    fold = (got.column("h").to_numpy().astype(np.uint64) >> np.uint64(40)) % np.uint64(folds)
    y = np.stack([got.column(c).to_numpy() for c in ys], axis=1)
    return fit_chain(hashes, y, fold.astype(int), **options)


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.4, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_<category> for each, and <category> (probability at least ``threshold``).

    A probability that equals the threshold counts. Null, empty and wordless texts get the probabilities of a text without any
    telling word; texts of any length are read whole. Null ids and repeated
    rows keep their rows; other columns are ignored, whatever their names, but
    for those of ``labels`` that ``categories`` names; an empty table gives an
    empty result.
    """
    chain = learn(docs, labels, categories, id_col, text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a few hundred weights
    names = list(categories)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.unique(np.concatenate([m.words for m in shared.value]))
        for batch in batches:
            found = []
            for h in text_hashes(batch.column(1).to_pylist()):
                if len(told) and len(h):
                    h = h[told[np.minimum(np.searchsorted(told, h), len(told) - 1)] == h]
                found.append(predict_chain(shared.value, np.unique(h)))
            p = np.array(found).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, i]) for i in range(len(names))]], names=["doc_id", *[f"p_{n}" for n in names]])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, " + ", ".join(f"`p_{n}` double" for n in names))
    return out.select("*", *[(F.col(f"p_{n}") >= threshold).alias(n) for n in names])

"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter 3-gram is the product
of its letters' vectors, the first permuted (rotated) twice, the second once.
A text is the sum of its 3-grams' vectors, a language's prototype the sum over
the texts it was learned from, and the prediction is the prototype with the
largest cosine.

Words are padded with a blank on either side, and every letter is the middle
of one 3-gram; what isn't a letter or mark is a blank. Sums are of integers,
so they don't depend on how rows are dealt out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 512
SEED = 20
#: Characters that are worked on at once, texts that are told at once, and cells of the matrices they take.
STEP, TEXTS, CELLS = 500_000, 400, 1_000_000
#: Bits of a code point in the number of a 3-gram.
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: 0 neither letter nor mark, 1 mark, 2 letter."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LM":
            kinds[c] = 2 if k == "L" else 1
    return kinds


@lru_cache(maxsize=20_000)
def letter_vector(code: int, dim: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, dim) * 2 - 1).astype(np.int8)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the 3-grams of ``texts``: index of the text, index of the 3-gram in the third result (rows of 3 code points)."""
    low = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = np.where(_letters()[points] > 0, points, 32)
    doc = np.repeat(np.arange(len(low) + 1), [1, *(len(t) + 1 for t in low)]) - 1
    keep = np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]
    points, doc = points[keep], doc[keep]
    middle = np.flatnonzero(points != 32)
    if not len(middle):
        return np.empty(0, int), np.empty(0, int), np.empty((0, 3), int)
    alphabet = np.flatnonzero(np.bincount(points))
    local = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
    local[alphabet] = np.arange(len(alphabet))
    x, n = local[points], len(alphabet)
    code = (x[middle - 1] * n + x[middle]) * n + x[middle + 1]
    if n**3 <= 1 << 20:
        distinct = np.flatnonzero(np.bincount(code, minlength=n**3))
        place = np.zeros(n**3, dtype=np.int64)
        place[distinct] = np.arange(len(distinct))
        gram = place[code]
    else:
        distinct, gram = np.unique(code, return_inverse=True)
    return doc[middle], gram, np.stack([alphabet[distinct // (n * n)], alphabet[distinct // n % n], alphabet[distinct % n]], axis=1)


def _bound(grams: np.ndarray, dim: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The vectors of the 3-grams, some columns at a time."""
    codes, at = np.unique(grams, return_inverse=True)
    own = np.stack([letter_vector(int(c), dim) for c in codes])
    twice, once = np.roll(own, 2, axis=1), np.roll(own, 1, axis=1)
    a, b, c = at.reshape(grams.shape).T
    wide = max(64, CELLS // len(grams))
    for first in range(0, dim, wide):
        some = slice(first, first + wide)
        yield some, (twice[:, some][a] * once[:, some][b] * own[:, some][c]).astype(np.float32)


def _upto(texts: list[str], at: int) -> int:
    """End of the texts from ``at`` on that are worked on at once."""
    end, size = at, 0
    while end < len(texts) and (size < STEP or end == at):
        size += len(texts[end])
        end += 1
    return end


def bundles(texts: list[str], group: np.ndarray, groups: int, dim: int = DIM) -> np.ndarray:
    """Sums of the 3-gram vectors of the texts of each group (group[i] is the group of text i)."""
    out = np.zeros((groups, dim))
    at = 0
    while at < len(texts):
        end = _upto(texts, at)
        doc, gram, grams = _grams(texts[at:end])
        if len(grams):
            own, row = np.unique(group[at:end], return_inverse=True)
            rows = row[doc]
            wide = len(grams)
            step = max(1, CELLS // wide)
            for some, vectors in _bound(grams, dim):
                for first in range(0, len(own), step):
                    those = (rows >= first) & (rows < first + step)
                    n = min(step, len(own) - first)
                    counts = np.bincount((rows[those] - first) * wide + gram[those], minlength=n * wide)
                    out[own[first : first + n], some] += counts.reshape(n, wide).astype(np.float32) @ vectors
        at = end
    return out


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes. Rows with a null text or language teach nothing.

    A prototype is a sum over 3-grams, so Spark adds up how often each occurs in
    each language, and each distinct one is bound once. What comes to the
    driver is one vector per language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = sorted(set(langs))
            group = np.array([own.index(x) for x in langs], dtype=int)
            at = 0
            while at < len(texts):
                end = _upto(texts, at)
                doc, gram, grams = _grams(texts[at:end])
                if len(grams):
                    counts = np.bincount(group[at:end][doc] * len(grams) + gram, minlength=len(own) * len(grams))
                    some = np.flatnonzero(counts)
                    a, b, c = grams[some % len(grams)].astype(np.int64).T
                    names = pa.DictionaryArray.from_arrays(pa.array(some // len(grams), pa.int32()), pa.array(own)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array((a << 2 * _BITS) | (b << _BITS) | c), pa.array(counts[some], pa.int64())], names=["lang", "gram", "n"])
                at = end

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        low = (1 << _BITS) - 1
        for batch in batches:
            code, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for first in range(0, len(code), 4096):
                part = code[first : first + 4096]
                for some, vectors in _bound(np.stack([part >> 2 * _BITS, part >> _BITS & low, part & low], axis=1), dim):
                    for lang in sorted(set(langs[first : first + 4096])):
                        own = langs[first : first + 4096] == lang
                        total.setdefault(lang, np.zeros(dim))[some] += n[first : first + 4096][own] @ vectors[own].astype(float)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.astype(np.int64) for v in total.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    grams = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = grams.mapInArrow(bind, "lang string, v array<long>").select("lang", F.posexplode("v"))
    sums = parts.groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("v")).collect():
        found[r.lang] = np.array([x.v for x in r.v], dtype=float)
    langs = sorted(found)
    return langs, np.stack([found[k] for k in langs]) if langs else np.zeros((0, dim))


def language_of(text: Column, langs: list[str], prototypes: np.ndarray) -> Column:
    """Struct of lang_pred and score (cosine, at least 0) of a text.

    und with score 0 stands for a text that is null or has no letter, and for
    any text if nothing was learned. Ties go to the first language in order.
    Texts of any length are told whole.
    """
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)

    def predict(column: pa.Array) -> pa.Array:
        kinds = _letters()
        names, scores = [], []
        for first in range(0, len(column), TEXTS):
            texts = [t or "" for t in column.slice(first, TEXTS).to_pylist()]
            v = bundles(texts, np.arange(len(texts)), len(texts), unit.shape[1])
            size = np.linalg.norm(v, axis=1)
            cos = v @ unit.T / np.maximum(size, 1e-300)[:, None]
            best = cos.argmax(axis=1) if langs else np.zeros(len(texts), int)
            for i, t in enumerate(texts):
                letters = size[i] > 0 and any(kinds[ord(c)] == 2 for c in t)
                names.append(langs[best[i]] if letters and langs else "und")
                scores.append(float(min(1.0, max(0.0, cos[i, best[i]]))) if letters and langs else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf(predict, "lang_pred string, score double")(text)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: a third by CRC-32 of the id; all without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. Learns from the rows that aren't held out.

    Nulls, ties and long texts are as ``language_of`` says; repeated rows and
    null ids keep their rows. Other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    langs, prototypes = learn_prototypes(rows.where("not held_out"), dim=dim)
    told = rows.select("doc_id", "held_out", language_of(F.col("text"), langs, prototypes).alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score")

"""Words as 64-bit hashes, n-gram hashes and bitmaps of them, in numpy."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
#: Characters that are worked on at once; longer texts are cut at a blank.
STEP = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_BASE = 0x9FB21C651E98DF25


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """By code point: whether it belongs to words."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])


_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse (mod 2**64), n of each at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def _hashed(low: Sequence[str]) -> list[np.ndarray]:
    """Word hashes of lower-cased texts: a polynomial of the code points, taken from one running sum, then mixed."""
    points = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = _in_words()[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    powers, inverse = _power(len(points))
    sums = np.cumsum(points * powers[: len(points)], dtype=np.uint64)
    h = (sums[ends - 1] - sums[starts - 1]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD[0]
    for shift, odd in ((32, _ODD[1]), (29, _ODD[2])):
        h = (h ^ (h >> np.uint64(shift))) * odd
    h ^= h >> np.uint64(32)
    firsts = 1 + np.cumsum([len(t) + 1 for t in low[:-1]], dtype=np.int64)
    return np.split(h, np.searchsorted(starts, firsts))


def text_hashes(texts: Sequence[str | None]) -> list[np.ndarray]:
    """64-bit hashes of the words (see ``words_of``) of each text, in order."""
    low = [t.lower() if t else "" for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(low):
        end, size = at, 0
        while end < len(low) and (size + len(low[end]) <= STEP or end == at):
            size += len(low[end])
            end += 1
        if size <= STEP:
            out += _hashed(low[at:end])
        else:
            parts, text, start = [], low[at], 0
            while start < len(text):
                cut = text.find(" ", start + STEP) if start + STEP < len(text) else -1
                stop = len(text) if cut < 0 else cut
                parts += _hashed([text[start:stop]])
                start = stop
            out.append(np.concatenate(parts))
        at = end
    return out


def word_hashes(words: Sequence[str]) -> np.ndarray:
    """Hashes of words, as ``text_hashes`` gives them."""
    return text_hashes([" ".join(words)])[0]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; of the whole sequence if it is shorter (none: no hash)."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    n = min(n, len(hashes))
    size = len(hashes) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + size]) * _ODD[i % len(_ODD)]
        out ^= out >> np.uint64(29)
    return out


class Bitmap:
    """Which of a set of hashes may occur: one bit per slot, of a size that is fixed by the number of slots."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - bits), words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return ((self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


#: The largest bitmap: 2**28 bits, 32 MB. Beyond about 2**24 hashes it lets more false candidates through, which the exact join drops.
MOST_BITS = 28


def bitmap(hashes: DataFrame, column: str, each: int = 64) -> Bitmap:
    """Of ``each`` bits for a hash, as far as MOST_BITS goes. Made of map-side sums; what comes to the driver is the bitmap's own words, 32 MB at most, however many hashes there are."""
    n = hashes.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) * each)), 12, MOST_BITS))
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    rows = hashes.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(bit).alias("word")).toPandas()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[rows["at"].to_numpy(dtype=np.int64)] = rows["word"].to_numpy(dtype=np.int64).view(np.uint64)
    return Bitmap(bits, words)


def local_alignment(a: list[np.ndarray], b: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of the pairs (a[i], b[i]) of word hashes, and where in b[i] the best alignment ends (exclusive).

    Row by row over a, all pairs at once; gaps along b are a running maximum.
    """
    n, la, lb = len(a), max(map(len, a), default=0), max(map(len, b), default=0)
    if not n or not la or not lb:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    x, y = np.zeros((n, la), np.uint64), np.zeros((n, lb), np.uint64)
    in_x, in_y = np.zeros((n, la), bool), np.zeros((n, lb), bool)
    for i in range(n):
        x[i, : len(a[i])], in_x[i, : len(a[i])] = a[i], True
        y[i, : len(b[i])], in_y[i, : len(b[i])] = b[i], True
    step = -gap * np.arange(lb, dtype=np.int32)
    h = np.zeros((n, lb + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(la):
        same = (y == x[:, i : i + 1]) & in_y & in_x[:, i : i + 1]
        t = np.maximum(h[:, :-1] + np.where(same, match, mismatch).astype(np.int32), h[:, 1:] + gap)
        np.maximum(t, 0, out=t)
        h[:, 1:] = np.maximum.accumulate(t + step, axis=1) - step
        top = h[:, 1:].argmax(axis=1)
        score = h[np.arange(n), top + 1]
        more = score > best
        best[more], end[more] = score[more], top[more] + 1
    return best.astype(np.int64), end


def aligned_spans(a: list[np.ndarray], b: list[np.ndarray], cells: int = 4_000_000, **scores: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, starts and ends (exclusive) in b of the best local alignments; pairs of like size are worked on together."""
    n = len(a)
    score, start, end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = sorted(range(n), key=lambda i: (len(b[i]), len(a[i])))
    at = 0
    while at < n:
        upto = at + 1
        while upto < n and (upto + 1 - at) * len(b[order[upto]]) <= cells // 16 and len(b[order[upto]]) <= 2 * len(b[order[at]]) + 16:
            upto += 1
        some = order[at:upto]
        s, e = local_alignment([a[i] for i in some], [b[i] for i in some], **scores)
        _, back = local_alignment([a[i][::-1] for i in some], [b[i][:z][::-1] for i, z in zip(some, e, strict=True)], **scores)
        score[some], end[some], start[some] = s, e, e - back
        at = upto
    return score, start, end

"""Exact token ids of a ``tokenizers`` file, with a bounded memo of what recurs.

Byte-pair encoding never crosses the bounds that a file's pre-tokenizer sets,
so the ids of a text are the ids of its pieces in a row. Pieces recur; each
distinct one is given to the library and remembered for as long as it keeps
turning up. Only texts and pieces for which this module can tell the bounds
surely take that way; all others are encoded whole by the library.
"""

from __future__ import annotations

import array
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np

#: Entries of the younger of a memo's two generations; with it the elder is let go and the younger takes its place.
MEMO = 300_000
#: Characters of the texts that are encoded together.
PART = 1 << 20
#: Python's \s holds these, the library's doesn't.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Characters for which lower-casing, NFC and letter classes are the same in every library and Unicode version.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]+")
_WORD_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]*")
_WORD_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_MARK = r"[\x21-/:-@\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]"  # of _WORD_PLAIN what is neither letter, digit nor blank
_RUN = re.compile(_MARK + _MARK)
_BYTE_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_BYTE_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]+")


def tokenizer_version(content: str) -> str:
    """Digest of a tokenizer file and of the library that reads it."""
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}\n{content}".encode()).hexdigest()


class Memo:
    """Ids by unit, in two generations: what was not asked for while the younger one filled is forgotten."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Keys that neither generation holds; all others are in the younger one afterwards."""
        out, young, old = [], self.young, self.old
        for key in set(keys).difference(young):
            if (found := old.get(key)) is None:
                out.append(key)
            else:
                young[key] = found
        return out


class Encoder:
    """Ids as unsigned 32-bit little-endian bytes, without added tokens; special strings as the library's default."""

    def __init__(self, content: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.loads(content)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.kind = self._kind(spec)
        self.units, self.pieces = Memo(memo), Memo(memo)
        if self.kind != "whole":
            names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size(with_added_tokens=True))]
            suffix = spec["model"].get("end_of_word_suffix") or ""
            self.last = np.array([bool(suffix) and n.endswith(suffix) for n in names])
            self.sizes = np.array([len(n) for n in names])  # byte-level: a character stands for a byte

    @staticmethod
    def _kind(spec: dict) -> str:
        """Which of the two known pre-tokenizers a file has; any other is encoded whole."""
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model", {})
        if model.get("type") != "BPE" or spec.get("truncation") or spec.get("padding"):
            return "whole"
        if norm is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("end_of_word_suffix"):
            return "bytes"
        if norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1].get("content") == " " and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}:
            parts = pre.get("pretokenizers", [])
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            if [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0] == {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True} and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]:
                return "words"
        return "whole"

    def _library(self, text: str) -> bytes:
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, units: list[str]) -> None:
        """Put the ids of new units into the memo."""
        words = self.kind == "words"
        prefix, split, plain = ("", _WORD_PIECE, _PLAIN) if words else (" ", _BYTE_PIECE, _BYTE_PLAIN)
        memo, pieces = self.units.young, self.units if words else self.pieces  # a piece of the kind "words" is a unit too
        parts: dict[str, list[str]] = {}
        alone: list[str] = []
        for unit in units:
            text = prefix + unit
            if not text:
                memo[unit] = b""
            elif plain.fullmatch(text):
                low = text.lower() if words else text
                if not unit.isalpha():
                    parts[unit] = split.findall(low)
                elif words and low == unit:
                    alone.append(unit)
                else:
                    parts[unit] = [low]
            else:
                memo[unit] = self._library(text)
        fresh = list(dict.fromkeys(chain(alone, pieces.missing(chain.from_iterable(parts.values())))))
        known = pieces.young
        known.update(zip(fresh, self._encode_pieces(fresh), strict=True))
        for unit, found in parts.items():
            memo[unit] = known[found[0]] if len(found) == 1 else b"".join([known[p] for p in found])

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Those that stay apart when they are strung together are given to the library as one text."""
        words = self.kind == "words"
        strung = pieces if words else [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        found: dict[str, bytes] = {}
        if len(strung) > 1:
            ids = np.array(self.library.encode_batch_fast([(" " if words else "").join(strung)], add_special_tokens=False)[0].ids, dtype="<u4")
            if words:
                ends = np.flatnonzero(self.last[ids]) + 1
                whole = len(ends) == len(strung) and (not len(ids) or ends[-1] == len(ids))
            else:
                upto, wanted = np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) for p in strung])
                ends = np.searchsorted(upto, wanted) + 1
                whole = len(upto) and ends[-1] == len(ids) and (upto[ends - 1] == wanted).all()
            if whole:
                raw, bounds = ids.tobytes(), (ends * 4).tolist()
                found = {p: raw[a:b] for p, a, b in zip(strung, [0, *bounds], bounds)}
        rest = [p for p in pieces if p not in found]
        if rest:
            for p, got in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                found[p] = array.array("I", got.ids).tobytes()
        return [found[p] for p in pieces]

    def _cut(self, text: str) -> tuple[bytes, list[str]]:
        """Ids of what stands first, and the units behind it."""
        if self.kind == "whole" or any(c in text for c in _ODD_SPACE) or any(s in text for s in self.special):
            return self._library(text), []
        if self.kind == "words":
            if _WORD_PLAIN.fullmatch(text):
                text = text.lower()
                # a mark that stands alone is a piece of its own, and blanks are dropped
                if not _RUN.search(text):
                    for mark in ".,;:!?":
                        text = text.replace(mark, f" {mark} ")
            return b"", text.split()
        # a text can be cut before any single space that something other than white space follows
        first, *units = text.split(" ") if "  " not in text and not re.search(r" \s| $", text) else re.split(r" (?=\S)", text)
        return self._first(first), units

    def _first(self, text: str) -> bytes:
        if text and _BYTE_PLAIN.fullmatch(text):
            known = self.pieces.young
            return b"".join([known[p] if p in known else self._library(p) for p in _BYTE_PIECE.findall(text)])
        return self._library(text) if text else b""

    def batch(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The ids of each text in order; memory is that of a few texts, or of the longest."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < PART or end == at):
                size += len(texts[end])
                end += 1
            cut = [self._cut(t) for t in texts[at:end]]
            self.units.turn()
            self.pieces.turn()
            new = self.units.missing(chain.from_iterable(units for _, units in cut))
            if new:
                self._learn(new)
            ids = self.units.young.__getitem__
            for head, units in cut:
                yield head + b"".join(map(ids, units))
            at = end

    def __call__(self, text: str) -> bytes:
        return next(self.batch([text]))


_made: dict[str, Encoder] = {}


def encoder(content: str) -> Encoder:
    """One encoder per worker and tokenizer file; it outlives tasks."""
    key = tokenizer_version(content)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(content)
    return _made[key]

"""Alignment of whole texts, token by token, against the relations over units."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.alignment import align_units, alignments, packed, units_of

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters():
    """Byte by letter, from the public rule: printable bytes stand for themselves, the rest are numbered from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + n)] = b
            n += 1
    return table


class Slow:
    """Whole texts through the libraries, and every pair of tokens compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(FILES[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
        self.byte = letters()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def rows(self, docs):
        spans = []
        for _, text in docs:
            sides = []
            for side in self.tokens(text):
                at, out = 0, []
                for i, raw in side:
                    out.append((i, at, at + len(raw)))
                    at += len(raw)
                sides.append(out)
            spans.append(sides)
        links = []
        for a, b in spans:
            own, first = [], 0
            for i, s, e in a:
                while first < len(b) and b[first][2] <= s:
                    first += 1
                own += [(i, j) for j, t, u in b[first : first + 400] if t < e and s < u]
            links.append(own)
        counts = Counter(p for own in links for p in own)
        most = {}
        for (_, j), n in counts.items():
            most[j] = max(most.get(j, 0), n)
        out = []
        for (d, _), (a, b), own in zip(docs, spans, links, strict=True):
            cuts = sorted({e for *_, e in a} & {e for *_, e in b})
            shown, low = [], 0
            for c in cuts:
                shown.append("|".join(",".join(str(i) for i, s, e in side if low < e <= c) for side in (a, b)))
                low = c
            out.append((d, len(a), len(b), len(cuts), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(";".join(shown).encode()).hexdigest() if a else ""))
        return out


@pytest.fixture(scope="module")
def slow():
    return Slow()


def texts():
    rng = random.Random(6)
    words = ["the", "Haus", "été", "naïve", "don't", "12", "3.14", "...", "😀", "中文字", "ﬁ", "é", "́x", "<s>", "<|endoftext|>", "<0x41>", "internationalisation", "aaaa", "_x_", "﻿q"]
    gaps = [" ", " ", " ", " ", "  ", "\n", " \n", "\t", " ", "　 ", " ​", "   ", "\x1c", " ᠎"]
    out = ["".join(rng.choice(["", *gaps]) + rng.choice(words) for _ in range(rng.randint(0, 25))) + rng.choice(["", "", " ", "\n"]) for _ in range(120)]
    return [*out, None, "", " ", "  ", "\n", "a", " a", "a\x00b", "x▁y", "the ▁ house", "the▁ house", "word " * 300, "é" * 300, "ab" * 200, out[3], out[3]]


def compare(spark, slow, docs, **more):
    key = lambda r: tuple((x is None, x) for x in r)
    got = alignments(spark.createDataFrame(docs, "doc_id long, text string"), *FILES, **more)
    want = sorted(slow.rows(docs), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    return want


def test_texts_of_every_kind(spark, slow):
    docs = [*enumerate(texts()), (3, texts()[3]), (3, texts()[3]), (None, "the Haus"), (None, None), (None, "the Haus")]
    want = compare(spark, slow, docs)
    assert sum(r[7] == "" for r in want) >= 7 and sum(r[5] < r[4] for r in want) > 50


def test_rare_units_and_large_pair_tables_take_the_joins(spark, slow, monkeypatch):
    monkeypatch.setattr("millrace.llm.alignment.FREQUENT", 8)
    compare(spark, slow, [*enumerate(texts()), (3, texts()[3])], broadcast=0)


def test_units_join_to_the_text(spark):
    for text in texts():
        if text:
            cut = units_of(text)
            assert "".join(cut) == " " + text and all(cut)


def test_units_are_encoded_together_as_they_are_alone():
    """One call of the first library for all units, whose ids, groups and refusals are those of each unit alone."""
    from millrace.llm.alignment import Pair

    pair = Pair(open(FILES[0]).read(), open(FILES[1], "rb").read())
    units = list(dict.fromkeys(u for t in texts() if t for u in units_of(t)))
    plain = [u for u in units if u.strip() == u[1:] and u[1:].isalnum()]
    for some in (units, plain, units[:1], []):
        alone = [pair.shown([u])[0] for u in some]
        assert pair.shown(some) == alone and (some is not units or None in alone)
    for u, shown in zip(plain, alone := pair.shown(plain), strict=True):
        ids = [[int(i) for g in shown.split(";") for i in g.split("|")[side].split(",")] for side in (0, 1)]
        assert [b"".join(names[i] for i in x) for x, names in zip(ids, (pair.a_bytes, pair.b_bytes), strict=True)] == [u.encode()] * 2
    calls = []
    split = pair.b.encode
    pair.b = type("Counted", (), {"encode": lambda self, some, **k: calls.append(len(some)) or split(some, **k)})()
    assert pair.shown(plain) == alone and calls == [len(plain)]


def test_no_pair_of_tokens_is_made_that_is_no_link(spark):
    """A unit whose sides meet only at its end gives as many rows as both have tokens, less one."""
    many = 2000
    sides = [packed(0, np.full(many, 1), np.full(many, 2)), packed(1, np.full(many + 1, 2), np.array([1, *[2] * (many - 1), 1]))]
    got = align_units(spark.createDataFrame([("u", 1, np.concatenate(sides).tolist())], "key string, n long, tokens array<long>")).collect()
    assert len(got) == 2 * many and sum(r.ends_a and r.ends_b for r in got) == 1 and all((r.a, r.b) == (1, 2) for r in got)


def test_clashing_columns_and_empty_tables(spark, slow):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    clashing = docs.withColumns({c: F.lit("x") for c in ("h", "key", "unit", "n", "a", "b", "n_a", "pos", "d", "g", "rest", "copies", "count")})
    assert sorted(tuple(r) for r in alignments(clashing, *FILES).collect()) == slow.rows([(1, "one two"), (2, None)])
    assert alignments(docs.limit(0), *FILES).count() == 0


def test_unfit_tokenizers_are_refused():
    from millrace.llm.alignment import Pair

    with pytest.raises(ValueError, match="byte-level"):
        Pair(open(public_tokenizers.path("word_bpe_49k.json")).read(), open(FILES[1], "rb").read())

"""Fill-in-middle against a plain cut by the grammar."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm.infill import boundary, digests, infill, units

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    found = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(found)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def texts():
    rng = random.Random(8)
    signs = ["a", "Zz", "é", " ", "\n", "😀", "中", "<", ">", "<P", "S>", "\u0000", "\u2028", "1", "e\u0301", "\U0001d11e"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return out + [None, "", "a", "é", "😀", "😀😀", "<P>", "a<S>b", "<M", "word " * 20_000, "x" * 100_000, "é" * 3_000]


def test_rows(spark):
    docs = spark.createDataFrame([*enumerate(texts()), (None, "a b"), (5, "again"), (5, "again")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("n", "form", "units", "parts", "output", "h1", "a")})
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in digests(infill(docs)).collect()), key=key)
    assert got == sorted([*(brute(i, t) for i, t in enumerate(texts())), brute(None, "a b"), brute(5, "again"), brute(5, "again")], key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert digests(infill(docs.limit(0))).count() == 0


@pytest.mark.parametrize(("grammar", "pattern"), [("words", r"[A-Za-z]+|[^A-Za-z]"), ("characters", r"[\s\S]"), ("words_and_numbers", r"[^\W\d_]+|\d+|\s+|[^\w\s]|_")])
def test_units_of_every_grammar(spark, grammar, pattern):
    rng = random.Random(3)
    some = ["".join(rng.choice("ab12 \n,._é中😀") for _ in range(rng.randint(0, 20))) for _ in range(100)] + [None]
    got = spark.createDataFrame([(t,) for t in some], "text string").select("text", units(F.col("text"), grammar).alias("u")).collect()
    for r in got:
        assert r.u == re.findall(pattern, r.text or ""), r.text


def test_a_boundary_is_neither_at_the_start_nor_at_the_end():
    for classes in ((), ("a-z",), ("a-z", "0-9")):
        assert [m.start() for m in re.finditer(boundary(classes), "é,")] == [1]

from __future__ import annotations

import random

import numpy as np

from millrace.llm.licenses import NOTICES, Index, banded, license_spans, winnow
from millrace.llm.wordhash import text_hashes


def test_winnowing_selects_the_rightmost_smallest_of_each_window():
    rng = random.Random(1)
    for _ in range(200):
        h = [rng.randint(0, 9) for _ in range(rng.randint(0, 20))]
        want = set()
        for i in range(max(0, len(h) - 2)) if len(h) > 3 else ([0] if h else []):
            window = h[i : i + 3] if len(h) > 3 else h
            want.add(i + max(k for k, x in enumerate(window) if x == min(window)))
        assert set(winnow(np.array(h, dtype=np.uint64), 3).tolist()) == want


def test_banded_alignment_within_a_full_band_is_the_textbooks():
    rng = random.Random(2)
    for _ in range(200):
        a = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 8))], dtype=np.uint64)
        b = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 14))], dtype=np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, matched, start, end = banded(a, b, -len(a), len(b))
        assert score == h.max() and matched * 2 >= score and 0 <= start <= end <= len(b)


def test_every_notice_is_found_whole_and_edited(docs, clash):
    rows, want = [], []
    for n, (name, text) in enumerate(sorted(NOTICES.items())):
        rows.append((n, f"Früher text 😀 before\n{text}\nand after"))
        want.append((n, name, len("Früher text 😀 before\n"), text))
    got = {r.doc_id: r for r in license_spans(clash(docs(rows))).collect()}
    for n, name, start, text in want:
        r = got[n]
        assert (r.license, r.coverage, r.start) == (name, 1.0, start) and r.end - start in (len(text), len(text.rstrip("./")))
    edit = NOTICES["Apache-2.0-header"].replace("you may not use", "you can never use").replace("obtain", "get")
    found = license_spans(docs([(1, f"x {edit} y")])).collect()
    assert [r.license for r in found] == ["Apache-2.0-header"] and 0.8 <= found[0].coverage < 1


def test_clean_odd_and_repeated_texts(docs):
    mit, gpl = NOTICES["MIT"], NOTICES["GPL-3.0"]
    rows = [(1, None), (2, ""), (3, "!!"), (4, "licensed under water"), (5, "the terms of the work"), (None, mit), (6, f"{mit} {gpl} {mit}"), (7, "filler words " * 50_000 + mit), (8, mit), (8, mit)]
    got = sorted((r.doc_id or 0, r.license) for r in license_spans(docs(rows)).collect())
    assert got == [(0, "MIT"), (6, "GPL-3.0"), (6, "MIT"), (6, "MIT"), (7, "MIT"), (8, "MIT"), (8, "MIT")]
    assert license_spans(docs([])).count() == 0
    assert license_spans(docs([(1, mit)]), {}).count() == 0
    assert Index({"x": ""}).scan("any text at all") == []


def whole(template, words):
    """Best local alignment by the textbook: score, and the most matched words of any that has it."""
    h = [[(0, 0)] * (len(words) + 1) for _ in range(len(template) + 1)]
    best = (0, 0)
    for i, x in enumerate(template):
        for j, y in enumerate(words):
            up, left, across = h[i][j + 1], h[i + 1][j], h[i][j]
            h[i + 1][j + 1] = max((0, 0), (across[0] + (2 if x == y else -1), across[1] + (x == y)), (up[0] - 1, up[1]), (left[0] - 1, left[1]))
            best = max(best, h[i + 1][j + 1])
    return best


def test_agrees_with_unbanded_alignment_of_all_templates():
    """Edited copies of all templates: those that the textbook covers by 0.8 are found."""
    rng = random.Random(4)
    index = Index(NOTICES)
    wrong = 0
    for name, text in NOTICES.items():
        own = text_hashes([text])[0].tolist()
        if len(own) > 60:
            continue
        for _ in range(12):
            copy = [w if rng.random() > 0.15 else rng.choice(["zz", ""]) for w in text.split()]
            words = text_hashes([" ".join(["before", *copy, "after"])])[0]
            score, matched = whole(own, words.tolist())
            got = {f[3] for f in index.finds(words)}
            if matched >= 0.8 * len(own):
                wrong += name not in got
    assert wrong == 0


def test_copies_that_follow_each_other_all_count(docs):
    mit = NOTICES["MIT"]
    got = license_spans(docs([(1, " ".join([mit] * 3)), (2, " ".join([mit] * 5000)), (3, " ".join([NOTICES["MIT-text"]] * 4))])).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.license))
    assert {i: len(s) for i, s in spans.items()} == {1: 3, 2: 5000, 3: 4}
    assert sorted(spans[1])[1][0] == len(mit) + 1


def test_words_put_in_and_words_left_out():
    index = Index(NOTICES)
    short = index.scan("Released under MIT License.")
    assert [(f[0], f[1]) for f in short] == [("MIT", 0.8)]
    words = NOTICES["GPL-3.0-header"].split()
    longer = index.scan(" ".join([*words[:20], *["put"] * 15, *words[20:]]))
    assert [f[0] for f in longer] == ["GPL-3.0-header"] and longer[0][1] == 1.0


def test_positions_are_those_of_the_text_itself(docs):
    text = "İİ İstanbul " + NOTICES["MIT"] + " İ"
    (r,) = license_spans(docs([(1, text)])).collect()
    assert text[r.start : r.end] == NOTICES["MIT"].rstrip(".")


def test_templates_in_parts_give_the_same(docs, clash):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["filler", *NOTICES.values()]) for _ in range(rng.randint(0, 4))) for _ in range(30)]
    rows = [*enumerate(texts), (3, texts[3]), (None, NOTICES["MIT"])]
    key = lambda df: sorted((str(r.doc_id), r.license, r.coverage, r.start, r.end) for r in df.collect())
    assert key(license_spans(clash(docs(rows)))) == key(license_spans(docs(rows), most_words=50))

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.decontamination import SPAN, contaminated
from millrace.llm.wordhash import aligned_spans, text_hashes, word_hashes, words_of


def slow_score(a, b, match=2, mismatch=-1, gap=-1):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (match if a[i] == b[j] else mismatch), h[i, j + 1] + gap, h[i + 1, j] + gap)
    return int(h.max())


def test_alignment_agrees_with_the_textbook():
    rng = random.Random(1)
    a = [np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 12))], dtype=np.uint64) for _ in range(300)]
    b = [np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 30))], dtype=np.uint64) for _ in range(300)]
    score, start, end = aligned_spans(a, b, cells=4000)
    for x, y, s, i, j in zip(a, b, score, start, end):
        assert s == slow_score(x, y)
        assert s == slow_score(x, y[i:j])  # the span alone gives as much


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    return [(i, " ".join(f"q{rng.randint(0, 4000)}" for _ in range(rng.randint(15, 40)))) for i in range(20)]


def fill(rng, n):
    return " ".join(rng.choice(["the", "of", "and", f"w{rng.randint(0, 500)}"]) for _ in range(n))


def edited(rng, text, share):
    words = text.split()
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = rng.choice(["", "zz", words[i] + " zz"])
    return " ".join(words)


def test_copies_edits_and_clean_texts(docs, clash, spark, items):
    rng = random.Random(2)
    rows, want = [], set()
    for n in range(120):
        text = fill(rng, rng.randint(20, 300))
        if n % 3 == 0:
            item = items[n % len(items)]
            copy = item[1] if n % 2 else edited(rng, item[1], 0.15)
            text = f"{text}\n{copy.upper() if n % 4 == 0 else copy} {fill(rng, 30)}"
            want.add((n, item[0]))
        rows.append((n, text))
    rows += [(500, None), (501, ""), (502, "!!"), (503, fill(rng, 40_000) + " " + items[4][1]), (None, items[5][1]), (504, items[6][1]), (504, items[6][1])]
    want |= {(503, 4), (None, 5), (504, 6)}
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, " .. ")], "item_id long, text string")
    got = contaminated(clash(docs(rows)), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    texts = dict(rows)
    for r in got:
        if r.score == 1.0:
            assert words_of(texts[r.doc_id])[r.start_word : r.end_word] == words_of(dict(items)[r.item_id])


def test_an_item_in_most_documents_is_still_found(docs, spark, items):
    rng = random.Random(3)
    rows = [(n, f"{fill(rng, 20)} {items[0][1]} {fill(rng, 20)}") for n in range(200)] + [(n, fill(rng, 50)) for n in range(200, 260)]
    got = contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(200))


def test_edited_and_partial_copies_in_most_documents_are_found(docs, spark, items):
    rng = random.Random(5)
    fifth = " ".join("zz" if i % 5 == 4 else w for i, w in enumerate(items[0][1].split()))
    words = items[1][1].split()
    part = " ".join(words[: len(words) * 6 // 10])
    rows = [(n, f"{fill(rng, 20)} {fifth if n % 2 else part} {fill(rng, 20)}") for n in range(200)] + [(n, fill(rng, 50)) for n in range(200, 230)]
    got = contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(n, 1 - n % 2) for n in range(200)]


def test_agrees_with_alignment_of_all_pairs(docs, spark):
    """Small alphabet, so that chance hits, ties and near misses abound; one long item among short ones."""
    rng = random.Random(8)
    letters = [f"q{i}" for i in range(14)]
    bench = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([4, 7, 12])))) for i in range(12)]
    bench += [(12, bench[3][1]), (3, bench[5][1]), (None, bench[6][1]), (13, " ".join(rng.choice(letters) for _ in range(150)))]
    rows = []
    for n in range(90):
        text = " ".join(rng.choice([*letters, "of", "the"]) for _ in range(rng.randint(0, 60)))
        if n % 2:
            text += " " + edited(rng, rng.choice(bench)[1], rng.choice([0, 0.2, 0.4]))
        rows.append((n, text))
    want = {}
    for d, text in rows:
        words = words_of(text)
        for i, item in bench:
            own = words_of(item)
            shared = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} & {tuple(own[k : k + 3]) for k in range(len(own) - 2)}
            score = slow_score(own, words) / (2 * len(own))
            if shared and score >= 0.5:
                want[d, i] = max(score, want.get((d, i), 0))
    got = contaminated(docs(rows), spark.createDataFrame(bench, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "reach", "gram", "window", "place")}))
    found = {(r.doc_id, r.item_id): r.score for r in got.collect()}
    assert found == pytest.approx(want) and len(want) > 40


def test_a_dump_of_many_items_in_one_document(docs, spark):
    """3,000 items in one text: hits are multiplied, its words are not."""
    rng = random.Random(11)
    bench = [(i, " ".join(f"q{rng.randint(0, 30_000)}" for _ in range(25))) for i in range(3000)]
    dump = " ".join(t for _, t in bench)
    got = contaminated(docs([(1, dump), (2, "clean text of no item")]), spark.createDataFrame([*bench, (9000, " ".join(f"z{i}" for i in range(4000)))], "item_id long, text string"))
    rows = got.collect()
    assert sorted(r.item_id for r in rows) == list(range(3000)) and all(r.doc_id == 1 and r.score == 1.0 for r in rows)


def test_insertions_beyond_the_items_length_stay_in_the_window(docs, spark):
    item = [f"q{i}" for i in range(40)]
    copy = [w for i, w in enumerate(item) for w in ([w] if i < 3 else ["zz", w])]
    got = contaminated(docs([(1, " ".join(["of"] * 9 + copy))]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.item_id, r.score, r.start_word, r.end_word) for r in got] == [(7, slow_score(item, copy) / 80, 9, 9 + len(copy))]


def test_short_items_and_empty_tables(docs, spark):
    bench = spark.createDataFrame([(1, "solo"), (2, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs([(1, "solo"), (2, "here two words are"), (3, "two words")]), bench).collect()}
    assert (1, 1) in got and (3, 2) in got  # a sequence shorter than a seed is a seed of its own
    assert contaminated(docs([]), bench).count() == 0
    assert contaminated(docs([(1, "solo")]), bench.limit(0)).count() == 0


def test_hashes_are_one_to_one_with_words():
    rng = random.Random(6)
    pool = ["a", "B", "ß", "é", "é", "_", "1", "²", " ", "\n", ".", "–", "中", "😀", "İ", "\x00", "ab" * 40]
    texts = [None, "", *("".join(rng.choice(pool) for _ in range(rng.randint(0, 20))) for _ in range(2000)), "word and " * 300_000, "x" * 1_200_000]
    got = text_hashes(texts)
    assert [len(h) for h in got] == [len(words_of(t)) for t in texts]
    pairs = {(w, int(h)) for t, hashes in zip(texts, got) for w, h in zip(words_of(t), hashes)}
    assert len({w for w, _ in pairs}) == len({h for _, h in pairs}) == len(pairs)
    assert text_hashes(["one"])[0].tolist() == text_hashes(["x", "two one"])[1][1:].tolist() == word_hashes(["one"]).tolist()


def stemmed(n, rng):
    """n items and n documents that share a phrase of eight words, and a document with a copy of every tenth item."""
    stem = "which of the following statements is most nearly"
    own = lambda k: " ".join(f"{k}{rng.randint(0, 10**6)}" for _ in range(14))
    bench = [(i, f"{stem} {own('q')}") for i in range(n)]
    rows = [(i, f"{own('d')} {stem} {own('d')}") for i in range(n)]
    return bench, rows + [(n + i, f"{own('d')} {edited(rng, bench[i][1], 0.1)} {own('d')}") for i in range(0, n, 10)]


def test_a_phrase_that_items_share_does_not_multiply_them_by_documents(docs, spark, monkeypatch):
    import millrace.llm.decontamination as module

    made = []
    real = module.seed_hits
    monkeypatch.setattr(module, "seed_hits", lambda *a: made.append(real(*a)) or made[-1])
    sizes = {}
    for n in (100, 400):
        bench, rows = stemmed(n, random.Random(n))
        got = contaminated(docs(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(n + i, i) for i in range(0, n, 10)}
        sizes[n] = made[-1].count()
    assert sizes[400] <= 5 * sizes[100] < 5 * 10 * 22  # places of the copies alone


def test_long_shared_stretches_still_open_pairs(docs, spark):
    """30 items that differ in three words of forty: their rarest shared n-grams open pairs, so copies of the shared part are found in all of them, as by alignment of all pairs, but for those without a run of SPAN n-grams."""
    rng = random.Random(14)
    words = [f"q{i}" for i in range(40)]
    bench = []
    for i in range(30):
        own = list(words)
        for k in rng.sample(range(40), 3):
            own[k] = f"own{i}x{k}"
        bench.append((i, " ".join(own)))
    rows = [(0, " ".join(words)), (1, f"{fill(rng, 20)} {' '.join(words[5:37])} {fill(rng, 9)}"), (2, bench[3][1]), (3, " ".join(words[:9])), (4, fill(rng, 50))]
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(docs(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {}
    for d, text in rows:
        for i, item in bench:
            score = slow_score(words_of(item), words_of(text)) / 80
            if score >= 0.5:
                want[d, i] = score
    run = SPAN + 2
    runs = lambda t: {" ".join(words_of(t)[k : k + run]) for k in range(len(words_of(t)) - run + 1)}
    lost = {(d, i) for d, i in want if not runs(rows[d][1]) & runs(bench[i][1])}
    assert set(want) - lost <= set(got) <= set(want) and len(want) - len(lost) > 80 and len(set(want) - set(got)) <= 1
    assert got == pytest.approx({k: want[k] for k in got})


def test_seeds_that_open_pairs(spark):
    """Rare ones do; of a run without any, those that fewest items hold."""
    from millrace.llm.decontamination import seeds_of

    own = spark.createDataFrame([(i, 5, [1, 2, 3, 100 + i, 4]) for i in range(4)] + [(9, 5, [1, 2, 3, 4, 5]), (10, 5, [2])], "item_no long, reach long, grams array<long>")
    got = {(r.item_no, r.gram): (r.common, r.opens) for r in seeds_of(own, rare=1, span=3).collect()}
    assert all(got[i, 100 + i] == (False, True) for i in range(4)) and got[9, 5] == (False, True)
    assert got[0, 1] == (True, True) and got[0, 2] == (True, False)  # 1 and 3 are held by five items, 2 by six
    assert got[9, 1][1] and got[10, 2] == (True, True)  # an item of common ones only is opened by these

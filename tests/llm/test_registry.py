"""The registered queries over small tables, whole, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import __spark_entry__
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_alignment import Slow
from test_decontamination import slow_score
from test_infill import brute as filled
from test_langid import slow_bundle
from test_licenses import whole
from test_pii import base, shown
from test_simhash import brute as near_groups
from test_simhash import fingerprint
from test_urlrules import brute as judged
from test_vectors import brute as near_vectors
from tokenizers import Tokenizer

from millrace.llm import registry
from millrace.llm.licenses import NOTICES
from millrace.llm.mixing import mixture_sql
from millrace.llm.wordhash import text_hashes, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TYPES = {
    "op1_decontamination": "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint, seeds bigint",
    "op2_toxicity": "doc_id bigint, p_low_quality double, p_toxic double, low_quality boolean, toxic boolean",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint, kept boolean",
    "op4_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_licenses": "doc_id bigint, license string, coverage double, start bigint, end bigint",
    "op6_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_tokenfiles": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_secret bigint, n_removed bigint, n_generalised bigint, sanitised_sha256 string",
    "op10_tokencounts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op11_urlrules": "page_id bigint, host string, path string, rule string, verdict string",
    "op12_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_infill": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
}
PAGES = [None, "http://a.net", "http://a.net/", "https://b.example.net/en/1?x", "https://b.example.com/de/", "http://org/fr/", "http://shop.casino-x.com/", "http://x.com/a?utm_medium=spam", "none"]


def make():
    """documents, benchmark, labels, embeddings as lists of rows."""
    rng = random.Random(21)
    syllables = {"en": ["the", "and", "ing", "wh", "er"], "de": ["sch", "ein", "ung", "lich", "ö"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))
    bench = [(i, " ".join(f"q{rng.randint(0, 900)}" for _ in range(18))) for i in range(5)]
    docs = []
    for i in range(70):
        lang = rng.choice(["en", "de"])
        words = [word(lang) for _ in range(rng.randint(40, 160))]
        if i % 9 == 1:
            words[20:20] = bench[i % 5][1].split()
        if i % 7 == 2:
            words += ["vile"] * 2
        if i % 8 == 3:
            words += [f"u{i}@mail.example", "10.0.0.7", "+49 30 1234567"]
        if i % 10 == 4:
            words += NOTICES["MIT"].split()
        docs.append((i, " ".join(words), lang, rng.choice(["a", "b", "c", None]), 1))
    docs += [(100, docs[3][1], "en", "a", 1), (101, docs[3][1], "de", "b", 1), (102, docs[5][1] + " end", "en", "a", 1)]
    docs += [(200, None, "en", "a", 0), (201, "", "en", None, 0), (202, "12 34 !!", "de", "c", 1), (203, "да нет " * 40, None, "a", 1)]
    labels = [(i, int(i % 11 != 0), int("vile" in (t or ""))) for i, t, *_ in docs[:60]]
    gen = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in np.float32(gen.normal(size=16))], 0) for i in range(40)]
    vectors += [(50 + i, [float(np.float32(x + 0.02)) for x in vectors[i][1]], 1) for i in range(8)] + [(90, None, 0), (91, [0.0] * 16, 0)]
    return docs, bench, labels, vectors


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    docs, bench, labels, vectors = make()
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(i, u, "<p>x") for i, u in enumerate(PAGES)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def results(spark, data):
    found = {}
    for name, query in registry.queries().items():
        df = query(spark, data)
        assert ", ".join(" ".join(t) for t in df.dtypes) == TYPES[name], name
        found[name] = [tuple(r) for r in df.collect()]
    return found


def leaks(docs, bench):
    out = {}
    for d, text, *_ in docs:
        words = words_of(text)
        for i, item in bench:
            own = words_of(item)
            shared = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} & {tuple(own[k : k + 3]) for k in range(len(own) - 2)}
            score = slow_score(own, words) / (2 * len(own)) if shared else 0
            if score >= 0.5:
                out[d, i] = score
    return out


def told(docs, learned, dim):
    """By document: language and cosine, letter by letter."""
    langs = sorted({x[2] for x in learned if x[2] is not None and x[1] is not None})
    prototypes = {k: sum(slow_bundle(x[1], dim) for x in learned if x[2] == k and x[1] is not None) for k in langs}
    out = {}
    for d, text, *_ in docs:
        v = slow_bundle(text or "", dim)
        cos = [float(v @ prototypes[k] / max(np.linalg.norm(v) * np.linalg.norm(prototypes[k]), 1e-300)) for k in langs]
        out[d] = (langs[int(np.argmax(cos))], max(0.0, max(cos))) if v.any() else ("und", 0.0)
    return out


def learned_from(docs):
    return [x for x in docs if zlib.crc32(str(x[0]).encode()) % 3 != 1]


def mixed(docs, favour_long=False):
    """doc_id -> taken, size by the SQL."""
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(x) for x in docs])
    return {r[0]: (r[4], r[1]) for r in duck.sql(mixture_sql(favour_long)).fetchall()}


def files(docs):
    library, at, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d, text, *_ in sorted(docs, key=lambda x: x[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_decontamination(results):
    docs, bench, _, _ = make()
    want = leaks(docs, bench)
    assert {(r[0], r[1]): r[2] for r in results["op1_decontamination"]} == pytest.approx(want) and len(want) >= 8


def test_toxicity(results):
    docs = make()[0]
    assert len(results["op2_toxicity"]) == len(docs)
    right = [r[4] == ("vile" in (dict((d, t) for d, t, *_ in docs)[r[0]] or "")) for r in results["op2_toxicity"]]
    assert np.mean(right) >= 0.95


def test_near_copies(results):
    rows = [(d, t) for d, t, *_ in make()[0]]
    want = near_groups(rows)
    assert {r[0]: r[1:] for r in results["op3_simhash"]} == {d: (f"{fingerprint(t):016x}", want[d], want[d] == d) for d, t in rows}


def test_languages(results):
    docs = make()[0]
    want = told(docs, learned_from(docs), 512)
    got = {r[0]: r for r in results["op4_langid"]}
    assert len(got) == len(results["op4_langid"]) == len(docs)
    for d, (lang, score) in want.items():
        assert got[d][1] == (zlib.crc32(str(d).encode()) % 3 == 1) and got[d][2] == lang and got[d][3] == pytest.approx(score, abs=1e-5)


def test_licenses(results):
    docs = make()[0]
    own = {n: text_hashes([t])[0].tolist() for n, t in NOTICES.items()}
    got = {}
    for r in results["op5_licenses"]:
        got.setdefault(r[0], set()).add(r[1])
    for d, text, *_ in docs:
        words = text_hashes([text])[0].tolist()
        covered = {n for n, t in own.items() if len(t) <= 20 and whole(t, words)[1] >= 0.8 * len(t)}
        assert got.get(d, set()) <= covered and bool(covered) == (d in got)


def test_vectors(results):
    want = near_vectors([(i, v) for i, v, _ in make()[3]])
    got = sorted(r[:3] for r in results["op6_vectors"])
    assert got == sorted(want) and all(r[3] == (r[0] == r[2]) for r in results["op6_vectors"])


def test_mixture(results):
    want = mixed(make()[0], favour_long=True)
    assert {r[0]: (r[4], r[1]) for r in results["op7_mixing"]} == want


def test_token_files(results):
    assert sorted(results["op8_tokenfiles"]) == files(make()[0])


def test_personal_data(results):
    docs = {d: t for d, t, *_ in make()[0]}
    assert sorted(r[0] for r in results["op9_pii"]) == sorted(docs)
    for r in results["op9_pii"]:
        want = base(docs[r[0]])
        assert r[1:5] == tuple(sum(k == x for x, _, _ in want) for k in ("email", "ip", "card", "phone"))
        assert r[5] == hashlib.sha256(shown(want).encode()).hexdigest() and r[6].startswith(shown(want))


def test_token_counts(results):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in make()[0]]
    assert sorted(r[:3] for r in results["op10_tokencounts"]) == sorted(want) and all(r[3] == (r[2] > 512) for r in results["op10_tokencounts"])


def test_url_rules(results):
    rules = [(p, v, 0) for p, v in registry.URL_LIST] + [(p, "block", 1) for p in registry.URL_PATTERNS]
    want = judged(list(enumerate(PAGES)), rules)
    listed = {p for p, _ in registry.URL_LIST}
    assert sorted(results["op11_urlrules"]) == sorted((i, h, p, r[2:] if r in listed else None, v) for i, (h, p, r, v) in want.items())


def test_alignment(results):
    assert sorted(results["op12_alignment"]) == sorted(Slow().rows([(d, t) for d, t, *_ in make()[0]]))


def test_infill(results):
    assert sorted(results["op13_infill"]) == sorted(filled(d, t) for d, t, *_ in make()[0])


def test_the_pipeline_agrees_with_brute_force(spark, data):
    docs, bench, _, _ = make()
    scores = told(docs, learned_from(docs), corpus_pipeline.LANGUAGE_DIM)
    left = [x for x in docs if scores[x[0]][0] != "und" and scores[x[0]][1] >= corpus_pipeline.LEAST_SCORE]
    heads = near_groups([(x[0], x[1]) for x in left])
    left = [x for x in left if heads[x[0]] == x[0]]
    bad = {d for d, _ in leaks(left, bench)}
    left = [x for x in left if x[0] not in bad]
    taken = mixed(left)
    left = [x for x in left for _ in range(taken[x[0]][0] // max(1, taken[x[0]][1]))]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, data).collect())
    want = files(left)
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want] and sorted(r[1] for r in got) == [r[1] for r in want]
    assert len(docs) > len(want) > 20 and 203 not in {r[0] for r in got}


def test_stages_take_clashing_columns(spark, data):
    from pyspark.sql import functions as F

    names = ("score", "lang_pred", "copies_", "rows_", "bad", "bad_", "id_", "hash_", "row_", "doc_", "text_hash_", "fp", "size", "col", "a`b.c")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    clashing = docs.withColumns({n: F.lit("x") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, clashing, data), stage(spark, docs, data)
        assert got.columns == clashing.columns, name
        assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in plain.collect()), name
    assert corpus_pipeline.token_files(spark, clashing, data).count() == docs.count()


def test_an_error_inside_an_operator_is_not_swallowed(monkeypatch):
    real = __spark_entry__.importlib.import_module

    def broken(name):
        if name == "millrace.llm.registry":
            raise ModuleNotFoundError("no such library", name="some_library")
        return real(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()

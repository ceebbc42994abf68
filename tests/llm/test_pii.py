from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm.pii import KINDS, base_spans, counted_mentions, disclosing_terms, find_spans, sanitised, span_digests

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


NAMES = r"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9_/+-]{8,})"


def secrets(text):
    return [("secret", m.start(1), m.end(1)) for m in re.finditer(NAMES, text or "")]


def shown(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


TEXTS = [
    None, "", "nothing here", "a@b.c and x.y+z%q-_@h-1.example.org.", "a@b.c_d@e.f", "a@b.c.d@e.f.g", "@a.b c@d e@.f", "é@a.b ü a@b.é.c",
    "1.2.3.4 1.2.3.4.5 256.1.1.1 0255.001.0.00000 1.2.3 999.1.2.3.4", "4371549438645904 4371 5494 3864 5904 4371-5494-3864-5904x 4371549438645905", "1234567890123456789012 4371549438645904 1",
    "+1 (234) 567-8901 +12 3 +49.30.123456789 +1234567 +12345678901234567890 ++12345678) +1 ()", "😀 a@b.c é 10.0.0.1", "mail\na@b.cc\t+1 234 567 89\n", "a" * 3000 + "@", "1." * 3000, "1 " * 3000, "x@a" + ".b" * 9000, " ".join(f"u{i}@m{i}.org" for i in range(700)),
]


def test_base_spans_agree_with_python(docs, clash, spark):
    rng = random.Random(8)
    pool = ["a", "é", "@", ".", "b-1", "+", "1", "23", "456", "255", "4371549438645904", " ", "-", "(", ")", "%", "\n", "_", "x@y.z", "10.0.0.1", "+4912345678", "😀"]
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    found = span_digests(find_spans(clash(docs(list(enumerate(texts)))))).collect()
    assert len(found) == len(texts)
    for r in found:
        want = base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in KINDS[:4]), texts[r.doc_id][:80]
        assert r.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest(), texts[r.doc_id][:80]
        assert r.spans.startswith(shown(want + secrets(texts[r.doc_id]))) and r.n_secret == len(secrets(texts[r.doc_id]))


def corpus():
    """An address that one rare name always goes with, among common words."""
    rng = random.Random(3)
    common = ["alpha", "beta", "gamma", "delta", "epsilon"]
    fill = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [f"{fill(5)} Zorbax {fill(2)} write to boss@corp.example now {fill(6)}" for _ in range(6)]
    rows += [f"{fill(4)} {fill(i % 7)} {fill(5)} number {i}" for i in range(60)]
    rows += ["zorbax is met here without any address"]
    rows += ["quux one@time.example once only"]
    rows += [f'{fill(7)} vault token = "{hashlib.sha1(str(i).encode()).hexdigest()}" {fill(3)} room {4711} b{i % 2}x {fill(6)}' for i in range(5)] + ["room 4711 is empty", "a token of thanks"]
    return rows


def group_of(name):
    kind, value = name.split(":", 1)
    return {"email": lambda: f"email:@{value.split('@')[1]}", "ip": lambda: f"ip:{value.rsplit('.', 1)[0]}.*", "card": lambda: f"card:{value[:6]}*", "phone": lambda: f"phone:{value[:4]}*", "secret": lambda: "secret:*"}[kind]()


def slow_terms(texts):
    """Distinct texts: mentions (entity, term) and their texts; disclosing pairs, with rare entities by their class, and rare classes by their kind."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    alone, near = {}, {}
    for t in texts:
        for kind, s, e in base(t) + secrets(t):
            name = f"{kind}:{t[s:e] if kind == 'secret' else t[s:e].lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', t[s:e])}"
            alone.setdefault(name, set()).add(t)
            for w in words(t[:s])[-10:] + words(t[e:])[:10]:
                if len(w) >= 3:
                    near.setdefault((name, w), set()).add(t)
    grouped = {}
    for n, held in alone.items():
        if len(held) < 3:
            grouped.setdefault(group_of(n), set()).update(held)
    key = {n: n if len(held) >= 3 else group_of(n) if len(grouped[group_of(n)]) >= 3 else f"{n.split(':')[0]}:*" for n, held in alone.items()}
    held, pairs, want = {}, {}, set()
    for n, some in alone.items():
        held.setdefault(key[n], set()).update(some)
    for (n, w), some in near.items():
        pairs.setdefault((key[n], w), set()).update(some)
    for (n, w), some in pairs.items():
        ic, n_t = -math.log2(len(held[n]) / len(texts)), sum(w in words(t) for t in texts)
        # a word cut by an entity may be none of the text's
        if len(held[n]) >= 3 and len(some) >= 3 and n_t and ic > 0 and math.log2(len(some) / n_t) >= -0.1 * ic:
            want.add((n, w))
    return near, want


def own_terms(df):
    found = base_spans(df)
    return {(r.entity, r.term) for r in disclosing_terms(counted_mentions(found), found.agg(F.count_distinct("digest").alias("total")), df).collect()}


def test_terms_agree_with_the_formula(docs):
    """Brute force over windows of ten words and distinct texts."""
    rows = corpus()
    _, want = slow_terms(sorted(set(rows)))
    got = own_terms(docs(list(enumerate(rows + rows[:3]))))
    assert got == want and {("email:boss@corp.example", "zorbax"), ("secret:*", "vault")} <= got


def test_rare_entities_are_counted_by_class(docs):
    rng = random.Random(12)
    fill = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    texts = [f"{fill(6)} Clinic Weiss asks user{i}@weiss.example to call +4930{i}11223 {fill(4)}" for i in range(5)]
    texts += [f"{fill(5)} server 10.1.2.{i} Kronos {fill(3)} card 437154943864590{i} {fill(2)}" for i in range(9)] + [f"{fill(12)} {i}" for i in range(60)]
    df = docs([*enumerate(texts), (900, texts[0])])
    got = own_terms(df)
    assert got == slow_terms(sorted(set(texts)))[1]
    assert {("email:@weiss.example", "weiss"), ("ip:10.1.2.*", "kronos"), ("phone:4930*", "clinic")} <= got
    shown_ = {r.doc_id: r.spans for r in span_digests(find_spans(df)).collect()}
    at = texts[2].index("Weiss")
    assert f"term:{at}:{at + 5}" in shown_[2]


def test_generalised_terms_name_their_class_and_overlaps_go_once(docs, spark):
    text = "Anna and bob met a@b.example"
    df = docs([(1, text)])
    span = "array<struct<kind:string,start:long,end:long,action:string>>"
    rows = [("email", 17, 28, "mask"), ("term", 0, 4, "generalise"), ("term", 9, 12, "generalise"), ("term", 9, 10, "remove"), ("term", 13, 16, "remove"), ("term", 19, 20, "generalise")]
    spans = spark.createDataFrame([(1, rows)], f"doc_id long, spans {span}").crossJoin(df.select(F.md5("text").alias("digest")))
    assert sanitised(df, spans).first().text == "[NAME] and [WORD]  [EMAIL]"


def test_numbers_and_mixed_tokens_have_classes_of_their_own(spark):
    from millrace.llm.pii import _general

    rows = spark.createDataFrame([("4711", "[1000-9999]"), ("555", "[100-999]"), ("b2x", "[CODE]"), ("Éva", "[NAME]"), ("eva", "[WORD]")], "term string, want string")
    assert all(r.got == r.want for r in rows.select("want", _general(F.col("term")).alias("got")).collect())


def test_secrets_and_the_words_that_announce_them(docs):
    rows = corpus()
    df = docs(list(enumerate(rows)))
    found = {r.doc_id: r for r in span_digests(find_spans(df)).collect()}
    clean = {r.doc_id: r.text for r in sanitised(df, find_spans(df)).collect()}
    i = next(k for k, t in enumerate(rows) if "vault" in t)
    value = re.search('"(.*?)"', rows[i])[1]
    assert found[i].n_secret == 1 and f"secret:{rows[i].index(value)}:{rows[i].index(value) + 40}" in found[i].spans and found[i].n_removed >= 1
    assert value not in clean[i] and "vault" not in clean[i] and '= "[SECRET]"' in clean[i]
    assert all(r.sanitised_sha256 == hashlib.sha256(clean[d].encode()).hexdigest() for d, r in found.items())


def test_long_texts_with_names_of_secrets_are_read_in_reasonable_time(docs):
    texts = ["token = " * 20_000, "token=" + "a" * 100_000, "x" * 200_000 + " password: hunter2hunter2", 'api_key = "abcdefgh"' * 3000]
    got = {r.doc_id: r.n_secret for r in span_digests(find_spans(docs(list(enumerate(texts))))).collect()}
    assert got == {i: len(secrets(t)) for i, t in enumerate(texts)}


def test_windows_go_past_numbers_entities_and_gaps(docs):
    """Brute force as above, over texts with numbers, lists of entities and words far apart."""
    rng = random.Random(7)
    fill = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "12", "2024", "10.5", "x"]) for _ in range(n))
    texts = [f"{fill(4)} Zorbax paid 17 on 2024 in {i} parts 4371549438645904 then 55 and 77 by Quixote {fill(5)}" for i in range(10, 16)]
    texts += [f"{fill(i)} Farlow {'. ' * 150} far@off.example {'- ' * 150} Yonder {fill(3)}" for i in range(2, 6)]
    texts += [f"{fill(i)} Mira +4912345671, Nora +4912345672, one@list.example two@list.example, Olga 10.1.2.3 Petra 999.1.1.1 {fill(i)}" for i in range(3, 8)]
    texts += [f"{fill(i)} \u00e9Ugo@cut.example\u00fcbrig 10.9.8.7 {'1 ' * 300}" for i in range(4)] + ["+4912345679", "10.0.0.1 " * 400] + [fill(30) for _ in range(60)]
    texts += [" ".join(rng.choice(["Vera", "a@b.example", "10.0.0.1", "+4912345678", "4371549438645904", "99", "ab", "Walt", "(", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts = sorted(set(texts))
    near, want = slow_terms(texts)
    df = docs(list(enumerate(texts)))
    rows = base_spans(df).collect()
    assert {(m.entity, w, texts[r.doc_id]) for r in rows for m in r.mentions for w in m.terms} == {(*k, t) for k, found in near.items() for t in found}
    assert own_terms(df) == want
    assert {("card:4371549438645904", "zorbax"), ("email:far@off.example", "farlow"), ("email:far@off.example", "yonder"), ("phone:4912345671", "olga"), ("email:ugo@cut.example", "\u00fcbrig")} <= set(near)
    assert {("email:far@off.example", "farlow"), ("phone:4912345671", "olga")} <= want


def test_terms_are_spans_where_the_entity_is_and_base_spans_stay(docs):
    rows = corpus()
    df = docs([*enumerate(rows), (500, rows[0]), (None, rows[1])])
    spans = find_spans(df)
    found = {r.doc_id: r.spans for r in span_digests(spans).collect()}
    at = rows[0].index("Zorbax")
    assert f"term:{at}:{at + 6}" in found[0] and found[500] == found[0] and found[None] == found[1]
    assert all("term" not in (found[i] or "") for i in range(6, len(rows)) if "vault" not in rows[i])
    clean = {r.doc_id: r.text for r in sanitised(df, spans).collect()}
    assert "boss@corp" not in clean[0] and "Zorbax" not in clean[0] and "[EMAIL]" in clean[0]
    assert clean[20] == rows[20]


def test_empty_table(docs):
    assert span_digests(find_spans(docs([]))).count() == 0

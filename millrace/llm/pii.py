"""Personal data: base spans by pattern, and information-theoretic sanitisation. DataFrame functions only.

Base spans are e-mail and IP addresses, card and phone numbers. Secrets (what
is given to a name like ``token`` or ``password``) are spans of the method.
All their values are the protected entities. A term (a word, number or mixed
token of three signs or more) next to an entity may give it away even when the
entity itself is taken out. How strongly it does is estimated over the whole
corpus, counted in distinct texts:

    IC(e) = -log2(n(e) / N),   PMI(e; t) = log2(N n(e, t) / (n(e) n(t)))

where n(e, t) counts the texts in which t stands within WINDOW words of e, be
they far off or parts of other entities (words are runs of letters and
digits). If PMI reaches RISK times IC, t discloses e, and t is a span wherever
it occurs in a text that holds e. It is removed if it discloses e fully
(PMI = IC), else generalised: a number to the range of its magnitude, a mixed
token to [CODE], a capitalised word to [NAME], any other to [WORD].

Nothing can be estimated from fewer than SUPPORT texts. An entity that fewer
hold is counted with those that are rare like it and of its class: an e-mail
address by its domain, an IP address by its first three parts, a card by its
first six digits, a phone number by its first four. Classes that fewer hold are
counted by their kind, as all secrets are that fewer hold: then a term
discloses that an entity of the kind stands there. So every entity is
protected, unless its kind itself is in fewer than SUPPORT texts; pairs of
fewer texts are left alone.

Pairs are only counted within windows, so a text with many entities gives rows
in proportion to its length. The patterns cannot backtrack over long runs:
a run that fails is not tried again from its middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored

KINDS = ("email", "ip", "card", "phone", "secret", "term")
_LOCAL = "A-Za-z0-9._%+-"
# Anchored to the start of a run, or to the end of the match before; quantifiers are possessive where that changes nothing.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a secret is given to; the texts that may hold one are told by the first pattern, then the value by what stands before it.
_NAMES = r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)"
_GIVEN = _NAMES + r"[\"']?[ \t]{0,3}[:=]"
SECRET = rf"(?<={_NAMES}[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?)(?-i:[A-Za-z0-9_/+-]{{8,}}+)"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_WORDS = r"[\p{L}\p{N}]++"
WINDOW, SUPPORT, RISK = 10, 3, 0.9
#: Elements of a block of the two-level running sum.
_BLOCK = 64


def _let(value: Column, use) -> Column:
    """``use(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str) -> Column:
    """Array of (value, start, end): matches and their code points."""

    def sums(matches: Column) -> Column:
        n = F.size(matches)

        def with_pieces(pieces: Column) -> Column:
            steps = F.zip_with(F.slice(pieces, 1, n), matches, lambda p, m: F.struct(F.length(p).cast("long").alias("p"), F.length(m).cast("long").alias("m")))

            def with_steps(steps: Column) -> Column:
                add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["p"] + x["m"])
                blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: add(F.slice(steps, b * _BLOCK + 1, _BLOCK)))

                def with_blocks(blocks: Column) -> Column:
                    upto = F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, 1, b), F.lit(0).cast("long"), lambda a, x: a + x))

                    def rows(upto: Column) -> Column:
                        def one(step: Column, i: Column) -> Column:
                            base = F.get(upto, F.floor(i / _BLOCK).cast("int"))
                            start = base + add(F.slice(steps, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)) + step["p"]
                            return _let(start, lambda s: F.struct(F.get(matches, i).alias("value"), s.alias("start"), (s + step["m"]).alias("end")))

                        return F.transform(steps, one)

                    return _let(upto, rows)

                return _let(blocks, with_blocks)

            return _let(steps, with_steps)

        # no empty match is possible, so the pieces number one more than the matches
        return F.when(n > 0, _let(F.split(text, pattern, -1), with_pieces))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), sums)


def _first(words: Column, test) -> Column:
    """Index of the first element for which ``test`` holds, and then for all after it; the size if there is none. By halving."""
    n = F.size(words)

    def step(state: Column, _: Column) -> Column:
        mid = F.shiftright(state["lo"] + state["hi"], 1)
        ahead = F.when(test(F.get(words, mid)), F.struct(state["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), state["hi"].alias("hi")))
        return F.when(state["lo"] < state["hi"], ahead).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int")), F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda state: state["lo"])


def _window_terms(words: Column, start: Column, end: Column) -> Column:
    """Lower-cased words of three signs or more among the WINDOW words before ``start`` and those after ``end``; a word that the entity runs into ends there."""
    before = _let(_first(words, lambda w: w["start"] >= start), lambda k: F.slice(words, F.greatest(k - WINDOW, F.lit(0)) + 1, F.least(k, F.lit(WINDOW))))
    after = _let(_first(words, lambda w: w["end"] > end), lambda k: F.slice(words, k + 1, WINDOW))
    left = F.transform(before, lambda w: F.when(w["end"] > start, F.left(w["value"], (start - w["start"]).cast("int"))).otherwise(w["value"]))
    right = F.transform(after, lambda w: F.when(w["start"] < end, F.right(w["value"], (w["end"] - end).cast("int"))).otherwise(w["value"]))
    return F.array_distinct(F.filter(F.transform(F.concat(left, right), F.lower), lambda w: F.length(w) >= 3))


def _entity(kind: str, value: Column) -> Column:
    plain = {"email": F.lower(value), "ip": value}.get(kind, _digits(value))
    return F.concat(F.lit(f"{kind}:"), plain)


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


_SPAN = "array<struct<kind:string,start:long,end:long,action:string>>"


_MENTION = "array<struct<entity:string,terms:array<string>>>"


def _valid(found: Column, kind: str) -> Column:
    return F.filter(found, lambda m: _holds(kind, m["value"]))


def _spans_of(kind: str) -> Column:
    spans = F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit("mask").alias("action")))
    return F.coalesce(spans.cast(_SPAN), F.array().cast(_SPAN))


def _mentions_of(kind: str, words: Column) -> Column:
    found = F.transform(kind, lambda m: F.struct(_entity(kind, m["value"]).alias("entity"), F.coalesce(_window_terms(words, m["start"], m["end"]), F.array().cast("array<string>")).alias("terms")))
    return F.coalesce(found.cast(_MENTION), F.array().cast(_MENTION))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text), sha256 (of the text), base (spans by kind, then start), secrets (likewise), mentions (entity and the terms around it), text (null without mentions)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hint = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.contains("text", F.lit("."))}
    for kind, pattern in PATTERNS.items():
        found = _placed(F.col("text"), pattern)
        if kind in hint:
            found = F.when(hint[kind], found)
        rows = rows.withColumn(kind, _valid(found, kind))
    given = (F.contains("text", F.lit("=")) | F.contains("text", F.lit(":"))) & F.rlike("text", F.lit(_GIVEN))
    rows = rows.withColumn("secret", F.when(given, _placed(F.col("text"), SECRET)))
    kinds = [*PATTERNS, "secret"]
    some = F.greatest(*[F.coalesce(F.size(kind), F.lit(0)) for kind in kinds]) > 0
    spans = [_spans_of(k) for k in PATTERNS]
    mentions = F.when(some, _let(_placed(F.col("text"), _WORDS), lambda words: F.concat(*[_mentions_of(k, words) for k in kinds]))).otherwise(F.array().cast(_MENTION))
    return rows.select("doc_id", F.md5("text").alias("digest"), F.sha2("text", 256).alias("sha256"), F.concat(*spans).alias("base"), _spans_of("secret").alias("secrets"), mentions.alias("mentions"), F.when(some, F.col("text")).alias("text"))


def _class(entity: Column) -> Column:
    """What an entity is counted with if it is too rare by itself. No entity has such a name."""
    return (
        F.when(F.startswith(entity, F.lit("email:")), F.concat(F.lit("email:@"), F.substring_index(entity, "@", -1)))
        .when(F.startswith(entity, F.lit("ip:")), F.regexp_replace(entity, r"[0-9]+$", "*"))
        .when(F.startswith(entity, F.lit("card:")), F.concat(F.substring(entity, 1, len("card:") + 6), F.lit("*")))
        .when(F.startswith(entity, F.lit("phone:")), F.concat(F.substring(entity, 1, len("phone:") + 4), F.lit("*")))
        .otherwise(_kind(entity))
    )


def _kind(entity: Column) -> Column:
    return F.concat(F.substring_index(entity, ":", 1), F.lit(":*"))


def counted_mentions(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(digest, entity, terms) of all mentions; rare entities by their class, and those of rare classes by their kind."""
    mentioned = found.where(F.size("mentions") > 0).select("digest", F.explode("mentions").alias("m")).select("digest", "m.entity", "m.terms")
    held = mentioned.select("entity", "digest").distinct()
    texts = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    # only rare ones are joined, so that an entity of many texts is no hot group of an aggregate
    rare = stored(texts.where(F.col("n_e") < support).select("entity", _class(F.col("entity")).alias("class")), "pii-rare")
    classes = held.join(rare, "entity").select("class", "digest").distinct().groupBy("class").agg(F.count("*").alias("n_c")).where(F.col("n_c") < support)
    rare = stored(rare.join(classes, "class", "left").select("entity", F.when(F.col("n_c").isNull(), F.col("class")).otherwise(_kind(F.col("class"))).alias("class")), "pii-classes")
    return mentioned.join(rare, "entity", "left").select("digest", F.coalesce("class", "entity").alias("entity"), "terms")


def disclosing_terms(mentioned: DataFrame, total: DataFrame, docs: DataFrame, text_col: str = "text", support: int = SUPPORT, risk: float = RISK) -> DataFrame:
    """(entity, term, action) of all pairs whose PMI reaches ``risk`` times the entity's information content.

    ``mentioned``: see ``counted_mentions``; ``total``: one row, the number of distinct texts.
    """
    # a text counts once however often it is copied
    entities = mentioned.select("entity", "digest").distinct().groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    entities = entities.crossJoin(F.broadcast(total)).withColumn("ic", F.log2("total") - F.log2("n_e")).where("ic > 0")  # one row
    entities = stored(entities, "pii-entities")  # no sum stands between the shuffle and the join, so a hot entity can be split
    near = mentioned.select("entity", "digest", F.explode("terms").alias("term"))
    # an entity that half the texts hold is one more key of sums that are made map-side
    pairs = near.join(entities, "entity").select("entity", "ic", "digest", "term").distinct().groupBy("entity", "ic", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    # PMI - IC = log2(n(e, t) / n(t)), and t is in at least the texts in which it stands near any entity:
    # what fails with these can't pass with all, so words that stand near everything are never looked up in the texts
    floor = F.col("ic") * (risk - 1)
    around = near.select("term", "digest").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    share = lambda n: F.log2("n_et") - F.log2(n)
    pairs = stored(pairs.join(around, "term").where(share("n_near") >= floor).select("entity", "ic", "term", "n_et"), "pii-pairs")
    words = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]{3,}+"), F.lit(0)))).alias("term"))
    spread = words.join(pairs.select("term").distinct(), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    return pairs.join(spread, "term").where(share("n_t") >= floor).select("entity", "term", F.when(F.col("n_et") >= F.col("n_t"), "remove").otherwise("generalise").alias("action"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, risk: float = RISK) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, base, spans, text, sha256; base and spans are arrays of (kind, start, end, action), text is null where nothing was found, sha256 that of the whole text.

    Positions are code points, ends exclusive; spans are base spans by kind in
    the order of KINDS, then start, then secrets, and the terms last. Null
    texts are empty; null ids and repeated rows keep their rows, and copies of
    a text count once; texts of any length are read whole. A PMI that equals
    the bound counts. Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    found = stored(base_spans(docs, id_col, text_col), "pii-base")
    mentioned = stored(counted_mentions(found, support), "pii-mentions")
    total = found.agg(F.count_distinct("digest").alias("total"))
    terms = stored(disclosing_terms(mentioned, total, docs, text_col, support, risk), "pii-terms")
    held = mentioned.select("digest", "entity").distinct()
    # the strongest action that any entity of the text asks for
    marked = held.join(terms, "entity").groupBy("digest", "term").agg(F.max(F.col("action") == "remove").alias("gone")).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "gone"))).alias("terms"))
    marked = stored(marked, "pii-marked")  # so that its size is known before texts would be shuffled to it
    hit = found.where("text IS NOT NULL").select("digest", "text").join(marked, "digest").groupBy("digest").agg(F.first("text").alias("text"), F.first("terms").alias("terms"))
    own = F.filter(_placed(F.col("text"), _WORDS), lambda m: F.map_contains_key(F.col("terms"), F.lower(m["value"])))
    spans = F.transform(own, lambda m: F.struct(F.lit("term").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.when(F.element_at(F.col("terms"), F.lower(m["value"])), "remove").otherwise("generalise").alias("action")))
    extra = stored(hit.select("digest", spans.cast(_SPAN).alias("extra")), "pii-extra")
    # a term inside another span goes with it
    fixed = F.concat("base", "secrets")
    free = F.filter("extra", lambda t: ~F.exists(F.col("fixed"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    met = found.withColumn("fixed", fixed).join(extra, "digest", "left")
    return met.select("doc_id", "digest", "base", F.concat("fixed", F.coalesce(free, F.array().cast(_SPAN))).alias("spans"), "text", "sha256")


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans as text, counts of secrets and of what happens to terms, and the digest of the sanitised text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    done = lambda a, name: F.size(F.filter("spans", lambda s: s["action"] == a)).cast("long").alias(name)
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    clean = F.when(F.size("spans") > 0, F.sha2(_without(F.col("text"), F.col("spans")), 256)).otherwise(F.col("sha256")).alias("sanitised_sha256")
    return spans.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"), secrets, done("remove", "n_removed"), done("generalise", "n_generalised"), clean)


def _general(term: Column) -> Column:
    """What a term is generalised to."""
    size = F.length(term)
    span = F.concat(F.lit("[1"), F.repeat(F.lit("0"), size - 1), F.lit("-"), F.repeat(F.lit("9"), size), F.lit("]"))
    number, mixed = F.regexp_like(term, F.lit(r"^[0-9]+$")), F.regexp_like(term, F.lit(r"\p{N}"))
    return F.when(number, span).when(mixed, "[CODE]").when(F.regexp_like(term, F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[WORD]")


def _without(text: Column, spans: Column) -> Column:
    """The text with its spans replaced, or taken out. Where spans overlap, the one that starts first (then the longer) counts."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("upto"), s["kind"].alias("kind"), s["action"].alias("action"))))

    def step(state: Column, s: Column) -> Column:
        own = F.substring(text, (s["start"] + 1).cast("int"), (-s["upto"] - s["start"]).cast("int"))
        label = F.when(s["action"] == "remove", "").when(s["action"] == "generalise", _general(own)).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        ahead = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.when(s["start"] >= state["at"], F.struct(F.concat(state["out"], ahead, label).alias("out"), (-s["upto"]).alias("at"))).otherwise(state)

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(order, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def sanitised(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): base spans and secrets replaced by their kind in brackets, terms generalised or left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("digest"))
    by_text = spans.groupBy("digest").agg(F.first("spans").alias("spans"))
    return rows.join(by_text, "digest", "left").select("doc_id", _without(F.col("text"), F.coalesce("spans", F.array().cast(_SPAN))).alias("text"))

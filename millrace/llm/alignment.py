"""Aligning the tokens of two tokenizers on the bytes of a text.

Texts are cut into units where both tokenizers surely end a token: before a
single blank between characters that nobody takes for white space. A
byte-level pre-tokenizer begins a word there, and a vocabulary without pieces
that hold a blank behind another character can't merge over it. So what holds
for a text is the sum of what holds for its units, and these recur: the
alignment is made once for each distinct unit, as relations.

* tokens: ``posexplode`` of either side's tokens, and the running sum of their
  bytes by (unit, side) as their ends;
* ends: tokens of both sides meet at equal (unit, end). An end stands once on
  either side at most, so this full outer equi-join is one grouping, and rows
  stay in the partition of their unit;
* groups: where both sides end is a cut; the running count of cuts numbers the
  groups;
* links: the bytes between two neighbouring ends belong to one token of either
  side, and no two such pieces to the same two tokens. So every end is a link,
  of the next tokens that end there or later: a running last value, and never
  all pairs of a group.

Corpus-wide counts of id pairs weigh links by how often their unit occurs.
Texts get the sums over their units: those of units that a 131,072nd of all
occurrences falls on from a broadcast table (there can't be more than 131,072,
and their keys are short), all others by a join on the unit, of the texts' own
counts. The digest of a text's groups needs their ids in order, which are
several times as long as the text; it is made where the text is, by a worker
that remembers the groups of recurring units.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, compress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.encoding import Memo
from millrace.llm.shared import stored

#: What some tokenizer may take for white space; U+2581 stands for a blank in piece vocabularies.
BLANKS = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2581\\u3000\\ufeff"
CUT = f"(?=\\x20[^{BLANKS}])(?<=[^{BLANKS}])"  # few places have the blank, which is looked for first
_CUT = re.compile(CUT)
_ODD = re.compile(f"[{BLANKS}][{BLANKS}]|\\A[{BLANKS}]|[{BLANKS}]\\Z")
#: Units that stay apart when they are strung together: where the next one begins is a cut.
_STRUNG = re.compile(f"\\x20[^{BLANKS}](?:.*[^{BLANKS}])?", re.DOTALL)
_GAP = re.compile(f"[{BLANKS}][{BLANKS}]|[{BLANKS}]\\Z")
#: Stands for the tokens of a unit that a tokenizer doesn't give back.
NONE = (1 << 31) - 1
#: How byte-level pre-tokenizers cut a text (a fixed value).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Units of more bytes go by their digest.
KEY_BYTES = 32
#: A unit is frequent if more than one in so many occurrences is of it.
FREQUENT = 1 << 17
#: Bytes up to which a table of id pairs is broadcast.
BROADCAST = 64 << 20
#: Units that a worker remembers, in each of two generations.
MEMO = 400_000
#: Units that are encoded together.
PART = 2000


def words_of(text: str) -> list[str]:
    """The units of a blank and the text, each without the blank that it begins with."""
    if _ODD.search(text):
        return [u[1:] for u in _CUT.split(" " + text)]
    return text.split(" ")


def units_of(text: str) -> list[str]:
    """The units of a blank and the text."""
    return [" " + w for w in words_of(text)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units in a row, and how many are of each."""
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


class Written:
    """Fixed strings of bytes, put together by their numbers."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self._from, self._all = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        n = self.sizes[numbers]
        return self._all[np.repeat(self._from[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()


class Pair:
    """Both tokenizers, for many units at once."""

    def __init__(self, bytes_json: str, pieces_model: bytes):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = {c: bytes([i]) for i, c in enumerate(_byte_letters())}
        vocabulary = _byte_level(json.loads(bytes_json))
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = b"".join(own.get(c, c.encode()) for c in piece)
        self.a = _byte_encoder(bytes_json, self.a_bytes)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the second tokenizer has pieces that go over a blank")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_names, self.b_names = Written(self.a_bytes), Written(self.b_bytes)
        self.a_sizes, self.b_sizes = self.a_names.sizes, self.b_names.sizes
        sides = (self.a_bytes, ",|"), (self.b_bytes, ",;\n")
        self.shown_as = Written([f"{i}{mark}".encode() for t, marks in sides for mark in marks for i in range(len(t))])

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units in a row and how many are of each, on either side; and which units both give back byte by byte."""
        raw = [u.encode() for u in units]
        wanted = np.fromiter(map(len, raw), np.int64, len(raw))
        sides = self.a(units, wanted), _flat(self.b.encode([u[1:] for u in units], num_threads=1))
        good = np.ones(len(units), bool)
        for (ids, counts), names in zip(sides, (self.a_names, self.b_names), strict=True):
            upto = np.concatenate([[0], np.cumsum(names.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            good &= np.diff(upto) == wanted
        for (ids, counts), names in zip(sides, (self.a_names, self.b_names), strict=True):
            if names.joined(ids[np.repeat(good, counts)]) != b"".join(compress(raw, good.tolist())):
                good &= [names.joined(ids[e - n : e]) == r for e, n, r in zip(np.cumsum(counts), counts, raw, strict=True)]
        return *sides[0], *sides[1], good

    def shown(self, units: list[str]) -> list[str | None]:
        """The groups of each unit, as ``a1,a2|b1;a3|b2,b3``; None if it isn't given back."""
        a, n_a, b, n_b, good = self.encode(units)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        upto_a, upto_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        cuts = np.intersect1d(upto_a, upto_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, upto_a), np.searchsorted(cuts, upto_b)
        last = np.zeros(len(b), int)
        last[np.cumsum(n_b[good]) - 1] = 1
        out = np.empty(len(a) + len(b), np.int64)
        # a group's tokens of the first side stand before those of the second
        out[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + len(self.a_bytes) * (upto_a == cuts[group_a])
        out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + 2 * len(self.a_bytes) + len(self.b_bytes) * ((upto_b == cuts[group_b]) + last)
        found = iter(self.shown_as.joined(out).decode().split("\n"))
        return [next(found) if g else None for g in good.tolist()]


def _byte_level(spec: dict) -> dict[str, int]:
    """The vocabulary of a byte-level BPE file, its added tokens too."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model", {})
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("end_of_word_suffix"):
        raise ValueError("the first tokenizer must be byte-level BPE")
    return model["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


def _byte_encoder(bytes_json: str, names: list[bytes]) -> Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Ids of units, which begin with a blank and whose sizes in bytes are known, special strings as plain text. A file whose ids are in the order of its merges is one of ranks too, which another library encodes several times as fast, and units that stay apart as one text."""
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(bytes_json)
    merges, vocabulary = spec["model"]["merges"], spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if len(vocabulary) == 256 + len(pairs) and all(vocabulary.get(x + y) == 256 + i for i, (x, y) in enumerate(pairs)):
        ranked = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks={names[i]: i for i in vocabulary.values()}, special_tokens={})
        sizes = np.array([len(x) for x in names])

        def strung(units: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            whole, apart, some = "".join(units), np.ones(len(units), bool), units
            if _GAP.search(whole):
                apart = np.array([_STRUNG.fullmatch(u) is not None for u in units], bool)
                some = [*compress(units, apart.tolist())]
                whole = "".join(some)
            ids = np.array(ranked.encode_ordinary(whole), np.int64)
            ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(wanted[apart])) + 1
            if len(some) == len(units):
                return ids, np.diff(ends, prepend=0)
            others, n = _flat([ranked.encode_ordinary(u) for u in compress(units, (~apart).tolist())])
            counts = np.empty(len(units), np.int64)
            counts[apart], counts[~apart] = np.diff(ends, prepend=0), n
            of = np.repeat(apart, counts)
            flat = np.empty(len(of), np.int64)
            flat[of], flat[~of] = ids, others
            return flat, counts

        return strung
    library = Tokenizer.from_str(bytes_json)
    library.encode_special_tokens = True
    return lambda units, _: _flat([e.ids for e in library.encode_batch_fast(units, add_special_tokens=False)])


def _byte_letters() -> list[str]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(i) if i in plain else chr(next(rest)) for i in range(256)]


_made: dict[int, Pair] = {}
_memos: dict[str, Memo] = {}


def _pair(bytes_json: str, pieces_model: bytes) -> Pair:
    """One per worker; it outlives tasks."""
    key = hash((bytes_json, pieces_model))
    if key not in _made:
        _made.clear()
        _made[key] = Pair(bytes_json, pieces_model)
    return _made[key]


def _memo(call: str) -> Memo:
    """What a worker remembers of units, for one call of ``alignments``; it outlives tasks."""
    if call not in _memos:
        _memos.clear()
        _memos[call] = Memo(MEMO)
    return _memos[call]


def _key(unit):
    return F.when(F.octet_length(unit) <= KEY_BYTES, unit).otherwise(F.sha2(unit, 256))


def _exploded(rows: DataFrame, *also) -> DataFrame:
    pieces = F.split(F.concat(F.lit(" "), F.col("text")), CUT, -1)
    return rows.where("text <> ''").select(*also, F.explode(pieces).alias("unit"))


def packed(side: np.ndarray | int, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens as one long each: side, size in bytes and id, which are shuffled in little room."""
    return (np.int64(1) * side << np.int64(60)) | (sizes.astype(np.int64) << np.int64(32)) | ids.astype(np.int64)


def align_units(units: DataFrame) -> DataFrame:
    """(key, n, a, b, ends_a, ends_b) a row for every link of the units (key, n, tokens): the tokens of side 0, then of side 1, ``packed``, whose sizes sum up alike; rows should be dealt by key already; ``ends_a`` and ``ends_b`` say which of the two tokens end with the link, and both together a cut."""
    part = lambda low, bits: F.shiftright("t", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
    tokens = units.select("key", "n", F.posexplode("tokens").alias("pos", "t")).select("key", "n", "pos", part(60, 1).alias("side"), part(32, 28).alias("size"), part(0, 31).alias("id"))
    upto = Window.partitionBy("key", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = tokens.withColumn("end", F.sum("size").over(upto))
    id_of = lambda side: F.max(F.when(F.col("side") == side, F.col("id")))
    met = ends.groupBy("key", "end").agg(F.first("n").alias("n"), id_of(0).alias("a"), id_of(1).alias("b"))
    later = Window.partitionBy("key").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    next_ = lambda c: F.last(c, ignorenulls=True).over(later).alias(c)
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    return met.select("key", "n", next_("a"), next_("b"), F.col("a").isNotNull().alias("ends_a"), F.col("b").isNotNull().alias("ends_b"), F.count_if(cut).over(later).alias("group_from_end"))


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold a pair of ids, and whether no other pair with the same b has more."""
    counts = stored(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, bytes_json: str, pieces_model: str, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. The files are a byte-level BPE of ``tokenizers`` and a BPE of ``sentencepiece``.

    Null and empty texts, and texts that either tokenizer doesn't give back
    byte by byte, have no tokens: zeros and an empty digest, and no part in the
    counts. Null ids stay; repeated rows keep their rows, and each counts
    corpus-wide. Texts of any length are taken whole, also without any blank.
    Other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((Path(bytes_json).read_text(), Path(pieces_model).read_bytes()))  # two vocabularies
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files.value)
        for batch in batches:
            for at in range(0, len(batch), PART):
                part = batch.slice(at, PART)
                a, n_a, b, n_b, good = pair.encode(part.column(2).to_pylist())
                counts = np.where(good[:, None], np.stack([n_a, n_b], axis=1), 1)
                side = np.repeat(np.tile([0, 1], len(good)), counts.ravel())
                fine = np.repeat(good, counts.sum(axis=1))
                flat, sizes = np.full(len(side), NONE, np.int64), np.ones(len(side), np.int64)
                for own, ids, n, size in ((0, a, n_a, pair.a_sizes), (1, b, n_b, pair.b_sizes)):
                    known = ids[np.repeat(good, n)]
                    flat[fine & (side == own)], sizes[fine & (side == own)] = known, size[known]
                offsets = np.concatenate([[0], np.cumsum(counts.sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(packed(side, flat, sizes)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["key", "n", "tokens"])

    seen = stored(_exploded(rows).groupBy("unit").agg(F.count("*").alias("n")), "units")
    units = seen.select(_key(F.col("unit")).alias("key"), "n", "unit").mapInArrow(tokens, "key string, n long, tokens array<long>").repartition("key")
    links = stored(align_units(units).drop("group_from_end"), "links")

    bad = links.where(F.col("a") == NONE).select("key")
    if not bad.isEmpty():  # texts with such a unit leave the counts
        spoilt = _exploded(rows, "doc_id", "h").withColumn("key", _key(F.col("unit"))).join(bad, "key", "left_semi").select(F.col("doc_id").alias("d"), F.col("h").alias("g")).distinct()
        without = rows.join(stored(spoilt, "spoilt"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left_semi")
        less = _exploded(without).groupBy(_key(F.col("unit")).alias("key")).agg(F.count("*").alias("less"))
        links = links.where(F.col("a") != NONE).join(less, "key", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less")
        links = stored(links, "links-counted")

    pairs = stored(pair_counts(links.where("n > 0")), "pairs")
    if pairs.count() * 24 <= broadcast:
        pairs = F.broadcast(pairs)
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    worth = links.join(pairs, ["a", "b"], "left").groupBy("key").agg(
        F.first("n").alias("n"), F.count_if("ends_a").alias("n_a"), F.count_if("ends_b").alias("n_b"), F.count_if(F.col("ends_a") & F.col("ends_b")).alias("n_groups"),
        F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.coalesce(F.sum("count"), F.lit(0)).alias("count_sum"),
    )
    worth = stored(worth, "unit-worth")
    total = worth.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * FREQUENT > total
    values = worth.where(frequent).select("key", F.array(*sums).alias("v")).collect()  # FREQUENT rows at most, keys of 64 bytes at most
    known = spark.sparkContext.broadcast((uuid.uuid4().hex, {r.key: i for i, r in enumerate(values)}, np.array([r.v for r in values], np.int64).reshape(len(values), len(sums))))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, (call, place, table) = _pair(*files.value), known.value
        memo = _memo(call)
        for batch in batches:
            ids, texts, hashes = (batch.column(i) for i in range(3))
            for at in range(0, len(batch), 200):
                cut = [words_of(t) if t else [] for t in texts.slice(at, 200).to_pylist()]
                memo.turn()
                new = memo.missing(chain.from_iterable(cut))
                for i in range(0, len(new), PART):
                    some = [" " + w for w in new[i : i + PART]]
                    for w, u, f in zip(new[i : i + PART], some, pair.shown(some), strict=True):
                        key = u if len(u.encode()) <= KEY_BYTES else hashlib.sha256(u.encode()).hexdigest()
                        memo.young[w] = (f, place.get(key, -1), key) if f else None
                digests, own, rest, young = [], [], [], memo.young
                for x in cut:
                    found = [*map(young.__getitem__, x)]
                    if not found or None in found:
                        found = []
                    digests.append(hashlib.sha256(";".join([f[0] for f in found]).encode()).hexdigest() if found else "")
                    own.append(table[[f[1] for f in found if f[1] >= 0]].sum(axis=0))
                    rest.append([f[2] for f in found if f[1] < 0])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 200), hashes.slice(at, 200), pa.array(digests, pa.string()), *[pa.array([int(v[i]) for v in own], pa.int64()) for i in range(len(sums))], pa.array(rest, pa.list_(pa.string()))],
                    names=["doc_id", "h", "groups_sha256", *sums, "rest"],
                )

    shape = ", ".join(["doc_id long", "h long", "groups_sha256 string", *[f"{c} long" for c in sums], "rest array<string>"])
    base = stored(rows.select("doc_id", "text", "h").mapInArrow(told, shape), "texts")
    met = base.select("doc_id", "h", F.explode("rest").alias("key")).join(worth.where(~frequent).drop("n"), "key")
    more = met.groupBy("doc_id", "h").agg(*[F.sum(c).alias(f"more_{c}") for c in sums]).withColumnsRenamed({"doc_id": "d", "h": "g"})
    # repeated rows share a sum, which then holds each of them
    copies = base.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.count("*").alias("copies"))
    shared = copies.join(more, copies.d.eqNullSafe(more.d) & (copies.g == more.g)).select(copies.d, copies.g, *[F.expr(f"more_{c} div copies").alias(f"more_{c}") for c in sums])
    both = base.drop("rest").join(shared, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    return both.select("doc_id", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums], "groups_sha256")

"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Two scans, neither of which shuffles a whole text:
1. an item's word n-grams are its seeds. Rare ones, which at most RARE items
   hold, open pairs of a document and an item; so do, of every run of SPAN
   n-grams without any rare one, those that fewest items hold. How often a
   document holds a seed says nothing about its rarity, since copies count
   too. All seeds go into a bitmap of bounded size;
2. documents are scanned for seeds, and the words around them come out as hash
   windows, with the seeds and their places, which then join the items
   exactly. From a seed, a window reaches as far as an alignment with one of
   the seed's items can reach if it is to count. Seeds that many items share
   are joined only for pairs that others have opened, so that a phrase which
   all items share doesn't multiply items by documents.

The seeds of an item in a window make stretches, whose words, cut to the item's
own reach, are aligned with it. An alignment's score is divided by
that of the item with itself; from THRESHOLD on, the document holds a copy,
also if words were replaced, dropped or put in, as long as one run of N words
is left that opens the pair. What the choice of seeds loses is a copy of which
nothing is left but a part shorter than SPAN n-grams that over RARE items share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored
from millrace.llm.wordhash import aligned_spans, bitmap, gram_hashes, text_hashes

N, THRESHOLD = 3, 0.5
#: Items that may hold a rare seed, and consecutive n-grams of an item of which at least one opens pairs.
RARE, SPAN = 16, 8
MATCH = 2
#: Bits of the bitmap for each seed, as far as its largest size goes.
SPARSE = 4096
#: Bits of a seed by which its reach is looked up.
REACH_BITS = 20


def _item_words(n: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = text_hashes(batch.column(1).to_pylist())
            longs = lambda rows: pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), longs(words), longs([gram_hashes(w, n) for w in words])], names=["item_id", "item", "grams"])

    return split


def _windows(seen, n: int):
    """Rows (doc_id, text_hash, at, words, places, grams): words around seeds that reach each other, and where in the text which seed stands."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, reaches = seen.value
        for batch in batches:
            out: list[tuple] = []
            for row, words in enumerate(text_hashes(batch.column(2).to_pylist())):
                grams = gram_hashes(words, n)
                places = np.flatnonzero(filter_.holds(grams))
                if not len(places):
                    continue
                far = reaches[(grams[places] >> np.uint64(64 - REACH_BITS)).astype(np.int64)].astype(np.int64)
                far = np.where(far > 0, np.int64(1) << np.minimum(far, 40), 0)
                low, high = np.maximum(0, places - far), np.minimum(len(words), places + n + far)
                # a seed of a short item may stand within the reach of a long one's
                order = np.argsort(low, kind="stable")
                upto = np.maximum.accumulate(high[order])
                cuts = np.flatnonzero(low[order][1:] > upto[:-1]) + 1
                for group in np.split(order, cuts):
                    first, last = int(low[group].min()), int(high[group].max())
                    own = np.sort(places[group])
                    out.append((batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), first, words[first:last].view(np.int64), own, grams[own].view(np.int64)))
            if out:
                d, h, at, w, p, g = zip(*out, strict=True)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.int64()), pa.array(w, longs), pa.array(p, longs), pa.array(g, longs)], names=["doc_id", "text_hash", "at", "words", "places", "grams"])

    return find


def _reaches(seeds: DataFrame) -> np.ndarray:
    """By the leading bits of a seed: the power of two that no reach of its items exceeds. 2**REACH_BITS bytes, however many seeds there are."""
    slot = F.shiftrightunsigned("gram", 64 - REACH_BITS).alias("slot")
    rows = seeds.groupBy(slot).agg(F.ceil(F.log2(F.max("reach") + 1)).cast("int").alias("power")).toPandas()
    out = np.zeros(1 << REACH_BITS, dtype=np.uint8)
    out[rows["slot"].to_numpy(dtype=np.int64)] = rows["power"].to_numpy(dtype=np.uint8)
    return out


def seeds_of(own: DataFrame, rare: int = RARE, span: int = SPAN) -> DataFrame:
    """(item_no, reach, gram, common, opens) of the items' (item_no, reach, grams in order) distinct n-grams: whether over ``rare`` items hold it, and whether it opens pairs."""
    placed = stored(own.select("item_no", "reach", F.size("grams").alias("size"), F.posexplode("grams").alias("pos", "gram")), "grams")
    held = placed.select("gram", "item_no").distinct().groupBy("gram").agg(F.count("*").alias("items"))
    # a gram of very many items is split by this join, as nothing is summed behind it
    placed = placed.join(stored(held, "gram-items"), "gram")
    ahead = Window.partitionBy("item_no").orderBy("pos").rowsBetween(0, span - 1)
    whole = (F.col("pos") == 0) | (F.col("pos") <= F.col("size") - span)
    least = placed.withColumn("least", F.min(F.struct("items", "gram")).over(ahead)).where(whole & (F.col("least.items") > rare))
    chosen = least.select("item_no", F.col("least.gram").alias("gram")).distinct().withColumn("chosen", F.lit(True))
    distinct = placed.select("item_no", "reach", "gram", (F.col("items") > rare).alias("common")).distinct()
    return distinct.join(chosen, ["item_no", "gram"], "left").select("item_no", "reach", "gram", "common", (~F.col("common") | F.coalesce("chosen", F.lit(False))).alias("opens"))


def seed_hits(windows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(window, item_no, reach, place) of all seeds of the items in the windows that an opening seed stands in. Only places and seeds are multiplied, never words."""
    places = windows.select("window", F.explode(F.arrays_zip("places", "grams")).alias("hit")).select("window", F.col("hit.places").alias("place"), F.col("hit.grams").alias("gram"))
    hits = places.join(seeds.where("not common").select("gram", "item_no", "reach"), "gram").select("window", "item_no", "reach", "place")
    common = seeds.where("common")
    if common.isEmpty():
        return hits
    hits = stored(hits, "rare-hits")
    by_common = places.join(common.where("opens").select("gram", "item_no"), "gram").select("window", "item_no")
    opened = stored(hits.select("window", "item_no").union(by_common).distinct(), "opened")
    there = places.join(common.select("gram").distinct(), "gram", "left_semi")
    more = there.join(opened, "window").join(common.select("gram", "item_no", "reach"), ["item_no", "gram"])
    return hits.union(more.select("window", "item_no", "reach", "place"))


def _aligned(threshold: float):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(["doc_id", "text_hash", "item_id", "seeds", "low"])
            array = lambda name: [np.asarray(x.values, dtype=np.int64).view(np.uint64) for x in batch.column(name)]  # noqa: E731, B023
            items = array("item")
            score, start, end = aligned_spans(items, array("words"), match=MATCH)
            share = score / np.maximum(1, [MATCH * len(i) for i in items])
            rows = rows.append_column("score", pa.array(share, pa.float64())).append_column("start_word", pa.array(start, pa.int64())).append_column("end_word", pa.array(end, pa.int64()))
            yield from rows.filter(pa.array(share >= threshold)).to_batches()

    return align


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score, start_word, end_word, seeds, text_hash.

    Words are lower-cased runs of letters and digits; positions count them,
    ends exclusive; of several copies of an item the best counts, then the
    first; seeds counts those of the stretch that was aligned. Null, empty and
    wordless texts hold nothing, and such items are held by none. Texts and
    items of any length are taken whole. Items of fewer than n words are only
    matched against texts that consist of nothing else. Items of equal id are
    told apart by their texts until the end. Repeated rows give one result row;
    rows of equal id, null too, are told apart by their text_hash. Other columns
    of either table are ignored, whatever their names; empty tables give an
    empty result.
    """
    sc = docs.sparkSession.sparkContext
    own = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_item_words(n), "item_id long, item array<long>, grams array<long>").where(F.size("item") > 0).distinct()
    # with match 2 and gap -1, an alignment that counts has put in at most 2 (1 - threshold) words for each word of the item
    reach = F.ceil(F.lit(3 - 2 * threshold) * F.size("item")).cast("long")
    own = stored(own.select("item_id", "item", "grams", reach.alias("reach"), F.monotonically_increasing_id().alias("item_no")), "items")
    seeds = stored(seeds_of(own), "seeds")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    seen = sc.broadcast((bitmap(seeds.select("gram").distinct(), "gram", SPARSE), _reaches(seeds)))  # 33 MB at most
    windows = texts.mapInArrow(_windows(seen, n), "doc_id long, text_hash long, at long, words array<long>, places array<long>, grams array<long>")
    windows = stored(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
    hits = seed_hits(windows, seeds)
    # stretches of an item's seeds that reach each other
    run = Window.partitionBy("window", "item_no").orderBy("place")
    fresh = F.coalesce(F.col("place") - F.lag("place").over(run) > 2 * F.col("reach") + n, F.lit(False)).cast("int")
    hits = hits.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stretches = hits.groupBy("window", "item_no", "stretch").agg(F.count("*").alias("seeds"), (F.min("place") - F.first("reach")).alias("first"), (F.max("place") + F.first("reach") + n).alias("last"))
    cut = F.greatest(F.col("first"), F.col("at")).alias("low")
    near = stretches.join(windows.select("window", "doc_id", "text_hash", "at", "words"), "window").select("item_no", "doc_id", "text_hash", "seeds", "at", "words", "last", cut)
    near = near.select("item_no", "doc_id", "text_hash", "seeds", "low", F.slice("words", (F.col("low") - F.col("at") + 1).cast("int"), (F.col("last") - F.col("low")).cast("int")).alias("words"))
    pairs = near.join(own.select("item_no", "item_id", "item"), "item_no").select("doc_id", "text_hash", "low", "item_id", "seeds", "words", "item")
    schema = "doc_id long, text_hash long, item_id long, seeds long, low long, score double, start_word long, end_word long"
    found = pairs.mapInArrow(_aligned(threshold), schema).withColumns({c: F.col(c) + F.col("low") for c in ("start_word", "end_word")})
    best = F.max_by(F.struct("score", "start_word", "end_word", "seeds"), F.struct("score", -F.col("start_word"))).alias("best")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "item_id", "best.*", "text_hash")

"""Main text of web pages: block density within a page, and the blocks that pages of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.html import page_blocks
from millrace.scratch import stored

#: Areas that hold no main text, whatever their density.
MARGINS = ("nav", "header", "footer", "aside", "form", "menu", "dialog")
#: A block with as many words, and at most this share of them in links, is dense.
DENSE_WORDS, MOST_LINKED = 10, 0.34
#: A block is shared if as many of a host's pages hold it, and this share of them.
SHARED_PAGES, SHARED_PART = 3, 0.1


def host(url: Column) -> Column:
    """Host of a URL, lower-cased; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, "://([^/?#]+)", 1), F.lit("")))


def _dense(block: Column) -> Column:
    """Enough words for the inline tags in it, and few of them in links."""
    return (block["words"] >= DENSE_WORDS) & (block["words"] > 2 * block["tags"]) & (block["link_words"] <= MOST_LINKED * block["words"])


def main_blocks(blocks: Column) -> Column:
    """The blocks (an array, as ``page_blocks`` gives) outside margins that are dense, or headings before, or short ones without links between dense ones. Order is kept."""
    inner = F.filter(blocks, lambda b: ~b["area"].isin(*MARGINS))
    beside = lambda i: F.coalesce(_dense(F.get(inner, i)), F.lit(False))
    heading = lambda b: b["tag"].rlike("^h[1-6]$")
    keep = lambda b, i: _dense(b) | (heading(b) & beside(i + 1)) | ((b["link_words"] == 0) & beside(i - 1) & beside(i + 1))
    return F.filter(inner, keep)


def shared_blocks(shown: DataFrame, hosts: DataFrame, least: int = SHARED_PAGES, part: float = SHARED_PART) -> DataFrame:
    """(host, digest) of the blocks that at least ``least`` pages of a host hold, and ``part`` of its pages.

    ``shown`` has a row (host, digest) for each distinct block of each page,
    ``hosts`` the pages of each host. Counts are summed map-side, and only
    blocks of several pages go on to meet their host's count.
    """
    often = shown.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return often.join(hosts, "host").where(F.col("n") >= part * F.col("pages")).select("host", "digest")


def page_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = SHARED_PAGES, part: float = SHARED_PART) -> DataFrame:
    """One row per row of ``pages``: id, host, title, n_blocks, n_main, n_shared, text (main blocks, a line each, without those that the host's pages share).

    Pages are read once, in Arrow batches, into blocks; digests alone go
    through the corpus-wide count, and a page gets back those of its own blocks
    that are shared. Texts move once, to meet these.

    Null and empty pages have no blocks and an empty text. Pages whose URL has
    no host count for no host, so that nothing of them is shared. Broken markup
    is read as ``parse_page`` says. Repeated rows are rows of their own, in the
    counts too; null ids stay; pages of any length are read whole. Other
    columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), page_blocks(F.col(html_col)).alias("page"))
    main = rows.select("page_id", "host", "page.title", F.size("page.blocks").alias("n_blocks"), F.transform(main_blocks(F.col("page.blocks")), lambda b: b["text"]).alias("main"))
    main = main.withColumn("digests", F.array_distinct(F.transform("main", lambda t: F.xxhash64(t))))
    read = stored(main.withColumn("own", F.xxhash64("main")), "pages-read")
    known = read.where("host IS NOT NULL")
    shown = known.select("page_id", "own", "host", F.explode("digests").alias("digest"))
    shared = stored(shared_blocks(shown, known.groupBy("host").agg(F.count("*").alias("pages")), least, part), "shared-blocks")
    hits = shown.join(shared, ["host", "digest"], "left_semi").groupBy("page_id", "own", "host").agg(F.collect_set("digest").alias("drop"))
    hits = hits.withColumnsRenamed({"page_id": "p", "own": "o", "host": "h"})
    met = read.join(hits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("own") == F.col("o")) & (F.col("host") == F.col("h")), "left")
    left = F.when(F.col("drop").isNull(), F.col("main")).otherwise(F.filter("main", lambda t: ~F.array_contains("drop", F.xxhash64(t))))
    return met.select("page_id", "host", "title", F.col("n_blocks").cast("long").alias("n_blocks"), F.size("main").cast("long").alias("n_main"), (F.size("main") - F.size(left)).cast("long").alias("n_shared"), F.array_join(left, "\n").alias("text"))

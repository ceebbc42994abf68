"""Judging URLs by pattern rules that are indexed by their rarest literal token.

A rule is a pattern, a verdict and a rank. Patterns are matched with what
follows the first ``://`` of a URL, its host lower-cased: ``||`` at the start
stands for a host or a domain above it, ``|`` at the start or end for the URL's
start or end, ``*`` for any run of characters, ``^`` for a mark that ends a
name, or the end; all else for itself.

Every rule is filed under one of its whole tokens (runs of letters, digits and
non-ASCII characters with a mark or an end on either side, so that a matching
URL has the same token): the one that fewest URLs hold. A URL's tokens fetch
the rules filed under them, and only these run their regular expression. Rules
without a whole token are filed under the empty token, which every URL holds
if there is such a rule.

Only distinct matches are shuffled, by URL, after a map-side reduction to the
best rule. The index is broadcast if its measured size allows; beyond that it
is joined by token, with the few tokens that a thousandth of all holds, and
their rules, dealt out by a hash of the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import ascii_lower, stored

#: Bytes of patterns up to which the index is broadcast.
BROADCAST = 8 << 20
#: A token that more than one in so many of all tokens is counts as hot, so that there are at most as many hot ones.
HOT = 1000

# ASCII characters that aren't letters or digits; all others belong to tokens.
_MARKS = r"\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f"
_BOUND = rf"[{_MARKS}&&[^*]]"
_TOKEN = rf"(?<={_BOUND})([^{_MARKS}]+)(?={_BOUND})"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _subject(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*(.*)\z", 1), F.lit(""))
    return F.concat(host_of(url), rest)


def _regex(pattern: Column) -> Column:
    """The regular expression of a pattern: its body with all marks but ``*`` and ``^`` taken literally, between its anchors."""
    body = F.regexp_replace(pattern, r"\A\|\|?", "")
    tail = F.when(body.endswith("|"), r"\z").otherwise("")
    body = F.regexp_replace(body, r"\|\z", "")
    body = F.regexp_replace(body, r"([\x00-\x7f&&[^A-Za-z0-9*^]])", r"\\$1")
    body = F.regexp_replace(body, r"\^", r"(?:[\\x00-\\x7f&&[^A-Za-z0-9_.%-]]|\\z)")
    head = F.when(pattern.startswith("||"), r"\A(?:[^/?#]*\.)?").when(pattern.startswith("|"), r"\A").otherwise("")
    return F.concat(F.lit("(?s)"), head, F.regexp_replace(body, r"\*", ".*"), tail)


def _tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(ascii_lower(text), f"[{_MARKS}]+")), "")


def indexed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rules with the token that each is filed under: of its whole tokens the one that is rarest in ``tokens`` (token, n); of equally rare ones the first by text. A token that no URL has is the rarest."""
    own = rules.withColumn("token", F.explode(F.when(F.size("whole") == 0, F.array(F.lit(""))).otherwise(F.col("whole"))))
    placed = own.join(tokens, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.min(F.struct("n", "token")).alias("rarest")
    found = placed.groupBy("pattern", "verdict", "rank", "regex").agg(rarest)
    return found.select(F.col("rarest.token").alias("token"), F.col("rarest.n").alias("n"), "pattern", "verdict", "rank", "regex")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", url_col: str = "url", broadcast: int = BROADCAST) -> DataFrame:
    """The rows of ``pages`` with host, path, pattern, rank and verdict of the rule that decides; pattern and rank are null and the verdict is ``otherwise`` where none fits.

    ``rules`` has pattern, verdict and rank; of the rules that fit, those of
    the lowest rank count, of these the longest pattern, of equally long ones
    the first by text. Rules with a null or empty pattern fit nothing, those
    that are listed twice count once. Rules without a rank come last.

    Null URLs and those without ``://`` have an empty host and path and fit no
    rule. URLs of any length are taken whole. Repeated rows, null ids and any
    other columns stay as they are, except that columns named like a result
    are replaced. An empty table gives an empty result.
    """
    listed = rules.select(F.col("pattern").cast("string"), F.col("verdict").cast("string"), F.coalesce(F.col("rank").cast("int"), F.lit(2**31 - 1)).alias("rank"))
    listed = listed.where("pattern <> ''").distinct()
    listed = stored(listed.select("*", _regex(F.col("pattern")).alias("regex"), F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("pattern")), F.lit(_TOKEN))).alias("whole")), "url-rules")
    size, bare = listed.select(F.sum(F.octet_length("pattern") + F.octet_length("regex")), F.count_if(F.size("whole") == 0)).first()
    small = (size or 0) <= broadcast
    spread = lambda df: F.broadcast(df) if small else df

    urls = pages.select(F.col(url_col).alias("url")).where(F.instr(F.col("url"), "://") > 0).select("url", _subject(F.col("url")).alias("subject"))
    held = _tokens(F.col("subject"))
    held = F.array_append(held, "") if bare else held
    each = urls.select("url", "subject", F.explode(held).alias("token"))
    asked = listed.select(F.explode("whole").alias("token")).distinct()
    counts = each.join(spread(asked), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = stored(indexed(listed, counts), "url-index")
    if small:
        met = each.join(F.broadcast(index), "token")
    else:
        ways = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        filed = index.select("token", "n").distinct()
        total = filed.agg(F.sum("n")).first()[0] or 0
        hot = [r.token for r in filed.where((F.col("n") * HOT > total) | (F.col("token") == "")).collect()]
        some = F.col("token").isin(hot) if hot else F.lit(False)
        way = F.when(some, F.pmod(F.xxhash64("url"), F.lit(ways))).otherwise(0).cast("int")
        ways_of = F.when(some, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
        kept = each.join(filed.select("token"), "token", "left_semi") if not bare else each
        met = kept.withColumn("way", way).join(index.withColumn("way", F.explode(ways_of)), ["token", "way"])
    fit = met.where(F.expr("subject rlike regex"))
    first = F.min(F.struct("rank", (-F.length("pattern")).alias("shorter"), "pattern", "verdict")).alias("rule")
    best = fit.groupBy("url").agg(first).select(F.col("url").alias("judged_"), F.struct("rule.pattern", "rule.rank", "rule.verdict").alias("rule_"))
    own = [F.col("`" + c.replace("`", "``") + "`") for c in pages.columns if c not in ("host", "path", "pattern", "rank", "verdict")]
    rows = pages.select(F.col(url_col).alias("url_"), F.struct(*own).alias("row_")).join(best, F.col("url_") == F.col("judged_"), "left")
    url = F.col("url_")
    return rows.select("row_.*", host_of(url).alias("host"), path_of(url).alias("path"), F.col("rule_.pattern").alias("pattern"), F.col("rule_.rank").alias("rank"), F.coalesce("rule_.verdict", F.lit(otherwise)).alias("verdict"))

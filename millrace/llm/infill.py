"""Fill-in-middle: texts cut into prefix, middle and suffix between units, and put in another order.

A unit grammar names the classes whose runs are one unit each; any other
character is a unit of its own. It is translated into a regular expression of
no width that looks at the two characters beside a place: a unit ends after a
character of no class, and where a class ends. Spark's ``split`` by it keeps
all pieces, in order. The empty text, which ``split`` gives one empty piece,
has no units.

Everything is a column expression: one scan, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes, as they stand between brackets in a regular expression, by the name of their grammar.
GRAMMARS = {
    "words": ("A-Za-z",),  # [A-Za-z]+|[^A-Za-z]
    "words_and_numbers": (r"\p{L}\p{M}", r"\p{Nd}", r"\s"),
    "characters": (),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundary(classes: tuple[str, ...]) -> str:
    """A regular expression of no width that fits between units, and neither at the start nor at the end of a text."""
    if not classes:
        return r"(?<=[\s\S])(?=[\s\S])"
    single = rf"(?<=[^{''.join(classes)}])(?=[\s\S])"
    return "|".join([single, *[f"(?<=[{c}])(?=[^{c}])" for c in classes]])


def units(text: Column, grammar: str = "words") -> Column:
    """Array of the units of a text; null and empty texts have none."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(GRAMMARS[grammar]), -1))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone: parts hold no marker, and no two markers can overlap."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill(docs: DataFrame, grammar: str = "words", plain_pct: int = 10, spm_pct: int = 20, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output.

    The draws are the first four groups of eight hex digits of the SHA-256 of
    seed, colon and id: cuts after the smaller and the larger of two of them
    modulo n + 1 units, ``plain_pct`` percent of texts left as they are,
    ``spm_pct`` percent of the rest with the suffix first. Texts that are empty
    or hold a marker stay plain too; their lengths are null.

    Null texts are empty, a null id is drawn as an empty string. Repeated rows
    give equal rows, texts of any length are cut whole. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[draw(i).alias(f"h{i + 1}") for i in range(4)])
    cut = rows.withColumn("units", units(F.col("text"), grammar)).withColumn("n", F.size("units").cast("long"))
    one, two = F.pmod(F.col("h1"), F.col("n") + 1), F.pmod(F.col("h2"), F.col("n") + 1)
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.col("text").contains(m)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_pct)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_pct, "spm").otherwise("psm")
    cut = cut.select("doc_id", "text", "units", "n", form.alias("form"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b"))
    part = lambda start, size: F.array_join(F.slice("units", start, size), "")
    cut = cut.withColumn("parts", F.when(F.col("form") != "plain", F.struct(part(F.lit(1), F.col("a")).alias("p"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("m"))))
    cut = cut.select("doc_id", "text", "n", "form", "parts", F.length("parts.p").cast("long").alias("prefix_chars"), F.length("parts.m").cast("long").alias("middle_chars"))
    p, m = F.col("parts.p"), F.col("parts.m")
    s = F.expr("substring(text, cast(prefix_chars + middle_chars + 1 AS int))")
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
    output = output.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)).otherwise(F.col("text"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def digests(rows: DataFrame) -> DataFrame:
    """What ``infill`` gives, with digests of the output and of the text rebuilt from it in the output's place."""
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


INFILL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
  CAST('0x' || substring(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substring(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substring(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substring(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(list_slice(units, 1, a), ''), '') AS pre, coalesce(array_to_string(list_slice(units, a + 1, b), ''), '') AS mid, coalesce(array_to_string(list_slice(units, b + 1, n), ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

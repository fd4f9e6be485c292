"""Texts against a keyword table of any size, by an inverted index of character n-grams.

A keyword can only be inside a text that holds all of the keyword's trigrams, so each keyword is listed under the one trigram
that the fewest texts hold, and a text is compared only with the keywords listed under its own trigrams. Keywords of one or two
characters are such grams themselves. Nothing is collected: grams, keywords and candidates meet in joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postkit.session import materialize

#: Characters of a gram; shorter keywords are their own gram.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The different substrings of ``size`` characters (none of a shorter text), found in one pass: ``substring`` would count from the
    start of the text for every one. A match begins at a character, not inside a surrogate pair."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{size - 1}}}))"), F.lit(1)))


def keyword_hits(texts: DataFrame, keywords: DataFrame, text_col: str = "text", keyword_col: str = "keyword") -> DataFrame:
    """``text`` (lower case) and ``n_keywords``: every different text that contains a keyword, whatever their case, and how many
    different keywords it contains. Null and empty keywords are ignored, null texts contain none.

    Texts travel as 64-bit hashes until their candidates are confirmed with ``contains`` on the text itself, so a clash of
    hashes costs a comparison and changes nothing; a text meets all its candidates at once. Equal texts and equal keywords are
    reduced on the map side."""
    known = materialize(texts.select(F.lower(text_col).alias("text")).where(F.length("text") > 0).distinct().withColumn("h", F.xxhash64("text")), "texts")
    words = materialize(keywords.select(F.lower(F.col(keyword_col).cast("string")).alias("keyword")).where(F.length("keyword") > 0).distinct(), "keywords")
    short = words.where(F.char_length("keyword") < GRAM).withColumn("gram", F.col("keyword"))

    sizes = [_grams(F.col("text"), GRAM)]
    if not short.isEmpty():                                # texts list their shorter grams only if some keyword is one
        sizes += [_grams(F.col("text"), k) for k in range(1, GRAM)]
    own = known.select("h", F.explode(F.flatten(F.array(*[F.coalesce(g, F.array().cast("array<string>")) for g in sizes]))).alias("gram"))

    spread = words.where(F.char_length("keyword") >= GRAM).select("keyword", F.explode(_grams(F.col("keyword"), GRAM)).alias("gram"))
    wanted = spread.select("gram").distinct()
    held = own.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    listed = (spread.join(held, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
              .groupBy("keyword").agg(F.min(F.struct("n", "gram")).alias("least")).where("least.n > 0").select("keyword", F.col("least.gram").alias("gram")))
    index = materialize(listed.unionByName(short.select("keyword", "gram")), "gram-index")

    candidates = own.join(index, "gram").groupBy("h").agg(F.collect_set("keyword").alias("keywords"))
    found = F.filter("keywords", lambda k: F.contains(F.col("text"), k))
    return known.join(candidates, "h").select("text", F.size(found).cast("bigint").alias("n_keywords")).where(F.col("n_keywords") > 0)


def with_keyword_count(rows: DataFrame, keywords: DataFrame, text_col: str, keyword_col: str = "keyword", out: str = "n_keywords") -> DataFrame:
    """``rows`` and ``out``, the number of different keywords that the text contains (0 for a null text)."""
    hits = materialize(keyword_hits(rows, keywords, text_col, keyword_col), "keyword-hits").select(F.col("text").alias("_text"), F.col("n_keywords").alias("_n"))
    joined = rows.join(hits, F.lower(text_col) == F.col("_text"), "left")
    return joined.select(*[rows[c] for c in rows.columns], F.coalesce("_n", F.lit(0)).cast("bigint").alias(out))

"""Classify the tokens of a listing link's text into title / company / location / salary.

Native higher-order functions over ``array<string>``; no Python per row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postkit import constants as K
from postkit.functions.text import ColumnOrName, _c


def tokenize(text: ColumnOrName, sep: str = "\n") -> Column:
    """Split on ``sep``, strip every part, drop empty parts."""
    parts = F.transform(F.split(_c(text), sep), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def _has_any(p: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | p.contains(w)
    return out


def _first_or(arr: Column, pred, default: str) -> Column:
    return F.coalesce(F.get(F.filter(arr, pred), 0), F.lit(default))


def with_token_fields(
    df: DataFrame,
    parts_col: str,
    out: str = "_t",
    tags: Sequence[str] = K.LINK_TAGS,
    salary_words: Sequence[str] = K.SALARY_KEYWORDS,
    place_words: Sequence[str] = K.PLACE_KEYWORDS,
    default_location: str = K.LINK_DEFAULT_LOCATION,
) -> DataFrame:
    """Adds ``out`` = ``struct(title, company, location, salary)``, null without parts.

    * title: parts before the first part containing a tag, joined by a space; when that is
      shorter than 3 characters, the first part.
    * rest: parts from the first tagged part on (empty when no part has a tag).
    * salary: first rest part containing a salary word, else ''.
    * location: first rest part containing a place word, else the default.
    * company: first rest part with no tag, no salary word and more than 2 characters, else ''.

    Staged projections: the tag position, the head and rest arrays and the joined title are each
    a column computed once per row (as one nested Column they would be re-evaluated at every
    use). Catalyst does not collapse projections that would duplicate a non-trivial expression."""
    cols, arr = df.columns, F.col(parts_col)
    s1 = df.select(*cols, F.array_position(F.transform(arr, lambda p: _has_any(p, tags)), True).alias("_k_idx"))
    idx = F.col("_k_idx")
    s2 = s1.select(
        *cols,
        F.when(idx == 0, arr).otherwise(F.slice(arr, F.lit(1), F.greatest(idx - 1, F.lit(0)))).alias("_k_head"),
        F.when(idx == 0, F.array().cast("array<string>")).otherwise(F.slice(arr, idx, F.size(arr))).alias("_k_rest"))
    s3 = s2.select(*cols, "_k_rest",
                   F.regexp_replace(F.array_join("_k_head", " "), r"(?U)^\s+|\s+$", "").alias("_k_joined"))
    rest, joined = F.col("_k_rest"), F.col("_k_joined")
    title = F.when(F.length(joined) < K.LINK_MIN_TITLE_CHARS, F.get(arr, 0)).otherwise(joined)
    company = _first_or(
        rest,
        lambda p: ~_has_any(p, tags) & ~_has_any(p, salary_words) & (F.length(p) >= K.LINK_MIN_COMPANY_CHARS),
        "",
    )
    return s3.select(*cols, F.when(F.size(arr) > 0, F.struct(
        title.alias("title"), company.alias("company"),
        _first_or(rest, lambda p: _has_any(p, place_words), default_location).alias("location"),
        _first_or(rest, lambda p: _has_any(p, salary_words), "").alias("salary"))).alias(out))

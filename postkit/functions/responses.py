"""Parse free-text scorer answers into typed score fields, natively.

Rules (what a permissive JSON-in-text reader does):

* remove code fences (```` ``` ```` or ```` ```json ````) anywhere, strip whitespace;
* the whole text must be exactly one JSON value; otherwise the greedy ``{...}`` span
  (first '{' to last '}', across lines) must be; the value must be an object;
* ``score``: missing -> 0; number -> truncated toward zero; integer text -> its value;
  boolean -> 0/1; null, other text, list, object -> failure;
* ``match_summary``: missing or null -> ''; text as is; other values as JSON text;
* ``skills_match`` / ``gaps``: JSON text of the value, '[]' when missing;
* ``seniority_match`` / ``remote_match``: truthiness (non-empty text is true, so "false" is
  true; ``strict_bool=True`` reads text "false"/"0"/"" as false); missing/null -> false.

A failed row keeps its id and gets an ``error`` reason; callers split on it (quarantine).
Strict parsing wraps the text in ``[...]``: plain ``try_parse_json`` accepts trailing garbage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postkit.functions.text import ColumnOrName, _c

_NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$"


def strip_fences(text: ColumnOrName) -> Column:
    """X12 + X11."""
    t = F.regexp_replace(_c(text), r"```(?:json)?", "")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def _field(obj: Column, name: str) -> Column:
    return F.variant_get(obj, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _score(v: Column) -> Column:
    k = _kind(v)
    txt = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull(), F.lit(0).cast("bigint"))
        .when(k.rlike(_NUMERIC), F.try_variant_get(v, "$", "double").try_cast("bigint"))
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
        .when((k == "STRING") & txt.rlike(r"^\s*[+-]?[0-9]+\s*$"),
              F.regexp_replace(txt, r"\s", "").try_cast("bigint"))
    )


def _truthy(v: Column, strict: bool) -> Column:
    k = _kind(v)
    txt = F.try_variant_get(v, "$", "string")
    text_true = (txt != "") if not strict else ~F.lower(txt).isin("", "false", "0")
    return F.coalesce(
        F.when(v.isNull() | F.is_variant_null(v), F.lit(False))
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(k.rlike(_NUMERIC), F.try_variant_get(v, "$", "double") != 0)
        .when(k == "STRING", text_true)
        .when(k.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(k.startswith("OBJECT"), k != "OBJECT<>"),
        F.lit(False),
    )


def _text(v: Column) -> Column:
    k = _kind(v)
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(""))
            .when(k == "STRING", F.try_variant_get(v, "$", "string"))
            .otherwise(F.to_json(v)))


def _json_list(v: Column) -> Column:
    return F.when(v.isNull(), F.lit("[]")).otherwise(F.to_json(v))


def parse_responses(df: DataFrame, text_col: str, keep: list[str], strict_bool: bool = False) -> DataFrame:
    """X13-X17 as staged projections: every expensive step (fence strip, strict parse, greedy
    fallback, field lookups) is its own projection column, computed once per row. Catalyst
    does not collapse projections that would duplicate a non-trivial expression, so the plan
    keeps the stages. Adds the struct column ``_p``: score, match_summary, skills_match,
    gaps, seniority_match, remote_match, score_in_range, error."""
    s1 = df.select(*keep, text_col, strip_fences(text_col).alias("_t"))
    s2 = s1.select("*", F.try_parse_json(F.concat(F.lit("["), F.col("_t"), F.lit("]"))).alias("_w"))
    one = lambda w: F.variant_get(w, "$[0]", "variant").isNotNull() & F.variant_get(w, "$[1]", "variant").isNull()
    s3 = s2.select(*keep, text_col, F.when(one(F.col("_w")), F.col("_w")).otherwise(
        F.try_parse_json(F.concat(F.lit("["), F.regexp_extract("_t", r"(?s)\{.*\}", 0), F.lit("]")))).alias("_c"),
        F.when(one(F.col("_w")), F.lit(True)).otherwise(F.lit(False)).alias("_direct"))
    s4 = s3.select(*keep, text_col, F.when(F.col("_direct") | one(F.col("_c")),
                                           F.variant_get("_c", "$[0]", "variant")).alias("_v"))
    s5 = s4.select(*keep, text_col, F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v")).alias("_o"))
    fields = ["score", "match_summary", "skills_match", "gaps", "seniority_match", "remote_match"]
    s6 = s5.select(*keep, text_col, "_o", *[_field(F.col("_o"), f).alias(f"_f_{f}") for f in fields])
    s7 = s6.select(*keep, text_col, "_o", F.col("_f_match_summary"), "_f_skills_match", "_f_gaps",
                   "_f_seniority_match", "_f_remote_match", _score(F.col("_f_score")).alias("_score"))
    error = (F.when(F.col(text_col).isNull(), F.lit("no response"))
             .when(F.col("_o").isNull(), F.lit("no JSON object"))
             .when(F.col("_score").isNull(), F.lit("score is not an integer")))
    ok = error.isNull()
    # The one-element explode is a plan barrier: a later filter on ``_p.error`` (the good /
    # quarantine split) cannot be pushed below it, which would re-inline every stage above
    # into the filter and the projection twice.
    return s7.select(*keep, text_col, F.explode(F.array(F.struct(
        F.when(ok, F.col("_score")).alias("score"),
        F.when(ok, _text(F.col("_f_match_summary"))).alias("match_summary"),
        F.when(ok, _json_list(F.col("_f_skills_match"))).alias("skills_match"),
        F.when(ok, _json_list(F.col("_f_gaps"))).alias("gaps"),
        F.when(ok, _truthy(F.col("_f_seniority_match"), strict_bool)).alias("seniority_match"),
        F.when(ok, _truthy(F.col("_f_remote_match"), strict_bool)).alias("remote_match"),
        F.when(ok, F.col("_score").between(0, 100)).alias("score_in_range"),
        error.alias("error"),
    ))).alias("_p"))


def split_parsed(df: DataFrame, text_col: str, key_cols: list[str], strict_bool: bool = False
                 ) -> tuple[DataFrame, DataFrame]:
    """Q1: (good, quarantine) from one parse; callers writing both should persist the parse."""
    parsed = parse_responses(df, text_col, key_cols, strict_bool)
    good = parsed.where(F.col("_p.error").isNull()).select(
        *key_cols, "_p.score", "_p.match_summary", "_p.skills_match", "_p.gaps",
        "_p.seniority_match", "_p.remote_match", "_p.score_in_range")
    bad = parsed.where(F.col("_p.error").isNotNull()).select(
        *key_cols, F.col(text_col).alias("response"), F.col("_p.error").alias("error"))
    return good, bad


def json_list(c: ColumnOrName) -> Column:
    """JSON list text -> array<string>; anything unreadable -> empty array."""
    return F.coalesce(F.from_json(_c(c), "array<string>"), F.array().cast("array<string>"))

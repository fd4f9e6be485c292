"""Filters, sorts and aggregates over the
current view. Everything is built-in expressions; only small results leave the executors."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postkit import constants as K
from postkit.functions.bands import accent_band, rating_band, ring_band
from postkit.functions.salary import salary_bounds, salary_overlap
from postkit.functions.text import ellipsis, search_match
from postkit.schemas import STATUS_DIM
from postkit.session import literal_frame, materialize


def status_dim(spark: SparkSession) -> DataFrame:
    """The fixed 7-row status dimension (safe to broadcast: its size is fixed)."""
    return literal_frame(spark, K.STATUS_DIM_ROWS, STATUS_DIM)


@dataclass
class FilterSpec:
    """The dashboard's sidebar: every field left at its default applies the default filter."""
    search: str | None = None
    search_literal: bool = False
    min_score: int | None = K.DEFAULT_MIN_SCORE
    source: str = "All"
    statuses: Sequence[str] = field(default_factory=lambda: list(K.DEFAULT_STATUS_FILTER))
    remote_only: bool = False
    salary_only: bool = False
    # None = no salary filter; "auto" = the full CZK range of the whole view (the default
    # slider position); (lo, hi) = explicit bounds
    salary_range: object = "auto"
    salary_currency: str = "CZK"


def filter_predicate(spec: FilterSpec, lo: Column | None = None, hi: Column | None = None) -> Column:
    """F5-F11 as one predicate (so Catalyst can push the simple parts into the scan)."""
    pred = F.lit(True)
    if spec.search:
        pred = pred & search_match(["title", "company", "location"], spec.search, spec.search_literal)
    if spec.min_score is not None:
        pred = pred & F.coalesce(F.col("score") >= spec.min_score, F.lit(False))
    if spec.source != "All":
        pred = pred & F.coalesce(F.col("source") == spec.source, F.lit(False))
    if spec.statuses:
        pred = pred & F.coalesce(F.col("status").isin(list(spec.statuses)), F.lit(False))
    if spec.remote_only:
        pred = pred & F.coalesce(F.col("remote_match"), F.lit(False))
    if spec.salary_only:
        pred = pred & F.coalesce(F.col("salary") != "", F.lit(False))
    if lo is not None and hi is not None:
        pred = pred & salary_overlap(lo, hi, spec.salary_currency)
    return pred


def _with_bounds(df: DataFrame, spec: FilterSpec) -> tuple[DataFrame, Column | None, Column | None]:
    """The salary-range bounds. 'auto' = the full range of the whole view: a one-row aggregate
    used as two scalar subqueries (computed once, before the filter; no join). With no row in
    the currency the salary filter is off, as in the dashboard."""
    if spec.salary_range is None:
        return df, None, None
    if spec.salary_range == "auto":
        bounds = salary_bounds(df, spec.salary_currency)
        lo, hi = bounds.select("salary_lo").scalar(), bounds.select("salary_hi").scalar()
        return df, F.coalesce(lo, F.lit(-(2 ** 62))), F.coalesce(hi, F.lit(2 ** 62))
    lo_v, hi_v = spec.salary_range
    return df, F.lit(lo_v), F.lit(hi_v)


def shown_flag(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """The view plus a boolean ``shown`` column (rows kept by the filters)."""
    joined, lo, hi = _with_bounds(df, spec)
    out = joined.withColumn("shown", filter_predicate(spec, lo, hi))
    return out.select(*df.columns, "shown")


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """The filtered view."""
    joined, lo, hi = _with_bounds(df, spec)
    return joined.where(filter_predicate(spec, lo, hi)).select(*df.columns)


_SORTS = {
    "Score (high→low)": ("score", False),
    "Score (low→high)": ("score", True),
    "Date (newest)": ("date_scraped", False),
    "Company (A→Z)": ("company", True),
}


def sort_columns(sort_by: str, key: str = "job_id") -> list[Column]:
    """O2: the four named sorts (unknown -> score desc). Missing values go last in both
    directions; ``key`` breaks ties."""
    col, asc = _SORTS.get(sort_by, ("score", False))
    first = F.col(col).asc_nulls_last() if asc else F.col(col).desc_nulls_last()
    return [first, F.col(key).asc()]


def sort_postings(df: DataFrame, sort_by: str, top: int | None = None, key: str = "job_id") -> DataFrame:
    """O2 (+ top-k page when ``top``: TakeOrderedAndProject, never a full sort)."""
    out = df.orderBy(*sort_columns(sort_by, key))
    return out.limit(top) if top else out


def ranked(df: DataFrame, sort_by: str, key: str = "job_id") -> DataFrame:
    """O2 over the whole view: every row with its place (from 1) in the named sort. The sort is a
    range shuffle; places are offsets of the sorted parts plus positions inside them, so no task
    holds more than its range."""
    order = df.select(key, *{_SORTS.get(sort_by, ("score", False))[0]}).orderBy(*sort_columns(sort_by, key))
    done = materialize(order.select(key, F.monotonically_increasing_id().alias("at")), "ranked")
    part = F.shiftright("at", 33)
    starts = done.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return done.join(starts, part == F.col("part")).select(F.lit(sort_by).alias("sort_by"), place.cast("bigint").alias("rank"), key)


def top_k_all_sorts(df: DataFrame, k: int, options: Sequence[str] = K.SORT_OPTIONS, key: str = "job_id") -> DataFrame:
    """O2 for several sort options in one pass over ``df``: every row is fanned out once per
    option with a uniform (number, text) sort key, and ``row_number() <= k`` per option compiles
    to a partial WindowGroupLimit, so each map task ships at most k rows per option (instead of
    one full scan of the view per option). Output: sort_by, rank (1-based), key."""
    entries = []
    for name in options:
        col, asc = _SORTS.get(name, ("score", False))
        c = F.col(col)
        if col == "company":
            num, txt = F.lit(None).cast("double"), c.cast("string")
        elif col == "date_scraped":
            days = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
            num, txt = (days if asc else -days), F.lit(None).cast("string")
        else:
            num, txt = (c.cast("double") if asc else -c.cast("double")), F.lit(None).cast("string")
        entries.append(F.struct(F.lit(name).alias("sort_by"), num.alias("n"), txt.alias("t")))
    fanned = df.select(key, F.explode(F.array(*entries)).alias("o")).select(key, "o.*")
    w = Window.partitionBy("sort_by").orderBy(F.col("n").asc_nulls_last(), F.col("t").asc_nulls_last(), F.col(key).asc())
    return fanned.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "sort_by", F.col("rank").cast("bigint").alias("rank"), key)


def _rows(weight: str | None, cond: Column | None = None) -> Column:
    """The number of rows (with ``cond``), each counted ``weight`` times if that is a column."""
    if weight is None:
        return F.count(F.lit(1)) if cond is None else F.count_if(cond)
    return F.coalesce(F.sum(F.col(weight) if cond is None else F.when(cond, F.col(weight))), F.lit(0)).cast("bigint")


def summary_metrics(view: DataFrame, spec: FilterSpec, weight: str | None = None) -> DataFrame:
    """A1-A5 in one pass over the view: total, shown, percent shown, mean shown score, shown
    rows with a salary, applied and interview counts over all rows. ``weight``, here and below, is
    the column of counts of a view in cells (``rollup.py``)."""
    flagged = shown_flag(view, spec)
    shown = F.col("shown")
    scored = shown & F.col("score").isNotNull()
    mean = F.avg(F.when(shown, F.col("score"))) if weight is None else (
        F.sum(F.when(scored, F.col("score") * F.col(weight))).cast("double") / F.sum(F.when(scored, F.col(weight))))
    return flagged.agg(
        _rows(weight).alias("total"),
        _rows(weight, shown).alias("shown"),
        mean.alias("avg_score"),
        _rows(weight, shown & (F.coalesce(F.col("salary"), F.lit("")) != "")).alias("with_salary"),
        _rows(weight, F.col("status") == "applied").alias("applied"),
        _rows(weight, F.col("status") == "interview").alias("interviews"),
    ).select(
        "total", "shown",
        (F.col("shown") * 100.0 / F.greatest(F.col("total"), F.lit(1))).alias("pct_shown"),
        F.round("avg_score", 4).alias("avg_score"),
        "with_salary", "applied", "interviews",
    ).select(
        "*",
        F.concat(whole_number_text("pct_shown"), F.lit("% of total")).alias("pct_shown_text"),
        F.coalesce(whole_number_text("avg_score"), F.lit("—")).alias("avg_score_text"),
    )


def whole_number_text(c) -> Column:
    """A number shown with 0 decimals, ties to even (62.5 -> '62'), no group separators."""
    x = F.col(c) if isinstance(c, str) else c
    return F.bround(x, 0).cast("bigint").cast("string")


def count_by_status(view: DataFrame, dim: DataFrame, weight: str | None = None) -> DataFrame:
    """A6 + J6 + X32: rows per status over the whole view; null status is not a group; the
    label comes from the dimension, else the title-cased status."""
    counts = view.where(F.col("status").isNotNull()).groupBy("status").agg(_rows(weight).alias("count"))
    return counts.join(F.broadcast(dim.select("status", "label", "emoji")), "status", "left").select(
        "status",
        F.concat_ws(" ", F.col("emoji"), F.coalesce(F.col("label"), F.initcap("status"))).alias("label"),
        "count",
    )


def count_by_source(shown: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows per source among the shown rows; null source is not a group."""
    return shown.where(F.col("source").isNotNull()).groupBy("source").agg(_rows(weight).alias("count"))


def score_histogram(shown: DataFrame, width: int = 5, lo: int = 0, hi: int = 100, weight: str | None = None) -> DataFrame:
    """Fixed-width bins ``[start, start+width)``; the top edge ``hi`` falls into the last
    bin below it. Scores outside [lo, hi] get their own bins of the same width."""
    s = F.col("score")
    start = F.when(s == hi, F.lit(hi - width)).otherwise(F.floor((s - lo) / width) * width + lo)
    return (shown.where(s.isNotNull())
            .groupBy(start.cast("bigint").alias("bin_start"))
            .agg(_rows(weight).alias("count"))
            .select("bin_start", (F.col("bin_start") + width).alias("bin_end"), "count"))


def distinct_sources(view: DataFrame, col: str = "source") -> DataFrame:
    """Distinct non-null values, sorted."""
    return view.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def board_topk(view: DataFrame, dim: DataFrame, k: int = K.BOARD_CARDS_PER_STATUS,
               key: str = "job_id") -> DataFrame:
    """W3 + X28 + X30: the first ``k`` cards per known status in the view's order
    (score desc, scrape time desc, key). ``row_number() <= k`` compiles to a partial
    WindowGroupLimit before the shuffle, so a status holding most rows still ships only
    ``k`` rows per map task."""
    order_time = "scraped_at" if "scraped_at" in view.columns else "date_scraped"
    w = Window.partitionBy("status").orderBy(F.col("score").desc_nulls_last(), F.col(order_time).desc_nulls_last(),
                                            F.col(key).asc())
    known = view.join(F.broadcast(dim.select("status")), "status", "left_semi")
    ranked = known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(
        "status", F.col("rank").cast("bigint").alias("rank"), key,
        F.coalesce(F.col("score"), F.lit(0)).cast("bigint").alias("card_score"),
        accent_band("score").alias("accent"),
        ellipsis("title", K.TITLE_ELLIPSIS_AT).alias("card_title"),
        ellipsis("company", K.COMPANY_ELLIPSIS_AT).alias("card_company"),
    )


def board_overflow(view: DataFrame, dim: DataFrame, k: int = K.BOARD_CARDS_PER_STATUS) -> DataFrame:
    """Every known status (zero-filled) with its card count and ``max(count - k, 0)``.
    A separate aggregate (not a ``count() over`` window, which would disable the group limit)."""
    counts = view.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))
    return F.broadcast(dim.select("ordinal", "status", "label")).join(counts, "status", "left").select(
        F.col("ordinal").cast("bigint").alias("ordinal"), "status", "label",
        F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint").alias("count"),
        F.greatest(F.coalesce(F.col("cnt"), F.lit(0)) - k, F.lit(0)).cast("bigint").alias("overflow"),
    )


def score_bands(view: DataFrame, key: str = "job_id", *extra: Column) -> DataFrame:
    """X27-X29 side by side, with further columns of the view."""
    return view.select(key, "score", *extra, ring_band("score").alias("ring"), accent_band("score").alias("accent"),
                       rating_band("score").alias("rating"))

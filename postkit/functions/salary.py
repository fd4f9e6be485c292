"""Salary text -> typed bounds, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postkit import constants as K
from postkit.functions.text import ColumnOrName, _c


def _squeezed(s: Column) -> Column:
    for ch in K.SALARY_REMOVED_CHARS:
        s = F.replace(s, F.lit(ch), F.lit(""))
    return s


def _text(raw: Column, group_separators: bool) -> Column:
    s = _squeezed(raw)
    return F.regexp_replace(s, r"[,.]", "") if group_separators else s


def _runs(s: Column) -> Column:
    return F.filter(F.regexp_extract_all(s, F.lit(r"(?U)[\d\s]{2,}"), 0), lambda r: F.regexp_replace(r, r"(?U)\s", "") != "")


def _numbers(runs: Column) -> Column:
    return F.transform(runs, lambda r: F.regexp_replace(r, r"(?U)^\s+|\s+$", "").try_cast("bigint"))


def _assemble(raw: Column, s: Column, runs: Column, nums: Column) -> Column:
    currency = (
        F.when(s.contains(K.SALARY_CZK_MARK), F.lit("CZK"))
        .when(s.contains(K.SALARY_EUR_MARK), F.lit("EUR"))
        .otherwise(F.lit("USD"))
    )
    period = F.when(F.lower(s).contains(K.SALARY_HOUR_MARK), F.lit("hour")).otherwise(F.lit("month"))
    has = F.coalesce(raw != "", F.lit(False)) & (F.size(runs) > 0)
    first = F.get(nums, 0)
    second = F.when(F.size(nums) > 1, F.get(nums, 1)).otherwise(first)
    return F.when(
        has,
        F.struct(
            first.alias("salary_min"), second.alias("salary_max"),
            currency.alias("salary_currency"), period.alias("salary_period"),
        ),
    )


def parse_salary(salary: ColumnOrName, group_separators: bool = False) -> Column:
    """``struct(salary_min, salary_max, salary_currency, salary_period)``; all null when
    the text is null/empty or holds no run of two or more digit-or-whitespace characters.

    Runs are found on the text after removing no-break spaces, zero-width joiners and spaces.
    min = first run, max = second run or the first. A run that does not read as an integer
    (e.g. one with an interior thin space) gives a null bound instead of an error.
    ``group_separators=True`` also removes ',' and '.' first, so ``$80,000`` reads as 80000.
    """
    raw = _c(salary)
    s = _text(raw, group_separators)
    runs = _runs(s)
    return _assemble(raw, s, runs, _numbers(runs))


def with_salary(df: DataFrame, col: str = "salary", group_separators: bool = False) -> DataFrame:
    """Add the four flat salary columns. The parse runs as staged projections (cleaned
    text, digit runs, numbers), each computed once per row; the one-element explode at the end
    is a plan barrier, so later filters on the salary columns (F11, the salary toggle) are not
    pushed below it and the parse is not re-inlined into them. Filters on other columns still
    pass below it to the scan."""
    cols = df.columns
    s1 = df.select(*cols, _text(F.col(col), group_separators).alias("_sal_s"))
    s2 = s1.select(*cols, "_sal_s", _runs(F.col("_sal_s")).alias("_sal_r"))
    s3 = s2.select(*cols, "_sal_s", "_sal_r", _numbers(F.col("_sal_r")).alias("_sal_n"))
    parsed = _assemble(F.col(col), F.col("_sal_s"), F.col("_sal_r"), F.col("_sal_n"))
    return s3.select(*cols, F.explode(F.array(parsed)).alias("_sal")).select(
        *cols, "_sal.salary_min", "_sal.salary_max", "_sal.salary_currency", "_sal.salary_period",
    )


def salary_overlap(lo: ColumnOrName, hi: ColumnOrName, currency: str = "CZK") -> Column:
    """rows not in ``currency`` (null included) pass; rows in it pass when
    ``salary_min <= hi AND salary_max >= lo`` (null bounds fail)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    in_cur = F.col("salary_currency").eqNullSafe(F.lit(currency))
    overlap = F.coalesce((F.col("salary_min") <= hi_c) & (F.col("salary_max") >= lo_c), F.lit(False))
    return (~in_cur) | overlap


def salary_bounds(df: DataFrame, currency: str = "CZK") -> DataFrame:
    """A10: one row (lo, hi) = min(salary_min), max(salary_max) over rows in ``currency``."""
    return df.where(F.col("salary_currency") == currency).agg(
        F.min("salary_min").alias("salary_lo"), F.max("salary_max").alias("salary_hi"))

import pytest
from pyspark.sql import functions as F

from postkit.functions.salary import parse_salary, salary_overlap, with_salary

NBSP, THIN = "\u00a0", "\u2009"

CASES = [
    (None, None), ("", None), ("Navrhni mzdu", None), ("5 Kč", None),
    ("80 000 – 110 000 Kč", (80000, 110000, "CZK", "month")),
    (f"80{NBSP}000 Kč / měsíc", (80000, 80000, "CZK", "month")),
    ("500 Kč/hod", (500, 500, "CZK", "hour")),
    ("1 000 € / home", (1000, 1000, "EUR", "hour")),
    ("€50.000", (50, 0, "EUR", "month")),
    ("$80,000-$110,000", (80, 0, "USD", "month")),
    ("120k USD /year", (120, 120, "USD", "month")),
    (f"60{THIN}000 Kč", (None, None, "CZK", "month")),        # unreadable run -> null bounds
    ("٤٥ EUR", (None, None, "USD", "month")),
    ("€21/hr", (21, 21, "EUR", "hour")),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_parse_salary(spark, text, expected):
    df = spark.createDataFrame([(text,)], "salary string")
    row = df.select(parse_salary("salary").alias("s")).first()["s"]
    if expected is None:
        assert row is None
    else:
        assert (row.salary_min, row.salary_max, row.salary_currency, row.salary_period) == expected


def test_group_separator_option(spark):
    df = spark.createDataFrame([("$80,000-$110,000",)], "salary string")
    row = df.select(parse_salary("salary", group_separators=True).alias("s")).first()["s"]
    assert (row.salary_min, row.salary_max) == (80000, 110000)


def test_overlap_keeps_non_czk_and_nulls(spark):
    rows = [("a", "80 000 – 110 000 Kč"), ("b", "10 000 Kč"), ("c", "€50/hr"), ("d", None), ("e", "")]
    df = with_salary(spark.createDataFrame(rows, "job_id string, salary string"))
    kept = {r.job_id for r in df.where(salary_overlap(90000, 120000)).collect()}
    assert kept == {"a", "c", "d", "e"}

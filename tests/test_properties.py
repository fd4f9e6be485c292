"""Literal expected rows, and invariants on many generated inputs at once (one Spark job each)."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postkit import constants as K
from postkit.functions.salary import parse_salary
from postkit.functions.tokens import with_token_fields
from postkit.operators.report import FilterSpec, board_overflow, board_topk, shown_flag, status_dim


# literal inputs and the expected (min, max, currency, period)
SALARIES = [
    (None, None), ("", None), ("Navrhni mzdu", None), ("5 Kč", None), ("k/r-,", None),
    ("80 000 – 110 000 Kč", (80000, 110000, "CZK", "month")),
    ("80\u00a0000 Kč / měsíc", (80000, 80000, "CZK", "month")),
    ("500 Kč/hod", (500, 500, "CZK", "hour")),
    ("1 000 € / home", (1000, 1000, "EUR", "hour")),
    ("€50.000", (50, 0, "EUR", "month")),
    ("$80,000-$110,000", (80, 0, "USD", "month")),
    ("120k USD /year", (120, 120, "USD", "month")),
    ("60\u2009000 Kč", (None, None, "CZK", "month")),
    ("30-20 €", (30, 20, "EUR", "month")),
    ("12\u200d34/H", (1234, 1234, "USD", "hour")),
    ("10 20 30 Kč 40", (102030, 40, "CZK", "month")),
]


def test_salary_literals(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SALARIES)], "i int, s string")
    for r in df.select("i", parse_salary("s").alias("p")).collect():
        got = None if r.p is None else (r.p.salary_min, r.p.salary_max, r.p.salary_currency, r.p.salary_period)
        assert got == SALARIES[r.i][1], SALARIES[r.i][0]


def test_salary_invariants(spark):
    """A text without two digits in a row once spaces are gone has no salary; a salary's bounds are
    runs of its digits; spaces between digits change nothing."""
    rnd = random.Random(7)
    pieces = ["1", "23", "456", "0", " ", "-", "–", ",", "€", "Kč", "USD", "/h", "k"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 10))) for _ in range(500)]
    df = spark.createDataFrame([(t, t.replace(" ", "")) for t in texts], "s string, t string")
    for r in df.select("s", "t", parse_salary("s").alias("p"), parse_salary("t").alias("q")).collect():
        assert r.p == r.q
        if not re.search(r"\d\d", r.t):
            assert r.p is None
        else:
            runs = [int(x) for x in re.findall(r"\d+", r.t)]
            assert r.p.salary_min in runs and r.p.salary_max in runs
            assert (r.p.salary_currency == "CZK") == ("Kč" in r.t) and (r.p.salary_period == "hour") == ("/h" in r.t)


def test_token_invariants(spark):
    """Every field is a token of the link, the joined head or its default; a link whose first
    token is a tag has no head."""
    words = ["Data", "Analyst", "BI", "HPP", "Hybrid", "Senior", "Acme", "Brno", "EUR", "60 000 Kč", "Navrhni mzdu", "Remote", "Co", "x", "Plzeň"]
    rnd = random.Random(11)
    lists = [[rnd.choice(words) for _ in range(rnd.randint(1, 7))] for _ in range(400)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(lists)], "i int, parts array<string>")
    for r in with_token_fields(df, "parts", out="t").select("i", "t").collect():
        parts, t = lists[r.i], r.t
        assert " ".join(parts).startswith(t.title) or t.title == parts[0]
        assert t.company in [*parts, ""] and t.location in [*parts, "Praha"] and t.salary in [*parts, ""]
        assert not any(tag in t.company for tag in K.LINK_TAGS)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 120) | st.none(), st.sampled_from(K.STATUSES + ["other", None])),
                min_size=1, max_size=60))
def test_shown_and_board_invariants(spark, rows):
    data = [(str(i), s, st_, "t", "c", "s", "", True) for i, (s, st_) in enumerate(rows)]
    v = spark.createDataFrame(data, "job_id string, score long, status string, title string, company string, "
                                    "source string, salary string, remote_match boolean").withColumn(
        "date_scraped", F.current_date()).withColumn("location", F.lit("x"))
    spec = FilterSpec(salary_range=None)
    flags = [r.shown for r in shown_flag(v, spec).collect()]
    assert sum(flags) <= len(flags)
    counts = {r.status: r["count"] for r in board_overflow(v, status_dim(spark)).collect()}
    per = {}
    for r in board_topk(v, status_dim(spark), k=3).collect():
        per[r.status] = per.get(r.status, 0) + 1
    for s in K.STATUSES:
        assert per.get(s, 0) == min(3, counts[s])

import pytest
from pyspark.sql import functions as F

from postkit.functions.bands import accent_band, rating_band, ring_band
from postkit.functions.text import ellipsis, is_relevant, posting_id, strip_ws
from postkit.functions.tokens import tokenize, with_token_fields

TOKENS = [
    (["Data Engineer", "Data developer", "HPP", "Hybrid", "Medior", "Acme", "Brno", "80 000 – 110 000 Kč"],
     ("Data Engineer", "Acme", "Brno", "80 000 – 110 000 Kč")),
    (["Senior Data Analyst", "HPP", "Remote", "Acme", "Praha"], ("Senior Data Analyst", "Acme", "Remote", "")),
    (["BI", "HPP", "Acme"], ("BI", "Acme", "Praha", "")),
    (["Data Analyst", "Acme", "Brno"], ("Data Analyst Acme Brno", "", "Praha", "")),
    (["Data Analyst", "HPP", "60 000 EUR"], ("Data Analyst", "60 000 EUR", "60 000 EUR", "")),
]


@pytest.mark.parametrize("parts,expected", TOKENS)
def test_classify_tokens(spark, parts, expected):
    df = spark.createDataFrame([(parts,)], "parts array<string>")
    r = with_token_fields(df, "parts", out="r").first()["r"]
    assert (r.title, r.company, r.location, r.salary) == expected


def test_tokenize(spark):
    df = spark.createDataFrame([("  Data Analyst \n\n HPP\n\tAcme  ",)], "t string")
    assert df.select(tokenize("t")).first()[0] == ["Data Analyst", "HPP", "Acme"]


def test_title_gate(spark):
    df = spark.createDataFrame([("Mobile Developer",), ("Java Developer",), ("SQL Admin",), (None,)], "title string")
    assert [r[0] for r in df.select(is_relevant("title")).collect()] == [True, False, True, False]


def test_posting_id_matches_md5(spark):
    import hashlib
    url = "https://example.com/job/1"
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(posting_id("url")).first()[0] == hashlib.md5(url.encode()).hexdigest()[:12]


def test_bands(spark):
    df = spark.createDataFrame([(75,), (74,), (50,), (49,), (None,), (90,), (30,)], "score int")
    got = [tuple(r) for r in df.select(ring_band("score"), accent_band("score"), rating_band("score")).collect()]
    assert got == [("high", "high", "good"), ("medium", "medium", "good"), ("medium", "medium", "partial"),
                   ("low", "low", "weak"), ("medium", "low", None), ("high", "high", "excellent"),
                   ("low", "low", "weak")]


def test_strip_and_ellipsis(spark):
    df = spark.createDataFrame([("  x \n", "a" * 40)], "a string, b string")
    r = df.select(strip_ws("a"), ellipsis("b", 35)).first()
    assert r[0] == "x" and r[1] == "a" * 35 + "…"

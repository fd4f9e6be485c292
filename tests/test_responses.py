import pytest

from postkit.functions.responses import json_list, parse_responses, split_parsed

OK_CASES = [
    ('{"score": 85, "skills_match": ["SQL"], "remote_match": true}', dict(score=85, match_summary="", skills_match='["SQL"]', gaps="[]", seniority_match=False, remote_match=True)),
    ('```json\n{"score": 85, "skills_match": ["SQL"], "remote_match": true}\n```', dict(score=85, skills_match='["SQL"]', remote_match=True)),
    ('Here: {"score": 70} thanks', dict(score=70)),
    ('{"score": "85"}', dict(score=85)),
    ('{"score": 85.7}', dict(score=85)),
    ('{"score": -3.9}', dict(score=-3)),
    ('{}', dict(score=0, match_summary="", skills_match="[]", gaps="[]", seniority_match=False, remote_match=False)),
    ('{"score": 120}', dict(score=120, score_in_range=False)),
    ('{"remote_match": "false"}', dict(remote_match=True)),
    ('{"match_summary": null}', dict(match_summary="")),
    ('{"score": true, "seniority_match": 1, "remote_match": []}', dict(score=1, seniority_match=True, remote_match=False)),
]

FAIL_CASES = ['{"score": 70} {x}', '{"score": "85.5"}', '{"score": null}', "[1,2]", "no json", "", '{"score": [1]}']


@pytest.mark.parametrize("text,expected", OK_CASES)
def test_parse_ok(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "id long, response string")
    p = parse_responses(df, "response", ["id"]).first()["_p"]
    assert p.error is None
    for k, v in expected.items():
        assert getattr(p, k) == v, k


@pytest.mark.parametrize("text", FAIL_CASES)
def test_parse_fail(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, response string")
    assert parse_responses(df, "response", ["id"]).first()["_p"].error is not None


def test_strict_bool(spark):
    df = spark.createDataFrame([(1, '{"remote_match": "false"}')], "id long, response string")
    assert parse_responses(df, "response", ["id"], strict_bool=True).first()["_p"].remote_match is False


def test_split_counts(spark):
    texts = [t for t, _ in OK_CASES] + FAIL_CASES
    df = spark.createDataFrame(list(enumerate(texts)), "id long, response string")
    good, bad = split_parsed(df, "response", ["id"])
    assert good.count() == len(OK_CASES) and bad.count() == len(FAIL_CASES)


def test_json_list(spark):
    df = spark.createDataFrame([('["a","b"]',), ("oops",), (None,)], "s string")
    got = [r[0] for r in df.select(json_list("s")).collect()]
    assert got == [["a", "b"], [], []]

"""Keyword index, staged loads, cells per date, stored answers and stored sort orders."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from postkit.operators import report as R
from postkit.operators.answers import AnswerStore
from postkit.operators.keyword_index import with_keyword_count
from postkit.operators.rollup import WEIGHT, Rollup, touched_dates
from postkit.operators.sorted_view import SortedView
from postkit.operators.staged import StagedTable, staged_load
from postkit.session import scratch_path

AT = dt.datetime(2024, 2, 1)


# ---- keyword index ------------------------------------------------------------------------

TEXTS = ["Data Analyst", "data analyst", "BI", "b", "", None, "Ůř žluť", "aaaa", "no match here", "the end (x)"] + ["hot title data"] * 300
WORDS = ["data", "DATA", "bi", "b", "ůř", "žluť", "aaa", "aaaaa", "zzz", "(x)", "", None, "t d", "analyst"]


def plain_count(text, words):
    return sum(w in text.lower() for w in {w.lower() for w in words if w}) if text else 0


@pytest.mark.parametrize("words", [WORDS, ["data", "analyst"], ["b"], []])
def test_keyword_index_equals_plain(spark, words):
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "id int, title string, text string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = with_keyword_count(rows, table, "title").collect()
    assert sorted((r.id, r.n_keywords, r.text) for r in got) == [(i, plain_count(t, words), "kept") for i, t in enumerate(TEXTS)]


def test_keyword_index_takes_thousands_of_keywords(spark):
    words = [f"{a}{b}{c}x{i % 7}" for i, (a, b, c) in enumerate((a, b, c) for a in "abcdefghijklmnopqrstuv" for b in "abcdefghijklmnopqrstuv" for c in "abcdefghijklmnopqrstuv")]
    titles = [f"{w} and {words[-i]}" for i, w in enumerate(words[::40], 1)]
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    out = with_keyword_count(rows, spark.createDataFrame([(w,) for w in words], "keyword string"), "title")
    assert len(words) > 10_000 and {r.title: r.n_keywords for r in out.collect()} == {t: plain_count(t, words) for t in titles}


# ---- staged loads -------------------------------------------------------------------------

BATCH = [("a", "A", 1), ("a", "A", 2), ("b", "B", 3), (None, "lost", 4), ("", "lost too", 5)]
POSTING = "job_id string, title string, score long, scraped_at timestamp"


def batch(spark, rows):
    return spark.createDataFrame([(*r, dt.datetime(2024, 1, 1 + (r[2] or 0) % 3)) for r in rows], POSTING)


def test_a_load_killed_between_its_writes_counts_once(spark, monkeypatch):
    table = StagedTable(spark, scratch_path(spark, "staged"))
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "ckpt")
    batch(spark, BATCH).write.parquet(f"{landing}/d1")

    def run():
        staged_load(spark, f"{landing}/*", POSTING, table, checkpoint, AT)

    for step in ("postkit.operators.staged.dedup_first", None):      # killed after the rejects, then before the commit
        with monkeypatch.context() as m:
            if step:
                m.setattr(step, lambda *a: 1 / 0)
            else:
                m.setattr(StagedTable, "commit", lambda *a: 1 / 0)
            with pytest.raises(Exception, match="division by zero"):
                run()
        assert table.committed() == [] and table.rows().count() == table.rejects().count() == 0
    run()
    want = sorted([("a", "A"), ("b", "B")]), sorted([("lost", "missing job_id"), ("lost too", "missing job_id")])
    for _ in range(2):                                               # also after a run without anything new
        assert (sorted((r.job_id, r.title) for r in table.rows().collect()), sorted((r.title, r.error) for r in table.rejects().collect())) == want
        run()
    assert table.load(batch(spark, [("z", "Z", 1)]), 0, AT) == (2, 1, 2)                # the committed epoch's counts, nothing written
    assert table.load(batch(spark, [("b", "late", 1), ("c", "C", 1), (None, "x", 1)]), 1, AT) == (1, 1, 1)
    assert StagedTable(spark, table.path, "other").load(batch(spark, [("c", "late", 1), ("d", "D", 2)]), 0, AT) == (1, 1, 0)
    assert sorted(r.job_id for r in table.rows().collect()) == ["a", "b", "c", "d"] and table.rejects().count() == 3


# ---- cells per date -----------------------------------------------------------------------

def postings(spark, rows):
    """(job_id, day, score, status, salary)"""
    return spark.createDataFrame([(i, "t", "c", "Praha", "u", "s", sal, dt.datetime(2024, 1, day, 5), score, "", "[]", "[]", None, score % 2 == 0 if score else None, st)
                                  for i, day, score, st, sal in rows],
                                 "job_id string, title string, company string, location string, url string, source string, salary string, scraped_at timestamp, score long,"
                                 " match_summary string, skills_match string, gaps string, seniority_match boolean, remote_match boolean, status string")


def log(spark, rows):
    return spark.createDataFrame([(i, s, dt.datetime(2024, 2, 1, n), n) for i, s, n in rows], "job_id string, status string, updated_at timestamp, seq long")


def metrics(spark, rollup, whole):
    spec = R.FilterSpec()
    got = R.summary_metrics(rollup.cells(), spec, WEIGHT).collect(), sorted(R.count_by_status(rollup.cells(), R.status_dim(spark), WEIGHT).collect())
    want = R.summary_metrics(whole, spec).collect(), sorted(R.count_by_status(whole, R.status_dim(spark)).collect())
    assert got == want


def test_only_touched_dates_are_counted_anew(spark):
    from postkit.functions.salary import with_salary
    from postkit.operators.current import current_postings

    old = [("a", 1, 80, "new", "30000 - 60000 Kč"), ("b", 1, 55, "new", ""), ("c", 2, None, "saved", None), ("d", 3, 90, "new", "€40/hr")]
    rollup, none = Rollup(spark, scratch_path(spark, "rollup")), log(spark, [])
    with pytest.raises(ValueError, match="nothing was refreshed"):
        rollup.cells()
    rollup.refresh(postings(spark, old), none)
    metrics(spark, rollup, with_salary(current_postings(postings(spark, old), none)))
    changes = log(spark, [("d", "applied", 1), ("nobody", "applied", 2)])
    dates = touched_dates(postings(spark, old), changes=changes)
    assert dates == [dt.date(2024, 1, 3)]
    rollup.refresh(postings(spark, old), changes, dates)
    rollup.refresh(postings(spark, old), changes, [])
    new = [r for r in old if r[1] != 2] + [("e", 4, 70, "new", "1")]                   # day 2 lost its only row
    rollup.refresh(postings(spark, new), changes, touched_dates(postings(spark, new), batch=postings(spark, new[-1:])) + [dt.date(2024, 1, 2)])
    metrics(spark, rollup, with_salary(current_postings(postings(spark, new), changes)))
    held = spark.read.parquet(f"{rollup.path}/cells/refresh=1").select("date_scraped").distinct().collect()
    assert [r[0] for r in held] == [dt.date(2024, 1, 3)]
    spark.createDataFrame([], "date_scraped date").write.mode("error").parquet(f"{rollup.path}/cells/refresh=3")    # a refresh killed before its dates
    metrics(spark, rollup, with_salary(current_postings(postings(spark, new), changes)))


# ---- stored answers -----------------------------------------------------------------------

def scorer(folder, good=True):
    """A scorer that notes every prompt it is asked."""
    def factory():
        import json
        import os
        import uuid

        def score(pdf):
            for p in pdf["prompt"]:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(p))
            return [json.dumps({"score": 50}) if good or p == "p1" else "nothing" for p in pdf["prompt"]]
        os.makedirs(folder, exist_ok=True)
        return score
    return factory


def asked(folder):
    return sorted(p.read_text() for p in folder.iterdir()) if folder.exists() else []


def test_equal_prompts_are_asked_once_over_all_runs(spark, tmp_path):
    store = AnswerStore(spark, scratch_path(spark, "answers"))
    runs = [[("a", "p1"), ("b", "p1"), ("c", "p2"), ("d", None)], [("e", "p1"), ("f", "p2"), ("g", "p3"), ("h", "p3")]]
    for i, (rows, good) in enumerate(zip(runs, (False, True))):
        out = store.answer(spark.createDataFrame(rows, "job_id string, prompt string"), scorer(str(tmp_path / f"r{i}"), good)).collect()
        assert sorted(r.job_id for r in out) == [k for k, _ in rows]
    assert asked(tmp_path / "r0") == ["None", "p1", "p2"] and asked(tmp_path / "r1") == ["p2", "p3"] and store.called == 2
    store.stored().write.mode("append").parquet(store.path)                          # a run that was killed and repeated
    out = store.answer(spark.createDataFrame([("x", "p3"), ("y", "p3")], "job_id string, prompt string"), scorer(str(tmp_path / "r2")))
    assert out.count() == 2 and store.called == 0 and asked(tmp_path / "r2") == []


# ---- stored sort orders -------------------------------------------------------------------

def test_a_page_reads_the_parts_that_hold_it(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("job_id"), F.when(F.col("id") % 3 > 0, F.lit(70)).otherwise(F.col("id") % 50).cast("long").alias("score"))
    view = SortedView.write(rows, scratch_path(spark, "sorted"), "Score (high→low)", 10)
    want = [r.job_id for r in R.sort_postings(rows, "Score (high→low)").collect()]
    assert [(r.rank, r.job_id) for r in view.all().orderBy("rank").collect()] == list(enumerate(want, 1))
    for page, size in ((1, 30), (4, 77), (67, 30), (1, 5000)):
        got = view.page(page, size)
        assert [(r.rank, r.job_id) for r in got.collect()] == list(enumerate(want, 1))[(page - 1) * size:page * size]
    assert view.page(99, 30).collect() == []
    plan = view.page(4, 77)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_part", plan)
    assert SortedView.write(rows.limit(0), scratch_path(spark, "sorted"), "Score (high→low)", 4).all().count() == 0


def test_grams_of_a_long_text_take_one_pass(spark):
    import time
    from postkit.operators import keyword_index as I
    df = spark.range(1).select(F.concat(F.repeat(F.lit("abcdefghij"), 60000), F.lit("x\U0001F600y\nz")).alias("text"))
    at = time.time()
    got = df.select(I._grams(F.col("text"), 3).alias("g"), I._grams(F.col("text"), 1).alias("one")).first()
    assert time.time() - at < 20
    long = "abcdefghij" * 60000 + "x\U0001F600y\nz"
    assert sorted(got.g) == sorted({long[i:i + 3] for i in range(len(long) - 2)}) and sorted(got.one) == sorted(set(long))
    assert spark.createDataFrame([("ab",), ("",)], "text string").select(F.size(I._grams(F.col("text"), 3)).alias("n")).where("n > 0").count() == 0


def test_a_text_meets_its_candidates_at_once(spark, monkeypatch):
    from postkit.operators import keyword_index as I
    real = F.xxhash64
    monkeypatch.setattr(I.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))                  # all texts clash
    texts = spark.createDataFrame([("SQL and Python",), ("python only",), ("none",), (None,)], "text string")
    words = spark.createDataFrame([("sql",), ("Python",), ("py",), ("only",)], "keyword string")
    got = {r.text: r.n_keywords for r in I.keyword_hits(texts, words).collect()}
    monkeypatch.setattr(I.F, "xxhash64", real)
    assert got == {"sql and python": 3, "python only": 3}

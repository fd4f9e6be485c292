import datetime as dt

from pyspark.sql import functions as F

from postkit.operators.current import apply_session_overrides, current_postings, latest_by_key
from postkit.operators.dedup import dedup_first, dedup_last, ingest_counters, insert_new, with_arrival_rank
from postkit.operators.warehouse import append_overrides, load_new, normalise_rows, quarantine_path, read_overrides, read_quarantine, read_table
from postkit.session import scratch_path

RAW = "job_id string, title string, source string, query_rank int, pos int"


def test_first_source_wins(spark):
    rows = [("x", "from linkedin", "linkedin", 0, 0), ("x", "from remotive", "remotive", 0, 3),
            ("y", "only", "jobstack", 1, 0)]
    df = with_arrival_rank(spark.createDataFrame(rows, RAW), ["remotive", "the_muse", "jobs_cz", "linkedin", "jobstack"])
    out = {r.job_id: r.title for r in dedup_first(df, "job_id", ["source_rank", "query_rank", "pos"]).collect()}
    assert out == {"x": "from remotive", "y": "only"}


def test_dedup_last_and_store_wins(spark):
    store = spark.createDataFrame([("x", "stored", 0)], "job_id string, title string, seq int")
    batch = spark.createDataFrame([("x", "new x", 1), ("z", "z1", 2), ("z", "z2", 3)], "job_id string, title string, seq int")
    new = {r.job_id: r.title for r in insert_new(store, batch, "job_id", ["seq"]).collect()}
    assert new == {"z": "z1"}
    last = {r.job_id: r.title for r in dedup_last(batch, "job_id", ["seq"]).collect()}
    assert last == {"x": "new x", "z": "z2"}


def test_dedup_is_idempotent_and_partition_invariant(spark):
    df = spark.range(0, 5000).select((F.col("id") % 97).cast("string").alias("job_id"), F.col("id").alias("seq"))
    once = dedup_first(df, "job_id", ["seq"])
    twice = dedup_first(once, "job_id", ["seq"])
    wide = dedup_first(df.repartition(16), "job_id", ["seq"])
    narrow = dedup_first(df.coalesce(1), "job_id", ["seq"])
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect())) == sorted(map(tuple, wide.collect())) == sorted(map(tuple, narrow.collect()))
    assert len(a) == 97 and all(int(s) == int(j) for j, s in a)


def test_hot_key_counters(spark):
    # one key holds a third of all rows
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("job_id"),
        F.col("id").alias("seq"), (F.col("id") % 2).cast("string").alias("source"))
    c = {r.source: (r.fetched, r.inserted, r.skipped) for r in ingest_counters(df, "job_id", ["seq"]).collect()}
    assert c["0"][0] + c["1"][0] == 3000
    assert c["0"][1] + c["1"][1] == 2001


def test_load_twice_inserts_nothing_and_quarantines_null_keys(spark):
    rows = [("a", "t", "2024-01-02T10:00:00+00:00", 80), ("b", "t", "2024-01-03T10:00:00+00:00", None),
            (None, "no key", "2024-01-03T10:00:00+00:00", 10), ("a", "dup in batch", "2024-01-04T10:00:00+00:00", 1)]
    df = spark.createDataFrame(rows, "job_id string, title string, scraped_at string, score long")
    path = scratch_path(spark, "wh-test")
    assert load_new(spark, df, path, "2024-02-01 00:00:00") == (2, 1, 1)
    assert load_new(spark, df, path, "2024-02-01 00:00:00") == (0, 3, 1)
    assert [(r.title, r.error) for r in read_quarantine(spark, path).collect()] == [("no key", "missing job_id")] * 2
    t = read_table(spark, path)
    assert t.count() == 2
    assert {r.title for r in t.where("job_id = 'a'").collect()} == {"t"}
    assert set(r.scraped_date for r in t.collect()) == {dt.date(2024, 1, 2), dt.date(2024, 1, 3)}
    _, bad = normalise_rows(df, "2024-02-01 00:00:00")
    assert bad.count() == 1


def _posts(spark):
    rows = [("a", 90, "new", dt.datetime(2024, 1, 1)), ("b", 50, "new", dt.datetime(2024, 1, 2)),
            ("c", None, "saved", dt.datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "job_id string, score long, status string, scraped_at timestamp")
    for c in ["title", "company", "location", "url", "source", "salary", "match_summary", "skills_match", "gaps"]:
        df = df.withColumn(c, F.lit("x"))
    return df.withColumn("seniority_match", F.lit(True)).withColumn("remote_match", F.lit(False))


def test_current_view_overrides(spark):
    t = dt.datetime(2024, 1, 5)
    log = spark.createDataFrame([
        ("a", "applied", t, 1), ("a", "interview", t + dt.timedelta(hours=1), 2),   # later wins
        ("b", "rejected", t, 7), ("b", "replied", t, 3),                            # tie -> higher seq
        ("zzz", "applied", t, 9),                                                   # unknown id -> no row
    ], "job_id string, status string, updated_at timestamp, seq long")
    v = current_postings(_posts(spark), log)
    got = [(r.job_id, r.status) for r in v.collect()]
    assert got == [("a", "interview"), ("b", "rejected"), ("c", "saved")]      # ordered by score desc, nulls last
    none = {r.job_id: r.status for r in current_postings(_posts(spark), None).collect()}
    assert none == {"a": "new", "b": "new", "c": "saved"}
    # arrival order of the log does not matter
    shuffled = current_postings(_posts(spark), log.orderBy(F.rand(7)).repartition(5))
    assert [(r.job_id, r.status) for r in shuffled.collect()] == got


def test_session_overrides(spark):
    v = current_postings(_posts(spark), None, ordered=False)
    s = spark.createDataFrame([("b", "ignored", 1), ("b", "saved", 2)], "job_id string, status string, seq long")
    got = {r.job_id: r.status for r in apply_session_overrides(v, s).collect()}
    assert got == {"a": "new", "b": "saved", "c": "saved"}


def test_latest_by_key_hot_key(spark):
    df = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("cold")).alias("k"),
                                      F.col("id").alias("ts"), (F.col("id") * 7).alias("v"))
    got = {r.k: r.v for r in latest_by_key(df, "k", ["ts"], ["v"]).collect()}
    assert got == {"hot": 29997 * 7, "cold": 29999 * 7}


def test_null_order_and_null_key_keep_a_survivor(spark):
    rows = [("a", None, "x1"), ("a", 5, "x2"), (None, 1, "n1"), (None, 2, "n2"), ("b", None, "only")]
    df = spark.createDataFrame(rows, "job_id string, seq int, v string")
    got = sorted((r.job_id or "", r.v) for r in dedup_first(df, "job_id", ["seq"]).collect())
    # min() ignores nulls, so 'a' keeps seq 5; a key whose order is all null keeps that row
    assert got == [("", "n1"), ("a", "x2"), ("b", "only")]


def test_load_keeps_one_row_of_an_id_that_ties(spark):
    rows = [(f"k{i % 5}", "t", "2024-01-02T10:00:00+00:00", i) for i in range(10)]
    df = spark.createDataFrame(rows, "job_id string, title string, scraped_at string, score long")
    path = scratch_path(spark, "wh-ties")
    assert load_new(spark, df, path, "2024-02-01 00:00:00") == (5, 5, 0)
    assert sorted((r.job_id, r.score) for r in read_table(spark, path).collect()) == [(f"k{i}", i) for i in range(5)]


def test_rejected_overrides_are_kept(spark):
    path = scratch_path(spark, "log")
    append_overrides(spark, spark.createDataFrame([("a", "saved"), (None, "saved"), ("b", None)], "job_id string, status string"), path)
    assert read_overrides(spark, path).count() == 1
    assert spark.read.parquet(quarantine_path(path)).count() == 2


def test_dedup_of_columns_without_an_order(spark):
    df = spark.createDataFrame([("a", 2, {"x": 1}), ("a", 1, {"y": 2}), ("b", 5, None)], "k string, o int, m map<string,int>")
    assert sorted((r.k, r.o, str(r.m)) for r in dedup_first(df, "k", ["o"]).collect()) == [("a", 1, "{'y': 2}"), ("b", 5, "None")]


def test_counters_reduce_and_missing_columns_take_defaults(spark):
    df = spark.createDataFrame([("a", 1, "s"), ("a", 2, "t"), (None, 3, "s"), (None, 4, "s")], "job_id string, seq int, source string")
    got = {r.source: (r.fetched, r.inserted, r.skipped) for r in ingest_counters(df, "job_id", ["seq"], "source", df.where("job_id = 'zzz'")).collect()}
    assert got == {"s": (3, 2, 1), "t": (1, 0, 1)}
    good, _ = normalise_rows(spark.createDataFrame([("a",)], "job_id string"), "2024-02-01 00:00:00")
    r = good.first()
    assert (r.title, r.salary, r.status, r.skills_match, r.gaps, r.score, r.remote_match) == ("", "", "new", "[]", "[]", None, None)
    assert r.scraped_at == r.loaded_at == dt.datetime(2024, 2, 1)

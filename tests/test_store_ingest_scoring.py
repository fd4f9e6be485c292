import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postkit.operators.ingest import extract_all, merge_into_store
from postkit.operators.scoring import (build_prompts, keyword_scorer, load_profile, score_postings, score_with,
                                       type_responses)
from postkit.schemas import RAW_COLUMNS, RAW_POSTING
from postkit.session import scratch_path
from postkit.sources.payloads import keywords_from_table, mentions_any, search_specs
from postkit.sources.store import read_store, write_store


def _raw(spark, rows):
    return spark.createDataFrame([r + ("",) * (9 - len(r)) for r in rows], RAW_POSTING)


def test_store_policies_and_versions(spark):
    root = scratch_path(spark, "store")
    assert read_store(spark, root).count() == 0
    assert read_store(spark, root, on_missing="skip") is None
    with pytest.raises(FileNotFoundError):
        read_store(spark, root, on_missing="error")
    v1 = write_store(_raw(spark, [("a", "t1")]), root)
    v2 = write_store(_raw(spark, [("a", "t1"), ("b", "t2")]), root)
    assert v1.endswith("version=000001") and v2.endswith("version=000002")
    assert sorted(r.job_id for r in read_store(spark, root).collect()) == ["a", "b"]


def test_legacy_json_array_last_duplicate_wins(spark, tmp_path):
    p = tmp_path / "raw_jobs.json"
    p.write_text(json.dumps([{"job_id": "a", "title": "first"}, {"job_id": "b", "title": "b"},
                             {"job_id": "a", "title": "last"}]))
    got = {r.job_id: r.title for r in read_store(spark, str(p)).collect()}
    assert got == {"a": "last", "b": "b"}


def test_split_jsonl_last_duplicate_wins(spark):
    """A JSON-lines file read in many splits: position is (file, split start, row), so the last
    occurrence of an id wins however the scan packs the splits into partitions."""
    n = 4000
    rows = [{"job_id": f"j{i % 50}", "title": f"t{i}"} for i in range(n)]
    path = scratch_path(spark, "split") + ".jsonl"
    spark.createDataFrame(pd.DataFrame(rows)).coalesce(1).write.json(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_store(spark, path, schema="job_id string, title string")
        got = {r.job_id: r.title for r in df.collect()}
        splits = spark.read.json(path).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits > 1
    assert got == {f"j{k}": f"t{max(i for i in range(n) if i % 50 == k)}" for k in range(50)}


def test_ingest_all_sources_first_wins(spark):
    rem = json.dumps({"jobs": [{"url": "https://same/1", "title": "Data Analyst", "company_name": "R"},
                               {"url": "https://r/2", "title": "Chef"}]})
    li = """<ul class="jobs-search__results-list"><li><h3 class="base-search-card__title">Data Analyst LI</h3>
            <a class="base-card__full-link" href="https://same/1?trk=1">x</a></li></ul>"""
    landed = spark.createDataFrame([
        ("linkedin", "data analyst BI", 1, li),
        ("remotive", "data analyst", 1, rem),
        ("remotive", "not a configured query", 1, rem),
    ], "source string, query string, page_no int, body string")
    ext = extract_all(spark, landed, search_specs(spark), scraped_at=F.lit("2024-01-01T00:00:00+00:00"))
    store = spark.createDataFrame([], RAW_POSTING)
    new, counters = merge_into_store(store, ext)
    rows = {r.job_id: (r.source, r.title) for r in new.collect()}
    assert list(rows.values()) == [("remotive", "Data Analyst")]
    c = {r.source: (r.fetched, r.inserted, r.skipped) for r in counters.collect()}
    assert c == {"remotive": (1, 1, 0), "linkedin": (1, 0, 1)}
    assert new.columns == RAW_COLUMNS
    again, counters = merge_into_store(new, ext)
    assert again.count() == 0 and all(r.inserted == 0 for r in counters.collect())


def test_scorer_row_isolation_and_quarantine(spark):
    def factory():
        def score(pdf):
            if any("boom" in p for p in pdf["prompt"]):
                raise RuntimeError("model error")
            return pd.Series(['{"score": 70}' if "ok" in p else "not json" for p in pdf["prompt"]])
        return score
    prompts = spark.createDataFrame([("a", "ok"), ("b", "boom"), ("c", "meh")], "job_id string, prompt string")
    good, bad = type_responses(score_with(prompts, factory))
    assert [(r.job_id, r.score) for r in good.collect()] == [("a", 70)]
    assert sorted((r.job_id, r.error.split(":")[0]) for r in bad.collect()) == [
        ("b", "RuntimeError"), ("c", "no JSON object")]


def test_score_postings_end_to_end(spark):
    raw = _raw(spark, [("a", "Data Analyst", "Acme", "Remote", "SQL and Python, remote"),
                       ("b", "Chef", "Food", "Praha", "cooking"),
                       ("c", "BI Developer", "X", "Brno", "dashboards")])
    done = spark.createDataFrame([("c",)], "job_id string")
    good, bad = score_postings(raw, done, load_profile(spark), keyword_scorer(["sql", "python", "dbt"]))
    r = good.collect()
    assert [(x.job_id, x.score, x.skills_match, x.remote_match, x.status) for x in r] == [
        ("a", 66, '["sql","python"]', True, "new")]
    assert bad.count() == 0


def test_prompt_layout(spark):
    raw = _raw(spark, [("a", "T", "C", "L", "D" * 3100, "u", "S", "")])
    p = build_prompts(raw, load_profile(spark), "job_id").first().prompt
    assert p.startswith("CANDIDATE PROFILE:\n") and "\nSalary: \nSource: S\n\nDescription:\n" in p
    assert p.endswith("D" * 3000 + "\n\nScore this job for the candidate.")
    p2 = build_prompts(raw.drop("salary"), load_profile(spark), "job_id").first().prompt
    assert "\nSalary: not specified\n" in p2


def test_keyword_table_gate(spark):
    kw = spark.createDataFrame([("SQL",), ("bi",), (None,), ("",), ("c++",)], "keyword string")
    df = spark.createDataFrame([("Mobile dev",), ("Chef",), ("C++ lead",), ("cc",), (None,)], "title string")
    assert [r[0] for r in df.select(mentions_any("title", keywords_from_table(kw))).collect()] == [True, False, True, False, False]
    assert [r[0] for r in df.select(mentions_any("title", keywords_from_table(kw.limit(0)))).collect()] == [False] * 5


def test_unfinished_store_version_is_not_read(spark):
    root = scratch_path(spark, "store")
    write_store(_raw(spark, [(str(i), "t") for i in range(5)]), root)
    _raw(spark, []).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/version=000002")
    assert read_store(spark, root).count() == 5
    assert write_store(_raw(spark, [("a", "t")]), root).endswith("version=000003")
    assert read_store(spark, root).count() == 1


def test_profile_is_one_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one profile \n")
    assert build_prompts(_raw(spark, [("a", "t")]), load_profile(spark, str(tmp_path))).first().prompt.startswith("CANDIDATE PROFILE:\none profile\n")
    (tmp_path / "b.txt").write_text("another")
    with pytest.raises(Exception, match="(?i)more than one row"):
        build_prompts(_raw(spark, [("a", "t")]), load_profile(spark, str(tmp_path))).collect()


def test_each_posting_is_one_prompt_and_tasks_are_many(spark, tmp_path):
    raw = _raw(spark, [(f"j{i % 20}", "Data Analyst", f"c{i // 20}") for i in range(40)])        # every id twice
    seen = str(tmp_path)

    def factory():
        def score(pdf):
            import uuid
            open(f"{seen}/{uuid.uuid4().hex}", "w").write("\n".join(["x"] * len(pdf)))           # one file per batch
            return pd.Series(['{"score": 5}' if i % 4 else "no answer" for i in range(len(pdf))])
        return score
    good, bad = score_postings(raw, raw.limit(0).select("job_id"), load_profile(spark), factory, parallelism=4)
    n_good, n_bad = good.count(), bad.count()
    assert n_good + n_bad == 20 and good.select("job_id").distinct().count() == n_good
    files = [f.read_text() for f in tmp_path.iterdir()]
    assert sum(len(t.splitlines()) for t in files) == 20 and len(files) > 1


def test_failed_scores_are_retried_without_new_files(spark):
    from postkit.streaming.incremental import incremental_score
    rows = _raw(spark, [(f"j{i}", "Data Analyst", "C", "L", "sql") for i in range(20)])
    landing, store, scored, bad, ckpt = (scratch_path(spark, n) for n in ("landing", "raw", "scored", "bad", "ckpt"))
    rows.write.parquet(f"{landing}/d1")

    def failing():
        def score(pdf):
            raise RuntimeError("no service")
        return score
    run = lambda f: incremental_score(spark, f"{landing}/*", rows.schema, store, scored, bad, ckpt, load_profile(spark), f)
    assert run(failing) == (0, 20)
    assert run(keyword_scorer(["sql"])) == (20, 0)
    assert run(keyword_scorer(["sql"])) == (0, 0)
    assert spark.read.parquet(scored).count() == 20 and spark.read.parquet(bad).where("run = 0").count() == 20


def test_caps_hold_per_search_and_null_is_no_cap(spark):
    card = '<article class="SearchResultCard"><h2 class="SearchResultCard__title"><a href="u{p}-{i}">data {i}</a></h2></article>'
    page = lambda p: "".join(card.format(p=p, i=i) for i in range(30))
    landed = spark.createDataFrame([("jobs_cz", q, p, page(f"{q}{p}")) for q in "abc" for p in (1, 2)], "source string, query string, page_no int, body string")
    specs = search_specs(spark, [("jobs_cz", "a", "", 5, True), ("jobs_cz", "b", "", 40, True), ("jobs_cz", "c", "", None, True)])
    got = extract_all(spark, landed, specs, scraped_at=F.lit("2024-01-01"))
    counts = {r.query_rank: r["count"] for r in got.groupBy("query_rank").count().collect()}
    assert counts == {0: 5, 1: 40, 2: 60}


def test_deep_and_broken_pages(spark):
    from postkit.sources import html as H
    deep = "<ul>" + "<li><p>" * 5000 + "<a href='/it-job/1'>x</a>"
    df = spark.createDataFrame([(1, deep), (2, None), (3, "<a href='/it-job/2'>no list</a>")], "page_id int, html string")
    got = H.extract_cards(df, "links", ["page_id"]).collect()
    assert [(r.page_id, r.href, r.error) for r in got] == [(1, "/it-job/1", None)]
    assert H.page_text(df, ["page_id"]).where("page_id = 1").first().text == "x"


def test_a_page_that_cannot_be_read_is_one_error_row(spark):
    from postkit.sources import html as H
    df = spark.createDataFrame([(1, b"\xff\xfe"), (2, b"<ul><li><a href='/it-job/2'>ok</a></li></ul>")], "page_id int, html binary")
    cards = H.extract_cards(df, "links", ["page_id"])
    assert {(r.page_id, r.href, r.error is None) for r in cards.collect()} == {(1, None, False), (2, None, False)}
    assert H.card_errors(cards, ["page_id"]).count() == 2


def test_scratch_is_cleaned_on_request(spark, monkeypatch):
    from postkit import session as S
    monkeypatch.setattr(S, "_SCRATCH", [])
    df = S.materialize(spark.range(5), "mine")
    path = S._SCRATCH[0]
    assert df.count() == 5 and S.clean_scratch(spark) == 1 and S.clean_scratch(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_checkpoint_folder_is_required_off_local():
    from postkit.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_pages_are_neither_broadcast_nor_gathered_by_search(spark, monkeypatch):
    from postkit.sources import payloads as P
    pages = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(500))).alias("page_no"))
    landed = pages.select(F.lit("remotive").alias("source"), F.when(F.col("page_no") % 100 == 0, "off").otherwise("q").alias("query"),
                          "page_no", F.repeat(F.lit("x"), 4000).alias("body"))
    specs = spark.createDataFrame([("remotive", "q", "", 7, True, 0, 0), ("remotive", "off", "", 7, False, 0, 1)], search_specs(spark).schema)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = P.with_enabled_specs(landed, specs)
    assert "BuildRight" in plan(few) and "BuildLeft" not in plan(few)
    monkeypatch.setattr(P, "BROADCAST_SPECS", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = P.with_enabled_specs(landed, specs)
        assert "BroadcastHashJoin" not in plan(many)
        assert many.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 495
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert many.columns == few.columns and many.count() == 495
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_events_are_dealt_before_bodies_are_made(spark, tmp_path):
    from postkit.plans import fixtures as X
    spark.range(400).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.col("id").alias("user_id"), F.lit(1.0).alias("value"),
                            F.lit('{"k": 1}').alias("props")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    landed = X.landed_remotive(spark, str(tmp_path))
    assert landed.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and landed.select("event_id").distinct().count() == 400

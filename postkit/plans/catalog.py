"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each reads whole driver tables through the adapters in ``fixtures.py`` and runs one or more
library operators. ``oracle.py`` holds the equivalent DuckDB SQL under the same names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postkit import constants as K
from postkit.functions.responses import json_list, split_parsed
from postkit.functions.salary import parse_salary, salary_bounds, with_salary
from postkit.functions.text import (absolutise, is_relevant, page_url, posting_id, remote_rule, search_match, strip_query,
                                   truncate_chars)
from postkit.functions.tokens import with_token_fields
from postkit.operators import report as R
from postkit.operators.answers import AnswerStore
from postkit.operators.current import apply_session_overrides, current_postings, latest_by_key
from postkit.operators.dedup import dedup_first, ingest_counters, merged_store
from postkit.operators.ingest import extract_all, ingest_ledger, merge_into_store, rejected, rejected_counts
from postkit.operators.key_index import KeyIndex
from postkit.operators.keyword_index import with_keyword_count
from postkit.operators.rollup import WEIGHT, Rollup, touched_dates
from postkit.operators.scoring import (build_prompts, keyword_scorer, lexical_score, load_profile, score_postings,
                                      scoring_counters, select_unscored)
from postkit.operators.sorted_view import stored_orders
from postkit.operators.staged import StagedTable
from postkit.operators.warehouse import (append_overrides, load_new, normalise_rows, read_overrides,
                                        read_quarantine, read_table as read_warehouse)
from postkit.plans import fixtures as X
from postkit.session import literal_frame, materialize, read_table, scratch_path
from postkit.sources.html import (chain_stops, cut_page_chain, extract_cards, extract_jobs_cz, extract_jobstack, extract_linkedin,
                                  heading, nav_links_capped, page_text)
from postkit.sources.payloads import (extract_muse, extract_remotive, json_field, keywords_from_table, mentions_any,
                                      search_specs, with_enabled_specs)
from postkit.sources.store import read_store, write_store

# query parameters (shared with oracle.py)
SEARCH_QUERY = "machinery|remote"
SALARY_WINDOW = (20000, 30075)                                  # cuts at every scale
GATE_KEYWORDS = ["tion", "data"]
PROFILE_SKILLS = ["the", "and", "tion"]
VOCABULARY = ["the", "and", "tion", "der", "ment", "ing", "sch", "que"]
EARLY = "doc_id % 3 < 2"                                        # the rows of the first drop or store
NAV_CAP = 3
SORT_TOP = 20
FIXED_SCRAPED_AT = "2024-01-01T00:00:00+00:00"


def _view(spark, sf, ordered=False, with_scraped_at=False):
    return current_postings(X.postings_b(spark, sf), X.overrides_l(spark, sf), ordered=ordered,
                            with_scraped_at=with_scraped_at)


def _salaried_view(spark, sf):
    return with_salary(_view(spark, sf))


DEFAULT_SPEC = R.FilterSpec()                                   # the dashboard defaults
STACK_SPEC = R.FilterSpec(remote_only=True, salary_only=True)   # + both toggles
ALL_SPEC = R.FilterSpec(min_score=None, statuses=[], salary_range=None)


def q_current_postings(spark, sf):
    return current_postings(X.postings_b(spark, sf), X.overrides_l(spark, sf), ordered=True)


def q_session_overrides(spark, sf):
    v = apply_session_overrides(_view(spark, sf), X.session_overrides_n(spark, sf))
    return v.select("job_id", "status", "score")


def q_search_filter(spark, sf):
    v = _view(spark, sf)
    return v.where(search_match(["title", "company", "location"], SEARCH_QUERY)).select(
        "job_id", "title", "company", "location")


def q_filter_stack(spark, sf):
    return R.apply_filters(_salaried_view(spark, sf), STACK_SPEC).select(
        "job_id", "score", "status", "salary_min", "salary_max", "salary_currency")


def q_sort_options(spark, sf):
    shown = R.apply_filters(_salaried_view(spark, sf), DEFAULT_SPEC).select("job_id", "score", "date_scraped", "company")
    return R.top_k_all_sorts(shown, SORT_TOP)


def q_salary_parse(spark, sf):
    b = X.postings_b(spark, sf)
    return b.select("job_id", "salary", parse_salary("salary").alias("s")).select(
        "job_id", "salary", "s.salary_min", "s.salary_max", "s.salary_currency", "s.salary_period")


def q_salary_overlap(spark, sf):
    v = _salaried_view(spark, sf)
    spec = R.FilterSpec(min_score=None, statuses=[], salary_range=SALARY_WINDOW)
    return R.apply_filters(v, spec).select("job_id", "salary_currency", "salary_min", "salary_max")


def q_salary_bounds(spark, sf):
    return salary_bounds(_salaried_view(spark, sf))


def q_summary_metrics(spark, sf):
    return R.summary_metrics(_salaried_view(spark, sf), DEFAULT_SPEC)


def q_count_by_status(spark, sf):
    return R.count_by_status(_view(spark, sf), R.status_dim(spark))


def q_count_by_source(spark, sf):
    return R.count_by_source(R.apply_filters(_salaried_view(spark, sf), DEFAULT_SPEC))


def q_score_histogram(spark, sf):
    return R.score_histogram(R.apply_filters(_view(spark, sf), ALL_SPEC))


def q_board_topk(spark, sf):
    return R.board_topk(_view(spark, sf, with_scraped_at=True), R.status_dim(spark))


def q_board_overflow(spark, sf):
    return R.board_overflow(_view(spark, sf), R.status_dim(spark))


def q_score_bands(spark, sf):
    v = _view(spark, sf)
    return R.score_bands(v, "job_id", remote_rule("location", "source").alias("remote_rule"))


def q_distinct_sources(spark, sf):
    return R.distinct_sources(read_table(spark, sf, "documents"))


def q_posting_id(spark, sf):
    g = read_table(spark, sf, "pages")
    href = F.regexp_extract("html", r'<li><a href="([^"]*)">', 1)
    clean = strip_query("url")
    return g.select(
        "page_id", posting_id("url").alias("job_id"), clean.alias("url_clean"), posting_id(clean).alias("clean_id"),
        absolutise(href, K.JOBSTACK_BASE_URL).alias("first_link"),
        page_url(clean, (F.col("page_id") % 3 + 1)).alias("page_url"))


def q_title_gate(spark, sf):
    d = X.raw_d(spark, sf)
    return d.select("doc_id", "title", is_relevant("title", GATE_KEYWORDS).alias("relevant"),
                    is_relevant("title").alias("relevant_default"))


def q_keyword_table_gate(spark, sf):
    """The title gate with keywords from a table (the distinct document languages), read as
    one scalar array inside the plan."""
    keywords = keywords_from_table(read_table(spark, sf, "documents").select(F.col("lang").alias("keyword")))
    return X.raw_d(spark, sf).select("doc_id", "title", mentions_any("title", keywords).alias("relevant"))


def q_dedup_first(spark, sf):
    return dedup_first(X.raw_d(spark, sf), "job_id", ["doc_id"]).select("job_id", "doc_id", "source")


def q_ingest_counters(spark, sf):
    return ingest_counters(X.raw_d(spark, sf), "job_id", ["doc_id"], "source")


def q_insert_new(spark, sf):
    d = X.raw_d(spark, sf).select("job_id", "doc_id")
    store = materialize(dedup_first(d.where(EARLY), "job_id", ["doc_id"]), "store")
    return merged_store(store, d.where(f"not ({EARLY})"), "job_id", ["doc_id"])


STORE_COLUMNS = ["job_id", "doc_id", "title", "source"]


def q_store_versions(spark, sf):
    """K1 + S1 + J4 + U-2: version 1 of a store = first arrivals of the early documents; the
    later documents are merged in (stored rows win) and written as version 2 next to it; the
    reader takes the newest version."""
    d = X.raw_d(spark, sf).select(*STORE_COLUMNS)
    root = scratch_path(spark, "store")
    write_store(dedup_first(d.where(EARLY), "job_id", ["doc_id"]), root)
    current = read_store(spark, root, schema=d.schema)
    merged = merged_store(current, d.where(f"not ({EARLY})"), "job_id", ["doc_id"])
    write_store(merged.drop("is_new"), root)
    return read_store(spark, root, schema=d.schema)


def q_store_last_wins(spark, sf):
    """S1 on a legacy JSON-lines store landed in document order: the last occurrence of an id
    in the file order wins."""
    d = X.raw_d(spark, sf).select(*STORE_COLUMNS)
    path = scratch_path(spark, "legacy") + ".jsonl"
    d.orderBy("doc_id").write.json(path)
    return read_store(spark, path, schema=d.schema)


def _labels_as_scored(spark, sf):
    return read_table(spark, sf, "labels").select("doc_id")


def q_select_unscored(spark, sf):
    return select_unscored(X.raw_d(spark, sf), _labels_as_scored(spark, sf), key="doc_id",
                           keywords=GATE_KEYWORDS).select("doc_id", "job_id", "title")


def q_unscored_indexed(spark, sf):
    """J2 by the bucketed index of the scored ids: the stored side is not shuffled."""
    index = KeyIndex(spark, scratch_path(spark, "index"), f"{sf}/labels.parquet", "doc_id", buckets=8, key_type="bigint")
    index.refresh()
    return select_unscored(X.raw_d(spark, sf), index, key="doc_id", keywords=GATE_KEYWORDS).select("doc_id", "job_id", "title")


def q_scoring_counters(spark, sf):
    return scoring_counters(X.raw_d(spark, sf), _labels_as_scored(spark, sf), key="doc_id", keywords=GATE_KEYWORDS)


def q_truncate_text(spark, sf):
    d = read_table(spark, sf, "documents")
    t = truncate_chars("text")
    return d.select("doc_id", F.md5(t).alias("desc_md5"), F.length(t).cast("bigint").alias("desc_chars"))


def q_build_prompts(spark, sf):
    d = X.raw_d(spark, sf).drop("salary")        # no salary field -> 'not specified'
    p = build_prompts(d, load_profile(spark), key="doc_id")
    return p.select("doc_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_chars"))


def q_lexical_score(spark, sf):
    d = read_table(spark, sf, "documents")
    s = lexical_score(d, "text", PROFILE_SKILLS, VOCABULARY)
    return s.select("doc_id", "score", "n_skills", "n_gaps")


def q_parse_responses(spark, sf):
    good, _ = split_parsed(X.responses_r(spark, sf), "response", ["response_id"])
    return good.drop("score_in_range")


def q_quarantine(spark, sf):
    _, bad = split_parsed(X.responses_r(spark, sf), "response", ["response_id"])
    return bad.select("response_id", "error")


def q_skills_array(spark, sf):
    b = X.postings_b(spark, sf)
    arr = json_list("skills_match")
    return b.select("job_id", F.size(arr).cast("bigint").alias("n_skills"), F.get(arr, 0).alias("first_skill"))


def q_normalise_rows(spark, sf):
    b = X.postings_b(spark, sf).drop("loaded_at")
    good, _ = normalise_rows(b, X.LOADED_AT)
    return good.select("job_id", "title", "company", "location", "url", "source", "salary",
                       F.col("scraped_at").cast("string").alias("scraped_at"), "score", "status",
                       "skills_match", "gaps", "seniority_match", "remote_match")


def q_load_twice(spark, sf):
    """K3 run three times into a fresh table: part, all, all again. Returns the table."""
    b = X.postings_b(spark, sf).drop("loaded_at")
    path = scratch_path(spark, "warehouse")
    load_new(spark, b.where(F.col("score") < 40), path, X.LOADED_AT)
    load_new(spark, b, path, X.LOADED_AT)
    load_new(spark, b, path, X.LOADED_AT)
    return read_warehouse(spark, path).select("job_id", "salary", "status", "scraped_date")


def q_load_indexed(spark, sf):
    """K3 as in ``load_twice``, each load finding the stored ids in a bucketed index that catches up with the table."""
    b, path = X.postings_b(spark, sf).drop("loaded_at"), scratch_path(spark, "warehouse")
    index = KeyIndex(spark, scratch_path(spark, "index"), path, buckets=8)
    for part in (b.where(F.col("score") < 40), b, b):
        load_new(spark, part, path, X.LOADED_AT, index)
    return read_warehouse(spark, path).select("job_id", "salary", "status", "scraped_date")


def q_json_props(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", json_field("props", "$.k", "bigint").alias("k"))


def q_remotive_extract(spark, sf):
    r = extract_remotive(X.landed_remotive(spark, sf), scraped_at=F.lit(FIXED_SCRAPED_AT))
    return r.select("event_id", F.col("pos").cast("bigint").alias("pos"), "job_id", "title", "company", "location",
                    F.length("description").cast("bigint").alias("desc_chars"), "salary")


def q_muse_extract(spark, sf):
    m = extract_muse(X.landed_muse(spark, sf), scraped_at=F.lit(FIXED_SCRAPED_AT))
    return m.select("conv_id", "turn", "job_id", "title", "company", "location",
                    F.md5("description").alias("desc_md5"))


def q_html_heading(spark, sf):
    g = read_table(spark, sf, "pages")
    return g.select("page_id", heading("html").alias("heading"))


def q_nav_cards_capped(spark, sf):
    return nav_links_capped(read_table(spark, sf, "pages"), "page_id", NAV_CAP)


def q_nav_cards_parsed(spark, sf):
    g = read_table(spark, sf, "pages")
    cards = extract_cards(g, "links", ["page_id"], "html", cap=NAV_CAP, selector="nav ul li a")
    return cards.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", F.col("text").alias("text"))


def q_html_text(spark, sf):
    t = page_text(read_table(spark, sf, "pages"), ["page_id"])
    return t.select("page_id", F.length("text").cast("bigint").alias("text_chars"), F.md5("text").alias("text_md5"))


def q_page_chain_cut(spark, sf):
    return cut_page_chain(X.page_chain_c(spark, sf), "category", max_pages=K.JOBSTACK_MAX_PAGES).select("category", "page_no")


def q_page_chain_all(spark, sf):
    return cut_page_chain(X.page_chain_c(spark, sf), "category").select("category", "page_no")


def q_link_tokens(spark, sf):
    t = X.link_tokens_t(spark, sf)
    return with_token_fields(t.select("p_partkey", "parts"), "parts", out="r").select(
        "p_partkey", "r.title", "r.company", "r.location", "r.salary")


def _scoring_inputs(spark, sf):
    # D without copies' labels: scored set = labelled doc ids; key = doc_id
    return X.raw_d(spark, sf), _labels_as_scored(spark, sf), load_profile(spark)


SCORE_COLUMNS = ["doc_id", "score", "skills_match", "gaps", "seniority_match", "remote_match", "status", "date_scraped"]


def q_score_postings(spark, sf):
    raw, done, profile = _scoring_inputs(spark, sf)
    good, _bad = score_postings(raw, done, profile, keyword_scorer(PROFILE_SKILLS), key="doc_id",
                                keywords=GATE_KEYWORDS)
    return good.select(*SCORE_COLUMNS)


def _incremental_score(spark, sf, scorers):
    from postkit.streaming.incremental import run_incremental_score
    raw, done, profile = _scoring_inputs(spark, sf)
    todo = raw.join(done, "doc_id", "left_anti")
    return run_incremental_score(spark, todo, F.expr(EARLY), profile, scorers, "doc_id", GATE_KEYWORDS)


def q_incremental_score(spark, sf):
    out, _ = _incremental_score(spark, sf, [keyword_scorer(PROFILE_SKILLS)] * 2)
    return out.select(*SCORE_COLUMNS)


def failing_scorer():
    """A scorer that answers no prompt from an even-numbered source."""
    def factory():
        score = keyword_scorer(PROFILE_SKILLS)()

        def some(pdf):
            even = pdf["prompt"].str.extract(r"Source: src(\d+)", expand=False).astype(int) % 2 == 0
            return score(pdf).where(~even.to_numpy(), "no answer")
        return some
    return factory


def q_score_retry(spark, sf):
    """K2: a first run whose scorer fails for some postings, a second one that retries them with
    the second drop, and a third with nothing left: scored and failed of each run."""
    _, counts = _incremental_score(spark, sf, [failing_scorer(), keyword_scorer(PROFILE_SKILLS), keyword_scorer(PROFILE_SKILLS)])
    return literal_frame(spark, [(i + 1, c.scored, c.failed) for i, c in enumerate(counts)], "run bigint, scored bigint, failed bigint")


def q_score_retry_store(spark, sf):
    """The scores after those runs."""
    out, _ = _incremental_score(spark, sf, [failing_scorer(), keyword_scorer(PROFILE_SKILLS), keyword_scorer(PROFILE_SKILLS)])
    return out.select(*SCORE_COLUMNS)


def q_warehouse_current(spark, sf):
    """E3 + E4 end to end: load postings into a fresh partitioned table (K4, K3), append the
    status log (K5), then read the current view from storage (S5, S7, W1, J1)."""
    table, log = scratch_path(spark, "warehouse"), scratch_path(spark, "overrides")
    assert read_overrides(spark, log) is None                     # no log yet -> base statuses
    load_new(spark, X.postings_b(spark, sf).drop("loaded_at"), table, X.LOADED_AT)
    append_overrides(spark, X.overrides_l(spark, sf), log)
    return current_postings(read_warehouse(spark, table), read_overrides(spark, log), ordered=False).select(
        "job_id", "status", "score", "salary", "date_scraped")


JOBS_CZ_CAP = 3


def q_jobs_cz_cards(spark, sf):
    out = extract_jobs_cz(X.landed_jobs_cz(spark, sf), cap=JOBS_CZ_CAP, scraped_at=F.lit(FIXED_SCRAPED_AT))
    return out.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "job_id", "title", "company", "location",
                      "salary", "url")


def q_linkedin_cards(spark, sf):
    out = extract_linkedin(X.landed_linkedin(spark, sf), scraped_at=F.lit(FIXED_SCRAPED_AT))
    return out.select("c_custkey", F.col("pos").cast("bigint").alias("pos"), "job_id", "title", "company", "location",
                      "url")


def _jobstack(spark, sf, max_pages):
    out = extract_jobstack(X.landed_jobstack(spark, sf), scraped_at=F.lit(FIXED_SCRAPED_AT), max_pages=max_pages)
    return out.select(F.col("query").alias("category"), F.col("page_no").cast("bigint").alias("page_no"),
                      F.col("pos").cast("bigint").alias("pos"), "job_id", "title", "company", "location", "salary")


def q_jobstack_links(spark, sf):
    return _jobstack(spark, sf, K.JOBSTACK_MAX_PAGES)


def q_jobstack_links_all(spark, sf):
    return _jobstack(spark, sf, None)


def q_jobs_cz_cards_all(spark, sf):
    out = extract_jobs_cz(X.landed_jobs_cz(spark, sf), scraped_at=F.lit(FIXED_SCRAPED_AT))
    return out.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "job_id", "title", "company", "location", "salary", "url")


def q_cards_by_spec_cap(spark, sf):
    """J10 + W4: pages of three searches with caps 5, 50 and none, each cap over all pages of its search."""
    landed = with_enabled_specs(X.landed_pages_jobs_cz(spark, sf), search_specs(spark, X.CAP_BY_SEARCH))
    out = extract_jobs_cz(landed, scraped_at=F.lit(FIXED_SCRAPED_AT), cap_col="cap")
    return out.select("query", F.col("page_no").cast("bigint").alias("page_no"), F.col("pos").cast("bigint").alias("pos"), "job_id", "title")


def q_nav_cards_all(spark, sf):
    cards = extract_cards(read_table(spark, sf, "pages"), "links", ["page_id"], "html", selector="nav ul li a")
    return cards.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "text")


def _ingest(spark, sf):
    """All five sources into a store that already has the Muse postings of each first turn."""
    extracted = extract_all(spark, X.landed_all(spark, sf), X.specs_all(spark, sf), scraped_at=F.lit(FIXED_SCRAPED_AT), max_pages=K.JOBSTACK_MAX_PAGES)
    c = read_table(spark, sf, "conversations").where("turn = 0")
    store = c.select(posting_id(F.concat(F.lit("https://muse.example/"), F.col("conv_id").cast("string"), F.lit("/0"))).alias("job_id"))
    return merge_into_store(store, extracted)


def q_ingest_all(spark, sf):
    return _ingest(spark, sf)[0].select("job_id", "title", "company", "source", F.length("description").cast("bigint").alias("desc_chars"))


def q_ingest_all_counters(spark, sf):
    return _ingest(spark, sf)[1]


def _broken_ledger(spark, sf):
    return ingest_ledger(spark, X.landed_broken(spark, sf), X.specs_all(spark, sf), scraped_at=F.lit(FIXED_SCRAPED_AT), max_pages=K.JOBSTACK_MAX_PAGES)


def q_ingest_quarantine(spark, sf):
    """Q1 + F2 over all sources, some of their pages damaged: everything that gave no posting, and why."""
    return rejected(_broken_ledger(spark, sf)).select(
        "source", "query", F.col("page_no").cast("bigint").alias("page_no"), F.col("pos").cast("bigint").alias("pos"), "reason", "title", "url")


def q_ingest_reasons(spark, sf):
    """A9 at ingest: postings (no reason) and rejected rows per source and reason."""
    return rejected_counts(_broken_ledger(spark, sf))


def q_page_chain_stops(spark, sf):
    """Where the reader of each category stops, and why."""
    return chain_stops(X.page_chain_c(spark, sf), "category", max_pages=K.JOBSTACK_MAX_PAGES)


def q_load_duplicates(spark, sf):
    """K3 + Q2 on a batch with repeated ids and rows without one: the table, then the quarantine."""
    path = scratch_path(spark, "warehouse")
    for _ in range(2):
        load_new(spark, X.repeated_b(spark, sf), path, X.LOADED_AT)
    kept = read_warehouse(spark, path).select(F.lit("table").alias("part"), "job_id", "title", "score")
    return kept.unionByName(read_quarantine(spark, path).select(F.col("error").alias("part"), "job_id", "title", "score"))


def q_load_counters(spark, sf):
    """A9 at the load: inserted, skipped and quarantined rows of two loads of that batch."""
    path = scratch_path(spark, "warehouse")
    runs = [load_new(spark, X.repeated_b(spark, sf), path, X.LOADED_AT) for _ in range(2)]
    return literal_frame(spark, [(i + 1, *r) for i, r in enumerate(runs)], "run bigint, inserted bigint, skipped bigint, quarantined bigint")


def q_source_filter(spark, sf):
    """F7."""
    return R.apply_filters(_salaried_view(spark, sf), R.FilterSpec(source="BUILDING", min_score=None)).select("job_id", "source", "score")


def q_sort_all(spark, sf):
    """O2 over the whole shown view, all four sorts, every row with its place."""
    shown = materialize(R.apply_filters(_salaried_view(spark, sf), DEFAULT_SPEC).select("job_id", "score", "date_scraped", "company"), "shown")
    return reduce(DataFrame.unionByName, [R.ranked(shown, name) for name in K.SORT_OPTIONS])


def q_latest_override(spark, sf):
    return latest_by_key(X.overrides_l(spark, sf), "job_id", ["updated_at", "seq"], ["status"])


def q_incremental_dedup(spark, sf):
    from postkit.streaming.incremental import run_incremental_dedup
    return run_incremental_dedup(spark, X.raw_d(spark, sf).select("job_id", "doc_id", "source"), F.expr(EARLY))


def q_incremental_load(spark, sf):
    from postkit.streaming.incremental import run_incremental_load
    b = X.postings_b(spark, sf).drop("loaded_at")
    return run_incremental_load(spark, b, X.LOADED_AT).select("job_id", "salary", "status", "scraped_date")


def q_override_stream(spark, sf):
    from postkit.streaming.incremental import run_override_stream
    return run_override_stream(spark, X.overrides_l(spark, sf))


def q_override_compacted(spark, sf):
    """ST4 + W1 from a snapshot and the epochs after it."""
    from postkit.streaming.changelog import read_latest, run_compacted_log
    return read_latest(spark, run_compacted_log(spark, X.overrides_l(spark, sf))).select("job_id", "status")


def q_stateful_dedup(spark, sf):
    """ST1 by keyed state: three drops in three runs, the last one holding all rows again."""
    from postkit.streaming.keyed_state import run_stateful_dedup
    rows = X.raw_d(spark, sf).select("job_id", "doc_id", "source")
    return run_stateful_dedup(spark, rows, [F.col("doc_id") % 3 == 1, F.col("doc_id") % 3 == 0, F.lit(True)])


def q_keyword_index_gate(spark, sf):
    """J9 with a large keyword table (every two neighbouring words of the benchmark, and the languages): how many of them each
    title mentions, by the inverted index of trigrams."""
    words = F.split(F.lower("text"), " ")
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", words[i], words[i + 1]))
    phrases = read_table(spark, sf, "benchmark").where(F.size(words) > 1).select(F.explode(pairs).alias("keyword"))
    keywords = phrases.unionByName(read_table(spark, sf, "documents").select(F.col("lang").alias("keyword")))
    return with_keyword_count(X.raw_d(spark, sf), keywords, "title").select("doc_id", "title", "n_keywords")


def _staged_loads(spark, sf):
    """A first load killed before its commit, its replay, a replay of the committed epoch, and a second epoch."""
    table, batch = StagedTable(spark, scratch_path(spark, "staged")), X.repeated_b(spark, sf)
    table.stage(batch, 0, X.LOADED_AT)
    counts = [table.load(batch, epoch, X.LOADED_AT) for epoch in (0, 0, 1)]
    return table, counts


def q_load_staged(spark, sf):
    """K3 + Q2: table and quarantine after those loads; each epoch counts once."""
    table, _ = _staged_loads(spark, sf)
    kept = table.rows().select(F.lit("table").alias("part"), "job_id", "title", "score")
    return kept.unionByName(table.rejects().select(F.col("error").alias("part"), "job_id", "title", "score"))


def q_load_staged_counters(spark, sf):
    """What each of those loads reports."""
    _, counts = _staged_loads(spark, sf)
    return literal_frame(spark, [(i + 1, *c) for i, c in enumerate(counts)], "run bigint, inserted bigint, skipped bigint, quarantined bigint")


def _rollup_cells(spark, sf):
    """Cells of the current view after two loads and two status batches, each refreshing only the dates it touched."""
    b, log = X.postings_b(spark, sf).drop("loaded_at"), X.overrides_l(spark, sf)
    path, overrides = scratch_path(spark, "warehouse"), scratch_path(spark, "overrides")
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    first, early = F.coalesce(F.col("score") < 40, F.lit(False)), F.col("updated_at") < F.lit("2024-01-15")
    load_new(spark, b.where(first), path, X.LOADED_AT)
    append_overrides(spark, log.where(early), overrides)
    rollup.refresh(read_warehouse(spark, path), read_overrides(spark, overrides))
    load_new(spark, b.where(~first), path, X.LOADED_AT)
    rollup.refresh(read_warehouse(spark, path), read_overrides(spark, overrides), touched_dates(read_warehouse(spark, path), batch=b.where(~first)))
    append_overrides(spark, log.where(~early), overrides)
    rollup.refresh(read_warehouse(spark, path), read_overrides(spark, overrides), touched_dates(read_warehouse(spark, path), changes=log.where(~early)))
    return rollup.cells()


def q_summary_rollup(spark, sf):
    """A1-A5 from the cells."""
    return R.summary_metrics(_rollup_cells(spark, sf), DEFAULT_SPEC, WEIGHT)


def q_status_rollup(spark, sf):
    """A6 from the cells."""
    return R.count_by_status(_rollup_cells(spark, sf), R.status_dim(spark), WEIGHT)


def q_source_rollup(spark, sf):
    """A7 from the cells."""
    return R.count_by_source(R.apply_filters(_rollup_cells(spark, sf), DEFAULT_SPEC), WEIGHT)


def q_histogram_rollup(spark, sf):
    """A8 from the cells."""
    return R.score_histogram(R.apply_filters(_rollup_cells(spark, sf), ALL_SPEC), weight=WEIGHT)


def _answered(spark, sf):
    """Two scoring runs over one store of answers: the early postings, then all of them."""
    raw, done, profile = _scoring_inputs(spark, sf)
    store, runs = AnswerStore(spark, scratch_path(spark, "answer-store")), []
    for rows in (raw.where(EARLY), raw):
        good, _ = score_postings(rows, done, profile, keyword_scorer(PROFILE_SKILLS), key="doc_id", keywords=GATE_KEYWORDS, answers=store)
        runs.append((good, store.called))
    return runs


def q_score_answers(spark, sf):
    """The scores of the second run, mostly from stored answers."""
    return _answered(spark, sf)[1][0].select(*SCORE_COLUMNS)


def q_answer_calls(spark, sf):
    """Postings scored and prompts put to the scorer by each of those runs."""
    return literal_frame(spark, [(i + 1, good.count(), called) for i, (good, called) in enumerate(_answered(spark, sf))], "run bigint, scored bigint, called bigint")


SORTED_PARTS = 16
SORTED_PAGE = (2, 10)


def _stored_orders(spark, sf):
    shown = materialize(R.apply_filters(_salaried_view(spark, sf), DEFAULT_SPEC).select("job_id", "score", "date_scraped", "company"), "shown")
    return stored_orders(shown, K.SORT_OPTIONS, SORTED_PARTS)


def q_sorted_pages(spark, sf):
    """O1 + O2: every row's place in the four stored orders."""
    return reduce(DataFrame.unionByName, [v.all().select(F.lit(name).alias("sort_by"), "rank", "job_id") for name, v in _stored_orders(spark, sf).items()])


def q_sorted_page(spark, sf):
    """O1 + O2: one page of each stored order, read from the parts that hold it."""
    return reduce(DataFrame.unionByName, [v.page(*SORTED_PAGE).select(F.lit(name).alias("sort_by"), "rank", "job_id") for name, v in _stored_orders(spark, sf).items()])


QUERIES = {
    "current_postings": q_current_postings,
    "session_overrides": q_session_overrides,
    "search_filter": q_search_filter,
    "filter_stack": q_filter_stack,
    "sort_options": q_sort_options,
    "salary_parse": q_salary_parse,
    "salary_overlap": q_salary_overlap,
    "salary_bounds": q_salary_bounds,
    "summary_metrics": q_summary_metrics,
    "count_by_status": q_count_by_status,
    "count_by_source": q_count_by_source,
    "score_histogram": q_score_histogram,
    "board_topk": q_board_topk,
    "board_overflow": q_board_overflow,
    "score_bands": q_score_bands,
    "distinct_sources": q_distinct_sources,
    "posting_id": q_posting_id,
    "title_gate": q_title_gate,
    "dedup_first": q_dedup_first,
    "ingest_counters": q_ingest_counters,
    "keyword_table_gate": q_keyword_table_gate,
    "insert_new": q_insert_new,
    "store_versions": q_store_versions,
    "store_last_wins": q_store_last_wins,
    "select_unscored": q_select_unscored,
    "scoring_counters": q_scoring_counters,
    "truncate_text": q_truncate_text,
    "build_prompts": q_build_prompts,
    "lexical_score": q_lexical_score,
    "parse_responses": q_parse_responses,
    "quarantine": q_quarantine,
    "skills_array": q_skills_array,
    "normalise_rows": q_normalise_rows,
    "load_twice": q_load_twice,
    "load_indexed": q_load_indexed,
    "unscored_indexed": q_unscored_indexed,
    "json_props": q_json_props,
    "remotive_extract": q_remotive_extract,
    "muse_extract": q_muse_extract,
    "html_heading": q_html_heading,
    "nav_cards_capped": q_nav_cards_capped,
    "nav_cards_parsed": q_nav_cards_parsed,
    "html_text": q_html_text,
    "page_chain_cut": q_page_chain_cut,
    "link_tokens": q_link_tokens,
    "score_postings": q_score_postings,
    "incremental_score": q_incremental_score,
    "warehouse_current": q_warehouse_current,
    "jobs_cz_cards": q_jobs_cz_cards,
    "linkedin_cards": q_linkedin_cards,
    "jobstack_links": q_jobstack_links,
    "latest_override": q_latest_override,
    "incremental_dedup": q_incremental_dedup,
    "incremental_load": q_incremental_load,
    "override_stream": q_override_stream,
    "override_compacted": q_override_compacted,
    "stateful_dedup": q_stateful_dedup,
    "page_chain_all": q_page_chain_all,
    "jobstack_links_all": q_jobstack_links_all,
    "jobs_cz_cards_all": q_jobs_cz_cards_all,
    "cards_by_spec_cap": q_cards_by_spec_cap,
    "nav_cards_all": q_nav_cards_all,
    "ingest_all": q_ingest_all,
    "ingest_all_counters": q_ingest_all_counters,
    "ingest_quarantine": q_ingest_quarantine,
    "ingest_reasons": q_ingest_reasons,
    "page_chain_stops": q_page_chain_stops,
    "load_duplicates": q_load_duplicates,
    "load_counters": q_load_counters,
    "source_filter": q_source_filter,
    "sort_all": q_sort_all,
    "score_retry": q_score_retry,
    "score_retry_store": q_score_retry_store,
    "keyword_index_gate": q_keyword_index_gate,
    "load_staged": q_load_staged,
    "load_staged_counters": q_load_staged_counters,
    "summary_rollup": q_summary_rollup,
    "status_rollup": q_status_rollup,
    "source_rollup": q_source_rollup,
    "histogram_rollup": q_histogram_rollup,
    "score_answers": q_score_answers,
    "answer_calls": q_answer_calls,
    "sorted_pages": q_sorted_pages,
    "sorted_page": q_sorted_page,
}

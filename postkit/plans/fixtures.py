"""Adapters that turn the driver tables into the posting data model.

Every adapter reads a whole table and derives its columns with built-in expressions, so
the work grows with the table. The SQL twins used by the oracle live in ``oracle.py``.

B = postings from ``customer``; L = status log from ``events``; D = raw postings from
``documents``; G = landed pages from ``pages``; T = link tokens from ``part``; R = scorer
answers from ``events``; C = page chains from ``conversations``; P = Remotive-shaped and
Muse-shaped landed JSON payloads from ``events`` / ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkit.functions.text import first_line, posting_id
from postkit.session import read_table
from postkit.sources.html import dealt
from postkit.sources.payloads import search_specs

LOADED_AT = "2024-02-01 00:00:00"
UNKNOWN_STATUS = "archived"                                     # not in the status dimension (J6)
STATUS_BY_MOD7 = ["new", "saved", "applied", "replied", "interview", "rejected", "ignored"]


def _case_mod(col, n: int, values: list[str]):
    expr = None
    for i, v in enumerate(values[:-1]):
        expr = (F.when(col % n == i, F.lit(v)) if expr is None else expr.when(col % n == i, F.lit(v)))
    return expr.otherwise(F.lit(values[-1]))


def postings_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B: warehouse-shaped postings (one per customer)."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    score = F.when(k % 11 == 0, F.lit(None)).otherwise(F.floor(F.col("c_acctbal") / 100)).cast("bigint")
    salary = (F.when(k % 4 == 0, F.lit(None).cast("string"))
              .when(k % 4 == 1, F.lit(""))
              .when(k % 4 == 2, F.concat((k + 30000).cast("string"), F.lit(" - "), (k * 2 + 60000).cast("string"),
                                         F.lit(" Kč")))
              .otherwise(F.concat(F.lit("€"), (k % 80 + 20).cast("string"), F.lit("/hr"))))
    skills = (F.when(k % 3 == 0, F.lit('["SQL","Python"]')).when(k % 3 == 1, F.lit("[]"))
              .otherwise(F.lit("not json")))
    return c.select(
        k.cast("string").alias("job_id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("company"),
        F.when(k % 2 == 0, F.lit("Remote, EU")).otherwise(F.lit("Praha")).alias("location"),
        F.concat(F.lit("https://jobs.example/"), k.cast("string")).alias("url"),
        F.col("c_mktsegment").alias("source"),
        salary.alias("salary"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(c_custkey % 30, c_custkey % 24, 0, 0)")
        .alias("scraped_at"),
        score.alias("score"),
        F.concat(F.lit("Segment "), F.col("c_mktsegment")).alias("match_summary"),
        skills.alias("skills_match"),
        F.lit('["Spark"]').alias("gaps"),
        (score > 60).alias("seniority_match"),
        F.when(k % 13 == 0, F.lit(None).cast("boolean")).otherwise(k % 2 == 0).alias("remote_match"),
        F.when(k % 50 == 49, F.lit(UNKNOWN_STATUS)).otherwise(_case_mod(k, 7, STATUS_BY_MOD7)).alias("status"),
        F.lit(LOADED_AT).cast("timestamp").alias("loaded_at"),
    )


def overrides_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: append-only status log (one override per event)."""
    e = read_table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "purchase", "applied")
              .when(F.col("event_type") == "signup", "interview")
              .when(F.col("event_type") == "error", "rejected")
              .when(F.col("event_type") == "view", "saved")
              .otherwise("replied"))
    return e.select(F.col("user_id").cast("string").alias("job_id"), status.alias("status"),
                    F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))


def session_overrides_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session override frame from ``nation``: every nation key is marked 'saved'."""
    n = read_table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("job_id"), F.lit("saved").alias("status"))


def raw_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: raw postings from documents; id = md5(text)[:12]; arrival order = doc_id."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        posting_id("text").alias("job_id"),
        F.col("doc_id"),
        first_line("text").alias("title"),
        F.col("source").alias("company"),
        F.col("lang").alias("location"),
        F.col("text").alias("description"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source"),
        F.lit("").alias("salary"),
        F.lit("2024-01-01T00:00:00+00:00").alias("scraped_at"),
        F.col("n_chars"),
    )


REMOTIVE_TITLES = {"view": "Data Analyst", "click": "Java Developer", "signup": "Mobile Developer",
                   "error": "SQL Admin", "purchase": "Chef"}


def landed_remotive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: one Remotive-shaped JSON response per event, two jobs each; 'view' events omit the
    location key; the second job has a description longer than 3000 characters. The events are dealt over the cluster before
    their long bodies are made: a file of them is a split or two whatever its number of rows."""
    e = dealt(read_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", "props"))
    k = F.get_json_object("props", "$.k")
    title = None
    for et, t in REMOTIVE_TITLES.items():
        title = F.when(F.col("event_type") == et, F.lit(t)) if title is None else title.when(F.col("event_type") == et, F.lit(t))
    title = title.otherwise(F.lit("Analyst"))
    loc = F.when(F.col("event_type") == "view", F.lit("")).otherwise(
        F.concat(F.lit(', "candidate_required_location": "'), F.col("event_type"), F.lit('"')))
    job1 = F.concat(
        F.lit('{"url": "https://remotive.example/'), F.col("user_id").cast("string"), F.lit("/"), k,
        F.lit('", "title": "'), title, F.lit(" "), k, F.lit('", "company_name": "Co'), F.col("user_id").cast("string"),
        F.lit('"'), loc, F.lit(', "description": "short", "salary": "'), F.floor("value").cast("bigint").cast("string"),
        F.lit('"}'))
    job2 = F.concat(
        F.lit('{"url": "https://remotive.example/e/'), F.col("event_id").cast("string"),
        F.lit('", "title": "Data Engineer", "company_name": "Big", "description": "'),
        F.repeat(F.lit("ab"), 1600), F.lit('"}'))
    body = F.concat(F.lit('{"jobs": ['), job1, F.lit(", "), job2, F.lit("]}"))
    return e.select(F.lit("remotive").alias("source"), F.col("event_type").alias("query"),
                    F.lit(1).alias("page_no"), F.col("event_id"), body.alias("body"))


def landed_muse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: one Muse-shaped JSON response per conversation turn (escaped by ``to_json``).
    The contents end with named, decimal and doubly escaped character references and a script.
    turn % 3 == 0 -> no locations; turn % 5 == 4 -> empty landing page (skipped)."""
    c = read_table(spark, sf_dir, "conversations")
    t = F.col("turn")
    locs = (F.when(t % 3 == 0, F.array().cast("array<struct<name:string>>"))
            .when(t % 3 == 1, F.array(F.struct(F.col("role").alias("name"))))
            .otherwise(F.array(F.struct(F.col("role").alias("name")), F.struct(F.lit("Brno").alias("name")))))
    url = F.when(t % 5 == 4, F.lit("")).otherwise(
        F.concat(F.lit("https://muse.example/"), F.col("conv_id").cast("string"), F.lit("/"), t.cast("string")))
    job = F.struct(
        first_line("text").alias("name"),
        F.concat(F.lit("<div><p>"), F.col("text"), F.lit("</p> caf&eacute; &#8211; Plze&#328; &amp;lt; <script>x</script></div>")).alias("contents"),
        F.struct(F.col("role").alias("name")).alias("company"),
        F.struct(url.alias("landing_page")).alias("refs"),
        locs.alias("locations"),
    )
    body = F.to_json(F.struct(F.array(job).alias("results")))
    return c.select(F.lit("the_muse").alias("source"), F.col("conv_id").cast("string").alias("query"),
                    (t + 1).cast("int").alias("page_no"), F.col("conv_id"), F.col("turn"), body.alias("body"))


def link_tokens_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: link-text tokens from ``part`` (several layouts, incl. one without any tag)."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    first = F.when(k % 6 == 0, F.lit("BI")).otherwise(F.col("p_name"))
    tag = (F.when(k % 5 == 0, F.lit("Remote")).when(k % 5 == 1, F.concat(F.lit("Senior "), F.col("p_type")))
           .otherwise(F.lit("HPP")))
    place = F.when(F.col("p_size") % 3 == 0, F.lit("Brno")).otherwise(F.col("p_name"))
    pay = F.when(F.col("p_size") % 4 == 0, F.lit("Navrhni mzdu")).otherwise(
        F.concat(F.col("p_size").cast("string"), F.lit("000 Kč")))
    parts = F.when(k % 13 == 0, F.array(F.col("p_name"), F.col("p_type"), F.col("p_brand"))).otherwise(
        F.array(first, tag, F.col("p_type"), F.col("p_brand"), place, pay))
    return p.select(k.alias("p_partkey"), parts.alias("parts"))


def responses_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: scorer answers in six shapes by ``event_id % 6`` (plain, fenced, embedded, no JSON,
    null score, empty object)."""
    e = read_table(spark, sf_dir, "events")
    n = F.floor(F.col("value")).cast("bigint").cast("string")
    m = F.col("event_id") % 6
    resp = (F.when(m == 0, F.concat(F.lit('{"score": '), n,
                                    F.lit(', "match_summary": "ok", "skills_match": ["SQL"], "remote_match": true}')))
            .when(m == 1, F.concat(F.lit('```json\n{"score": '), n, F.lit(', "gaps": ["Spark"]}\n```')))
            .when(m == 2, F.concat(F.lit('Here: {"score": '), n, F.lit(', "seniority_match": "false"} thanks')))
            .when(m == 3, F.lit("no json here"))
            .when(m == 4, F.lit('{"score": null}'))
            .otherwise(F.lit("{}")))
    return e.select(F.col("event_id").alias("response_id"), resp.alias("response"))


def page_chain_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: conversations as paged listings: conv_id = category, turn + 1 = page number, a turn
    shorter than 40 characters is a page without job links."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("category"), (F.col("turn") + 1).alias("page_no"),
                    (F.length("text") < 40).alias("empty"), F.lit(False).alias("last"))


def _s(c):
    return F.col(c).cast("string")


def landed_jobs_cz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: one jobs.cz-shaped result page per part: a full card, a card without logo text and a
    single footer item, a card without a title link, and a fourth card beyond a cap of 3."""
    p = read_table(spark, sf_dir, "part")
    url = lambda i: F.concat(F.lit("https://jobs.example.cz/"), _s("p_partkey"), F.lit(f"/{i}"))
    card0 = F.concat(
        F.lit('<article class="SearchResultCard"><h2 class="SearchResultCard__title"><a href="'), url(0), F.lit('">'),
        F.col("p_name"), F.lit(' analyst</a></h2><div class="CompanyLogo"><img alt="'), F.col("p_brand"),
        F.lit('"></div><ul><li class="SearchResultCard__footerItem">'), F.col("p_type"),
        F.lit('</li><li class="SearchResultCard__footerItem">Brno</li></ul><span class="Tag Tag--success">'),
        _s("p_size"), F.lit(" 000 Kč</span></article>"))
    card1 = F.concat(
        F.lit('<article class="SearchResultCard"><h2 class="SearchResultCard__title"><a href="'), url(1), F.lit('">Chef '),
        F.col("p_name"), F.lit('</a></h2><div class="CompanyLogo"><img src="x.png"></div><ul>'
                               '<li class="SearchResultCard__footerItem">'), F.col("p_type"), F.lit("</li></ul></article>"))
    card2 = F.lit('<article class="SearchResultCard"><p>no title link</p></article>')
    card3 = F.concat(F.lit('<article class="SearchResultCard"><h2 class="SearchResultCard__title"><a href="'), url(3),
                     F.lit('">Data lead</a></h2></article>'))
    body = F.concat(F.lit("<html><body><main>"), card0, card1, card2, card3, F.lit("</main></body></html>"))
    return p.select(F.lit("jobs_cz").alias("source"), F.lit("data analyst").alias("query"), F.lit(1).alias("page_no"),
                    F.col("p_partkey"), body.alias("body"))


def landed_linkedin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: one LinkedIn-shaped result list per customer: a full card (URL with a tracking query),
    a card without company and location, and a card without a link."""
    c = read_table(spark, sf_dir, "customer")
    k = _s("c_custkey")
    card0 = F.concat(
        F.lit('<li><div class="base-card"><a class="base-card__full-link" href="https://li.example/jobs/view/'), k,
        F.lit('?trk=public">x</a><h3 class="base-search-card__title">Data Analyst '), F.col("c_name"),
        F.lit('</h3><h4 class="base-search-card__subtitle">'), F.col("c_mktsegment"),
        F.lit('</h4><span class="job-search-card__location">Brno</span></div></li>'))
    card1 = F.concat(F.lit('<li><a class="base-card__full-link" href="https://li.example/jobs/view/'), k,
                     F.lit('-b">x</a><h3 class="base-search-card__title">BI Developer</h3></li>'))
    card2 = F.lit('<li><h3 class="base-search-card__title">SQL Admin</h3></li>')
    body = F.concat(F.lit('<ul class="jobs-search__results-list">'), card0, card1, card2, F.lit("</ul>"))
    loc = F.when(F.col("c_custkey") % 2 == 0, F.lit("Worldwide")).otherwise(F.lit("Prague"))
    return c.select(F.lit("linkedin").alias("source"), F.lit("data analyst BI").alias("query"), F.lit(1).alias("page_no"),
                    F.col("c_custkey"), loc.alias("search_location"), body.alias("body"))


def landed_jobstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P + C: Jobstack-shaped listing pages, one per conversation turn (category = conv_id,
    page = turn + 1). A turn shorter than 40 characters is a page without job links; turns with
    ``turn % 4 == 3`` have no next-page link. The first link's id is shared by turns 2j-1 and 2j,
    so in-run dedup (before the title gate) decides which of the two survives."""
    c = read_table(spark, sf_dir, "conversations")
    t, cid = F.col("turn"), _s("conv_id")
    title0 = F.when(F.col("role") == "user", F.lit("Data Analyst")).otherwise(F.lit("Chef"))
    link0 = F.concat(F.lit('<li><a href="/it-job/'), cid, F.lit("-"), F.floor((t + 1) / 2).cast("string"), F.lit('">'),
                     title0, F.lit("<br>HPP<br>Co"), cid, F.lit("<br>Brno<br>"), t.cast("string"),
                     F.lit("0 000 Kč</a></li>"))
    link1 = F.concat(F.lit('<li><a href="/it-job/'), cid, F.lit("-x"), t.cast("string"),
                     F.lit('">Senior BI Developer<br>Remote<br>Acme s.r.o.</a></li>'))
    links = F.when(F.length("text") < 40, F.lit("")).otherwise(F.concat(link0, link1))
    nxt = F.when(t % 4 == 3, F.lit("")).otherwise(
        F.concat(F.lit('<a href="/it-jobs/c'), cid, F.lit("?page="), (t + 2).cast("string"), F.lit('">next</a>')))
    body = F.concat(F.lit("<html><body><ul>"), links, F.lit("</ul>"), nxt, F.lit("</body></html>"))
    return c.select(F.lit("jobstack").alias("source"), cid.alias("query"), (t + 1).cast("int").alias("page_no"),
                    body.alias("body"))


def landed_pages_jobs_cz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: the jobs.cz pages as result pages of three searches (part key modulo 3), in page order."""
    p = landed_jobs_cz(spark, sf_dir)
    return p.select("source", F.concat(F.lit("search "), F.col("p_partkey") % 3).alias("query"),
                    F.col("p_partkey").cast("int").alias("page_no"), "body")


CAP_BY_SEARCH = [("jobs_cz", "search 0", "", 5, True), ("jobs_cz", "search 1", "", 50, True), ("jobs_cz", "search 2", "", None, True)]


def landed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: pages of all five sources in one landed table. LinkedIn's links point to postings that
    Remotive has too, so ids overlap across sources."""
    wide = lambda df, query, page: df.select("source", query.alias("query"), page.cast("int").alias("page_no"), "body")
    li = landed_linkedin(spark, sf_dir).withColumn("body", F.replace("body", F.lit("https://li.example/jobs/view/"), F.lit("https://remotive.example/e/")))
    parts = [
        wide(landed_remotive(spark, sf_dir), F.lit("data analyst"), F.col("event_id")),
        wide(landed_muse(spark, sf_dir), F.lit("Data Science"), F.col("conv_id") * 100 + F.col("turn")),
        landed_pages_jobs_cz(spark, sf_dir),
        wide(li, F.lit("data analyst BI"), F.col("c_custkey")),
        wide(landed_jobstack(spark, sf_dir), F.col("query"), F.col("page_no")),
        wide(landed_remotive(spark, sf_dir), F.lit("switched off"), F.col("event_id")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def landed_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: ``landed_all`` with damaged bodies on every page whose number ends in 7 (Jobstack: in 3): cut JSON, text that is no
    JSON or no body at all (Muse), markup that the parser rejects."""
    page, json_cut = F.col("page_no"), F.substring("body", 1, 60)
    hit = F.when(F.col("source") == "jobstack", page % 10 == 3).otherwise(page % 10 == 7)
    no_json = F.when(page % 20 == 7, F.lit("not json"))
    body = (F.when(~hit, F.col("body")).when(F.col("source") == "remotive", json_cut).when(F.col("source") == "the_muse", no_json)
            .otherwise(F.concat(F.lit("<p><![foo["), F.col("body"))))
    return landed_all(spark, sf_dir).withColumn("body", body)


def specs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spec table for ``landed_all``: one row per search, one of them disabled; a Jobstack
    category per conversation, every fourth disabled."""
    fixed = search_specs(spark, [("remotive", "data analyst", "", 20, True), ("remotive", "switched off", "", 20, False),
                                 ("the_muse", "Data Science", "", 15, True), *CAP_BY_SEARCH, ("linkedin", "data analyst BI", "Prague", None, True)])
    c = read_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return fixed.unionByName(c.select(
        F.lit("jobstack").alias("source"), _s("conv_id").alias("query"), F.lit("").alias("location"), F.lit(None).cast("int").alias("cap"),
        (F.col("conv_id") % 4 != 0).alias("enabled"), F.lit(4).alias("source_rank"), F.col("conv_id").cast("int").alias("query_rank")))


def repeated_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B as a re-scored batch: every posting twice with different scores, and a row without an id
    for every tenth."""
    b = postings_b(spark, sf_dir).drop("loaded_at")
    again = b.withColumn("score", F.coalesce(F.col("score"), F.lit(0)) + 7)
    return b.unionByName(again).unionByName(b.where(F.col("job_id").cast("long") % 10 == 0).withColumn("job_id", F.lit(None).cast("string")))

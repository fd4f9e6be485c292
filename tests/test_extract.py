import json

from pyspark.sql import functions as F

from postkit.operators.report import FilterSpec, apply_filters, board_overflow, board_topk, status_dim
from postkit.sources.html import cut_page_chain, extract_jobs_cz, extract_jobstack, extract_linkedin, get_text, parse, select
from postkit.sources.payloads import extract_muse, extract_remotive

LANDED = "source string, query string, page_no int, search_location string, body string"

JOBS_CZ = """<html><body>
<article class="SearchResultCard"><h2 class="SearchResultCard__title"><a href="https://x/1">Data Analyst</a></h2>
 <div class="CompanyLogo"><img alt="Acme"></div>
 <li class="SearchResultCard__footerItem">FooterCo</li><li class="SearchResultCard__footerItem">Brno</li>
 <span class="Tag--success">50 000 Kč</span></article>
<article class="SearchResultCard"><h2 class="SearchResultCard__title"><a href="https://x/2">BI Developer</a></h2>
 <div class="CompanyLogo"><img></div><li class="SearchResultCard__footerItem">Beta s.r.o.</li></article>
<article class="SearchResultCard"><p>no title link</p></article>
<article class="SearchResultCard"><h2 class="SearchResultCard__title"><a href="https://x/4">Data Lead</a></h2></article>
</body></html>"""


def test_jobs_cz_cards(spark):
    landed = spark.createDataFrame([("jobs_cz", "data analyst", 1, "", JOBS_CZ)], LANDED)
    rows = extract_jobs_cz(landed, cap=3).orderBy("pos").collect()
    assert [(r.title, r.company, r.location, r.salary) for r in rows] == [
        ("Data Analyst", "Acme", "Brno", "50 000 Kč"), ("BI Developer", "Beta s.r.o.", "Praha", "")]


LINKEDIN = """<ul class="jobs-search__results-list">
<li><h3 class="base-search-card__title">Chef</h3><a class="base-card__full-link" href="https://l/view/0?trk=x">x</a></li>
<li><h3 class="base-search-card__title">Data Analyst</h3><h4 class="base-search-card__subtitle">Acme</h4>
    <a class="base-card__full-link" href="https://l/view/1?trk=x">x</a></li>
<li><h3 class="base-search-card__title">BI Analyst</h3><a class="base-card__full-link" href="https://l/view/2">x</a></li>
</ul>"""


def test_linkedin_cap_before_gate_and_defaults(spark):
    landed = spark.createDataFrame([("linkedin", "q", 1, "Prague", LINKEDIN)], LANDED)
    rows = extract_linkedin(landed, cap=2).collect()          # cap 2: the irrelevant first card uses a slot
    assert [(r.title, r.url, r.company, r.location) for r in rows] == [("Data Analyst", "https://l/view/1", "Acme", "Prague")]


def _jobstack_page(n, links, nxt):
    items = "".join(f'<li><a href="/it-job/{h}">{t}</a></li>' for h, t in links)
    more = f'<a href="?page={n + 1}">next</a>' if nxt else ""
    return f"<ul>{items}</ul>{more}"


def test_jobstack_chain_dedup_and_tokens(spark):
    p1 = _jobstack_page(1, [("a", "Data Engineer<br>HPP<br>Acme<br>Brno<br>80 000 Kč"), ("b", "Java Dev<br>HPP<br>X")], True)
    p2 = _jobstack_page(2, [("a", "Data Engineer again<br>HPP"), ("c", "Data Analyst<br>Remote<br>Beta")], False)
    p3 = _jobstack_page(3, [("d", "Data Analyst<br>HPP<br>Never read")], True)   # after a page without next link
    landed = spark.createDataFrame([("jobstack", "cat", i + 1, "", b) for i, b in enumerate([p1, p2, p3])], LANDED)
    rows = {r.url: (r.title, r.company, r.location, r.salary) for r in extract_jobstack(landed).collect()}
    assert rows == {
        "https://www.jobstack.it/it-job/a": ("Data Engineer", "Acme", "Brno", "80 000 Kč"),
        "https://www.jobstack.it/it-job/c": ("Data Analyst", "Beta", "Remote", ""),
    }


def test_page_chain_cut(spark):
    df = spark.createDataFrame([("c", p, p == 3, False) for p in range(1, 8)] + [("d", p, False, p == 2) for p in range(1, 8)],
                               "category string, page_no int, empty boolean, last boolean")
    got = sorted((r.category, r.page_no) for r in cut_page_chain(df, "category").collect())
    assert got == [("c", 1), ("c", 2), ("d", 1), ("d", 2)]


def test_get_text_tolerant():
    root = parse("<div><p><b>Hi &amp; bye<br>there<script>var x=1</script></div>")
    assert get_text(root) == "Hi & byethere"
    assert len(select(root, "div p b")) == 1


def test_remotive_and_muse(spark):
    rem = {"jobs": [
        {"url": "https://r/1", "title": "Data Analyst", "company_name": "A", "description": "d" * 3500},
        {"url": "https://r/2", "title": "Java Developer", "company_name": "B", "candidate_required_location": "EU"},
    ]}
    muse = {"results": [
        {"name": "Chef", "contents": "<p>Hello &amp; welcome</p>", "company": {"name": "M"},
         "refs": {"landing_page": "https://m/1"}, "locations": []},
        {"name": "X", "refs": {"landing_page": ""}, "locations": [{"name": "Brno"}]},
        {"name": "Y", "refs": {"landing_page": "https://m/3"}, "locations": [{"name": "Brno"}, {"name": "Wien"}]},
    ]}
    landed = spark.createDataFrame([("remotive", "q", 1, "", json.dumps(rem)), ("the_muse", "q", 1, "", json.dumps(muse))], LANDED)
    r = extract_remotive(landed.where("source = 'remotive'")).collect()
    assert [(x.title, x.location, len(x.description)) for x in r] == [("Data Analyst", "Worldwide", 3500)]
    m = sorted((x.title, x.location, x.description) for x in extract_muse(landed.where("source = 'the_muse'")).collect())
    assert m == [("Chef", "Remote", "Hello & welcome"), ("Y", "Brno, Wien", "")]


def test_board_limits(spark):
    rows = [(str(i), i, "new" if i % 2 else "applied", "t" * 40, "c") for i in range(30)] + [("u", 1, "unknown", "t", "c")]
    v = spark.createDataFrame(rows, "job_id string, score long, status string, title string, company string") \
        .withColumn("date_scraped", F.current_date())
    top = board_topk(v, status_dim(spark), k=8).collect()
    assert len(top) == 16 and all(len(r.card_title) == 36 for r in top)
    over = {r.status: (r["count"], r.overflow) for r in board_overflow(v, status_dim(spark)).collect()}
    assert over["new"] == (15, 7) and over["ignored"] == (0, 0) and "unknown" not in over


def test_filters_commute(spark):
    rows = [(str(i), i, ["new", "saved", "rejected"][i % 3], i % 2 == 0, "" if i % 4 else "5 Kč", "s") for i in range(100)]
    v = spark.createDataFrame(rows, "job_id string, score long, status string, remote_match boolean, salary string, source string") \
        .withColumn("title", F.lit("t")).withColumn("company", F.lit("c")).withColumn("location", F.lit("l"))
    a = apply_filters(apply_filters(v, FilterSpec(remote_only=True, salary_range=None)), FilterSpec(min_score=70, salary_range=None))
    b = apply_filters(v, FilterSpec(min_score=70, remote_only=True, salary_range=None))
    assert sorted(r.job_id for r in a.collect()) == sorted(r.job_id for r in b.collect())

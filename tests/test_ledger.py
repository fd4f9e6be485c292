"""Ingest that loses nothing: broken payloads, unreadable pages, rejected cards, caps by counted pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from postkit.operators.ingest import ingest_ledger, postings, rejected, rejected_counts
from postkit.operators.prefix import grouped_offsets
from postkit.sources import html as H
from postkit.sources import payloads as P

CARD = '<article class="SearchResultCard"><h2 class="SearchResultCard__title"><a href="/j/{}">Data analyst</a></h2></article>'


def test_grouped_offsets_equal_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), "q", i, r.choice([0, 1, 5, None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, h string, at int, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # several ranges
    try:
        got = {(x.g, x.at): x.offset for x in grouped_offsets(df, ["g", "h"], ["at"], "n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = {}, {}
    for g, _, at, n in rows:
        want[g, at] = total.get(g, 0)
        total[g] = total.get(g, 0) + (n or 0)
    assert got == want


def test_json_that_is_broken_is_kept_and_the_rest_goes_on(spark):
    rows = [(1, '{"jobs": [{"url": "u1", "title": "Data analyst"}]}'), (2, '{"jobs": [{"url": '), (3, "no json"), (4, None), (5, '{"jobs": []}'),
            (6, '{"jobs": [null, {"url": "u6", "title": "Chef"}]}'), (7, "")]
    landed = spark.createDataFrame(rows, "page_no int, body string").withColumn("source", F.lit("remotive"))
    got = sorted((x.page_no, x.pos, x.reason, x.detail) for x in P.remotive_rows(landed, scraped_at=F.lit("t")).select(
        "page_no", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("detail", F.lit("")).alias("detail")).collect())
    assert [x for x in got if x[0] in (1, 2, 3, 4, 5, 6)] == [
        (1, 0, "", ""), (2, -1, "broken payload", '{"jobs": [{"url": '), (3, -1, "broken payload", "no json"), (4, -1, "broken payload", ""),
        (6, 0, "title not relevant", ""), (6, 1, "title not relevant", "")]


def test_ledger_splits_into_postings_and_quarantine(spark):
    specs = P.search_specs(spark, [("jobs_cz", "q", "", 3, True), ("jobs_cz", "off", "", None, False)])
    page = "".join(CARD.format(i) for i in range(2)) + '<article class="SearchResultCard">no title</article>'
    rows = [("jobs_cz", "q", 1, "<![foo["), ("jobs_cz", "q", 2, page), ("jobs_cz", "q", 3, page.replace("/j/", "/k/")), ("jobs_cz", "off", 1, page)]
    landed = spark.createDataFrame(rows, "source string, query string, page_no int, body string")
    ledger = ingest_ledger(spark, landed, specs, scraped_at=F.lit("t"))
    assert sorted((x.page_no, x.pos) for x in postings(ledger).collect()) == [(2, 0), (2, 1)]      # the third card counts against the cap
    assert sorted((x.page_no, x.pos or 0, x.reason) for x in rejected(ledger).collect()) == [(1, 0, "unreadable page"), (2, 2, "card without title")]
    assert {(x.reason, x.n) for x in rejected_counts(ledger).collect()} == {(None, 2), ("unreadable page", 1), ("card without title", 1)}
    assert "MapIn" not in rejected(ledger)._jdf.queryExecution().executedPlan().toString()


def test_caps_rank_no_cards(spark):
    landed = spark.createDataFrame([("jobs_cz", "q", i, CARD.format(i) * 4, 10) for i in range(9)], "source string, query string, page_no int, body string, cap int")
    cards = H.capped_cards(H.parse_pages(landed, "jobs_cz", ["source", "query", "page_no", "cap"], "body"), ["source", "query"])
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and "row_number" not in plan
    assert sorted((x.page_no, x.pos) for x in cards.collect()) == [(p, i) for p in range(3) for i in range(4) if p * 4 + i < 10]


def test_parser_is_linear(spark):
    deep = "<div>" * 200_000 + "<ul><li><a href='/it-job/1'>x</a>" + "</b>" * 200_000
    t = time.perf_counter()
    root = H.parse(deep)
    assert [n.attrs["href"] for n in H.select(root, "div ul li a[href*=/it-job/]")] == ["/it-job/1"]
    assert time.perf_counter() - t < 20


@pytest.mark.parametrize("selector,want", [("a b", ["2", "3"]), ("a a b", ["3"]), ("b", ["1", "2", "3"])])
def test_select_descendants(selector, want):
    root = H.parse("<b id=1></b><a><b id=2></b><p><a><b id=3></b></a></p></a>")
    assert [n.attrs["id"] for n in H.select(root, selector)] == want


def test_select_sees_what_is_above_its_root():
    (inner,) = H.select(H.parse("<a><p><b id=1></b></p></a>"), "p")
    assert len(H.select(inner, "a b")) == 1 and len(H.select(inner, "p b")) == 1


@pytest.mark.parametrize("flags,want", [
    ([(1, False, False, None), (2, None, None, "bad"), (3, False, False, None)], (2, "unreadable page", False)),
    ([(1, False, False, None), (2, True, True, None)], (2, "no links", False)),
    ([(1, False, True, None), (2, True, False, None)], (1, "no next page", True)),
    ([(1, False, False, None), (2, False, False, None), (3, False, False, None)], (2, "page limit", True)),
    ([(1, False, False, None)], (1, "no more pages", True))])
def test_chain_stops(spark, flags, want):
    df = spark.createDataFrame([("c", *f) for f in flags], "c string, page_no int, empty boolean, last boolean, error string")
    (row,) = H.chain_stops(df, "c", max_pages=2, error_col="error").collect()
    assert (row.page_no, row.reason, row.inclusive) == want
    kept = sorted(x.page_no for x in H.cut_page_chain(df, "c", max_pages=2, error_col="error").collect())
    assert kept == [f[0] for f in flags if f[0] < want[0] or want[2] and f[0] == want[0]]


def test_a_card_is_walked_once_for_all_its_fields(monkeypatch):
    card = '<article class="SearchResultCard"><h2 class="SearchResultCard__title"><a href="u">data</a></h2><ul><li>a</li><li>b</li></ul></article>'
    root = H.parse(card * 50)
    selectors = ["article h2 a", "ul li", "li", "h2", ".SearchResultCard__title a"]
    assert H.select_each(root, selectors) == [H.select(root, s) for s in selectors]
    walks = []
    each = H.select_each
    monkeypatch.setattr(H, "select_each", lambda node, s: walks.append(1) or each(node, s))
    assert [c["href"] for c in H.read_cards(root, H.CARD_KINDS["jobs_cz"])] == ["u"] * 50
    assert len(walks) == 51


@pytest.mark.parametrize("html", ['<ul class="a b"><li>x &amp; y<li>z</ul>', "<!DOCTYPE html><p>a<br>b<br/>c</p>", '<a href="x?a=1&amp;b" title="">t</a >', "<title>a <b> c</title><p>d",
                                  '<script>if (a<b) "</p>"</script><p id=1 class=\'q\'>x</p>', '<p a="1"b="2">x<i c="', "a &am <b>c</b> &#10;", '<a b="1" b="2" c="x>y">z</a></p></a>', ""])
def test_plain_tags_are_read_as_the_library_reads_them(html):
    class Library(H._Builder):
        feed, parse_starttag, updatepos = H.HTMLParser.feed, H.HTMLParser.parse_starttag, H.HTMLParser.updatepos

    tree = lambda n: (n.tag, n.attrs, [tree(c) if isinstance(c, H.Node) else c for c in n.children])
    b = Library()
    b.feed(html)
    b.close()
    assert tree(H.parse(html)) == tree(b.root)


def test_cards_are_laid_out_as_arrow_lays_them_out():
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(T.ArrayType(H.CARD_SCHEMA))
    for values in ([], [None], [[{"pos": 0, "title": "a", "has_link": True}], None, [], [{"pos": 1}, {"pos": 2, "href": ""}]]):
        assert H._column(values, kind).equals(pa.array(values, kind))

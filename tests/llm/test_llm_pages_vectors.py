"""Small tests of the archive, page and vector operators."""

import time
import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postkit.llm import embed_dedup, html_text, warc
from postkit.llm.components import components
from postkit.session import scratch_path


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- op8 ----------------------------------------------------------------------------------

PAGES = [(3, "http://a/1", "<p>x</p>"), (1, "http://a/2", "<p>x</p>"), (2, "http://b/é", "two\r\n\r\nWARC/1.1\r\n"), (4, None, None), (5, "u", ""),
         (6, "bad\r\nHeader: 1", "é漢" * 50_000), (None, "n", "<p>x</p>"), (None, "n", "only null"), (7, "http://a/1", "two\r\n\r\nWARC/1.1\r\n"), (1, "http://a/2", "<p>x</p>")]


@pytest.mark.parametrize("least", [0, 9])
def test_archive_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "sha", "clash") for p in PAGES], "page_id long, url string, html string, sha256 string, header string")
    path = warc.write_archive(df, scratch_path(spark, "warc"), min_bytes=least)
    payload = lambda h: (h or "").encode()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[payload(h)] = min(first.get(payload(h), i), i)
    want = []
    for i, _, h in PAGES:
        p = payload(h)
        to = first.get(p)
        revisit = len(p) >= least and to is not None and to != i
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    assert rows(warc.digest(spark, path), "id", "payload_bytes", "payload_digest", "record_type", "refers_to_id") == sorted(want, key=repr)
    assert warc.read_payloads(spark, path).count() == len({payload(h) for _, _, h in PAGES})
    for r in warc.records(spark, path).collect():
        head, http, body = bytes(r.record).split(b"\r\n\r\n", 2)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert int(fields[b"Content-Length"]) == len(http) + 4 + len(body)
        kind = fields[b"WARC-Type"].decode()
        assert body == (b"" if kind == "revisit" else bytes(r.payload)) and b"\n" not in fields[b"WARC-Target-URI"]
        assert fields[b"WARC-Payload-Digest"][5:].decode() == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()


def test_exported_files_hold_every_record(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = warc.write_archive(df, scratch_path(spark, "warc"))
    warc.export_warc(spark, path, out := scratch_path(spark, "warc-files"), compression="none")
    data, n = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(out).orderBy("path").collect() if r.path.endswith(".txt")), 0
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size:size + 4] == b"\r\n\r\n"
        data, n = rest[size + 4:], n + 1
    assert n == len(PAGES)


def test_archive_of_no_pages_and_damage(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.digest(spark, warc.write_archive(df, scratch_path(spark, "warc"))).count() == 0
    path = warc.write_archive(spark.createDataFrame([(1, "u", "x")], df.schema), scratch_path(spark, "warc"))
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit("y").cast("binary"))
    bad.write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-bad/headers")
    with pytest.raises(Exception, match="does not match"):
        warc.digest(spark, f"{path}-bad").collect()


# ---- op9 ----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie-banner">We use cookies, really.</div><div id=wrap><article><h1>Head &amp; shoulders</h1><div class="ad">Buy, buy, buy</div>
<p>First   paragraph,\n with <b>bold, <a href=x>link</a></b><br>text.<p>Second &lt;one&gt; &#8211; caf&eacute;.<ul><li>item 1<li>item 2</ul><form><input><p>Subscribe!</p></form>
<script>var x = "</p>";</script><blockquote>Quoted, at length.</blockquote>{}</article><aside><p>Related, things, to, read</p></aside></div>
<section class="comments"><p>{}</p></section><footer>&copy; us, all rights</footer></body></html>"""


def test_main_text_of_a_page():
    want = "Head & shoulders\n\nFirst paragraph, with bold, link text.\n\nSecond <one> – café.\n\nitem 1\n\nitem 2\n\nQuoted, at length."
    assert html_text.main_text(PAGE.format("", "I think, that, it, is, " * 200)) == want
    assert html_text.main_text(PAGE.format("<div class='comments'><p>no</p></div>", "")) == want


def test_main_text_without_article_element():
    body = "".join(f"<p>Paragraph {i}, with some text, and more, to be long enough.</p>" for i in range(5))
    page = f"<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div class=c><h2>Title</h2>{body}</div><div class=footer>foot, er</div></body>"
    assert html_text.main_text(page).split("\n\n") == ["Title"] + [f"Paragraph {i}, with some text, and more, to be long enough." for i in range(5)]
    assert html_text.main_text("plain <i>text</i> only") == "plain text only"


@pytest.mark.parametrize("around", ["article", "main"])
def test_main_text_keeps_sections_with_furniture_words(around):
    parts = ['<h2 id="related-work">Related work</h2><p class="share-price">The price, per share.</p>', '<section id="side-effects"><p>Side effects, few.</p></section>',
             '<div id="social-impact">Impact, <a href=1>one</a> link of many words.</div>', '<h3 class="notice">Notice</h3><p id="notice-period">A month, at least.</p>']
    gone = '<div class="share-buttons"><a href=1>Post</a> <a href=2>Mail</a></div><ul class="related-posts"><li><a href=3>Next</a></li></ul><div class="comments"><p>no</p></div>'
    got = html_text.main_text(f"<body><{around}><p>Start, of it.</p>{''.join(parts)}{gone}</{around}></body>")
    assert got.split("\n\n") == ["Start, of it.", "Related work", "The price, per share.", "Side effects, few.", "Impact, one link of many words.", "Notice", "A month, at least."]


@pytest.mark.parametrize("around", ["article", "main", "section"])
def test_main_text_set_directly_in_its_block(around):
    lines = [f"Line {i} of the text, with commas, and enough words to be read." for i in range(6)]
    page = f"<body><{around}>{'<br>'.join(lines)}</{around}><div class=c><p>Another paragraph, short.</p></div><div>All rights, reserved.</div></body>"
    assert html_text.main_text(page) == " ".join(lines)


def test_main_text_edges(spark):
    deep = "<div>" * 20_000 + "deep, text" + "<p>" * 5000
    cases = [None, "", "<nav>menu</nav>", "<p>unclosed <b>bold", "a < b & c &amp", "<!-- <p>x</p>", "<script>x", deep, "<p>" + "long, " * 50_000 + "</p>", "<p a='>'>ok</p>"]
    df = spark.createDataFrame([(i, f"u{i}", h, "t", 1) for i, h in enumerate(cases)] + [(None, None, "<p>n</p>", "t", 1)] * 2, "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert [got[i].text for i in range(8)] == ["", "", "", "unclosed bold", "a < b & c &", "", "", "deep, text"]
    assert got[8].n_chars == 50_000 * 6 - 1 and got[9].text == "ok"
    assert got[8].n_chars == len(got[8].text) and got[0].n_chars == 0 and got[None].text == "n"
    assert html_text.extract(df).count() == len(cases) + 2 and html_text.extract(df.limit(0)).count() == 0


# ---- op6 ----------------------------------------------------------------------------------

def brute_links(vectors, t=0.9):
    unit = []
    for _, v in vectors:
        ok = v and None not in v and all(map(math.isfinite, v)) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    n = len(vectors)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t] for i in range(n)]
    label = [v[0] for v in vectors]
    big = 10**9
    label = [big if x is None else x for x in label]
    while True:
        new = [min([label[i]] + [label[j] for j in near[i]]) for i in range(n)]
        if new == label:
            break
        label = new
    out = []
    for i in range(n):
        c = None if label[i] == big else label[i]
        out.append((vectors[i][0], len(near[i]), c, vectors[i][0] == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile,leaf", [(4 << 20, 512), (2048, 4)])
def test_vector_links_equal_brute_force(spark, monkeypatch, tile, leaf):
    monkeypatch.setattr(embed_dedup, "TILE_BYTES", tile)
    monkeypatch.setattr(embed_dedup, "LEAF_ROWS", leaf)
    r = random.Random(7)
    data = []
    for _ in range(15):
        c = [r.gauss(0, 1) for _ in range(8)]
        data += [[x + r.gauss(0, s) for x in c] for s in (0, 0.1, 0.1, 0.2, 0.3)]
    data += [[2 * x for x in data[0]], data[0], data[0], [1e-30] * 8, [1e30] * 8, None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8, [1.0, 0.0], [1.0, 0.1]]
    ids = list(range(len(data)))
    r.shuffle(ids)
    ids[3] = ids[1]                                            # a repeated id
    ids[-1] = None
    vectors = list(zip(ids, data))
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in vectors], "vec_id long, embedding array<double>, key string, copies int")
    got = rows(embed_dedup.link_vectors(df), "vec_id", "n_links", "component_id", "kept")
    want = brute_links(vectors)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert embed_dedup.link_vectors(df.limit(0)).count() == 0
    assert rows(embed_dedup.link_vectors(df.where("embedding is null")), "n_links", "kept") == [(0, True)]


@pytest.mark.parametrize("distinct", [1, 2, 7])
def test_few_vectors_of_a_length(spark, distinct):
    r = random.Random(distinct)
    few = [[r.gauss(0, 1) for _ in range(64)] for _ in range(distinct)]
    few = few[:-1] + [[x + 0.01 for x in few[0]]] if distinct > 1 else few
    data = few + few[:1] + [[r.gauss(0, 1) for _ in range(9)] for _ in range(40)]       # next to a larger group of another length
    vectors = list(enumerate(data))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = rows(embed_dedup.link_vectors(df), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(brute_links(vectors), key=repr)


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (60, 55), (55, 60)]
    r.shuffle(edges)
    got = rows(components(spark.createDataFrame(edges, "u long, v long")), "node", "component")
    assert got == sorted([(i, 0) for i in range(51)] + [(100 + i, 100) for i in range(40)] + [(55, 55), (60, 55)], key=repr)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


GONE = [f'<div class="{n}"><p>Furniture, not text.</p></div>' for n in (
    "comment-list", "comments-section", "user-comments", "newsletter-box", "ad-slot", "cookie-notice", "share-buttons", "sidebar-box", "commentList", "post comments")]
GONE += ['<p class="advert">Buy, now.</p>', '<section id="comments"><p>First, I say.</p></section>', '<aside><p>Aside, note.</p></aside>',
         '<div class="reply-to-comment-42"><p>Your answer, please.</p><textarea></textarea></div>', '<div class="related-stories-x"><a href=1>One</a> <a href=2>Two</a></div>']
KEPT = ['<h2 id="notice-period">Notice period</h2>', '<p id="share-price">The price, per share.</p>', '<div id="side-effects"><p>Side effects, few.</p></div>',
        '<h3 class="notice">Notice</h3>', '<section id="social-impact"><p>Impact, of work.</p></section>', '<div class="comment-culture"><p>On comments, in general.</p></div>']


@pytest.mark.parametrize("around", ["article", "main", "div class=story"])
def test_furniture_goes_and_text_stays_inside_and_outside_an_article(around):
    body = [f"<p>Paragraph {i}, with some text, and more, to be long enough.</p>" for i in range(len(GONE) + len(KEPT))]
    page = "".join(x + y for x, y in zip(body, GONE + KEPT))
    want = [f"Paragraph {i}, with some text, and more, to be long enough." for i in range(len(GONE))]
    for i, x in enumerate(["Notice period", "The price, per share.", "Side effects, few.", "Notice", "Impact, of work.", "On comments, in general."]):
        want += [f"Paragraph {len(GONE) + i}, with some text, and more, to be long enough.", x]
    assert html_text.main_text(f"<body><{around}>{page}</{around.split()[0]}></body>").split("\n\n") == want


@pytest.mark.parametrize("tags", ["<div>", "<b>", "<b><h1>", "<p><i>", "<li><b>"])
def test_deep_pages_take_linear_time(tags):
    start = time.perf_counter()
    html_text.main_text(tags * 100_000 + "text, here" + "</b>" * 100_000)
    assert time.perf_counter() - start < 30

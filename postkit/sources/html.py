"""Landed HTML pages -> card rows.

Pages are dealt over the cluster and parsed inside ``mapInArrow`` (Arrow batches, one parse per page) with the stdlib ``html.parser``, which tolerates the unclosed tags real pages have.
Selectors are deliberately small: descendant chains of ``tag.class[attr*=value]`` parts.
Everything after the parse (caps, gates, ids, defaults, dedup) is native DataFrame code.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from typing import Iterator, NamedTuple, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from postkit import constants as K
from postkit.functions.text import absolutise, is_relevant, posting_id, strip_query
from postkit.functions.tokens import tokenize, with_token_fields
from postkit.operators.prefix import grouped_offsets
from postkit.session import materialize

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW_TEXT = {"script", "style"}


_PLAIN = re.compile(r'([^<]*)<(?:/([a-z][a-z0-9]*)>|([a-z][a-z0-9]*)((?: [a-z][a-z0-9_-]*="[^"]*")*)>)')
_PLAIN_ATTR = re.compile(r' ([a-z][a-z0-9_-]*)="([^"]*)"')
#: Elements whose content some version of the library's parser does not read as markup.
_OPAQUE = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.cur = self.root
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in _VOID:
            self.cur = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(Node(tag, {k: (v or "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        if not self.open.get(tag):                   # unmatched end tags are ignored, without a climb
            return
        while True:
            done, self.cur = self.cur.tag, self.cur.parent
            self.open[done] -= 1
            if done == tag:
                return

    def handle_data(self, data):
        self.cur.children.append(data)

    # Plain tags are most of a page: small letters, attributes in double quotes, a space between. What the library makes of them is
    # made here in one match each; at anything else, and in elements whose content is no markup, the library's parser goes on.
    def feed(self, data):
        at, n = 0, len(data)
        while at < n and isinstance(data, str):
            m = _PLAIN.match(data, at)
            if not m or m[3] in _OPAQUE:
                break
            if m[1]:
                self.handle_data(unescape(m[1]))
            self._plain(m[2], m[3], m[4])
            at = m.end()
        super().feed(data[at:])

    def _plain(self, closed, tag, attrs):
        if closed:
            self.handle_endtag(closed)
        else:
            self.handle_starttag(tag, [(k, unescape(v)) for k, v in _PLAIN_ATTR.findall(attrs)] if attrs else ())

    def parse_starttag(self, i):
        m = _PLAIN.match(self.rawdata, i)
        if not m or m[1] or m[3] in _OPAQUE:
            return super().parse_starttag(i)
        self._plain(None, m[3], m[4])
        return m.end()

    def updatepos(self, i, j):                       # line numbers are not asked for
        return j


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_PART = re.compile(r"^(?P<tag>[a-zA-Z0-9]*)(?P<classes>(?:\.[\w-]+)*)(?:\[(?P<attr>[\w-]+)\*=['\"]?(?P<val>[^'\"\]]*)['\"]?\])?$")


@lru_cache(maxsize=256)
def _compile(selector: str):
    parts = []
    for p in selector.split():
        m = _PART.match(p)
        if not m:
            raise ValueError(f"unsupported selector part: {p}")
        classes = [c for c in m.group("classes").split(".") if c]
        parts.append((m.group("tag") or None, classes, m.group("attr"), m.group("val")))
    return parts


def _matches(node: Node, part) -> bool:
    tag, classes, attr, val = part
    if tag and node.tag != tag:
        return False
    if classes:
        have = node.attrs.get("class")
        if not have:
            return False
        have = have.split()
        for c in classes:
            if c not in have:
                return False
    if attr is not None and (attr not in node.attrs or val not in node.attrs[attr]):
        return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Descendant-combinator selection in document order (like CSS ``a b c``)."""
    return select_each(root, (selector,))[0]


def select_each(root: Node, selectors: Sequence[str]) -> list[list[Node]]:
    """What ``select`` gives for each selector, in one walk: every node carries how many leading parts of each its ancestors
    match, those above ``root`` included."""
    compiled = [_compile(x) for x in selectors]
    done, above, n = [0] * len(compiled), [], root
    while n is not None:
        above.append(n)
        n = n.parent
    for n in reversed(above):
        for i, parts in enumerate(compiled):
            done[i] += done[i] < len(parts) - 1 and _matches(n, parts[done[i]])
    out = [[] for _ in compiled]
    each = [(i, parts, len(parts) - 1) for i, parts in enumerate(compiled)]
    stack = [(c, done) for c in reversed(root.children) if isinstance(c, Node)]
    while stack:
        n, done = stack.pop()
        inner = done
        for i, parts, last in each:
            at = done[i]
            if _matches(n, parts[at]):
                if at == last:
                    out[i].append(n)
                else:
                    if inner is done:
                        inner = done.copy()
                    inner[i] += 1
        for c in reversed(n.children):
            if isinstance(c, Node):
                stack.append((c, inner))
    return out


def _strings(node: Node):
    stack = list(reversed(node.children))
    while stack:
        x = stack.pop()
        if not isinstance(x, Node):
            yield x
        elif x.tag not in _RAW_TEXT:
            stack.extend(reversed(x.children))


def get_text(node: Node | None, sep: str = "", strip: bool = False) -> str:
    """Concatenated text (entities decoded; script/style bodies excluded)."""
    if node is None:
        return ""
    parts = list(_strings(node))
    if strip:
        parts = [p.strip() for p in parts if p.strip()]
    return sep.join(parts)


# ---------------------------------------------------------------- per-page extractors
CARD_SCHEMA = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("salary", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("has_title", T.BooleanType()),
    T.StructField("has_link", T.BooleanType()),
])
#: Pages of one Arrow batch whose trees and cards are held at a time.
_PAGE_ROWS = 256


class Field(NamedTuple):
    """Where a card's value is: the ``nth`` match of a selector, its text or an attribute. Later
    fields of the same name fill in where earlier ones found nothing or an empty value."""
    name: str
    selector: str
    attr: str | None = None
    nth: int = 0


class CardKind(NamedTuple):
    """A source's cards: the selector of a card, its fields and the values of absent ones."""
    card: str
    fields: tuple[Field, ...]
    absent: dict


# --- FIXED VALUES: selectors of the sources' result pages and the values of absent fields
CARD_KINDS = {
    "jobs_cz": CardKind("article.SearchResultCard", (
        Field("title", ".SearchResultCard__title a"),
        Field("href", ".SearchResultCard__title a", "href"),
        Field("company", ".CompanyLogo img", "alt"),
        Field("company", ".SearchResultCard__footerItem"),
        Field("location", ".SearchResultCard__footerItem", nth=1),
        Field("salary", ".Tag--success"),
    ), {"company": "", "location": K.JOBS_CZ_DEFAULT_LOCATION, "salary": ""}),
    "linkedin": CardKind(".jobs-search__results-list li", (
        Field("title", ".base-search-card__title"),
        Field("href", "a.base-card__full-link", "href"),
        Field("company", ".base-search-card__subtitle"),
        Field("location", ".job-search-card__location"),
    ), {"company": "", "salary": ""}),
}


def read_cards(root: Node, kind: CardKind) -> Iterator[dict]:
    """The cards of a page in page order, read by the kind's field table. ``None``: no element."""
    selectors = list(dict.fromkeys(f.selector for f in kind.fields))
    for pos, card in enumerate(select(root, kind.card)):
        row, matches = {"pos": pos}, dict(zip(selectors, select_each(card, selectors)))
        for f in kind.fields:
            if row.get(f.name):
                continue
            found = matches[f.selector][f.nth:f.nth + 1]
            if found:
                row[f.name] = get_text(found[0], strip=True) if f.attr is None else found[0].attrs.get(f.attr, "")
        row["has_title"], row["has_link"] = row.get("title") is not None, row.get("href") is not None
        yield {**kind.absent, **row}


def read_links(root: Node, selector: str) -> Iterator[dict]:
    for pos, a in enumerate(select(root, selector)):
        yield {"pos": pos, "href": a.attrs.get("href", ""), "text": get_text(a, sep="\n", strip=True), "has_title": True, "has_link": True}


def dealt(pages: DataFrame) -> DataFrame:
    """Pages dealt over the cluster by rows. A landed file of short, well compressed rows is one split whatever the cluster,
    and parsing costs far more than moving a page."""
    spark = pages.sparkSession
    return pages.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _reader(kind: str, selector: str | None):
    if kind == "links":
        return lambda root: read_links(root, selector or "ul li a[href*=/it-job/]")
    if kind not in CARD_KINDS:
        raise ValueError(f"unknown card kind {kind}")
    return lambda root: read_cards(root, CARD_KINDS[kind])


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column of Python values. Lists of structs (cards) are laid out field by field; a null list stays null."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    rows, starts = [], []
    for v in values:
        starts.append(None if v is None else len(rows))
        rows += v or ()
    fields = list(kind.value_type)
    structs = pa.StructArray.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in fields], fields=fields)
    return pa.ListArray.from_arrays(pa.array([*starts, len(rows)], pa.int32()), structs, type=kind)


def _parsed(pages: DataFrame, keys: Sequence[str], html_col: str, fields: Sequence[T.StructField], read) -> DataFrame:
    """One row per page: its keys, what ``read(root, row)`` gives for ``fields`` and ``error``. A page that cannot be read has
    its ``error`` and nulls, and the others go on (Q1)."""
    schema = T.StructType([*pages.select(*keys).schema.fields, *fields, T.StructField("error", T.StringType())])
    kinds, n = [to_arrow_type(f.dataType) for f in fields], len(keys)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _PAGE_ROWS):
                b, rows = batch.slice(start, _PAGE_ROWS), []
                for key, html in zip(b.select(range(n)).to_pylist(), b.column(n).to_pylist()):
                    try:
                        rows.append((*read(parse(html), key), None))
                    except Exception as exc:
                        rows.append((*[None] * len(kinds), f"{type(exc).__name__}: {exc}"))
                made = [_column(c, k) for c, k in zip(zip(*rows), [*kinds, pa.string()])]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=schema.fieldNames())

    return dealt(pages.select(*keys, F.col(html_col).alias("_html"))).mapInArrow(run, schema)


def parse_pages(pages: DataFrame, kind: str, key_cols: Sequence[str], html_col: str = "html", selector: str | None = None) -> DataFrame:
    """One row per page: its keys, ``cards`` in page order (``kind`` = a name in CARD_KINDS, or 'links': the elements of
    ``selector``, with href and text split into lines) and ``error``."""
    read = _reader(kind, selector)
    return _parsed(pages, list(key_cols), html_col, [T.StructField("cards", T.ArrayType(CARD_SCHEMA))], lambda root, _: (list(read(root)),))


def page_cards(parsed: DataFrame) -> DataFrame:
    """The cards of parsed pages, a row each; a page with an ``error`` is one row without a card."""
    keys = [c for c in parsed.columns if c not in ("cards", "error")]
    nothing = F.array(F.lit(None).cast(CARD_SCHEMA))
    rows = parsed.select(*keys, F.explode(F.when(F.col("error").isNotNull(), nothing).otherwise(F.col("cards"))).alias("_card"), "error")
    return rows.select(*keys, "_card.*", "error")


def extract_cards(pages: DataFrame, kind: str, key_cols: Sequence[str], html_col: str = "html",
                  cap: int | None = None, selector: str | None = None) -> DataFrame:
    """One row per card, in page order (``pos``). ``cap`` keeps the first cards of a page *before* any gate; None keeps
    all. A page that cannot be read gives one row with ``error`` and no card (Q1)."""
    cards = page_cards(parse_pages(pages, kind, key_cols, html_col, selector))
    return cards if cap is None else cards.where(F.col("pos").isNull() | (F.col("pos") < cap))


def capped_cards(parsed: DataFrame, search_cols: Sequence[str], cap_col: str = "cap") -> DataFrame:
    """The cards of parsed pages up to ``cap_col`` cards a search (page by page, in page order); a null cap is no
    cap. Pages are counted, not cards ranked: a grouped prefix sum over the pages' numbers of cards gives the place of each
    page's first card in its search, and the cap is a filter on that place plus the position on the page."""
    rows = materialize(parsed.withColumn("_page", F.monotonically_increasing_id()), "parsed")
    counts = rows.where(F.col(cap_col).isNotNull()).select(
        *search_cols, *[c for c in ("page_no",) if c in rows.columns], "_page", F.greatest(F.size("cards"), F.lit(0)).alias("_cards"))
    order = [c for c in counts.columns if c in ("page_no", "_page")]
    first = grouped_offsets(counts, search_cols, order, "_cards", "_first").select("_page", "_first")
    cap = F.col(cap_col)
    near = rows.join(first, "_page", "left").where(cap.isNull() | F.col("error").isNotNull() | (F.col("_first") < cap))
    within = F.col("error").isNotNull() | cap.isNull() | (F.col("_first") + F.col("pos") < cap)
    return page_cards(near).where(within).drop("_page", "_first")


def card_errors(cards: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Q1: the pages that could not be read."""
    return cards.where(F.col("error").isNotNull()).select(*key_cols, "error")


def with_html_text(df: DataFrame, html_col: str, out: str, error: str | None = None) -> DataFrame:
    """Adds the text of an HTML column (character references decoded, script and style bodies dropped); null for a page
    that cannot be read, whose error is in the column ``error`` names."""
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.StringType()) for c in (out, error) if c])

    def text(html):
        try:
            return get_text(parse(html)), None
        except Exception as exc:
            return None, f"{type(exc).__name__}: {exc}"

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _PAGE_ROWS):
                b = batch.slice(start, _PAGE_ROWS)
                found = [text(h) for h in b.column(b.schema.get_field_index(html_col)).to_pylist()]
                made = [pa.array([x[i] for x in found], pa.string()) for i in range(2 if error else 1)]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.fieldNames())

    return dealt(df).mapInArrow(run, schema)


def page_text(pages: DataFrame, key_cols: Sequence[str], html_col: str = "html") -> DataFrame:
    """Full text of each page (``get_text`` with entities decoded, script/style dropped)."""
    return with_html_text(pages.select(*key_cols, F.col(html_col).alias("_html")), "_html", "text").drop("_html")


LINK_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("href", T.StringType()),
    T.StructField("text", T.StringType()),
]))


def listing_pages(pages: DataFrame, key_cols: Sequence[str], html_col: str = "html",
                  link_selector: str = "ul li a[href*=/it-job/]") -> DataFrame:
    """One parse per listing page: the S13 flags ``empty`` (no job link) and ``has_next`` (a link
    to page_no + 1), the page's job links as ``links`` (``pos``, ``href``, link text split into
    lines) and ``error`` for a page that cannot be read (its flags are null). ``page_no`` must be among ``key_cols``."""
    def read(root, key):
        found = list(read_links(root, link_selector))
        return not found, bool(select(root, f"a[href*=page={int(key['page_no']) + 1}]")), found

    fields = [T.StructField("empty", T.BooleanType()), T.StructField("has_next", T.BooleanType()), T.StructField("links", LINK_SCHEMA)]
    return _parsed(pages, list(key_cols), html_col, fields, read)


# ---------------------------------------------------------------- native parts
def chain_stops(pages: DataFrame, group_col: str, page_col: str = "page_no", empty_col: str = "empty", last_col: str | None = "last",
                max_pages: int | None = None, error_col: str | None = None) -> DataFrame:
    """Where a sequential reader of each group stops: ``page_col``, ``reason`` and whether that page is still read
    (``inclusive``). It stops at the first page that cannot be read or has no links, after the first page without a next
    link, after page ``max_pages`` (None: no limit), or where the landed pages end. One aggregate that combines per task."""
    reason = F.when(F.col(empty_col), F.lit("no links"))
    if error_col:
        reason = F.when(F.col(error_col).isNotNull(), F.lit("unreadable page")).when(F.col(empty_col), F.lit("no links"))
    if last_col:
        reason = reason.when(F.col(last_col), F.lit("no next page"))
    within = pages
    if max_pages is not None:
        within, reason = pages.where(F.col(page_col) <= max_pages), reason.when(F.col(page_col) == max_pages, F.lit("page limit"))
    stop = F.min(F.when(reason.isNotNull(), F.struct(F.col(page_col).alias("p"), reason.alias("reason"))))
    end = F.struct(F.max(page_col).alias("p"), F.lit("no more pages").alias("reason"))
    found = within.groupBy(group_col).agg(F.coalesce(stop, end).alias("_s"))
    return found.select(group_col, F.col("_s.p").alias(page_col), F.col("_s.reason").alias("reason"),
                        (~F.col("_s.reason").isin("unreadable page", "no links")).alias("inclusive"))


def cut_page_chain(pages: DataFrame, group_col: str, page_col: str = "page_no", empty_col: str = "empty",
                   last_col: str | None = "last", max_pages: int | None = None, error_col: str | None = None) -> DataFrame:
    """The pages of each group that a sequential reader would have read (``chain_stops``, joined back: no window
    over a whole group)."""
    stops = chain_stops(pages, group_col, page_col, empty_col, last_col, max_pages, error_col).select(
        F.col(group_col).alias("_group"), F.col(page_col).alias("_stop"), "inclusive")
    keep = (F.col(page_col) < F.col("_stop")) | (F.col("inclusive") & (F.col(page_col) == F.col("_stop")))
    return pages.join(stops, F.col(group_col).eqNullSafe(F.col("_group"))).where(keep).drop("_group", "_stop", "inclusive")


def heading(html: Column | str, tag: str = "h1") -> Column:
    """First ``<h1>`` inner HTML (regexp form, for well-formed headings)."""
    c = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract(c, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)


NAV_LINK_PATTERN = r'<li><a href="([^"]*)">([^<]*)</a></li>'


def nav_links_capped(pages: DataFrame, key: str, cap: int, html_col: str = "html") -> DataFrame:
    """W4 (regexp form): the first ``cap`` list links of each page, position from 0."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(NAV_LINK_PATTERN), 1)
    texts = F.regexp_extract_all(F.col(html_col), F.lit(NAV_LINK_PATTERN), 2)
    z = F.arrays_zip(hrefs.alias("href"), texts.alias("text"))
    return pages.select(key, F.posexplode(z).alias("pos", "l")).where(F.col("pos") < cap).select(
        key, F.col("pos").cast("bigint").alias("pos"), F.col("l.href").alias("href"), F.col("l.text").alias("text"))


# ---------------------------------------------------------------- source extractors
def _scraped(scraped_at):
    return scraped_at if scraped_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _page_columns(landed: DataFrame) -> list[str]:
    """Columns of the landed rows that stay with each card (a card's own columns take precedence)."""
    return [c for c in landed.columns if c not in ("body", "error") and c not in CARD_SCHEMA.fieldNames()]


def accepted(rows: DataFrame) -> DataFrame:
    """The postings among rows that carry a ``reason`` for their rejection."""
    return rows.where(F.col("reason").isNull()).drop("reason", "detail")


def _searched(landed: DataFrame, kind: str, cap: int | None, cap_col: str | None) -> DataFrame:
    """Cards of landed pages, capped per page by ``cap`` or per search by the column ``cap_col``."""
    keys = _page_columns(landed)
    if not cap_col:
        return extract_cards(landed, kind, keys, "body", cap)
    return capped_cards(parse_pages(landed, kind, keys, "body"), [c for c in ("source", "query", "search_location") if c in keys], cap_col)


def jobs_cz_rows(landed: DataFrame, cap: int | None = None, keywords=K.RELEVANT_TITLE_KEYWORDS,
                 scraped_at=None, cap_col: str | None = None) -> DataFrame:
    """S10 + Q1 + F2: every card within the cap and every page that cannot be read, with the ``reason`` why it is no posting
    (null for postings) and ``detail``."""
    reason = (F.when(F.col("error").isNotNull(), F.lit("unreadable page")).when(~F.col("has_title"), F.lit("card without title"))
              .when(~is_relevant("title", keywords), F.lit("title not relevant")))
    return _searched(landed, "jobs_cz", cap, cap_col).select(
        *_page_columns(landed), "pos", posting_id("href").alias("job_id"), "title", "company", "location",
        F.lit("").alias("description"), F.col("href").alias("url"), F.lit("jobs_cz").alias("source_name"),
        "salary", _scraped(scraped_at).alias("scraped_at"), reason.alias("reason"), F.col("error").alias("detail"))


def extract_jobs_cz(landed: DataFrame, cap: int | None = None, keywords=K.RELEVANT_TITLE_KEYWORDS,
                    scraped_at=None, cap_col: str | None = None) -> DataFrame:
    """Title gate after the cap (P8), company from the logo text else the first footer
    item, location = second footer item else 'Praha'. No cap unless one is given."""
    return accepted(jobs_cz_rows(landed, cap, keywords, scraped_at, cap_col))


def linkedin_rows(landed: DataFrame, cap: int | None = None, keywords=K.RELEVANT_TITLE_KEYWORDS,
                  search_location_col: str = "search_location", scraped_at=None, cap_col: str | None = None) -> DataFrame:
    """S11 + Q1 + F2: as ``jobs_cz_rows``, for LinkedIn's result lists."""
    landed = landed.withColumn("_search_location", F.col(search_location_col))
    url = strip_query("href")
    reason = (F.when(F.col("error").isNotNull(), F.lit("unreadable page")).when(~F.col("has_title"), F.lit("card without title"))
              .when(~F.col("has_link"), F.lit("card without link")).when(~is_relevant("title", keywords), F.lit("title not relevant")))
    return _searched(landed, "linkedin", cap, cap_col).select(
        *[c for c in _page_columns(landed) if c != "_search_location"], "pos", posting_id(url).alias("job_id"), "title", "company",
        F.coalesce(F.col("location"), F.col("_search_location")).alias("location"),
        F.lit("").alias("description"), url.alias("url"), F.lit("linkedin").alias("source_name"),
        F.lit("").alias("salary"), _scraped(scraped_at).alias("scraped_at"), reason.alias("reason"), F.col("error").alias("detail"))


def extract_linkedin(landed: DataFrame, cap: int | None = None, keywords=K.RELEVANT_TITLE_KEYWORDS,
                     search_location_col: str = "search_location", scraped_at=None, cap_col: str | None = None) -> DataFrame:
    """Title and link required, URL without its query, missing location -> the search's
    location (a column of the landed rows, from the spec join). No cap unless one is given."""
    return accepted(linkedin_rows(landed, cap, keywords, search_location_col, scraped_at, cap_col))


def jobstack_rows(landed: DataFrame, category_col: str = "query", keywords=K.RELEVANT_TITLE_KEYWORDS,
                  scraped_at=None, max_pages: int | None = None) -> DataFrame:
    """S12 + S13 + J5 + Q1: pages cut per category, links parsed into tokens (X22-X26), in-run first-seen dedup by id *before*
    the title gate; rejected links and every landed page that cannot be read have a ``reason``."""
    from postkit.operators.dedup import dedup_first
    keys = [c for c in landed.columns if c not in ("body", "error")]
    # Pages are parsed once; the cut (an aggregate and its join-back), the first-wins dedup (the same) and the rejected
    # rows read the written parse, not the HTML again.
    parsed = materialize(listing_pages(landed, keys, "body"), "jobstack-pages")
    kept = cut_page_chain(parsed.withColumn("last", ~F.col("has_next")), category_col, max_pages=max_pages, error_col="error")
    links = kept.select(*keys, F.inline("links"))
    # The one-element explode is a plan barrier: the emptiness filter on the token array is not
    # pushed below it, so the array is computed once and the stages of ``with_token_fields`` stay.
    tokens = links.select(*links.columns, F.explode(F.array(tokenize("text"))).alias("_parts"))
    fine = (F.col("href") != "") & (F.size("_parts") > 0)
    url, at = absolutise("href", K.JOBSTACK_BASE_URL), _scraped(scraped_at).alias("scraped_at")
    rows = with_token_fields(tokens.where(fine), "_parts").select(
        *keys, "pos", posting_id(url).alias("job_id"), F.col("_t.title").alias("title"),
        F.col("_t.company").alias("company"), F.col("_t.location").alias("location"),
        F.lit("").alias("description"), url.alias("url"), F.lit("jobstack").alias("source_name"),
        F.col("_t.salary").alias("salary"), at)
    order = [c for c in ("query_rank", category_col, "page_no") if c in keys] + ["pos"]
    first = dedup_first(rows.withColumn("_o", F.struct(*order)), "job_id", ["_o"]).drop("_o")
    first = first.select("*", F.when(~is_relevant("title", keywords), F.lit("title not relevant")).alias("reason"), F.lit(None).cast("string").alias("detail"))
    bare = tokens.where(~fine).select(*keys, "pos", F.lit("jobstack").alias("source_name"), F.col("href").alias("url"), at,
                                      F.when(F.col("href") == "", F.lit("link without address")).otherwise(F.lit("link without text")).alias("reason"))
    broken = parsed.where(F.col("error").isNotNull()).select(
        *keys, F.lit("jobstack").alias("source_name"), at, F.lit("unreadable page").alias("reason"), F.col("error").alias("detail"))
    return first.unionByName(bare, allowMissingColumns=True).unionByName(broken, allowMissingColumns=True)


def extract_jobstack(landed: DataFrame, category_col: str = "query", keywords=K.RELEVANT_TITLE_KEYWORDS,
                     scraped_at=None, max_pages: int | None = None) -> DataFrame:
    """S12 + S13 + J5: the postings of ``jobstack_rows``."""
    return accepted(jobstack_rows(landed, category_col, keywords, scraped_at, max_pages))

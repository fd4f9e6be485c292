"""Landed JSON payloads -> raw postings (native ``from_json`` + ``inline``).

A landed payload row is one fetched response: ``source, query, page_no, ..., body``.
Order-of-arrival columns (``source_rank, query_rank, pos``) are carried for first-wins dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit import constants as K
from postkit.functions.text import is_relevant, posting_id
from postkit.schemas import MUSE_PAYLOAD, REMOTIVE_PAYLOAD, SEARCH_SPEC
from postkit.session import literal_frame
from postkit.sources.html import accepted, with_html_text

def search_specs(spark: SparkSession, rows=None) -> DataFrame:
    """The search-spec table. A null cap is no cap."""
    rows = rows if rows is not None else K.SEARCH_SPECS
    out, per_source = [], {}
    for src, q, loc, cap, en in rows:
        qr = per_source.setdefault(src, 0)
        per_source[src] = qr + 1
        out.append((src, q, loc, cap, en, K.SOURCE_ORDER.index(src) if src in K.SOURCE_ORDER else len(K.SOURCE_ORDER), qr))
    return literal_frame(spark, out, SEARCH_SPEC)


#: Searches that are broadcast to the pages; above that, pages and searches meet in a shuffle, a search's pages in so many tasks.
BROADCAST_SPECS, SPEC_SALTS = 10_000, 16


def with_enabled_specs(landed: DataFrame, specs: DataFrame) -> DataFrame:
    """S15 + J10: keep payloads of enabled specs and attach their ranks, cap and search location.
    A spec is (source, query, location); landed rows without a ``location`` match the first
    enabled spec of their (source, query), so the join never multiplies payloads.

    Few searches have most pages, and Spark takes a page for a few bytes while its body is not made yet, so neither may the
    pages be broadcast nor all pages of a search go to one task. Up to ``BROADCAST_SPECS`` searches are broadcast; more of them
    are repeated for every salt, and a page has one by its body."""
    sp = specs.where("enabled").drop("enabled")
    if "location" in landed.columns:
        keys = ["source", "query", "location"]
        sp = sp.withColumn("search_location", F.col("location"))
    else:
        keys = ["source", "query"]
        first = F.min(F.struct("query_rank", "location", "cap", "source_rank")).alias("_s")
        sp = sp.groupBy(*keys).agg(first).select(
            *keys, "_s.query_rank", F.col("_s.location").alias("search_location"), "_s.cap", "_s.source_rank")
    if sp.limit(BROADCAST_SPECS + 1).count() <= BROADCAST_SPECS:
        return landed.join(F.broadcast(sp), keys, "inner")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SPEC_SALTS - 1)).cast("array<bigint>"))
    own = [c for c in ("page_no", "body") if c in landed.columns]
    salted = landed.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(SPEC_SALTS)))
    return salted.join(sp.withColumn("_salt", salts).hint("merge"), [*keys, "_salt"], "inner").drop("_salt")


def _items(landed: DataFrame, payload: T.StructType, name: str) -> DataFrame:
    """The elements ``j`` (at ``pos``) of the list ``name`` in each JSON body, and for a body that is no such JSON one row
    without an element and with the body in ``broken`` (``from_json``'s corrupt record; a null body is broken, too)."""
    keep = [c for c in landed.columns if c not in ("body", "pos", "reason", "detail")]
    schema = T.StructType([*payload.fields, T.StructField("_broken", T.StringType())])
    doc = F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = landed.select(*keep, F.explode(F.array(doc)).alias("_d"), "body")
    bad = F.when(F.col("body").isNull(), F.lit("")).otherwise(F.col("_d._broken"))
    item = payload[name].dataType.elementType
    found = F.transform(F.coalesce(F.col(f"_d.{name}"), F.array().cast(payload[name].dataType)),
                        lambda j, i: F.struct(i.alias("pos"), j.alias("j"), F.lit(None).cast("string").alias("broken")))
    lost = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast(item).alias("j"), bad.alias("broken")))
    return rows.select(*keep, F.inline(F.when(bad.isNotNull(), F.concat(found, lost)).otherwise(found)))


def _now(scraped_at: Column | None) -> Column:
    return scraped_at if scraped_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def remotive_rows(landed: DataFrame, keywords=K.RELEVANT_TITLE_KEYWORDS, scraped_at: Column | None = None) -> DataFrame:
    """S8 + Q1 + F2: every element of ``jobs[]`` and every broken body, with the ``reason`` why it is no posting (null for
    postings) and ``detail`` (the broken body)."""
    jobs = _items(landed, REMOTIVE_PAYLOAD, "jobs")
    keep = [c for c in jobs.columns if c not in ("pos", "j", "broken")]
    title = F.coalesce(F.col("j.title"), F.lit(""))
    reason = F.when(F.col("broken").isNotNull(), F.lit("broken payload")).when(~is_relevant(title, keywords), F.lit("title not relevant"))
    return jobs.select(
        *keep, "pos",
        posting_id("j.url").alias("job_id"),
        title.alias("title"),
        F.coalesce(F.col("j.company_name"), F.lit("")).alias("company"),
        F.coalesce(F.col("j.candidate_required_location"), F.lit(K.REMOTIVE_DEFAULT_LOCATION)).alias("location"),
        F.coalesce(F.col("j.description"), F.lit("")).alias("description"),
        F.coalesce(F.col("j.url"), F.lit("")).alias("url"),
        F.lit("remotive").alias("source_name"),
        F.coalesce(F.col("j.salary"), F.lit("")).alias("salary"),
        _now(scraped_at).alias("scraped_at"), reason.alias("reason"), F.col("broken").alias("detail"),
    )


def extract_remotive(landed: DataFrame, keywords=K.RELEVANT_TITLE_KEYWORDS,
                     scraped_at: Column | None = None) -> DataFrame:
    """Explode ``jobs[]``, gate titles (F1), apply defaults, id = md5(url)[:12]."""
    return accepted(remotive_rows(landed, keywords, scraped_at))


def muse_rows(landed: DataFrame, cap: Column | None = None, scraped_at: Column | None = None) -> DataFrame:
    """S9 + Q1 + F2: as ``remotive_rows`` for ``results[]``; a posting whose contents cannot be read has its error as detail."""
    res = _items(landed, MUSE_PAYLOAD, "results")
    if cap is not None:
        res = res.where(F.col("pos").isNull() | (F.col("pos") < cap))
    keep = [c for c in res.columns if c not in ("pos", "j", "broken")]
    url = F.coalesce(F.col("j.refs.landing_page"), F.lit(""))
    names = F.transform(F.coalesce(F.col("j.locations"), F.array().cast("array<struct<name:string>>")),
                        lambda x: F.coalesce(x["name"], F.lit("")))
    # The gate is known before the parse: only postings' contents go through it.
    early = F.when(F.col("broken").isNotNull(), F.lit("broken payload")).when(url == "", F.lit("posting without link"))
    html = F.when(early.isNull(), F.coalesce(F.col("j.contents"), F.lit("")))
    texts = with_html_text(res.select("*", early.alias("_early"), html.alias("_html")), "_html", "_text", "_error")
    return texts.select(
        *keep, "pos",
        posting_id(url).alias("job_id"),
        F.coalesce(F.col("j.name"), F.lit("")).alias("title"),
        F.coalesce(F.col("j.company.name"), F.lit("")).alias("company"),
        F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit(K.MUSE_EMPTY_LOCATION)).alias("location"),
        F.col("_text").alias("description"),
        url.alias("url"),
        F.lit("the_muse").alias("source_name"),
        F.lit("").alias("salary"),
        _now(scraped_at).alias("scraped_at"),
        F.coalesce(F.col("_early"), F.when(F.col("_error").isNotNull(), F.lit("unreadable text"))).alias("reason"),
        F.coalesce(F.col("broken"), F.col("_error")).alias("detail"),
    )


def extract_muse(landed: DataFrame, cap: Column | None = None, scraped_at: Column | None = None) -> DataFrame:
    """Explode ``results[]``; location = joined location names or 'Remote' when the list is
    empty; rows without a landing page are dropped; description = the whole text of the parsed
    HTML contents, every character reference decoded. No title gate here (P6). ``cap`` optionally limits rows per response (P7, off by default)."""
    return accepted(muse_rows(landed, cap, scraped_at))


def json_field(c: Column | str, path: str, dtype: str = "string") -> Column:
    """Scalar from a JSON text column (``get_json_object`` + cast)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.get_json_object(col, path).cast(dtype)


def to_raw_posting(extracted: DataFrame, source_order=K.SOURCE_ORDER) -> DataFrame:
    """P1 + U-1: the 9-column posting schema plus arrival order ``source_rank, query_rank,
    page_no, pos`` (first-seen-wins dedup sorts on these); rows with a ``reason`` keep it, ``detail`` and ``query``."""
    src = F.col("source_name") if "source_name" in extracted.columns else F.col("source")
    rank = F.lit(len(source_order))
    for i, s in reversed(list(enumerate(source_order))):
        rank = F.when(src == s, F.lit(i)).otherwise(rank)
    qr = F.col("query_rank") if "query_rank" in extracted.columns else F.lit(0)
    page = F.col("page_no") if "page_no" in extracted.columns else F.lit(1)
    return extracted.select(
        "job_id", "title", "company", "location", "description", "url", src.alias("source"), "salary",
        F.col("scraped_at").cast("string").alias("scraped_at"),
        rank.alias("source_rank"), qr.cast("int").alias("query_rank"), page.cast("int").alias("page_no"),
        F.col("pos").cast("int").alias("pos"), *[c for c in ("query", "reason", "detail") if "reason" in extracted.columns],
    )


def keywords_from_table(df: DataFrame, col: str = "keyword") -> Column:
    """J9 with a keyword *table*: its lower-cased distinct values as one pattern, a scalar
    subquery evaluated once with the query (nothing is collected to the driver, and there is no
    nested-loop join over the postings). Null and empty keywords are ignored."""
    word = F.regexp_replace(F.lower(F.col(col)), r"([^\p{L}\p{N}\s])", r"\\$1")
    return df.where(F.length(col) > 0).agg(F.nullif(F.array_join(F.array_sort(F.collect_set(word)), "|"), F.lit("")).alias("pattern")).scalar()


def mentions_any(text: Column | str, pattern: Column) -> Column:
    """F1 with such a pattern: the lower-cased text contains a keyword; false for a null text or
    no keywords."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(F.rlike(low, pattern), F.lit(False))

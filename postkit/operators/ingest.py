"""E1 as one job: landed payloads of every source -> raw postings -> first-seen-wins append to
the store + per-source counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkit import constants as K
from postkit.operators.dedup import dedup_first, ingest_counters, not_stored
from postkit.schemas import RAW_COLUMNS
from postkit.session import materialize
from postkit.sources import html as H
from postkit.sources import payloads as P

ORDER = ["source_rank", "query_rank", "page_no", "pos"]


def ingest_ledger(spark: SparkSession, landed: DataFrame, specs: DataFrame | None = None,
                  keywords=K.RELEVANT_TITLE_KEYWORDS, scraped_at=None, max_pages: int | None = None) -> DataFrame:
    """S8-S12 + S15 + P1 + U-1 + Q1: what every landed payload of an enabled search gave, written once: postings with arrival
    order over all sources (``reason`` null), and what was rejected, with the ``reason`` and ``detail``: broken or unreadable
    payloads, cards without title or link, titles that are not relevant. Every payload is parsed once. Caps come from the
    row of the spec table of each search; a null cap is no cap."""
    specs = materialize(specs, "specs") if specs is not None else P.search_specs(spark)
    readers = {
        "remotive": lambda d: P.remotive_rows(d, keywords, scraped_at),
        "the_muse": lambda d: P.muse_rows(d, None, scraped_at),
        "jobs_cz": lambda d: H.jobs_cz_rows(d, keywords=keywords, scraped_at=scraped_at, cap_col="cap"),
        "linkedin": lambda d: H.linkedin_rows(d, keywords=keywords, scraped_at=scraped_at, cap_col="cap"),
        "jobstack": lambda d: H.jobstack_rows(d, keywords=keywords, scraped_at=scraped_at, max_pages=max_pages),
    }
    of = F.col("source")
    parts = [P.to_raw_posting(read(P.with_enabled_specs(landed.where(of == src), specs.where(of == src)))) for src, read in readers.items()]
    return materialize(reduce(DataFrame.unionByName, parts), "ledger")


def postings(ledger: DataFrame) -> DataFrame:
    """The raw postings of a written ledger, with their arrival order."""
    return ledger.where(F.col("reason").isNull()).drop("query", "reason", "detail")


def rejected(ledger: DataFrame) -> DataFrame:
    """Q1: the quarantine of a written ledger: what gave no posting, where it came from and why."""
    return ledger.where(F.col("reason").isNotNull()).select("source", "query", "page_no", "pos", "reason", "detail", "title", "url", "scraped_at")


def rejected_counts(ledger: DataFrame) -> DataFrame:
    """A9 at ingest: rows per source and reason; postings have the reason null."""
    return ledger.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


def extract_all(spark: SparkSession, landed: DataFrame, specs: DataFrame | None = None,
                keywords=K.RELEVANT_TITLE_KEYWORDS, scraped_at=None, max_pages: int | None = None) -> DataFrame:
    """One raw-posting frame with arrival order over all sources: the postings of ``ingest_ledger``."""
    return postings(ingest_ledger(spark, landed, specs, keywords, scraped_at, max_pages))


def merge_into_store(store: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J4 + U-2 + A9: (first arrivals of unseen ids, to be appended to the store; per-source
    counters). ``extracted`` should be a written table, as ``extract_all`` gives it. The store
    is read by its key only and never rewritten."""
    counters = ingest_counters(extracted, "job_id", ORDER, "source", store)
    new = not_stored(dedup_first(extracted, "job_id", ORDER), store, "job_id", extracted)
    return new.select(*RAW_COLUMNS), counters

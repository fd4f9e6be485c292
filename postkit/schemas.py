"""Explicit schemas of the posting data model (no schema inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

RAW_POSTING = T.StructType([
    T.StructField("job_id", S, False),
    T.StructField("title", S),
    T.StructField("company", S),
    T.StructField("location", S),
    T.StructField("description", S),
    T.StructField("url", S),
    T.StructField("source", S),
    T.StructField("salary", S),
    T.StructField("scraped_at", S),
])
RAW_COLUMNS = [f.name for f in RAW_POSTING.fields]

# order-of-arrival columns carried until first-seen-wins dedup
ARRIVAL_COLUMNS = ["source_rank", "query_rank", "pos"]

SCORE_FIELDS = T.StructType([
    T.StructField("score", T.LongType()),
    T.StructField("match_summary", S),
    T.StructField("skills_match", S),   # JSON list text, as stored
    T.StructField("gaps", S),
    T.StructField("seniority_match", T.BooleanType()),
    T.StructField("remote_match", T.BooleanType()),
])

SCORED_POSTING = T.StructType(
    RAW_POSTING.fields + SCORE_FIELDS.fields + [
        T.StructField("status", S),
        T.StructField("date_scraped", S),
    ]
)

WAREHOUSE = T.StructType([
    T.StructField("job_id", S, False),
    T.StructField("title", S),
    T.StructField("company", S),
    T.StructField("location", S),
    T.StructField("url", S),
    T.StructField("source", S),
    T.StructField("salary", S),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("score", T.LongType()),
    T.StructField("match_summary", S),
    T.StructField("skills_match", S),
    T.StructField("gaps", S),
    T.StructField("seniority_match", T.BooleanType()),
    T.StructField("remote_match", T.BooleanType()),
    T.StructField("status", S),
    T.StructField("loaded_at", T.TimestampType(), False),
])
WAREHOUSE_COLUMNS = [f.name for f in WAREHOUSE.fields]
PARTITION_COLUMN = "scraped_date"

STATUS_OVERRIDE = T.StructType([
    T.StructField("job_id", S, False),
    T.StructField("status", S, False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("seq", T.LongType()),
])

CURRENT_COLUMNS = [
    "job_id", "title", "company", "location", "url", "source", "salary",
    "score", "match_summary", "skills_match", "gaps",
    "seniority_match", "remote_match", "status", "date_scraped",
]

SEARCH_SPEC = T.StructType([
    T.StructField("source", S),
    T.StructField("query", S),
    T.StructField("location", S),
    T.StructField("cap", T.IntegerType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("source_rank", T.IntegerType()),
    T.StructField("query_rank", T.IntegerType()),
])

STATUS_DIM = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("status", S),
    T.StructField("label", S),
    T.StructField("emoji", S),
])

# landed payload wrapper: one fetched response per row
LANDED = T.StructType([
    T.StructField("source", S),
    T.StructField("query", S),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("url", S),
    T.StructField("body", S),
])

REMOTIVE_PAYLOAD = T.StructType([
    T.StructField("jobs", T.ArrayType(T.StructType([
        T.StructField("url", S),
        T.StructField("title", S),
        T.StructField("company_name", S),
        T.StructField("candidate_required_location", S),
        T.StructField("description", S),
        T.StructField("salary", S),
    ]))),
])

MUSE_PAYLOAD = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("name", S),
        T.StructField("contents", S),
        T.StructField("company", T.StructType([T.StructField("name", S)])),
        T.StructField("refs", T.StructType([T.StructField("landing_page", S)])),
        T.StructField("locations", T.ArrayType(T.StructType([T.StructField("name", S)]))),
    ]))),
])

SALARY = T.StructType([
    T.StructField("salary_min", T.LongType()),
    T.StructField("salary_max", T.LongType()),
    T.StructField("salary_currency", S),
    T.StructField("salary_period", S),
])

PARSED_RESPONSE = T.StructType([
    T.StructField("score", T.LongType()),
    T.StructField("match_summary", S),
    T.StructField("skills_match", S),
    T.StructField("gaps", S),
    T.StructField("seniority_match", T.BooleanType()),
    T.StructField("remote_match", T.BooleanType()),
    T.StructField("error", S),
])

"""Pick the work, build prompts, score with a
pluggable batch scorer, type its answers and split failures into a quarantine."""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit import constants as K
from postkit.functions.responses import split_parsed
from postkit.functions.text import contains_any, date_prefix, is_relevant, remote_rule, truncate_chars
from postkit.operators.answers import AnswerStore
from postkit.operators.key_index import KeyIndex
from postkit.operators.dedup import dedup_first, not_stored
from postkit.session import literal_frame, materialize


def load_profile(spark: SparkSession, path: str | None = None, fallback: str = K.DEFAULT_PROFILE) -> DataFrame:
    """One-row ``profile`` frame: the whole file trimmed, or the fallback text. A folder of
    several files gives several rows, which ``build_prompts`` rejects: no file is preferred."""
    if path:
        try:
            df = spark.read.text(path, wholetext=True)
            return df.select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("profile"))
        except Exception as exc:  # a missing file only; other errors surface
            if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
                raise
    return literal_frame(spark, [(fallback.strip(),)], "profile string")


def unscored(raw: DataFrame, scored: DataFrame | KeyIndex, key: str = "job_id") -> DataFrame:
    """Postings without a score, by the scored rows or by a bucketed index of their keys."""
    return scored.unseen(raw) if isinstance(scored, KeyIndex) else not_stored(raw, scored, key)


def select_unscored(raw: DataFrame, scored: DataFrame | KeyIndex, key: str = "job_id", title_col: str = "title",
                    keywords: Sequence[str] = K.RELEVANT_TITLE_KEYWORDS) -> DataFrame:
    """F3 = J2 + F1: not yet scored and relevant. Filters are applied here, before the
    expensive scorer (Catalyst cannot push filters through ``mapInPandas``)."""
    return unscored(raw.where(is_relevant(title_col, keywords)), scored, key)


def scoring_counters(raw: DataFrame, scored: DataFrame, key: str = "job_id", title_col: str = "title",
                     keywords: Sequence[str] = K.RELEVANT_TITLE_KEYWORDS) -> DataFrame:
    """A9 for scoring: already scored, to score (F3) and irrelevant (F4), in one pass."""
    fresh = raw.join(scored.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    rel = is_relevant(title_col, keywords)
    todo = F.col("_done").isNull()
    return fresh.agg(
        F.count_if(~todo).alias("already_scored"),
        F.count_if(todo & rel).alias("to_score"),
        F.count_if(todo & ~rel).alias("irrelevant"),
    )


def prompt_column(profile: Column, title: Column, company: Column, location: Column, salary: Column | None,
                  source: Column, description: Column) -> Column:
    """The per-posting prompt. A missing salary column prints 'not specified'; null values
    print as empty text; the description is cut to 3000 characters."""
    parts = K.PROMPT_LAYOUT.split("{")
    values = {
        "profile": profile, "title": title, "company": company, "location": location,
        "salary": salary if salary is not None else F.lit(K.PROMPT_SALARY_MISSING),
        "source": source, "description": truncate_chars(description, K.DESCRIPTION_MAX_CHARS),
    }
    pieces: list[Column] = [F.lit(parts[0])]
    for p in parts[1:]:
        name, lit = p.split("}", 1)
        pieces.append(F.coalesce(values[name], F.lit("")))
        pieces.append(F.lit(lit))
    return F.concat(*pieces)


def build_prompts(postings: DataFrame, profile: DataFrame, key: str = "job_id",
                  cols: dict | None = None) -> DataFrame:
    """J8 + X34: render every posting's prompt with the profile. The profile is a one-row
    frame used as a scalar subquery: evaluated once, no join and no shuffle of the postings."""
    m = {"title": "title", "company": "company", "location": "location", "salary": "salary",
         "source": "source", "description": "description"}
    m.update(cols or {})

    def col_or_none(name):
        c = m[name]
        return F.col(c) if c is not None and c in postings.columns else None

    prof = profile.select("profile").scalar()
    return postings.select(
        key,
        prompt_column(prof, col_or_none("title"), col_or_none("company"), col_or_none("location"),
                      col_or_none("salary"), col_or_none("source"), col_or_none("description")).alias("prompt"),
    )


def lexical_score(df: DataFrame, text_col: str, profile_skills: Sequence[str], vocabulary: Sequence[str],
                  title_col: str | None = None, location_col: str | None = None, source_col: str | None = None,
                  senior_words: Sequence[str] = ("senior", "lead", "principal")) -> DataFrame:
    """A network-free scorer with the scorer's output contract, all native.

    skills_match = profile skills found in the text; gaps = vocabulary terms found that the
    profile lacks; score = 100·m div (m+g) (0 when neither); seniority from title words;
    remote from X33."""
    text = F.lower(F.col(text_col))
    skills = [s.lower() for s in profile_skills]
    gaps_vocab = [v.lower() for v in vocabulary if v.lower() not in skills]
    sk = F.filter(F.array(*[F.lit(s) for s in skills]), lambda s: text.contains(s)) if skills else F.array()
    gp = F.filter(F.array(*[F.lit(s) for s in gaps_vocab]), lambda s: text.contains(s)) if gaps_vocab else F.array()
    m, g = F.size(sk), F.size(gp)
    score = F.when(m + g == 0, F.lit(0)).otherwise(F.floor(F.lit(100) * m / (m + g))).cast("bigint")
    senior = contains_any(title_col, senior_words) if title_col else F.lit(False)
    remote = remote_rule(location_col, source_col) if (location_col and source_col) else F.lit(False)
    return df.select(
        "*", score.alias("score"), m.cast("bigint").alias("n_skills"), g.cast("bigint").alias("n_gaps"),
        F.to_json(sk).alias("skills_match"), F.to_json(gp).alias("gaps"),
        senior.alias("seniority_match"), remote.alias("remote_match"),
    )


Scorer = Callable[[pd.DataFrame], pd.Series]


def score_with(prompts: DataFrame, scorer_factory: Callable[[], Scorer], key: str = "job_id",
               parallelism: int | None = None) -> DataFrame:
    """Call a pluggable batch scorer once per Arrow batch (``mapInPandas``).

    ``scorer_factory()`` runs once per task (one client per partition) and returns a function
    ``pdf[key, prompt] -> Series[str]``. A raising batch is retried row by row so one bad row
    becomes one error row and the rest of the batch still scores. ``parallelism`` bounds the
    number of concurrent callers and is always applied (default: the slots of the cluster), so a
    small batch behind a slow model is not one serial task. Output: key, response, error."""
    src = prompts.select(key, "prompt").repartition(parallelism or prompts.sparkSession.sparkContext.defaultParallelism)
    schema = T.StructType([src.schema[key], T.StructField("response", T.StringType()),
                           T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer_factory()
        for pdf in batches:
            try:
                resp = list(score(pdf))
                err = [None] * len(pdf)
            except Exception:
                resp, err = [], []
                for i in range(len(pdf)):
                    try:
                        resp.append(list(score(pdf.iloc[i:i + 1]))[0])
                        err.append(None)
                    except Exception as exc:  # row-level isolation (Q1)
                        resp.append(None)
                        err.append(f"{type(exc).__name__}: {exc}")
            yield pd.DataFrame({key: pdf[key].to_numpy(), "response": resp, "error": err})

    return src.mapInPandas(run, schema)


def keyword_scorer(skills: Sequence[str]) -> Callable[[], Scorer]:
    """An offline scorer with the model's answer contract, for dry runs and tests: JSON with
    ``score`` = 100 * skills found in the prompt's description div number of skills,
    ``skills_match`` = those skills, ``remote_match`` = the description mentions 'remote'."""
    low = [s.lower() for s in skills]
    head, tail = "\nDescription:\n", "\n\nScore this job for the candidate."

    def factory() -> Scorer:
        import json

        def score(pdf: pd.DataFrame) -> pd.Series:
            out = []
            for p in pdf["prompt"]:
                desc = p.split(head, 1)[-1]
                desc = (desc[: -len(tail)] if desc.endswith(tail) else desc).lower()
                hits = [s for s in low if s in desc]
                out.append(json.dumps({"score": 100 * len(hits) // max(len(low), 1), "skills_match": hits,
                                       "remote_match": "remote" in desc}))
            return pd.Series(out, dtype="object")
        return score
    return factory


def type_responses(responses: DataFrame, key: str = "job_id", strict_bool: bool = False
                   ) -> tuple[DataFrame, DataFrame]:
    """X13-X17 + Q1: (scored fields, quarantine). Call errors go to the quarantine too."""
    ok = responses.where(F.col("error").isNull()).drop("error")
    good, bad = split_parsed(ok, "response", [key], strict_bool)
    failed_calls = responses.where(F.col("error").isNotNull()).select(key, "response", "error")
    return good, bad.unionByName(failed_calls)


def merge_scores(raw: DataFrame, scores: DataFrame, key: str = "job_id", status: str = K.DEFAULT_STATUS) -> DataFrame:
    """Posting fields + score fields (score side wins on a name clash) + status + the date
    prefix of ``scraped_at``."""
    score_cols = [c for c in scores.columns if c != key]
    keep = [c for c in raw.columns if c not in score_cols and c not in ("status", "date_scraped")]
    return raw.select(*keep).join(scores, key, "inner").select(
        *keep, *score_cols, F.lit(status).alias("status"),
        date_prefix(F.coalesce(F.col("scraped_at").cast("string"), F.lit(""))).alias("date_scraped"))


def score_postings(raw: DataFrame, scored: DataFrame | KeyIndex, profile: DataFrame, scorer_factory, key: str = "job_id",
                   keywords: Sequence[str] = K.RELEVANT_TITLE_KEYWORDS, parallelism: int | None = None,
                   strict_bool: bool = False, answers: AnswerStore | None = None) -> tuple[DataFrame, DataFrame]:
    """E2 as one job: F3 -> J8/X34 -> U1 -> X13-X17 -> P3. Returns (scored rows, quarantine).

    Repeated ids are one posting (the least row survives, and the title gate sees that one). Only postings without a score are
    reduced to one per id, so a run costs what is new and not what is stored. The postings and the scorer's answers are
    written once before anything reads them twice: each posting is one prompt, and neither a second reader nor a lost
    executor calls the scorer again. With a store of ``answers``, equal prompts of this and earlier runs are scored once."""
    one = dedup_first(unscored(raw, scored, key), key, [])
    todo = materialize(one.where(is_relevant("title", keywords)), "to-score")
    ask = answers.answer if answers is not None else score_with
    given = materialize(ask(build_prompts(todo, profile, key), scorer_factory, key, parallelism), "answers")
    good, bad = type_responses(given, key, strict_bool)
    return merge_scores(todo, good, key), bad

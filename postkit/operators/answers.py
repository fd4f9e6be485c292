"""A scorer's answers, stored under the digest of their prompt.

Equal prompts of one run are one call, and a prompt that any earlier run had answered is none. Only usable answers are
stored, so failed calls and unreadable answers are asked for again (K2). A store belongs to one scorer: its answers to the
same prompt are taken to be as good later as now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkit.functions.responses import split_parsed
from postkit.session import materialize, path_exists

_STORED = "digest string, response string"


class AnswerStore:
    """Answers (``digest``, ``response``) at ``path``. ``called`` is the number of prompts that the last run put to the scorer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.called = spark, path, 0

    def stored(self) -> DataFrame:
        """All rows; a run that was killed after its write and repeated may have stored a digest twice."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(self.path)

    def answer(self, prompts: DataFrame, scorer_factory, key: str = "job_id", parallelism: int | None = None) -> DataFrame:
        """``key``, ``response`` and ``error`` for every row of ``prompts`` (key, prompt), as ``score_with`` gives them. The store
        is narrowed to the run's digests where it is read, so what is shuffled is of the size of the run."""
        from postkit.operators.scoring import score_with

        asked = materialize(prompts.select(key, "prompt", F.coalesce(F.sha2("prompt", 256), F.lit("no prompt")).alias("digest")), "asked")
        digests = asked.select("digest").distinct()
        found = materialize(self.stored().join(digests, "digest", "left_semi").groupBy("digest").agg(F.min("response").alias("response")), "answers-found")
        missing = asked.select("digest", "prompt").join(found, "digest", "left_anti").dropDuplicates(["digest"])
        fresh = materialize(score_with(missing, scorer_factory, "digest", parallelism), "answers-fresh")
        self.called = fresh.count()
        usable, _ = split_parsed(fresh.where(F.col("error").isNull()).drop("error"), "response", ["digest"])
        fresh.join(usable.select("digest"), "digest", "left_semi").select("digest", "response").write.mode("append").parquet(self.path)
        answers = found.withColumn("error", F.lit(None).cast("string")).unionByName(fresh)
        return asked.select(key, "digest").join(answers, "digest").select(key, "response", "error")

"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all its predecessor kept; its
result is written as Parquet under ``spark.checkpoint.dir`` and read again as the next one's
``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkit.llm import decontam, langid, line_dedup, minhash, packing
from postkit.llm.common import fold, set_apart
from postkit.llm.tokenizer import token_lengths
from postkit.session import materialize, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised (score at least 0.5; texts without a letter
    are not); a null ``lang`` is filled. Learnt as in op4, from fold 0, 1 and 3 of 4."""
    return langid.accept(docs, langid.fit(docs, fold("doc_id", 4) != 2))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines whose template recurs across documents, but at their first place; documents
    that lose all their text so go. ``n_chars`` follows the text where there is such a column. Null and empty texts stay; rows
    with the same id and text are one document; other columns may have any name."""
    def shorter(df: DataFrame) -> DataFrame:
        out = line_dedup.dedup_lines(df, prefix="__")
        left = (F.col("__n_dropped") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != "")
        changed = F.col("__n_dropped") > 0
        return out.where(left).select(*[F.when(changed, F.length("text")).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c)
                                        if c == "n_chars" else F.col(c) for c in df.columns])

    return set_apart(docs, ["doc_id", "text", "n_chars"], shorter)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one with the smallest id (null ids last). Repeated rows are
    copies; texts without words, null ones too, stay; an empty table gives no rows; other columns may have any name."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover at least one word in twenty. Each row is judged by itself, so null and
    repeated ids change nothing; null and empty texts stay; an empty benchmark keeps all; other columns may have any name."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document left. Null and empty texts have 0 tokens and no place; repeated rows and null ids
    each get a place; an empty table gives no rows; other columns are not carried on."""
    return packing.pack(materialize(token_lengths(docs), "lengths"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("pack", pack)]

#: Language ID and sampling have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words. Every item gives its windows of ``window`` consecutive words (an item of
fewer, but not none, is one window). Patterns of equal length form one search table: a *shift*
table over blocks of words says how far the scan may jump from a block that ends a window, and
where the shift is 0 the suffix block selects a bucket, its prefix block the test strings, and a
direct comparison of all words confirms the occurrence. Documents stream through
``mapInArrow``; there is no shuffle. Search tables are built from at most ``SHARD_BYTES`` of
benchmark text: a larger benchmark is searched in several passes whose findings are merged per
row, so nothing is left out and what is broadcast stays bounded.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit.llm.common import arrow_batches, broadcast_bytes, field, set_apart
from postkit.session import materialize

#: Words of UTF-8 text whose A-Z are lower-cased: digits, a-z and every non-ASCII byte.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Benchmark text (bytes) compiled into one broadcast search table.
SHARD_BYTES = 16 << 20


def split_words(data: bytes | None) -> list[bytes]:
    """Words of a text; ``bytes.lower`` changes A-Z only. None has none."""
    return WORD.findall(data.lower()) if data else []


def compile_patterns(items: list[tuple[int, bytes]], window: int) -> list[tuple]:
    """One Wu-Manber table per pattern length: (length, block, default shift, shifts, buckets).
    ``buckets[suffix block][prefix block]`` lists (pattern, numbers of the items that have it)."""
    owners: dict[int, dict[tuple, set[int]]] = {}
    for number, text in items:
        words = split_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            pattern = tuple(words[i:i + window])
            owners.setdefault(len(pattern), {}).setdefault(pattern, set()).add(number)
    tables = []
    for length, patterns in sorted(owners.items()):
        block = min(length, 2 if len(patterns) < 100_000 else 3)
        shifts: dict[tuple, int] = {}
        buckets: dict[tuple, dict[tuple, list]] = {}
        for p, numbers in patterns.items():
            for end in range(block, length + 1):
                key = p[end - block:end]
                shifts[key] = min(shifts.get(key, length), length - end)
            buckets.setdefault(p[-block:], {}).setdefault(p[:block], []).append((p, sorted(numbers)))
        tables.append((length, block, length - block + 1, shifts, buckets))
    return tables


def search(words: list[bytes], tables: list[tuple]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged spans [start, end) of words inside occurrences, and the numbers of items found."""
    n, spans, found = len(words), [], set()
    for length, block, default, shifts, buckets in tables:
        i = length
        while i <= n:                                   # i: end of the window under the cursor
            tail = tuple(words[i - block:i])
            step = shifts.get(tail, default)
            if step:
                i += step
                continue
            start = i - length
            tests = buckets[tail].get(tuple(words[start:start + block]))
            if tests:
                here = tuple(words[start:i])
                for pattern, numbers in tests:
                    if pattern == here:
                        found.update(numbers)
                        spans.append((start, i))
            i += 1
    return merge_spans(spans), found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text",
                  keep: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text",
                  shard_bytes: int = SHARD_BYTES, prefix: str = "") -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (default: ``doc_id`` and the text) and
    ``n_words``, ``spans`` (word spans [start, end) inside occurrences) and ``items`` (ids as
    strings of the items found, sorted), each under ``prefix`` so that they need not clash.

    Null and empty texts have no words and no spans; an item without words has no windows, one
    with a null id is named ``null``; repeated item ids count once; repeated documents each get
    their row; columns not kept are ignored. Empty tables give empty spans or no rows.
    """
    keep = ["doc_id", text_col] if keep is None else keep
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             F.col(item_text_col).cast("binary").alias("data"))
    total = items.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    df = docs.select(*keep, F.col(text_col).cast("binary").alias("__data"),
                     F.lit(None).cast("long").alias("__words"),
                     F.lit(None).cast("array<struct<s:int,e:int>>").alias("__spans"),
                     F.lit(None).cast("array<string>").alias("__items"))
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k)
        df = _pass(df, part, window)
        if k + 1 < shards:                              # one table at a time in a worker's memory
            df = materialize(df, "decontam")
    return df.select(*keep, F.col("__words").alias(f"{prefix}n_words"), F.col("__spans").alias(f"{prefix}spans"),
                     F.col("__items").alias(f"{prefix}items"))


def _pass(df: DataFrame, items: DataFrame, window: int) -> DataFrame:
    rows = items.select("item", "data").collect()       # at most about shard_bytes of text
    names = sorted({r["item"] for r in rows})
    number = {x: i for i, x in enumerate(names)}
    tables = broadcast_bytes(df, (names, compile_patterns([(number[r["item"]], bytes(r["data"] or b"")) for r in rows], window)))
    schema = T.StructType([field(df, c) for c in df.columns])
    at = len(df.columns) - 4                            # __data, __words, __spans, __items come last
    span_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def scan(batches):
        names, compiled = tables.value
        for b in batches:
            n_words, spans, items = [], [], []
            for data, old_spans, old_items in zip(*(b.column(at + i).to_pylist() for i in (0, 2, 3))):
                words = split_words(data)
                now, found = search(words, compiled)
                both = merge_spans(now + [(x["s"], x["e"]) for x in old_spans or []])
                n_words.append(len(words))
                spans.append([{"s": s, "e": e} for s, e in both])
                items.append(sorted({names[i] for i in found} | set(old_items or [])))
            yield pa.RecordBatch.from_arrays(
                b.columns[:at + 1] + [pa.array(n_words, pa.int64()), pa.array(spans, span_type),
                                      pa.array(items, pa.list_(pa.string()))], names=b.schema.names)

    return arrow_batches(df, scan, schema)


def hit_words(spans: str) -> Column:
    """Words inside the spans of a row."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])


def contaminated(n_hit, n_words, per: int = 20):
    """Some word is hit, and at least one in ``per`` words."""
    return (n_hit > 0) & (per * n_hit >= n_words)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of every document (13-word windows, 5 percent of the words)."""
    found = find_overlaps(docs, benchmark, keep=["doc_id"])
    return (found.withColumn("n_hit", hit_words("spans"))
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                    contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all its columns, that are not contaminated. Each row is judged by
    itself where it is read, so there is no join and repeated or null ids change nothing. Null and empty texts stay; an empty
    table gives no rows, an empty benchmark keeps all; other columns may have any name."""
    def clean(df: DataFrame) -> DataFrame:
        found = find_overlaps(df, benchmark, keep=df.columns, prefix="__dc_")
        return found.where(~contaminated(hit_words("__dc_spans"), F.col("__dc_n_words"))).select(*df.columns)

    return set_apart(docs, ["text"], clean)

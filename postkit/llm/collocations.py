"""Collocations: scored word sequences, counted by top-order marginalisation.

Only the longest windows are counted. Every word starts one window of ``max_words`` lead columns
(the word and those after it in its piece, padded with nulls where the piece ends), so every
occurrence of a shorter phrase is the beginning of exactly one window, and the sums over all
beginnings give the counts of all lengths, of single words and of all words.

A longest window is nearly always unique, so a first pass finds the beginnings that can be frequent:
they are counted by hashes of 44 bits, of which a task sends only 32 and a count cut at
``min_count``, packed by the other 12; those that reach ``min_count`` set a bit of a filter of
2**``filter_bits`` bits. The second pass pads a window from its first beginning outside the filter
on, so that little but frequent phrases is sent as words. A clash of hashes or
bits only lets more windows through, and their counts are of the words themselves, so the results
are exact whatever the size of the corpus; a fuller filter pads less.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postkit.llm.common import BATCH_ROWS, broadcast_bytes
from postkit.llm.shingles import mix
from postkit.session import materialize

#: A-Z to lower case, piece ends to a line feed, tab to a space.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Bytes of text handled at a time; longer texts are cut between words.
CHUNK_BYTES = 2 << 20
#: Bits of a hash by which hashes are dealt out (each value has its own piece of the filter), and those sent beside them.
_DEAL_BITS, _SENT_BITS = 12, 32
#: Hashes that a task holds before it counts and sends them.
_HELD = 1 << 21
_GAP = re.compile(rb"[ \n]")
#: Buckets in which a language's best phrases are found before they meet.
_RANK_BUCKETS = 64


def _units(rows, chunk: int, overlap: int):
    """(languages, tokens, words at the end that start no window) for folded stretches of about ``chunk`` bytes. Tokens are
    words and marks: 0xff ends a piece, 0xff and a number starts a row in that language (no UTF-8 text holds that byte)."""
    langs, parts, size = {}, [], 0
    for lang, data in rows:
        data = data.translate(_FOLD)
        mark = b"\xff%d " % langs.setdefault(lang, len(langs))
        if len(data) <= chunk:
            parts.append(mark + data.replace(b"\n", b" \xff "))
            size += len(data)
            if size >= chunk:
                yield list(langs), b" ".join(parts).split(), 0
                langs, parts, size = {}, [], 0
            continue
        start = 0
        while start < len(data):
            cut = _GAP.search(data, start + chunk)
            end = cut.start() if cut else len(data)
            after = re.match(rb" *(?:[^ \n]+ *){0,%d}" % overlap, data[end:end + chunk] if cut else b"").group().split()
            own = data[start:end].replace(b"\n", b" \xff ").split()
            yield [lang], [b"\xff0", *own, *after], len(after)
            start = end
    if parts:
        yield list(langs), b" ".join(parts).split(), 0


class _Windows:
    """The padded windows of one unit: ``columns`` of word numbers from 1 (0: padding), ``lang`` numbers, for every word."""

    def __init__(self, langs: list[str], tokens: list[bytes], tail: int, width: int):
        number = dict.fromkeys(tokens)
        self.words, self.langs = list(number), langs
        for i, w in enumerate(self.words):
            number[w] = i
        ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        marks = [(i, w) for i, w in enumerate(self.words) if w[:1] == b"\xff"]
        is_mark, row_lang = np.zeros(len(self.words) + 1, bool), np.full(len(self.words) + 1, -1, np.int64)
        for i, w in marks:
            is_mark[i] = True
            if len(w) > 1:
                row_lang[i] = int(w[1:])
        seen = row_lang[ids]
        lang = seen[np.maximum.accumulate(np.where(seen >= 0, np.arange(len(ids)), 0))]
        starts = ~is_mark[ids]
        if tail:
            starts[-tail:] = False
        at = np.flatnonzero(starts)
        padded = np.append(np.where(is_mark[ids], 0, ids + 1), np.zeros(width, np.int64))
        self.lang, self.columns = lang[at], [padded[at]]
        for k in range(1, width):
            self.columns.append(np.where(self.columns[-1] > 0, padded[at + k], 0))
        self._hash = np.array([0, *map(xxhash.xxh3_64_intdigest, self.words)], np.uint64)
        self._lang_hash = np.array([xxhash.xxh3_64_intdigest(x) for x in langs], np.uint64)

    def beginnings(self):
        """For each column: the hashes of the windows' words up to it, in their language."""
        h = self._lang_hash[self.lang]
        for c in self.columns:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self._hash[c])
            yield h

    def counted(self, columns):
        """The different rows of (lang, *columns): their first places and numbers."""
        code = self.lang
        for c in columns:
            code = np.unique(code * (len(self.words) + 1) + c, return_inverse=True)[1]
        return np.unique(code, return_index=True, return_counts=True)[1:]


def _source(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("string").cast("binary").alias("text")).where(F.length("text") > 0)


def _all_rows(batches):
    for b in batches:
        for i in range(0, b.num_rows, BATCH_ROWS):
            yield from zip(*[c.to_pylist() for c in b.slice(i, BATCH_ROWS).columns], strict=True)


def _dealt(hashes: np.ndarray, deal_bits: int, most: int, kind) -> pa.RecordBatch:
    """The different ones of ``hashes``, a row for each value of their first ``deal_bits`` bits: ``h`` holds the next 32 bits of
    them and ``n`` how often each is there, ``most`` at most."""
    hashes = hashes >> np.uint64(64 - deal_bits - _SENT_BITS)
    hashes.sort()
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    n = np.minimum(np.diff(np.append(first, len(hashes))), most).astype(kind)
    hashes = hashes[first]
    piece = (hashes >> np.uint64(_SENT_BITS)).astype(np.int32)
    starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    ends, sent = np.append(starts[1:], len(piece)), hashes.astype(np.uint32)
    packed = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(piece[starts]), packed(sent), packed(n)], names=["piece", "h", "n"])


def phrase_filter(source: DataFrame, max_words: int, min_count: int, filter_bits: int, chunk: int = CHUNK_BYTES) -> bytes:
    """The filter: a bit for the hash of every phrase of up to ``max_words`` words that occurs ``min_count`` times or more in its
    language. It is 2**``filter_bits`` / 8 bytes, whatever the corpus."""
    deal_bits = max(0, min(_DEAL_BITS, filter_bits - 3))
    piece_bits, kind = filter_bits - deal_bits, np.min_scalar_type(min_count)

    def counts(batches):
        held, size = [], 0
        for unit in _units(_all_rows(batches), chunk, max_words - 1):
            w = _Windows(*unit, max_words)
            for h, c in zip(w.beginnings(), w.columns, strict=True):
                held.append(h[c > 0])
                size += len(held[-1])
            if size >= _HELD:
                yield _dealt(np.concatenate(held), deal_bits, min_count, kind)
                held, size = [], 0
        if size:
            yield _dealt(np.concatenate(held), deal_bits, min_count, kind)

    def packed(key, table):
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint32)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), kind)
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        often = h[first[np.add.reduceat(n[order], first, dtype=np.int64) >= min_count]]
        bits = np.zeros(1 << piece_bits, np.uint8)
        bits[often >> np.uint32(_SENT_BITS - piece_bits)] = 1
        return pa.table({"piece": [key[0]] if len(often) else pa.array([], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()][:len(often)], pa.binary())})

    step = max(1, (1 << piece_bits) // 8)
    found = bytearray(max(1, (1 << filter_bits) // 8))
    pieces = source.mapInArrow(counts, "piece int, h binary, n binary").groupBy("piece").applyInArrow(packed, "piece int, bits binary")
    for r in pieces.toLocalIterator():
        found[r.piece * step:r.piece * step + len(r.bits)] = r.bits
    return bytes(found)


def padded_windows(source: DataFrame, max_words: int, filter_bits: int, bits, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``lang``, ``w0``, ``w1``, ... and ``n``: the windows of all words, padded from their first beginning outside the filter
    on (``bits``, a broadcast value), and how often each is there; a window may come in several rows."""
    shift, names = np.uint64(64 - filter_bits), [f"w{i}" for i in range(max_words)]

    def windows(batches):
        table = np.frombuffer(bits.value, np.uint8)
        for unit in _units(_all_rows(batches), chunk, max_words - 1):
            w = _Windows(*unit, max_words)
            columns, whole = [], True
            for h, c in zip(w.beginnings(), w.columns, strict=True):
                at = h >> shift
                hit = (table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1)
                columns.append(np.where(whole & (hit > 0), c, 0))
                whole = columns[-1] > 0
            first, n = w.counted(columns)
            words, langs = pa.array(w.words, pa.binary()), pa.array(w.langs, pa.string())
            out = [langs.take(pa.array(w.lang[first]))]
            for c in columns:
                x = c[first]
                text = words.take(pa.array(np.maximum(x - 1, 0), mask=x == 0)).cast(pa.string())
                out.append(text)
            yield pa.RecordBatch.from_arrays([*out, pa.array(n)], names=["lang", *names, "n"])

    return source.mapInArrow(windows, "lang string, " + ", ".join(f"{x} string" for x in names) + ", n long")


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10, filter_bits: int = 27, lang_col: str = "lang",
                  text_col: str = "text", chunk: int = CHUNK_BYTES) -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``n``: every phrase of ``k`` words (up to ``max_words``) that occurs ``min_count`` times or
    more in its language, and per language a row with k = 0, no phrase, and the number of all words.

    A-Z count as a-z; pieces end at ``. , ; : ! ?`` and line ends; words are parted by spaces and tabs. A null language is
    ``und``; null and empty texts and texts without words add nothing; each of several equal rows counts; an empty table
    gives no rows. Other columns are ignored, whatever their names."""
    source, names = _source(docs, lang_col, text_col), [f"w{i}" for i in range(max_words)]
    bits = broadcast_bytes(docs, phrase_filter(source, max_words, min_count, filter_bits, chunk))
    counted = padded_windows(source, max_words, filter_bits, bits, chunk)
    begun = [F.when(F.col(names[i]).isNotNull(), F.concat_ws(" ", *names[:i + 1])) for i in range(max_words)]
    sums = counted.select("lang", F.posexplode(F.array_compact(F.array(F.lit(""), *begun))).alias("k", "phrase"), "n")
    sums = sums.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return sums.where((F.col("k") == 0) | (F.col("n") >= min_count))


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(counts: DataFrame, per_lang: int | None = 2000, absorb_percent: int = 50, max_words: int = 3) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the phrases of 2 words and more of a written table
    of ``phrase_counts``, by score, count and phrase; the first ``per_lang`` of each language (None: all).

    ``score`` is the lowest floor(10**6 a a / (l r)) over the cuts into a first part (l times) and a rest (r times), in
    decimals of 38 digits; of equal cuts the one with the fewest first words counts. A phrase inside a longer one with
    ``absorb_percent`` percent of its count or more goes."""
    known = counts.where(F.col("k") > 0).select("lang", "phrase", "n")
    totals = counts.where(F.col("k") == 0).select("lang", F.col("n").alias("n"))
    cand = counts.where(F.col("k") > 1).select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cand.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _part(F.col("w"), F.lit(1), F.col("cut")).alias("first"),
        _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = (cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"]))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    top, bottom = (F.lit(1000000).cast("decimal(7,0)") * (wide("a") * wide("a"))).cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)")
    cuts = cuts.withColumn("top", top).withColumn("bottom", bottom).withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = cand.where(F.col("k") > 2).select("lang", "k", "w", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "longer", "m", "w", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("i"))
    inner = inner.groupBy("lang", _part(F.col("w"), F.col("i"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < absorb_percent * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if per_lang is not None:
        some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_RANK_BUCKETS))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= per_lang).drop("rank")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if per_lang is not None:
        ranked = ranked.where(F.col("rank") <= per_lang)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, max_words: int = 3, min_count: int = 10, per_lang: int | None = 2000, **options) -> DataFrame:
    """``collocations`` of the phrases of ``docs``; the counts are written once under the shared checkpoint folder."""
    return collocations(materialize(phrase_counts(docs, max_words, min_count, **options), "phrases"), per_lang, max_words=max_words)

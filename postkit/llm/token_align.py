"""Alignment of two tokenizers over the same texts.

Both encode ``space + text``: A a byte-level BPE (vocabulary and merges in a json file), B a sentence
piece model that adds the space itself. The byte offsets at which tokens end are two sorted lists;
their intersection cuts the tokens into groups over the same bytes. It is found by galloping: every
end of the shorter list is searched in the longer one from the place of the last, by steps that
double until they pass it and a binary search between the last two. The common places slice both
lists into groups, and the differences of their ranks are the groups' numbers of tokens.

All pairs of an A and a B token of one group are linked. How many documents hold a pair of ids
linked is one aggregate over the documents' different pairs. These counts go back to the documents
in two ways that add up: the most frequent pairs, ``broadcast_pairs`` at most, are broadcast to a
pass over the written alignments, all others are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit.llm.common import arrow_batches, broadcast_bytes, field
from postkit.llm.tokenizer import LONG_RUN, MAX_RANKS_BYTES, PIECES
from postkit.session import materialize

DEFAULT_BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
DEFAULT_PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Groups with more links than this are reduced to their different ids before they are paired.
_WIDE = 64


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANKS_BYTES + 1)
    if len(data) > MAX_RANKS_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANKS_BYTES} bytes")
    return data


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_bpe_ranks(path: str) -> dict[bytes, int]:
    """Tokens of a byte-level BPE file as bytes, with their ids. Ids must follow the order of the merges, so that
    merging by id is merging by rank."""
    model = json.loads(_read(path))["model"]
    alphabet, vocab = _byte_alphabet(), model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        raise ValueError(f"{path}: ids do not follow the merges")
    known = set(merged)                                   # special tokens are in the vocabulary, too
    return {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if i in known or len(token) == 1}


class Encoders:
    """Ids and token bytes of both tokenizers, in a worker."""

    def __init__(self, ranks: dict[bytes, int], model: bytes):
        import sentencepiece
        import tiktoken

        self._a = tiktoken.Encoding("byte", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = max(ranks.values()) + 1
        self.bytes_a = [b""] * size
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(self._b.id_to_piece(i)) for i in range(self._b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        out, start = [], 0
        if len(text) > 20_000:
            for m in LONG_RUN.finditer(text):            # as in Counter: the last space of a run belongs to what follows
                end = m.end() if m.end() == len(text) else m.end() - 1
                out += self._a.encode_ordinary(text[start:m.start()]) + self._a.encode_ordinary(text[m.start():end])
                start = end
        return out + self._a.encode_ordinary(text[start:])

    def __call__(self, text: str | None) -> tuple[list[int], list[int]] | None:
        """Ids of A and of B, or None where the text has none or a tokenizer does not give its bytes back."""
        if not text:
            return None
        a, b, whole = self.encode_a(" " + text), self._b.encode(text), b" " + text.encode()
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(table.__getitem__, ids)) != whole:
                return None
        return a, b


def common_ends(short: list[int], long: list[int]) -> tuple[list[int], list[int]]:
    """Places of the common values in two strictly increasing lists, by galloping through ``long``."""
    in_short, in_long, j, n = [], [], 0, len(long)              # ``long`` holds a value
    for i, x in enumerate(short):
        if long[j] < x:
            step = 1
            while j + step < n and long[j + step] < x:
                j += step
                step *= 2
            j = bisect_left(long, x, j + 1, min(j + step + 1, n))
            if j == n:
                break
        if long[j] == x:
            in_short.append(i)
            in_long.append(j)
            j += 1
            if j == n:
                break
    return in_short, in_long


def groups(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of the groups in A and in B, with the numbers of all tokens at the end."""
    if len(ends_a) <= len(ends_b):
        a, b = common_ends(ends_a, ends_b)
    else:
        b, a = common_ends(ends_b, ends_a)
    return tuple(np.append(0, np.array(x, np.int64) + 1) for x in (a, b))


def linked_pairs(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Different linked pairs of ids, as id of A times ``size_b`` plus id of B, and how often each is linked."""
    na, nb = np.diff(from_a), np.diff(from_b)
    one, wide = (na == 1) & (nb == 1), na * nb > _WIDE
    codes, times = [a[from_a[:-1][one]] * size_b + b[from_b[:-1][one]]], [np.ones(int(one.sum()), np.int64)]
    some = np.flatnonzero(~one & ~wide)
    n = na[some] * nb[some]
    which = np.repeat(some, n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    codes.append(a[from_a[which] + at // nb[which]] * size_b + b[from_b[which] + at % nb[which]])
    times.append(np.ones(len(which), np.int64))
    for g in np.flatnonzero(wide):
        x, nx = np.unique(a[from_a[g]:from_a[g + 1]], return_counts=True)
        y, ny = np.unique(b[from_b[g]:from_b[g + 1]], return_counts=True)
        codes.append((x[:, None] * size_b + y).ravel())
        times.append((nx[:, None] * ny).ravel())
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(times)).astype(np.int64)


class _Writer:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, size_a: int, size_b: int):
        self.size_a, self.size_b = size_a, size_b
        self.table = np.array([b"%d%s" % (i, end) for n, ends in ((size_a, (b",", b"|")), (size_b, (b",", b";"))) for end in ends for i in range(n)])

    def __call__(self, a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> bytes:
        x, y = a.copy(), b + 2 * self.size_a
        x[from_a[1:] - 1] += self.size_a
        y[from_b[1:] - 1] += self.size_b
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(from_b[:-1], np.diff(from_a))] = x
        out[np.arange(len(b)) + np.repeat(from_a[1:], np.diff(from_b))] = y
        return self.table[out].tobytes().replace(b"\0", b"")[:-1]


def align(docs: DataFrame, byte_bpe: str = DEFAULT_BYTE_BPE, piece_model: str = DEFAULT_PIECE_MODEL, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``pairs`` (different linked
    pairs: id of A times the size of B plus id of B) and ``times`` (how often each is linked). A text without tokens (null, empty, or
    not given back by one of the tokenizers) has zeros, '' and empty lists. Null and repeated ids stay, other columns are ignored."""
    shared = broadcast_bytes(docs, (byte_bpe_ranks(byte_bpe), _read(piece_model)))
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([field(docs, id_col), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("groups_sha256", T.StringType()),
                           T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def run(batches):
        encode = Encoders(*shared.value)
        size_b = len(encode.bytes_b)
        write = _Writer(len(encode.bytes_a), size_b)
        for batch in batches:
            rows, nothing = [], (0, 0, 0, 0, "", [], [])
            for text in batch.column(1).to_pylist():
                ids = encode(text)
                if ids is None:
                    rows.append(nothing)
                    continue
                a, b = (np.array(x, np.int64) for x in ids)
                from_a, from_b = groups(np.cumsum(encode.length_a[a]).tolist(), np.cumsum(encode.length_b[b]).tolist())
                pairs, times = linked_pairs(a, b, from_a, from_b, size_b)
                rows.append((len(a), len(b), len(from_a) - 1, int(times.sum()), hashlib.sha256(write(a, b, from_a, from_b)).hexdigest(), pairs, times))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=schema.names)

    return arrow_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, schema)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``pair``, ``n_docs`` (rows of ``aligned`` that hold it linked), ``best`` (no other pair of its id of A has more)."""
    counts = materialize(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")), "pairs")
    of = F.floor(F.col("pair") / size_b).alias("of")
    most = counts.groupBy(of).agg(F.max("n_docs").alias("most"))
    return counts.select("pair", "n_docs", of).join(most, "of").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least number of documents for which at most ``most`` pairs have as many or more (0: all pairs), from a histogram
    over eighths of powers of two."""
    step = F.floor(F.log2("n_docs") * 8).cast("int")
    hist = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("n_docs").alias("least")).collect(), key=lambda r: -r.step)
    total, least = 0, 1 << 62
    for r in hist:
        total += r.n
        if total > most:
            return least
        least = r.least
    return 0


def summarise(docs: DataFrame, byte_bpe: str = DEFAULT_BYTE_BPE, piece_model: str = DEFAULT_PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text",
              broadcast_pairs: int = 1 << 21) -> DataFrame:
    """The columns of ``align`` without the pairs, ``n_best`` (links whose pair has the highest count of its id of A) and ``count_sum``
    (counts of the links' pairs). A count is a number of rows of ``docs``: equal rows count each. An empty table gives no rows."""
    size_b = len(Encoders(byte_bpe_ranks(byte_bpe), _read(piece_model)).bytes_b)
    found = align(docs, byte_bpe, piece_model, id_col, text_col)
    names = ["id", *found.columns[1:]]
    aligned = materialize(found.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(aligned, size_b), "pair-counts")
    least = _frequent(counts, broadcast_pairs)
    table = counts.where(F.col("n_docs") >= least).toArrow().sort_by("pair") if least < 1 << 62 else counts.limit(0).toArrow()
    shared = broadcast_bytes(docs, tuple(table.column(c).to_numpy() for c in ("pair", "n_docs", "best")))

    def known(batches):
        pair, n_docs, best = shared.value
        for b in batches:
            pairs, times = (b.column(i).flatten().to_numpy() for i in (1, 2))
            row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            yield b, row, pairs, times, hit, at, n_docs, best

    def totals(batches):
        for b, row, _, times, hit, at, n_docs, best in known(batches):
            n_best, count_sum = (np.zeros(b.num_rows, np.int64) for _ in range(2))
            np.add.at(n_best, row[hit], times[hit] * best[at[hit]])
            np.add.at(count_sum, row[hit], times[hit] * n_docs[at[hit]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_best), pa.array(count_sum)], names=["row", "n_best", "count_sum"])

    def others(batches):
        for b, row, pairs, times, hit, *_ in known(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[~hit])), pa.array(pairs[~hit]), pa.array(times[~hit])], names=["row", "pair", "times"])

    linked = aligned.select("row", "pairs", "times")
    sums = arrow_batches(linked, totals, "row long, n_best long, count_sum long")
    if least:                                             # some pairs were not broadcast
        rest = arrow_batches(linked, others, "row long, pair long, times long").join(counts.where(F.col("n_docs") < least), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
        sums = sums.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.select("row", *names[:-2]).join(sums, "row").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

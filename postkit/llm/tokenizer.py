"""Encoded lengths of texts with a public byte-level BPE vocabulary.

The ranks file is read once on the driver and broadcast (its size is that of the vocabulary, and
is checked), so executors need no copy of it.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit.llm.common import arrow_batches, broadcast_bytes, field

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary splits texts (possessive form of its published pattern).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: White space of the pattern; Python's \s has a few more control characters.
WS = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Long runs of white space exceed the pattern engine's stack; they are cut where it would cut.
LONG_RUN = re.compile(f"{WS}{{2000,}}")
MAX_RANKS_BYTES = 64 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A ranks file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANKS_BYTES + 1)
    if len(data) > MAX_RANKS_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANKS_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Counter:
    """Encoded length of whole texts under one vocabulary (null and empty: 0)."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encode = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        total, start = 0, 0
        if len(text) > 20_000:
            for m in LONG_RUN.finditer(text):            # the last space of a run belongs to what follows
                end = m.end() if m.end() == len(text) else m.end() - 1
                total += len(self.encode(text[start:m.start()])) + len(self.encode(text[m.start():end]))
                start = end
        return total + len(self.encode(text[start:]))


def token_lengths(docs: DataFrame, ranks_path: str = DEFAULT_RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``n_tokens``, the encoded length of its whole text
    (null and empty texts: 0). Null and repeated ids are kept, other columns ignored."""
    shared = broadcast_bytes(docs, load_ranks(ranks_path))
    schema = T.StructType([field(docs, id_col), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        count = Counter(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([count(x) for x in b.column(1).to_pylist()], pa.int64())], names=[id_col, "n_tokens"])

    return arrow_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, schema)

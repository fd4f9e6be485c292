"""Token alignment against a plain version with the public tokenizer libraries, and edge rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postkit.llm import token_align as ta

DOC = "doc_id long, text string, row long, pair string, n_a string, id string"


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 200), min_size=1), st.sets(st.integers(1, 200), min_size=1))
def test_galloping_finds_the_common_ends(x, y):
    x, y = sorted(x), sorted(y)
    a, b = ta.common_ends(x, y)
    assert [x[i] for i in a] == [y[j] for j in b] == sorted(set(x) & set(y))


TOKENIZER = Tokenizer.from_file(ta.DEFAULT_BYTE_BPE)
TOKENIZER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=ta.DEFAULT_PIECE_MODEL)
_SHIFTED = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
_BYTE = {chr(256 + i): b for i, b in enumerate(_SHIFTED)}


def plain(rows):
    docs, holders = [], Counter()
    for doc_id, text in rows:
        whole = b" " + (text or "").encode()
        a = TOKENIZER.encode(" " + (text or ""), add_special_tokens=False).ids
        b = PIECES.encode(text or "")
        bytes_a = [bytes(_BYTE.get(c, ord(c) & 255) for c in TOKENIZER.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(PIECES.id_to_piece, b)]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((doc_id, [], Counter()))
            continue
        ends = []
        for tokens in (bytes_a, bytes_b):
            at, n = [], 0
            for t in tokens:
                n += len(t)
                at.append(n)
            ends.append(at)
        both = sorted(set(ends[0]) & set(ends[1]))
        found, low = [], 0
        for high in both:
            found.append(tuple([i for i, e in zip(ids, at, strict=True) if low < e <= high] for ids, at in zip((a, b), ends, strict=True)))
            low = high
        links = Counter((x, y) for p, q in found for x in p for y in q)
        holders.update(links.keys())
        docs.append((doc_id, found, links))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, found, links in docs:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in found)
        out.append((doc_id, sum(len(p) for p, _ in found), sum(len(q) for _, q in found), len(found), sum(links.values()),
                    sum(n for x, n in links.items() if holders[x] == most[x[0]]), sum(n * holders[x] for x, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return sorted(out, key=repr)


WORDS = ["the", "The", " reading", "Straße", "été", "漢字", "▁", "<|endoftext|>", "</s>", "<s>", "<0x41>", "  ", "\n\n", "\t", "'ll", "1234", "🙂", "​", "xx", "\xa0", "."]


@pytest.mark.parametrize("broadcast_pairs", [1 << 21, 200, 0])
def test_alignment_equals_the_plain_version(spark, broadcast_pairs):
    r = random.Random(4)
    text = lambda: "".join(r.choice(WORDS) + r.choice(["", " "]) for _ in range(r.randint(0, 25)))
    rows = [(i, text()) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n" * 3000 + "a"), (204, "x" * 2000), (205, "é" * 300), (206, "a " * 2000), (None, "again"), (None, "again"), (3, "the"), (207, "漢" * 70 + "͸" * 40)]
    docs = spark.createDataFrame([(i, t, 1, "p", "n", "i") for i, t in rows], DOC)
    got = [tuple(x) for x in ta.summarise(docs, broadcast_pairs=broadcast_pairs).collect()]
    assert sorted(got, key=repr) == plain(rows)


def test_very_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000, 1, "p", "n", "i"), (2, " " * 90_000, 1, "p", "n", "i"), (3, "x" * 40_000, 1, "p", "n", "i")], DOC)
    got = {x.doc_id: x for x in ta.summarise(docs).collect()}
    assert got[1].n_a >= 60_000 and got[1].n_groups >= 60_000
    assert ta.summarise(docs.where("false")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_public_library(text):
    encode = getattr(test_ids_are_those_of_the_public_library, "encode", None) or ta.Encoders(ta.byte_bpe_ranks(ta.DEFAULT_BYTE_BPE), ta._read(ta.DEFAULT_PIECE_MODEL))
    test_ids_are_those_of_the_public_library.encode = encode
    assert encode.encode_a(" " + text) == TOKENIZER.encode(" " + text, add_special_tokens=False).ids

"""Collocations against a plain version, and edge rows."""

import random
import re
from collections import Counter

import pytest

from postkit.llm import collocations

DOC = "doc_id long, text string, lang string, n long, k string, phrase string, w0 string"


def plain(rows, min_count, width=3, per_lang=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, width + 1) for i in range(len(w) - k + 1))
    cand = {x: n for x, n in counts.items() if len(x[1]) > 1 and n >= min_count}
    out = []
    for (lang, w), a in cand.items():
        inside = any(lang == other and len(v) > len(w) and 100 * n >= 50 * a and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
                     for (other, v), n in cand.items())
        cuts = [(10**6 * a * a // (counts[lang, w[:c]] * counts[lang, w[c:]]), c) for c in range(1, len(w))]
        score, c = min(cuts)
        if not inside:
            out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:c]], counts[lang, w[c:]]))
    rank, result = Counter(), []
    for lang, s, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= per_lang:
            result.append((lang, rank[lang], p.decode(), -a, left, right, total[lang], -s))
    return sorted(result)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 5, "k", "p", "w") for i, (lang, t) in enumerate(rows)], DOC)


@pytest.mark.parametrize("chunk,bits,width", [(8 << 20, 20, 3), (40, 4, 3), (300, 16, 4)])
def test_collocations_equal_the_plain_version(spark, chunk, bits, width):
    r = random.Random(chunk)
    words = ["a", "b", "B", "ç", "Éa", "zz", "\x1f", "<|x|>", "漢字", "\xa0"]
    def text(n):
        return "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", ";"]) for _ in range(n))
    rows = [(r.choice(["en", "en", "de", None, "und", "", "x y"]), text(r.randint(0, 60))) for _ in range(120)]
    rows += [("en", None), (None, None), ("en", ""), ("fr", " \t\n.,"), ("fr", "one"), ("en", text(3000)), ("en", "a b " * 40_000), ("de", "x" * 60_000)]
    rows += [rows[3]] * 30
    got = collocations.mine(table(spark, rows), max_words=width, min_count=10, filter_bits=bits, chunk=chunk)
    assert sorted(tuple(x) for x in got.collect()) == plain(rows, 10, width)


def test_first_phrases_and_empty_tables(spark):
    r = random.Random(2)
    rows = [("en", " ".join(r.choice("abcdefgh") for _ in range(50))) for _ in range(40)]
    got = collocations.mine(table(spark, rows), min_count=3, per_lang=7)
    assert sorted(tuple(x) for x in got.collect()) == plain(rows, 3, per_lang=7)
    assert collocations.mine(table(spark, rows).where("false")).collect() == []


def test_products_beyond_64_bits(spark):
    a = 10**12
    counts = spark.createDataFrame([("en", 0, "", 10**15), ("en", 1, "x", 3 * a), ("en", 1, "y", 7 * a + 1), ("en", 2, "x y", a)], "lang string, k int, phrase string, n long")
    (row,) = collocations.collocations(counts).collect()
    assert row.score == 10**6 * a * a // (3 * a * (7 * a + 1))


def test_only_what_can_be_frequent_is_sent_as_words(spark):
    import numpy as np
    words = [f"w{i}" for i in range(24)]
    texts = [f"{a} {b} {c}." for a in words for b in words for c in words]       # every pair 1,152 times, every triple once
    texts += [f"rare{i}" for i in range(2000)] + ["w1 w2 w3"] * 9
    source = collocations._source(table(spark, [("en", t) for t in texts]), "lang", "text")
    bits = collocations.phrase_filter(source, 3, 10, 24)
    assert len(bits) == 2**21 and np.unpackbits(np.frombuffer(bits, np.uint8)).sum() == 24 + 24**2 + 1
    sent = collocations.padded_windows(source, 3, 24, spark.sparkContext.broadcast(bits)).collect()
    assert sum(x.n for x in sent) == 3 * (24**3 + 9) + 2000
    assert sum(x.n for x in sent if x.w0 is None) == 2000                        # they count among all words only
    assert {(x.w0, x.w1, x.w2) for x in sent if x.w2 is not None} == {("w1", "w2", "w3")}

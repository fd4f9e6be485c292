"""Small tests of the text operators: brute-force twins and edge rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from postkit.llm import decontam, langid, line_dedup, minhash, packing, token_counts, toxicity
from postkit.llm.shingles import shingle_hashes, word_hashes
from postkit.llm.tokenizer import DEFAULT_RANKS, Counter, load_ranks, token_lengths

DOC = "doc_id long, text string, lang string, source string, n_chars long, item_id string, label string, n_words string"


def documents(spark, texts, langs=None, ids=None):
    """Rows with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(ids[i] if ids else i, t, langs[i] if langs else "en", "s", None, "x", "y", "z") for i, t in enumerate(texts)], DOC)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


EDGES = [None, "", "   \n\t", "!!! ...", "word", "word", "a " * 30_000, "x" * 50_000, "é漢字 ñ"]


# ---- words and shingles -------------------------------------------------------------------

def test_word_hashes_follow_words():
    r = random.Random(5)
    for _ in range(200):
        text = "".join(r.choice("aB1é ,.-\n漢") for _ in range(r.randint(0, 60)))
        words = decontam.split_words(text.encode())
        h = word_hashes(text.encode())
        assert len(h) == len(words)
        assert len(set(h.tolist())) == len(set(words))
        assert len(shingle_hashes(h, 5)) == (max(1, len(words) - 4) if words else 0)


# ---- op2 ----------------------------------------------------------------------------------

def brute_decontam(docs, items, window=13):
    out = {}
    wins = {}
    for item, text in items:
        w = decontam.split_words((text or "").encode())
        if w:
            k = min(window, len(w))
            wins.setdefault(str(item) if item is not None else "null", set()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for d, text in docs:
        w = decontam.split_words((text or "").encode())
        hit, found = set(), set()
        for item, ps in wins.items():
            for p in ps:
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i:i + len(p)]) == p:
                        hit.update(range(i, i + len(p)))
                        found.add(item)
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("shard", [16 << 20, 40])
def test_decontamination_equals_brute_force(spark, shard):
    r = random.Random(3)
    vocab = ["the", "of", "a", "b", "é", "Of", "x1"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 5, 13, 14, 20]))) for i in range(8)] + [(None, "zebra quagga"), (3, "again of"), (9, None), (10, "!!")]
    docs = [(i, f"{text(r.randint(0, 40))} {(items[r.randrange(8)][1] if i % 2 else '')} {text(r.randint(0, 9))}") for i in range(60)]
    docs += [(100 + i, t) for i, t in enumerate(EDGES)] + [(200, "zebra, QUAGGA")]
    d = documents(spark, [t for _, t in docs], ids=[i for i, _ in docs])
    b = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    found = decontam.find_overlaps(d, b, keep=["doc_id"], shard_bytes=shard)
    found = found.withColumn("n_hit", decontam.hit_words("spans")).collect()
    want = brute_decontam(docs, items)
    for x in found:
        got = (x.n_words, x.n_hit, len(x["items"]), hashlib.sha256(",".join(x["items"]).encode()).hexdigest(), x.n_hit > 0 and 20 * x.n_hit >= x.n_words)
        assert got == want[x.doc_id], x.doc_id
    if shard > 100:
        assert {x.doc_id: tuple(x)[1:] for x in decontam.digest(d, b).collect()} == want


def test_decontamination_empty_tables_and_repeats(spark):
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    d = documents(spark, ["one two three", "one two three", "clean text here"], ids=[7, 7, None])
    assert rows(decontam.digest(d, b), "doc_id", "n_hit", "contaminated") == sorted([(7, 3, True), (7, 3, True), (None, 0, False)], key=repr)
    assert decontam.drop_contaminated(d, b).columns == d.columns
    assert rows(decontam.drop_contaminated(d, b), "doc_id", "text", "n_words") == [(None, "clean text here", "z")]
    assert decontam.digest(d.limit(0), b).count() == 0
    assert rows(decontam.digest(d, b.limit(0)), "n_hit", "n_items") == [(0, 0)] * 3


# ---- op3 ----------------------------------------------------------------------------------

def test_line_templates_generalise_and_keep_first(spark):
    notice = "Posted on 2024-01-0{} by user{} in the general news section today"
    near = "this long shared line differs in just one {} word somewhere in its middle part only"
    texts = [f"alpha own text of one\n{notice.format(1, 7)}\n{near.format('red')}", f"beta own text of two\n{notice.format(2, 8)}\n\n{near.format('blue')}",
             f"gamma own text of three\n{near.format('green')}\nalpha", None, "", "alpha own text of one more", "alpha"]
    d = documents(spark, texts).withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(d).collect()}
    assert got[0] == (texts[0], 3, 0)
    assert got[1] == ("beta own text of two\n", 4, 2)
    assert got[2] == ("gamma own text of three\nalpha", 3, 1)     # the first place of a short line
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0)
    assert got[5][2] == 0 and got[6] == ("", 1, 1)
    assert line_dedup.dedup_lines(d).columns.count("n_lines") == 1


def test_line_dedup_copies_repeats_numbers_and_empty(spark):
    body = "\n".join(f"paragraph {w} of a document that was copied whole by others" for w in ("one", "two", "three"))
    d = documents(spark, [body, body, "12 34 56", "78 90 12", body], ids=[5, 5, 8, 9, 2])
    got = rows(line_dedup.dedup_lines(d), "doc_id", "text")
    assert got == sorted([(2, body), (5, ""), (5, ""), (8, "12 34 56"), (9, "78 90 12")], key=repr)
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0
    edges = documents(spark, EDGES + ["x" * 50_000], ids=[None] + list(range(len(EDGES))))
    assert line_dedup.dedup_lines(edges).count() == len(EDGES) + 1


def test_line_dedup_of_repeated_rows_with_some_recurring_lines(spark):
    shared = "this one notice is on every page of the whole site"
    texts = [f"{shared}\nfirst own text", f"{shared}\nsecond own text", f"third own text\n{shared}", f"fourth own text\n\n{shared}"]
    d = documents(spark, [texts[0], *texts[1:] * 3, texts[2]], ids=[1, *[5, 7, None] * 3, 8])
    got = rows(line_dedup.dedup_lines(d), "doc_id", "text", "n_lines", "n_dropped")
    want = [(1, texts[0], 2, 0), (8, "", 2, 2)] + [(5, "second own text", 2, 1), (7, "third own text", 2, 1), (None, "fourth own text\n", 3, 1)] * 3
    assert got == sorted(want, key=repr)


def test_a_leaf_holds_several_families(spark):
    """Two families with the same length and leading tokens, many unrelated lines of that leaf, and a family of two lines."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfghjklmnp") for _ in range(7))
    a = [f"the report of {word()} was sent to all of the members here" for _ in range(12)]
    b = [f"the report of our group says that {word()} went home alone today" for _ in range(13)]
    c = [f"the report of nine old men on a {x} boat was sunk" for x in ("red", "blue")]
    other = ["the report of " + " ".join(word() for _ in range(9)) for _ in range(200)]
    lines = [(kind, x) for kind, xs in (("a", a), ("b", b), ("c", c), ("other", other)) for x in xs]
    r.shuffle(lines)
    got = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(documents(spark, [x for _, x in lines])).collect()}
    dropped = {k: sum(got[i] for i, (kind, _) in enumerate(lines) if kind == k) for k in "abc"}
    assert all(len(x.split(" ")) == 12 for _, x in lines)
    assert dropped == {"a": 11, "b": 12, "c": 1} and sum(got.values()) == 24


def test_short_lines_can_be_left_to_a_larger_number_of_documents(spark):
    docs = documents(spark, [f"same here\nown line number {'abc'[i]} of this text is long" for i in range(3)])
    assert sorted(x.n_dropped for x in line_dedup.dedup_lines(docs).collect()) == [0, 2, 2]
    assert [x.n_dropped for x in line_dedup.dedup_lines(docs, short_tokens=8, similarity=1.0).collect()] == [0, 0, 0]


def test_line_dedup_is_native(spark):
    plan = line_dedup.dedup_lines(documents(spark, ["a b c", "d"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- op4 ----------------------------------------------------------------------------------

SAMPLES = {"en": "the and of that with this from which have not are".split(), "de": "der und die nicht mit sich das ist auf eine".split(),
           "es": "que los del por con una para las como pero".split()}


def sentences(n, seed=1):
    r = random.Random(seed)
    return [(lang, " ".join(r.choice(SAMPLES[lang]) for _ in range(r.randint(4, 40)))) for _ in range(n) for lang in SAMPLES]


def test_language_id_learns_and_marks_unknown(spark):
    data = sentences(40)
    d = documents(spark, [t for _, t in data] + EDGES, langs=[x for x, _ in data] + [None] * len(EDGES))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = langid.fit(d, fold != 2)
    got = {r.doc_id: r for r in langid.predict(d, model).collect()}
    held = [i for i in range(len(data)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == data[i][0] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    for k in range(4):
        assert (got[len(data) + k].lang_pred, got[len(data) + k].score) == ("und", 0.0)
    kept = langid.accept(d, model)
    assert kept.columns == d.columns and kept.where("text is null or text = ''").count() == 0
    assert kept.where(F.col("doc_id") < len(data)).count() == len(data)
    assert got[len(data) + 4].lang_pred == got[len(data) + 5].lang_pred


def test_language_id_does_not_learn_from_held_out_or_null(spark):
    data = sentences(10)
    d = documents(spark, [t for _, t in data], langs=[x for x, _ in data])
    assert langid.fit(d, F.lit(False)) == {"classes": []}
    assert {r.lang_pred for r in langid.predict(d, langid.fit(d, F.lit(False))).collect()} == {"und"}
    only = langid.fit(d.where("lang = 'de'"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(d, only).collect()} == {"de"}
    assert langid.predict(d.limit(0), only).count() == 0
    assert langid.fit(d.limit(0), F.lit(True)) == {"classes": []}


def test_ngrams_do_not_depend_on_stretches(monkeypatch):
    table = langid.fold_table()
    text = "".join(random.Random(2).choice("abc É,1 Z") for _ in range(5000))
    whole = langid.ngram_counts(text, table)
    monkeypatch.setattr(langid, "STRETCH", 37)
    assert (langid.ngram_counts(text, table) == whole).all()


# ---- op5 ----------------------------------------------------------------------------------

def near_copy(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"w{r.randrange(10**6)}"
    return out


def brute_classes(texts, idf, threshold=0.8):
    sets = [minhash.weighted_set((t or "").encode(), 5, idf) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and minhash.weighted_jaccard(sets[i], sets[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(9)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 300))]
        texts += [" ".join(base), "  ".join(base).upper()] + [" ".join(near_copy(r, base, e)) for e in (1, 2, 3, 6)]
    chain = [f"c{i}" for i in range(200)]                       # neighbours alike, the ends far apart
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = near_copy(r, chain, 3)
    passage = " ".join(f"p{i}" for i in range(60))              # shared passage, otherwise different
    texts += [passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(60)) for _ in range(15)]
    texts += ["a b c", "a b c", "A, b! c", "a b", "one two three four five"]
    d = documents(spark, texts)
    idf = minhash.idf_table(d, "text", 5)
    want = brute_classes(texts, idf)
    got = {x.doc_id: x.class_id for x in minhash.classes(d).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = minhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(want))


def test_near_duplicate_edges(spark):
    d = documents(spark, EDGES + ["same words here", "same words here", "Same, words here!"], ids=[None, None, 1, 2, 4, 3, 5, 6, 7, 9, 9, 8])
    got = rows(minhash.classes(d), "doc_id", "class_id", "n_class")
    assert got == sorted([(None, None, 1), (None, None, 1), (1, 1, 1), (2, 2, 1), (4, 3, 2), (3, 3, 2), (5, 5, 1), (6, 6, 1), (7, 7, 1), (9, 8, 3), (9, 8, 3), (8, 8, 3)], key=repr)
    kept = minhash.drop_near_duplicates(d)
    assert sorted(x.doc_id or -1 for x in kept.collect()) == [-1, -1, 1, 2, 3, 5, 6, 7, 8]
    assert minhash.classes(d.limit(0)).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    own = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcdefg"]
    near = own[0] + " end"
    d = documents(spark, [own[0], near, own[1], own[2], own[2], own[3], own[4], own[5], own[5], own[6]], ids=[None, None, None, None, None, 7, 7, 7, None, 8])
    idf = minhash.idf_table(d, "text", 5)
    assert minhash.weighted_jaccard(*(minhash.weighted_set(t.encode(), 5, idf) for t in (own[0], near))) >= 0.9
    got = rows(minhash.drop_near_duplicates(d), "doc_id", "text")
    assert [x for x in got if x[1] not in (own[0], near)] == sorted([(None, own[1]), (None, own[2]), (7, own[3]), (7, own[4]), (7, own[5]), (8, own[6])], key=repr)
    assert sum(x in [(None, own[0]), (None, near)] for x in got) == 1


def test_consistent_sampling_estimates_weighted_jaccard():
    import numpy as np
    rng = np.random.default_rng(4)
    f = np.sort(rng.integers(0, 2**63, 1500, dtype=np.uint64))
    a, b = (f[:1200], rng.choice([1.0, 1.5, 2.0], 1200)), (f[300:], rng.choice([1.0, 2.0], 1200))
    same = (minhash.consistent_samples(*a, 4000) == minhash.consistent_samples(*b, 4000)).mean()
    assert abs(same - minhash.weighted_jaccard(a, b)) < 0.03


def test_least_of_bounds_is_the_least_of_all():
    import numpy as np
    rng = np.random.default_rng(8)
    for rows, n, kinds in ((1, 1, 9), (7, 300, 2**63), (60, 256, 2**63), (40, 200, 5), (3, 50, 1)):
        x = rng.choice(rng.integers(0, 2**64, min(kinds, 20_000), dtype=np.uint64), (rows, n))        # few kinds: equal values
        for rest in (rng.normal(0, 2, (rows, n)), rng.integers(-1, 1, (rows, n)), np.zeros((rows, n))):
            rest = rest.astype(np.float32)
            value = minhash._LOG_C[(x >> np.uint64(44)).astype(np.int64)] + rest
            i, least = minhash._least(x, rest, np.empty_like(x), np.empty_like(rest))
            assert (i == value.argmin(axis=1)).all() and (least == value.min(axis=1)).all()


@pytest.mark.parametrize("similarity", [0.8, 0.81])
def test_bands_miss_no_more_than_independent_ones(similarity):
    import inspect

    import numpy as np
    rng, default = np.random.default_rng(3), inspect.signature(minhash.classes).parameters
    slots = minhash.band_slots(*(default[x].default for x in ("samples", "bands", "rows")))
    same = rng.random((500_000, default["samples"].default), np.float32) < similarity
    missed = ~np.any([same[:, band].all(axis=1) for band in slots], axis=0)
    assert missed.mean() <= (1 - similarity**3) ** 10      # ten bands of three samples of their own


# ---- op7, op10 ----------------------------------------------------------------------------

def test_token_lengths_and_long_white_space(spark):
    count = Counter(load_ranks(DEFAULT_RANKS))
    assert count(None) == count("") == 0
    assert count("x" + " " * 3_000_000 + "y") > 1
    mid = "a" + "\n" * 2500 + " b" * 12_000 + "\t" * 2100
    assert count(mid) == len(count.encode(mid))
    got = token_lengths(documents(spark, EDGES), DEFAULT_RANKS).collect()
    assert [x.n_tokens for x in sorted(got, key=lambda x: x.doc_id)] == [count(t) for t in EDGES]
    assert token_lengths(documents(spark, EDGES).limit(0)).count() == 0


def test_limit_table_equals_brute_force(spark):
    r = random.Random(1)
    lengths = [r.choice([0, 1, 5, 1023, 1024, 1025, 3000, 50_000]) for _ in range(300)]
    hist = token_counts.length_histogram(spark.createDataFrame([(n,) for n in lengths] + [(None,)], "n_tokens long"))
    lengths.append(0)
    limits = token_counts.limit_table(hist)
    for x in limits.collect():
        k = x.n_tokens
        assert (x.n_docs, x.docs_over, x.tokens_over) == (lengths.count(k), sum(n > k for n in lengths), sum(n for n in lengths if n > k))
        assert (x.docs_within, x.tokens_within) == (sum(n <= k for n in lengths), sum(n for n in lengths if n <= k))
        assert x.truncated_total == sum(min(n, k) for n in lengths) and abs(x.quantile - x.docs_within / len(lengths)) < 1e-12
    at = token_counts.at_limits(hist, [0, 7, 2000, 10**6]).collect()
    assert [(x.docs_over, x.truncated_total) for x in at] == [(sum(n > k for n in lengths), sum(min(n, k) for n in lengths)) for k in (0, 7, 2000, 10**6)]
    got = {x.share: x.n_tokens for x in token_counts.quantiles(limits, [0.5, 1.0]).collect()}
    assert got[1.0] == max(lengths) and got[0.5] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    empty = token_counts.length_histogram(spark.createDataFrame([], "n_tokens long"))
    assert token_counts.limit_table(empty).count() == 0 and token_counts.at_limits(empty, [5]).first().truncated_total == 0


def brute_padding(lengths, counts, buckets):
    import itertools
    best = None
    for m in range(min(buckets, len(lengths))):
        for cut in itertools.combinations(range(len(lengths) - 1), m):
            bounds = [lengths[i] for i in cut] + [lengths[-1]]
            pad = sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
            best = pad if best is None else min(best, pad)
    return best


def test_bucket_bounds_are_optimal():
    r = random.Random(8)
    for _ in range(200):
        lengths = sorted(r.sample(range(1, 60), r.randint(1, 9)))
        counts, k = [r.randint(1, 9) for _ in lengths], r.randint(1, 5)
        bounds = packing.bucket_bounds(lengths, counts, k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1]
        assert sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts)) == brute_padding(lengths, counts, k)
    assert packing.bucket_bounds([], [], 4) == []


def test_packing_places_every_document_once(spark):
    r = random.Random(6)
    data = [(r.randrange(400), r.choice([None, 0, 3, 3, 3, 9, 17, 64, 500])) for _ in range(500)] + [(None, 12), (None, 12)]
    got = packing.pack(spark.createDataFrame([(i, n, "x") for i, n in data], "doc_id long, n_tokens long, bucket string"), budget=256, buckets=3).collect()
    assert sorted(((x.doc_id, x.n_tokens) for x in got), key=repr) == sorted(((i, n or 0) for i, n in data), key=repr)
    places = [(x.bucket, x.batch, x.slot) for x in got if x.n_tokens]
    assert len(set(places)) == len(places)
    for x in got:
        if not x.n_tokens:
            assert x.bucket is None and x.batch is None and x.slot is None
            continue
        fits = max(1, 256 // x.bucket_len)
        assert x.n_tokens <= x.bucket_len and x.slot < fits and x.over_budget == (x.bucket_len > 256)
    for b in {x.bucket for x in got if x.n_tokens}:             # batches are full but for the last
        inside = sorted((x.batch, x.slot) for x in got if x.bucket == b)
        fits = max(1, 256 // next(x.bucket_len for x in got if x.bucket == b))
        assert inside == [(i // fits, i % fits) for i in range(len(inside))]
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 0)], "doc_id long, n_tokens long")).first().bucket is None


def test_packing_has_the_least_padding(spark):
    data = [9, 9, 9, 10, 17, 18, 19, 33, 33, 50]
    got = packing.pack(spark.createDataFrame(list(enumerate(data)), "doc_id long, n_tokens long"), buckets=3).collect()
    lengths = sorted(set(data))
    assert sum(x.bucket_len - x.n_tokens for x in got) == brute_padding(lengths, [data.count(n) for n in lengths], 3)
    assert {x.bucket_len for x in got} <= set(lengths)


def test_packing_deals_a_hot_length_without_ids(spark):
    """Rows of one length and no id are many ranges of the written order, and every one has a place."""
    data = [(None, 7)] * 4000 + [(i, 3 + i % 3) for i in range(40)] + [(None, 0), (None, None)]
    wide = spark.createDataFrame(data, "doc_id long, n_tokens long").repartition(8).withColumns({c: F.lit("x") for c in ("id", "own", "padded", "at")})
    plan = []
    real = packing.materialize
    packing.materialize = lambda df, name: plan.append(real(df, name)) or plan[-1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")       # small ranges stay apart
    try:
        got = packing.pack(wide, budget=70, buckets=2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        packing.materialize = real
    assert len(got) == len(data) and len({(x.bucket, x.batch, x.slot) for x in got if x.bucket is not None}) == 4040
    assert all(x.bucket is x.bucket_len is x.batch is x.slot is None and not x.over_budget for x in got if not x.n_tokens)
    in_batch = [x.slot for x in got if x.n_tokens == 7]
    assert max(in_batch) == 9 and in_batch.count(0) == 400
    ranges = plan[0].where("padded = 7").groupBy(F.shiftright("at", 33)).count().collect()
    assert len(ranges) >= 4 and max(r["count"] for r in ranges) <= 2000


# ---- op1 ----------------------------------------------------------------------------------

def toxic_corpus(n=400, seed=2):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    out = []
    for _ in range(n):
        bad = r.random() < 0.25
        w = [r.choice(words) for _ in range(r.randint(10, 60))]
        if bad:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "moron", "vileness", "vilely"]))
        out.append((" ".join(w), int(bad)))
    return out


def test_toxicity_learns_and_scores_all(spark):
    data = toxic_corpus()
    d = documents(spark, [t for t, _ in data] + EDGES)
    labels = spark.createDataFrame([(i, 1, y, "extra") for i, (_, y) in enumerate(data)] + [(None, 1, 1, ""), (3, None, None, "")], "doc_id long, quality int, toxic int, text string")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    got = {x.doc_id: x for x in toxicity.fit_and_score(d, labels, fold != 0).collect()}
    assert len(got) == len(data) + len(EDGES)
    held = [i for i in range(len(data)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i].score >= 0.5) == bool(data[i][1]) for i in held)
    assert all(0 <= x.score <= 1 for x in got.values()) and got[len(data)].score < 0.5
    toxic = next(i for i in held if data[i][1])
    assert got[toxic].evidence and not set(got[toxic].evidence) & set(held)


def test_toxicity_without_labels_or_rows(spark):
    d = documents(spark, ["a b", "a b", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert rows(toxicity.fit_and_score(d, none, F.lit(True)), "score") == [(0.0,)] * 3
    ones = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, toxic int")
    assert all(x.score > 0.5 for x in toxicity.fit_and_score(d, ones, F.lit(True)).collect())
    assert toxicity.fit_and_score(d.limit(0), ones, F.lit(True)).count() == 0


def test_toxicity_of_rare_words(spark):
    """Marking words that few labelled rows hold are compared too, and a text with known words has a score of its own."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(1500)]
    bad = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)]
    data = []
    for _ in range(3000):
        w = [words[min(1499, int(r.expovariate(1 / 300)))] for _ in range(r.randint(20, 120))]
        toxic = int(r.random() < 0.1)
        for _ in range(r.randint(1, 3) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        data.append((" ".join(w), toxic))
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    got = {x.doc_id: x.score for x in toxicity.fit_and_score(documents(spark, [t for t, _ in data]), labels, fold != 0).collect()}
    held = [i for i in range(len(data)) if zlib.crc32(str(i).encode()) % 5 == 0]
    marked, said = {i for i in held if data[i][1]}, {i for i in held if got[i] >= 0.5}
    assert len(marked & said) >= 0.9 * len(marked) and len(marked & said) >= 0.9 * len(said)
    scores = sorted(got.values())
    same = int(0.01 * len(data))
    assert all(low < high for low, high in zip(scores, scores[same:]))


def test_toxicity_scores_equal_plain_version(spark):
    """Whole scores against dense cosines over all examples, with factors and idf counted anew."""
    import numpy as np
    data = toxic_corpus(150, seed=4)
    texts = [t for t, _ in data] + ["", None, "unseen unheard"]
    learnt = [i for i in range(len(data)) if i % 3]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.fit_and_score(documents(spark, texts), labels, F.col("doc_id") % 3 != 0, neighbours=5).collect()}

    bags = [toxicity.terms_of(t) for t in texts]
    y = [data[i][1] for i in learnt]
    p, n = sum(y), len(y) - sum(y)
    factor = {}
    for t in sorted({t for i in learnt for t in bags[i]}):
        a = sum(t in bags[i] and data[i][1] for i in learnt)
        b = sum(t in bags[i] and not data[i][1] for i in learnt)
        cells = [(a, p, a + b), (b, n, a + b), (p - a, p, p + n - a - b), (n - b, n, p + n - a - b)]
        gain = 2 * sum(x * np.log(x * (p + n) / (row * col)) for x, row, col in cells if x)
        odds = (a + 0.5) / (p - a + 0.5) / ((b + 0.5) / (n - b + 0.5))
        if not t.endswith("*") or (a >= 4 and gain >= 18 and odds >= 6):
            factor[t] = 0.25 + (np.sqrt(max(0, gain - 8)) if odds > 1 else 0)
    idf = {t: np.log((1 + len(texts)) / (1 + sum(t in g for g in bags))) + 0.1 for t in factor}

    def unit(g):
        x = np.array([(1 + np.log(g[t])) * idf[t] * f if t in g else 0.0 for t, f in factor.items()])
        return x / np.linalg.norm(x)

    vectors = np.array([unit(bags[i]) for i in learnt])
    prior = (p + 0.5) / (p + n + 1)

    def votes(x, skip=None):
        cos = vectors @ x
        if skip is not None:
            cos[skip] = 0
        near = [e for e in range(len(learnt)) if cos[e] > 0 and cos[e] >= np.sort(cos)[-5] - 1e-9]
        w = [np.log(2) / (0.05 + max(0, 1 - cos[e])) for e in near]
        return (sum(v for v, e in zip(w, near) if y[e]) + prior / 1.05) / (sum(w) + 1 / 1.05)

    a, b = toxicity.fit_curve(np.array([votes(v, e) for e, v in enumerate(vectors)]), np.array(y, float), 1.0 - np.array(y))
    for i, g in enumerate(bags):
        if any(t in factor for t in g):
            v = votes(unit(g))
            assert abs(got[i] - 1 / (1 + np.exp(-(a * np.log(v / (1 - v)) + b)))) < 1e-6
        else:
            assert abs(got[i] - prior) < 1e-9


def test_block_max_search_is_exact():
    import numpy as np
    rng = np.random.default_rng(3)
    terms, vectors = 40, []
    for _ in range(500):
        at = np.sort(rng.choice(terms, rng.integers(1, 6), replace=False))
        x = rng.random(len(at)) + 0.1
        vectors.append((at, x / np.linalg.norm(x)))
    index = toxicity.BlockMaxIndex(vectors, [1] * 500, [0] * 500, list(range(500)), terms)
    dense = np.zeros((500, terms))
    for i, (at, x) in enumerate(vectors):
        dense[i, at] = x
    for _ in range(100):
        at = np.sort(rng.choice(terms, rng.integers(1, 5), replace=False))
        x = rng.random(len(at)) + 0.1
        x /= np.linalg.norm(x)
        cos = dense[:, at] @ x
        k_best = np.sort(cos)[-10]
        found, got = index.nearest(at, x, 10)
        want = sorted(i for i in range(500) if cos[i] >= k_best - 1e-12 and cos[i] > 0)
        assert sorted(index.who[i] for i in found) == want and np.allclose(sorted(got), sorted(cos[want]))


def test_samples_of_a_set_do_not_depend_on_the_stretch(monkeypatch):
    import numpy as np
    from postkit.llm import minhash as M
    r = np.random.default_rng(3)
    found, weights = np.unique(r.integers(0, 2**63, 1001, dtype=np.uint64) * np.uint64(3)), None
    weights = r.integers(1, 9, len(found)) * r.choice([1.0, 1.37, 2.0], len(found))
    want = M.consistent_samples(found, weights, 60)
    for stretch in (1, 7, 256, 5000):
        monkeypatch.setattr(M, "STRETCH", stretch)
        assert (M.consistent_samples(found, weights, 60) == want).all()

"""Toxicity by nearest labelled examples.

Terms are all words of the examples, and those leading characters of words that mark label 1 (likelihood ratio and odds).
Every document becomes a sparse vector over all of them: TF-IDF, idf counted over all documents, times a factor that grows
with the likelihood ratio of the term for label 1 and is ``plain`` for words that say nothing about it. Its nearest examples
by exact cosine are found with a block-max inverted index: examples are held in blocks, similar ones together, and every
term lists the blocks that hold it, each with its largest weight there and its postings. The sums of those weights bound the
cosines of a block: those with the highest bounds are opened first, then all whose bound can beat the k-th best
cosine so far. Votes are weighted with the distance, and a logistic curve fitted on leave-one-out votes of the examples
turns them into calibrated scores.

The rows that are learnt from are bounded: ``fit_rows`` labelled rows for the terms, ``examples`` of them, half of either
label where there are enough, for the index; the curve weighs either label by the share of it that was taken. Equal example
vectors are one entry with its counts, so ties never depend on an order. Texts are read once: what is kept of each is its
vector, a few numbers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit.llm.common import arrow_batches, broadcast_bytes, field
from postkit.session import materialize

WORD = re.compile(r"[^\W_]+")
#: Lengths of the word beginnings that are terms, besides whole words.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A beginning that a text has this often is a further term.
OFTEN = 3
#: Examples in one block of the index.
BLOCK = 64
#: Blocks that are opened first.
_LEAD = 8
#: Gain (2 x log likelihood ratio) that unrelated words reach by chance.
_NOISE = 8.0


def terms_of(text: str | None) -> dict[str, int]:
    """Occurrences of all terms in a whole text: words, their beginnings (marked ``*``) and, for
    beginnings that occur OFTEN times, a second term (marked ``**``)."""
    words: dict[str, int] = {}
    for w in WORD.findall(text.lower()) if text else ():
        words[w] = words.get(w, 0) + 1
    heads: dict[str, int] = {}
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                p = w[:k] + "*"
                heads[p] = heads.get(p, 0) + n
    return words | heads | {f"{p}*": n for p, n in heads.items() if n >= OFTEN}


def term_factors(labelled: DataFrame, least_docs: int, least_gain: float, least_odds: float, plain: float) -> tuple[dict[str, float], int, int]:
    """The factor of every term, and the rows of either label. ``labelled``: text, label (0/1), shown (whether the row is an
    example). Terms are all words of the examples; beginnings of words need ``least_docs`` positive rows, a gain (2 x log
    likelihood ratio) and an odds ratio of at least the given values. The factor is ``plain``, and for terms commoner in
    label 1 the square root of the gain above _NOISE more. The rows collected are bounded by the examples' terms."""
    def run(batches):
        counts: dict[str, list[int]] = {}
        rows = [0, 0, 0]

        def flush():
            held = [*counts.values(), rows]
            return pa.RecordBatch.from_arrays([pa.array([*counts, ""], pa.string()), *(pa.array([x[i] for x in held], pa.int64()) for i in (1, 0, 2))],
                                              names=["term", "pos", "neg", "shown"])

        for b in batches:
            for text, label, shown in zip(*(c.to_pylist() for c in b.columns)):
                rows[label] += 1
                for t in terms_of(text):
                    n = counts.setdefault(t, [0, 0, 0])
                    n[label] += 1
                    n[2] += shown
            if len(counts) > 300_000:                       # bounded memory in long partitions
                yield flush()
                counts.clear()
                rows[:] = [0, 0, 0]
        yield flush()

    summed = materialize(arrow_batches(labelled.select("text", "label", "shown"), run, "term string, pos long, neg long, shown long").groupBy("term").agg(
        *(F.sum(c).alias(c) for c in ("pos", "neg", "shown"))), "tox-terms")
    total = summed.where("term = ''").first()
    p, n = (float(total["pos"]), float(total["neg"])) if total else (0.0, 0.0)
    if not p or not n:
        return {}, int(p), int(n)
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    share = (a + b) / (p + n)
    gain = 2 * (part(a, p * share) + part(b, n * share) + part(p - a, p * (1 - share)) + part(n - b, n * (1 - share)))
    odds = ((a + 0.5) / (p - a + 0.5)) / ((b + 0.5) / (n - b + 0.5))
    told = summed.where("term != '' and shown > 0").select("term", "pos", gain.alias("gain"), odds.alias("odds"))
    marks = (F.col("pos") >= least_docs) & (F.col("gain") >= least_gain) & (F.col("odds") >= least_odds)
    kept = told.where(~F.col("term").endswith("*") | marks).select(
        "term", (F.lit(plain) + F.when(F.col("odds") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("gain") - _NOISE))).otherwise(0.0)).alias("factor"))
    found = kept.orderBy("term").toArrow()
    return dict(zip(found["term"].to_pylist(), found["factor"].to_pylist())), int(p), int(n)


def project(docs: DataFrame, terms: list[str], text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the counts of the terms (``at`` ascending, ``tf``) of every text."""
    shared = broadcast_bytes(docs, {t: i for i, t in enumerate(terms)})
    df = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([field(df, c) for c in keep] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("at", "tf")])

    def run(batches):
        known = shared.value
        heads = {k: {t.rstrip("*") for t in known if t.endswith("*") and len(t.rstrip("*")) == k} for k in PREFIXES}
        parts: dict[str, tuple] = {}                        # of the words met so far: number of the word, beginnings that are terms

        def parts_of(w):
            if len(parts) >= 200_000:
                parts.clear()
            found = parts[w] = known.get(w, -1), tuple(w[:k] for k, names in heads.items() if len(w) > k and w[:k] in names)
            return found

        for b in batches:
            at, tf = [], []
            for text in b.column(len(keep)).to_pylist():
                found: dict[int, int] = {}
                if text and known:
                    stems: dict[str, int] = {}
                    for w, n in Counter(WORD.findall(text.lower())).items():
                        i, begin = parts.get(w) or parts_of(w)
                        if i >= 0:
                            found[i] = n
                        for p in begin:
                            stems[p] = stems.get(p, 0) + n
                    for p, n in stems.items():
                        for t in (f"{p}*", f"{p}**")[:1 + (n >= OFTEN)]:
                            if t in known:
                                found[known[t]] = n
                order = sorted(found)
                at.append(order)
                tf.append([found[i] for i in order])
            yield pa.RecordBatch.from_arrays(b.columns[:len(keep)] + [pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=schema.names)

    return arrow_batches(df, run, schema)


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges ``starts`` to ``ends``, one range after the other, and the lengths of the ranges."""
    n = ends - starts
    before = np.cumsum(n) - n
    return np.repeat(starts - before, n) + np.arange(n.sum()), n


def _near_order(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> list[int]:
    """An order with similar vectors in the same block, which makes its bounds tight: random projections, in which common
    terms (those of a language or a topic) count more, are halved along their principal direction until a part is one block."""
    axes = np.random.default_rng(5).standard_normal((terms, 32), np.float32)
    axes *= np.sqrt(np.bincount(np.concatenate([np.empty(0, np.int64), *(at for at, _ in vectors)]), minlength=terms))[:, None]
    places = np.array([w @ axes[at] for at, w in vectors])
    order, parts = [], [np.arange(len(vectors))]
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            order.extend(part.tolist())
            continue
        x = places[part] - places[part].mean(axis=0)
        part = part[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
        half = BLOCK * max(1, len(part) // (2 * BLOCK))
        parts += [part[half:], part[:half]]
    return order


class BlockMaxIndex:
    """Inverted index over unit vectors of examples, with the largest weight of each block.

    ``pos`` and ``neg`` count the labelled rows that have an example's vector, ``who`` names one. ``first`` are the places of a
    term's entries (the next term's first is its end); an entry is a ``block``, its largest weight ``bound`` and the place of
    its first posting ``posting``; a posting is an ``example`` and its ``weight``."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], pos: list[int], neg: list[int], who: list, terms: int):
        order = _near_order(vectors, terms)
        self.pos, self.neg, self.who = np.asarray(pos, float)[order], np.asarray(neg, float)[order], [who[i] for i in order]
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        term = np.concatenate([np.empty(0, np.int64), *(vectors[i][0] for i in order)]).astype(np.int64)
        weight = np.concatenate([np.empty(0), *(vectors[i][1] for i in order)])
        example = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by_term = np.lexsort([example, term])
        term, self.weight, self.example = term[by_term], weight[by_term], example[by_term]
        entry = term * self.blocks + self.example // BLOCK
        new = np.flatnonzero(np.diff(entry, prepend=-1))
        self.block, self.bound = entry[new] % self.blocks, np.maximum.reduceat(self.weight, new) if len(new) else np.empty(0)
        self.posting = np.append(new, len(term))
        self.first = np.searchsorted(entry[new] // self.blocks, np.arange(terms + 1))

    @classmethod
    def of(cls, state: dict) -> BlockMaxIndex:
        """The index with this state (its ``__dict__``: arrays and lists only, which workers read without this package)."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def nearest(self, at: np.ndarray, x: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples with the highest positive cosine (all that tie with the k-th) and
        their cosines. ``skip`` leaves one example out."""
        entries, n = _spans(self.first[at], self.first[at + 1])
        q, block = np.repeat(x, n), self.block[entries]
        bound = np.bincount(block, q * self.bound[entries], self.blocks)
        cosine, least = np.zeros((self.blocks, BLOCK)), 0.0
        opened = np.zeros(self.blocks, bool)
        opened[np.argsort(-bound, kind="stable")[:_LEAD]] = True
        closed = ~opened
        while opened.any():                                 # the blocks with the highest bounds, then all others that may matter
            here = np.flatnonzero(opened[block])
            postings, n = _spans(self.posting[entries[here]], self.posting[entries[here] + 1])
            cosine += np.bincount(self.example[postings], np.repeat(q[here], n) * self.weight[postings], cosine.size).reshape(cosine.shape)
            if skip >= 0:
                cosine[divmod(skip, BLOCK)] = 0.0
            known = cosine[~closed].ravel()
            if len(known) > k:
                least = max(0.0, np.partition(known, len(known) - k)[len(known) - k])
            opened = closed & (bound > 0) & (bound >= least - 1e-12)
            closed = np.zeros(self.blocks, bool) if opened.any() else closed
        cosine = cosine.ravel()
        found = np.flatnonzero((cosine > 0) & (cosine >= least - 1e-12))
        best = np.lexsort([found, -cosine[found]])
        return found[best], cosine[found[best]]


def vote(index: BlockMaxIndex, found: np.ndarray, cosines: np.ndarray, prior: float) -> float:
    """Share of label 1 among the examples, weighted by 1 / (0.05 + distance) and the logarithm of
    their number, with one vote at distance 1 for the prior."""
    n = index.pos[found] + index.neg[found]
    w = np.log1p(n) / (0.05 + np.maximum(0, 1 - cosines))
    base = 1 / 1.05
    return float(((w * index.pos[found] / n).sum() + base * prior) / (w.sum() + base))


def fit_curve(votes: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve on the log odds of votes (ridge, Newton steps)."""
    x = np.log(votes / (1 - votes))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        n = pos + neg
        g = np.array([((p * n - pos) * x).sum() + 0.1 * (a - 1), (p * n - pos).sum() + 0.1 * b])
        h = n * p * (1 - p) + 1e-9
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def fit_and_score(docs: DataFrame, labels: DataFrame, learnable: Column, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id",
                  fit_rows: int = 20_000, examples: int = 4_000, neighbours: int = 16, least_docs: int = 4, least_gain: float = 18.0,
                  least_odds: float = 6.0, plain: float = 0.25) -> DataFrame:
    """One row per row of ``docs``: id, ``score`` (0 to 1), ``evidence`` (ids of the nearest
    examples, at most ``neighbours``) and ``cosines``.

    Labels are learnt from rows with ``learnable`` (an expression over ``docs``): about ``fit_rows``
    labelled documents chosen by a hash of the id, those with null labels or ids left out, an id
    with several labels counting as 1 if any of them is; about ``examples`` of them, half of either label if there are
    enough, are compared with. Texts without any word of the examples (null and empty ones too) get the share of label 1
    among labelled texts like them. Without
    labelled rows of both kinds every score is that share, 0 if there are none. Repeated rows get
    equal rows; other columns are ignored; an empty table gives no rows.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__label_id")).agg(
        (F.max(label_col) > 0).cast("int").alias("label"))
    n_labels = known.count()
    rate = min(1.0, fit_rows / max(1, n_labels))
    picked = known.where(F.pmod(F.xxhash64("__label_id", F.lit(11)), F.lit(1_000_000)) < rate * 1_000_000)
    own = docs.where(learnable).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = materialize(own.join(picked, F.col("id") == F.col("__label_id")).select("id", "text", "label"), "tox-rows")
    rows = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = rows.get(1, 0), rows.get(0, 0)
    half = examples // 2
    take_pos = min(1.0, max(half, examples - n_neg) / max(1, n_pos))
    take_neg = min(1.0, max(half, examples - n_pos) / max(1, n_neg))
    shown = F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1_000_000)) < F.when(F.col("label") == 1, take_pos * 1_000_000).otherwise(take_neg * 1_000_000)
    sample = sample.withColumn("shown", shown.cast("int"))
    factors, n_pos, n_neg = term_factors(sample, least_docs, least_gain, least_odds, plain)
    terms = list(factors)

    vectors = materialize(project(docs, terms, text_col, [id_col]), "tox-vectors")
    freq = vectors.select(F.explode("at").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()   # at most a row a term
    n_docs = vectors.count()
    scale = np.full(len(terms), math.log(1 + n_docs))
    scale[freq["t"].to_numpy()] = np.log((1 + n_docs) / (1 + freq["df"].to_numpy()))
    scale = (scale + 0.1) * np.array([factors[t] for t in terms])

    def unit(at, tf):
        x = (1 + np.log(np.asarray(tf, float))) * scale[at]
        return x / np.linalg.norm(x)

    held = project(sample.where("shown = 1"), terms, "text", ["id", "label"]).groupBy("at", "tf").agg(
        F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"), F.min("id").alias("who")).orderBy("at", "tf").collect()   # about ``examples`` rows
    plain_rows = [r for r in held if not r["at"]]
    rest = [r for r in held if r["at"]]
    share = (n_pos + 0.5) / (n_pos + n_neg + 1) if n_pos + n_neg else 0.0
    odds_pos, odds_neg = 1 / max(take_pos, 1e-9), 1 / max(take_neg, 1e-9)      # rows that an example of either label stands for
    empty_pos, empty_neg = (sum(r["pos"] for r in plain_rows) * odds_pos, sum(r["n"] - r["pos"] for r in plain_rows) * odds_neg)
    empty = (empty_pos + 2 * share) / (empty_pos + empty_neg + 2)
    index = BlockMaxIndex([(np.array(r["at"]), unit(np.array(r["at"]), r["tf"])) for r in rest], [r["pos"] for r in rest],
                          [r["n"] - r["pos"] for r in rest], [r["who"] for r in rest], len(terms))
    prior = (index.pos.sum() + 0.5) / (index.pos.sum() + index.neg.sum() + 1) if rest else share
    curve = (1.0, 0.0)
    if rest:
        votes, pos, neg = [], [], []
        places = {w: e for e, w in enumerate(index.who)}
        for r in rest:                                      # leave-one-out: an example does not vote for itself
            at = np.array(r["at"])
            found, cosines = index.nearest(at, unit(at, r["tf"]), neighbours, skip=places[r["who"]])
            votes.append(vote(index, found, cosines, prior))
            pos.append(r["pos"] * odds_pos), neg.append((r["n"] - r["pos"]) * odds_neg)
        curve = fit_curve(np.array(votes), np.array(pos), np.array(neg))
    model = broadcast_bytes(docs, (index.__dict__, scale, prior, empty, curve))
    schema = T.StructType([field(vectors, id_col), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(field(docs, id_col).dataType)),
                           T.StructField("cosines", T.ArrayType(T.DoubleType()))])

    def run(batches):
        state, scale, prior, empty, (a, b) = model.value
        index = BlockMaxIndex.of(state)
        seen: dict = {}
        for batch in batches:
            scores, evidence, cosine = [], [], []
            (at_all, at_ends), (tf_all, _) = ((c.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(c).to_numpy()))) for c in batch.columns[1:3])
            for lo, hi in pairwise(at_ends):
                at, tf = at_all[lo:hi], tf_all[lo:hi]
                key = at.tobytes() + tf.tobytes()
                if key not in seen:
                    if len(seen) >= 5_000:
                        seen.clear()
                    if len(at):
                        x = (1 + np.log(tf)) * scale[at]
                        found, c = index.nearest(at, x / np.linalg.norm(x), neighbours)
                        v = vote(index, found, c, prior)
                        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * math.log(v / (1 - v)) + b))))
                        seen[key] = p, [index.who[i] for i in found[:neighbours]], c[:neighbours].tolist()
                    else:
                        seen[key] = empty, [], []
                p, who, c = seen[key]
                scores.append(p), evidence.append(who), cosine.append(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(batch.column(0).type)), pa.array(cosine, pa.list_(pa.float64()))],
                names=schema.names)

    return arrow_batches(vectors, run, schema)

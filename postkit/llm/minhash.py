"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: weight = occurrences x idf, where
idf = 1 + ln(N / max(df, f N)) / ln(1 / f) runs from 1 (in every document) to 2 (in a share of at
most ``f`` of the documents). Document frequencies are those of hashed shingles over all
documents; the frequencies above f N are few whatever N is (at most the mean number of shingles
per document / f), so the table sent to the workers is bounded.

Improved consistent weighted sampling draws ``samples`` samples per text; two texts draw the same
sample with a probability equal to their weighted Jaccard similarity. Texts that agree in all
``rows`` samples of a band meet in a bucket. Equal texts are one node.

Each bucket has a pivot, the member that meets most others over all bands. It is compared with
the bucket's members: first by their samples (a pair that agrees in fewer than half of them is
not similar; at similarity 0.8 that happens to one pair in 10**8), then exactly. What this
links is put together; a bucket whose rest is one component is done. In the others, all members
outside the largest component are compared exactly with all members, in blocks of bounded size
that tasks join with each other and that report a spanning forest of their links. So every
pair of a bucket is either compared or linked through others, a group of near-copies costs
about one comparison per member, and neither pairs nor groups are ever listed or capped.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit.llm.common import arrow_batches, broadcast_bytes, field, set_apart
from postkit.llm.components import components
from postkit.llm.shingles import mix, shingle_hashes, word_hashes
from postkit.session import materialize

#: Share of the documents up to which a shingle counts as rare (idf 2).
RARE = 0.01
#: Shingles sampled at a time.
STRETCH = 256
#: Least share of equal samples of a pair that is verified.
AGREE = 0.5
#: Texts of a block, and their total weight (at most two per shingle), when buckets are compared in full.
BLOCK_TEXTS, BLOCK_WEIGHT = 512, 2_000_000


def idf_table(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """idf of every hashed shingle (index: the upper bits of its hash). One pass over all texts;
    each task sums its part, the rest is an aggregate, and only frequent ones reach the driver."""
    n, chars = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    bits = min(24, max(12, math.ceil(math.log2(4 * max(1, (chars or 0) / max(1, n) / 6) / RARE))))

    def run(batches):
        df = np.zeros(1 << bits, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                found = shingle_hashes(word_hashes(data), size) >> np.uint64(64 - bits)
                df[np.unique(found).astype(np.int64)] += 1
        at = np.flatnonzero(df)
        for i in range(0, len(at), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 65_536].astype(np.int32)), pa.array(df[at[i:i + 65_536]])], names=["slot", "df"])

    df = arrow_batches(docs.select(F.col(text_col).cast("binary")), run, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df"))
    table = np.full(1 << bits, 2.0, np.float32)
    for r in df.where(F.col("df") > RARE * n).collect():     # at most (mean shingles per document / RARE) rows
        table[r["slot"]] = 1 + math.log(n / r["df"]) / math.log(1 / RARE)
    return table


def weighted_set(data: bytes | None, size: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (ascending) of a whole text and their TF-IDF weights."""
    found, times = np.unique(shingle_hashes(word_hashes(data), size), return_counts=True)
    slot = found >> np.uint64(64 - (len(idf).bit_length() - 1))
    return found, times * idf[slot.astype(np.int64)].astype(np.float64)


def _gamma_quantiles(bits: int) -> np.ndarray:
    """Gamma(2, 1) at the middles of 2**bits equal steps of probability: P(x) = 1 - (1 + x) e**-x,
    solved by Newton's method on ln(1 + x) - x = ln(1 - p)."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x, target = np.sqrt(2 * p) + p, np.log1p(-p)
    for _ in range(60):
        x = np.maximum(x - (np.log1p(x) - x - target) * (1 + x) / -x, x / 4)
    return x


_R = _gamma_quantiles(16).astype(np.float32)
_LOG_C = np.log(_gamma_quantiles(20)).astype(np.float32)
#: The least ln c for each value of the first 12 of its 20 bits.
_LOG_C_LOW = _LOG_C.reshape(1 << 12, -1).min(axis=1)


def consistent_samples(found: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """``count`` samples (hashes of shingle and level). Per shingle and sample: r and c are
    Gamma(2, 1), beta uniform; t = floor(ln S / r + beta), ln a = ln c - r (t - beta) - r; the
    shingle with the least a is drawn, together with t. One hash of shingle and sample gives
    all three: 20 bits choose c, 16 r, 16 beta."""
    seeds = _seeds(count)[:, None]
    best, of, level = np.full(count, np.inf, np.float32), np.zeros(count, np.uint64), np.zeros(count, np.float32)
    logs = np.log(weights).astype(np.float32)
    held = count * min(STRETCH, len(found))                 # the arrays of a stretch are used again by the next
    xs, bits = np.empty(held, np.uint64), np.empty(held, np.uint64)
    rs, betas, ts = np.empty(held, np.float32), np.empty(held, np.float32), np.empty(held, np.float32)
    for at in range(0, len(found), STRETCH):
        f, log_s = found[at:at + STRETCH], logs[at:at + STRETCH]
        x, b, r, beta, t = (a[:count * len(f)].reshape(count, len(f)) for a in (xs, bits, rs, betas, ts))
        np.multiply(f, seeds, out=x)                        # the hashes f are mixed: the upper bits of the products are, too
        np.right_shift(x, np.uint64(28), out=b)
        np.bitwise_and(b, np.uint64(0xFFFF), out=b)
        np.take(_R, b.view(np.int64), out=r, mode="clip")
        np.right_shift(x, np.uint64(12), out=b)
        np.copyto(beta, b.astype(np.uint16))
        beta *= np.float32(2.0**-16)
        np.divide(log_s, r, out=t)
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= np.float32(1)
        beta *= r                                           # ln c - ln a, negated
        i, low = _least(x, beta, b, r)
        better = low < best
        best = np.where(better, low, best)
        of, level = np.where(better, f[i], of), np.where(better, t[np.arange(count), i], level)
    return np.where(best < np.inf, mix(of + level.astype(np.int64).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), np.uint64(0))


@functools.cache
def _seeds(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _least(x: np.ndarray, rest: np.ndarray, b: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place and value of the least ln c + ``rest`` of every row, the first of equal ones; ``b`` and ``low`` are written over.
    ln c is looked up in the large table only where the first 12 bits of c leave the least open: sums in float32 keep order."""
    np.right_shift(x, np.uint64(52), out=b)
    np.take(_LOG_C_LOW, b.view(np.int64), out=low, mode="clip")
    low += rest
    at = np.arange(len(x))
    i = np.argmin(low, axis=1)
    most = _LOG_C[(x[at, i] >> np.uint64(44)).view(np.int64)] + rest[at, i]
    spot = np.flatnonzero(low <= most[:, None])             # row by row, at least one in each
    if len(spot) == len(x):
        return i, most
    row = spot // x.shape[1]
    value = _LOG_C[(x.ravel()[spot] >> np.uint64(44)).view(np.int64)] + rest.ravel()[spot]
    least = np.minimum.reduceat(value, np.searchsorted(row, at))
    spot, row = (a[value == least[row]] for a in (spot, row))
    return spot[np.searchsorted(row, at)] % x.shape[1], least


def band_slots(samples: int, bands: int, rows: int) -> np.ndarray:
    """Which samples each band takes: shuffled rounds over all samples, so that every sample is
    used about equally often and bands share few of them."""
    rng, order = np.random.default_rng(11), []
    while len(order) < bands * rows:
        order += rng.permutation(samples).tolist()
    return np.array(order[:bands * rows]).reshape(bands, rows)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Sum of the smaller weights over sum of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if len(a[0]) and len(b[0]) else 0.0


def _node(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, idf, id_col: str, text_col: str, size: int, samples: int, bands: int, rows: int) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``node`` (digest of its words; null if it has none),
    ``weight`` (of the whole set), ``marks`` (16 bits of each sample) and ``buckets`` (one number
    per band)."""
    slots = band_slots(samples, bands, rows)

    def run(batches):
        for b in batches:
            node, weight, marks, buckets = [], [], [], []
            for data in b.column(2).to_pylist():
                words = word_hashes(data)
                if not len(words):
                    for out in (node, weight, marks, buckets):
                        out.append(None)
                    continue
                found, w = weighted_set(data, size, idf.value)
                drawn = consistent_samples(found, w, samples)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for k in range(rows):
                    key = mix(key * np.uint64(0xD6E8FEB86659FD93) + drawn[slots[:, k]])
                node.append(_node(words))
                weight.append(float(w.sum()))
                marks.append((drawn >> np.uint64(48)).astype(np.uint16).tobytes())
                buckets.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(node, pa.binary()), pa.array(weight, pa.float64()), pa.array(marks, pa.binary()),
                 pa.array(buckets, pa.list_(pa.int64()))], names=["id", "th", "node", "weight", "marks", "buckets"])

    schema = T.StructType([field(docs, id_col, "id"), T.StructField("th", T.LongType()), T.StructField("node", T.BinaryType()),
                           T.StructField("weight", T.DoubleType()), T.StructField("marks", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType()))])
    return arrow_batches(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary")), run, schema)


def _node_texts(docs: DataFrame, wanted: DataFrame, sigs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node``, ``data``: one text of every wanted node, read again from the documents."""
    rows = sigs.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("r"))
    rows = rows.select("node", F.col("r.id").alias("rid"), F.col("r.th").alias("rth"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("data"))
    return texts.join(rows, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).groupBy("node").agg(F.first("data").alias("data"))


def _agreeing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (u, v) that agree in enough samples to be verified."""
    side = lambda s: marks.select(F.col("node").alias(s), F.col("marks").alias(f"{s}_marks"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_marks", "v_marks")

    def run(batches):
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (2, 3))
                yield b.select([0, 1]).filter(pa.array((a == c).mean(axis=1) >= AGREE))

    return arrow_batches(both, run, "u binary, v binary")


def _similar(pairs: DataFrame, texts: DataFrame, idf, size: int, threshold: float) -> DataFrame:
    """The pairs (u, v) whose weighted Jaccard similarity is at least ``threshold``."""
    side = lambda s: texts.select(F.col("node").alias(s), F.col("data").alias(f"{s}_data"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_data", "v_data")

    def run(batches):
        held, key = None, None
        for b in batches:
            yes, cols = [], [b.column(i).to_pylist() for i in range(4)]
            for i, (u, _, ud, vd) in enumerate(zip(*cols)):
                if u != key:
                    key, held = u, weighted_set(ud, size, idf.value)
                if weighted_jaccard(held, weighted_set(vd, size, idf.value)) >= threshold:
                    yes.append(i)
            yield b.select([0, 1]).take(pa.array(yes, pa.int32()))

    return arrow_batches(both, run, "u binary, v binary")


def block_links(a: dict, b: dict, size: int, idf: np.ndarray, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between the texts of two blocks (``node``, ``comp``, ``data``) of different components,
    as the edges of a spanning forest. The second block is an inverted index; each text of the
    first collects its shared weight with all of it at once."""
    sets = [weighted_set(d, size, idf) for d in b["data"]]
    total = np.array([w.sum() for _, w in sets])
    hashes = np.concatenate([f for f, _ in sets])
    order = np.argsort(hashes, kind="stable")
    hashes, row = hashes[order], np.repeat(np.arange(len(sets)), [len(f) for f, _ in sets])[order]
    weight = np.concatenate([w for _, w in sets])[order]
    comps = np.array(b["comp"], dtype=object)
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    edges = []
    for node, comp, data in zip(a["node"], a["comp"], a["data"]):
        f, w = weighted_set(data, size, idf)
        lo, hi = np.searchsorted(hashes, f, "left"), np.searchsorted(hashes, f, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(row[at], np.minimum(weight[at], np.repeat(w, n)), len(sets))
        near = np.flatnonzero((shared >= threshold * (w.sum() + total - shared)) & (comps != comp))
        for j in near:
            x, y = find(comp), find(comps[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((node, b["node"][j]))
    return edges


def _compare_blocks(open_rows: DataFrame, texts: DataFrame, idf, size: int, threshold: float) -> DataFrame:
    """Links (u, v) between ``outside`` members and all members of each open bucket, block by block.
    ``open_rows``: bucket, node, comp, weight, outside."""
    size_of = lambda rows: F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("weight") / BLOCK_WEIGHT)
    block = lambda n: F.pmod(F.xxhash64("node"), F.ceil(n)).alias("block")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        sizes = materialize(rows.groupBy("bucket").agg(size_of(rows).alias("n")), "block-sizes")
        held = rows.join(sizes, "bucket").join(texts, "node").groupBy("bucket", block(F.col("n"))).agg(
            F.collect_list(F.struct("node", "comp", "data")).alias("t"))
        return held.select("bucket", F.struct(*[F.transform("t", _part(c)).alias(c) for c in ("node", "comp", "data")]).alias(name))

    both = blocks(open_rows.where("outside"), "a").join(blocks(open_rows, "b"), "bucket").select("a", "b")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                edges = block_links(a, b, size, idf.value, threshold)
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], names=["u", "v"])

    return both.mapInArrow(run, "u binary, v binary")


def _part(name: str):
    return lambda x: x[name]


def link_nodes(sigs: DataFrame, docs: DataFrame, idf, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """``node``, ``component`` for every node linked with another."""
    nodes = sigs.where("node is not null").groupBy("node").agg(F.first("weight").alias("weight"), F.first("marks").alias("marks"), F.first("buckets").alias("buckets"))
    nodes = materialize(nodes, "nodes")
    rows = nodes.select("node", "weight", F.explode("buckets").alias("bucket"))
    shared = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    rows = materialize(rows.join(shared, "bucket"), "buckets")
    texts = materialize(_node_texts(docs, rows.select("node").distinct(), sigs, id_col, text_col), "node-texts")

    met = rows.groupBy("node").agg(F.sum("n").alias("met"))
    pivots = rows.select("bucket", "node", "weight").join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node", "weight")).alias("p"))
    pivots = materialize(pivots.select("bucket", F.col("p.node").alias("p"), F.col("p.weight").alias("pw")), "pivots")
    ratio = F.least("weight", "pw") >= threshold * F.greatest("weight", "pw") * (1 - 1e-9)   # what the total weights allow
    star = rows.join(pivots, "bucket").where((F.col("node") != F.col("p")) & ratio)
    pairs = materialize(star.select(F.greatest("p", "node").alias("u"), F.least("p", "node").alias("v")).distinct(), "pairs")
    links = materialize(_similar(materialize(_agreeing(pairs, nodes), "agreeing"), texts, idf, size, threshold), "similar")

    merged = materialize(components(links), "merged")
    rest = rows.join(pivots, "bucket").where(F.col("node") != F.col("p"))                    # pivots have met all of their bucket
    rest = rest.select("bucket", "node", "weight").join(merged, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    rest = materialize(rest, "rest")
    per = rest.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = materialize(per.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
                          .where("comps > 1").select("bucket", F.col("top.comp").alias("top")), "largest")
    open_rows = materialize(rest.join(largest, "bucket").select("bucket", "node", "weight", "comp", (F.col("comp") != F.col("top")).alias("outside")), "open")
    more = materialize(_compare_blocks(open_rows, texts, idf, size, threshold), "block-links")
    return components(links.unionByName(more))


def classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, samples: int = 60, bands: int = 24, rows: int = 5,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``th`` (hash of the text), ``class_id`` (smallest id of the
    documents reachable through links) and ``n_class`` (documents of the class).

    Two documents are linked if their words are equal or the weighted Jaccard similarity of
    their shingles is at least ``threshold`` (found with a probability of 0.999 at 0.8, more
    above; a class hangs together by any of its links). Texts without words (null, empty, signs only) are
    classes of their own; texts of fewer than ``size`` words are one shingle. Repeated rows are
    copies; null ids are never the smallest unless a class has no other. Other columns are
    ignored, an empty table gives no rows.
    """
    return _classed(docs, threshold, size, samples, bands, rows, id_col, text_col).drop("component").withColumnRenamed("id", id_col)


def _classed(docs: DataFrame, threshold: float = 0.8, size: int = 5, samples: int = 60, bands: int = 24, rows: int = 5,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``classes`` with the id as ``id`` and ``component``, which names a class even if
    its ids are null or other classes have them too (null for texts without words)."""
    idf = broadcast_bytes(docs, idf_table(docs, text_col, size))
    sigs = materialize(signatures(docs, idf, id_col, text_col, size, samples, bands, rows), "signatures")
    linked = link_nodes(sigs, docs, idf, id_col, text_col, size, threshold)
    per_node = sigs.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    comp = materialize(per_node.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "node-classes")
    size_of = comp.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("n").alias("n_class"))
    by_node = comp.select("node", "component").join(size_of, "component").select("node", "component", "class_id", "n_class")
    plain = sigs.select("id", "th", "node")
    with_words = plain.where("node is not null").join(by_node, "node").select("id", "th", "component", "class_id", "n_class")
    without = plain.where("node is null").select("id", "th", F.lit(None).cast("binary").alias("component"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_class"))
    return with_words.unionByName(without)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, with all its columns, one of each class (the one with the smallest id, null
    last; of rows with that id, one). Texts without words (null and empty ones too) all stay. Repeated rows are copies. An empty
    table gives no rows; other columns may have any name."""
    own = [options.get("id_col", "doc_id"), options.get("text_col", "text")]
    return set_apart(docs, own, lambda df: _drop_near_duplicates(df, *own, options))


def _drop_near_duplicates(docs: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("first")
    keep = _classed(docs, **options).where("component is not null").groupBy("component").agg(first).select(
        F.col("first.id").alias("__id"), F.col("first.th").alias("__th"))
    with_words = docs.where(has_words).withColumn("__h", F.xxhash64(text_col))
    kept = with_words.join(keep, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left_semi")
    return kept.dropDuplicates([id_col, "__h"]).select(*docs.columns).unionByName(docs.where(~has_words))

"""Language identification.

Sparse multinomial logistic regression on hashed TF-IDF character n-grams, trained with
follow-the-regularised-leader (per-coordinate rates, elastic-net penalty) and followed by
temperature calibration on rows kept out of the training.

Document frequencies come from every document that may be learnt from. The classifier itself is
fitted on a bounded sample of them (``fit_rows`` whole texts, stratified by language), so what
reaches the driver is bounded by parameters; prediction streams over all documents with no
shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit.llm.common import arrow_batches, broadcast_bytes, field, set_apart

UNKNOWN = "und"
#: Hashed n-gram features.
BITS = 14
ORDERS = (1, 2, 3)
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Code points of a text handled at a time (n-grams across the cut are counted in the later part).
STRETCH = 1 << 18


def fold_table() -> np.ndarray:
    """For every code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def ngram_counts(text: str | None, table: np.ndarray) -> np.ndarray | None:
    """Counts of hashed n-grams of the letters of a whole text (other characters part words);
    None if the text has no letter."""
    if not text:
        return None
    counts = np.zeros(1 << BITS, np.int64)
    any_letter, carry = False, np.array([32], np.uint32)
    for at in range(0, len(text), STRETCH):
        codes = table[np.frombuffer(text[at:at + STRETCH].encode("utf-32-le", "replace"), np.uint32)]
        last = at + STRETCH >= len(text)
        codes = np.concatenate([carry, codes, np.array([32], np.uint32)] if last else [carry, codes])
        space = codes == 32
        any_letter = any_letter or not space.all()
        codes = codes[~(space & np.concatenate([[False], space[:-1]]))]     # one space between words
        old = len(carry) if at else 0
        for order in ORDERS:
            grams = len(codes) - order + 1
            if grams <= 0:
                continue
            h = np.full(grams, np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF))
            for k in range(order):
                h = (h ^ codes[k:k + grams]) * np.uint32(MULTIPLIERS[k])
                h ^= h >> np.uint32(15)
            skip = max(0, old - order + 1)                                  # those of the stretch before
            counts += np.bincount(h[skip:] >> np.uint32(32 - BITS), minlength=1 << BITS)
        carry = codes[-(max(ORDERS) - 1):]
    return counts if any_letter else None


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Active features and their values: (1 + ln tf) * idf, of length one."""
    at = np.flatnonzero(counts)
    x = (1.0 + np.log(counts[at])) * idf[at]
    return at, x / np.linalg.norm(x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(examples: list, labels: list[int], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights (classes x features + bias) by FTRL-proximal; L1 keeps them sparse."""
    width = (1 << BITS) + 1
    z, n = np.zeros((classes, width)), np.zeros((classes, width))

    def weights(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, x = examples[i]
            at, x = np.append(at, width - 1), np.append(x, 1.0)
            zz, nn = z[:, at], n[:, at]
            w = weights(zz, nn)
            p = softmax(w @ x)
            p[labels[i]] -= 1.0
            g = p[:, None] * x
            grown = nn + g * g
            z[:, at] = zz + g - (np.sqrt(grown) - np.sqrt(nn)) / alpha * w
            n[:, at] = grown
    return weights(z, n)


def temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The temperature with the least log loss on rows that were not trained on (1 if there are none)."""
    if not logits:
        return 1.0
    z, y = np.array(logits), np.array(labels)

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 60))
    return float(min(grid, key=loss))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``feature``, ``df`` over all rows; feature -1 counts the rows that have a letter. Each
    task sums its own part before anything is shuffled."""
    table = broadcast_bytes(docs, fold_table())

    def run(batches):
        df, rows = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                counts = ngram_counts(text, table.value)
                if counts is not None:
                    df += counts > 0
                    rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], rows))], names=["feature", "df"])

    return arrow_batches(docs.select(F.col(text_col).cast("string")), run, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df"))


def fit(docs: DataFrame, learnable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        fit_rows: int = 3000, max_classes: int = 200) -> dict:
    """The model. Only texts and non-null languages of rows with ``learnable`` are used:
    document frequencies of all of them, and for the weights a sample of about ``fit_rows``
    rows, as many of each language as there are up to an equal share (at least 30; rows chosen
    by a hash of the id). The ``max_classes`` most frequent languages are learnt."""
    known = docs.where(learnable & F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_classes).collect()}
    classes = sorted(sizes)
    if not classes:
        return {"classes": []}
    freq = {r["feature"]: r["df"] for r in document_frequencies(known, "text").collect()}         # at most 2**BITS + 1 rows
    rows = freq.pop(-1, 0)
    idf = np.full(1 << BITS, np.log(1.0 + rows))
    for f, n in freq.items():
        idf[f] = np.log((1.0 + rows) / (1.0 + n)) + 0.1
    share = max(30, fit_rows // len(classes))
    rate = F.coalesce(*[F.when(F.col("lang") == c, F.lit(min(1.0, share / sizes[c]))) for c in classes], F.lit(0.0))
    picked = known.where(F.pmod(F.col("h"), F.lit(1_000_000)) < rate * 1_000_000)
    table = broadcast_bytes(docs, fold_table())

    def run(batches):
        for b in batches:
            at, tf, lang, h = [], [], [], []
            for text, c, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                counts = ngram_counts(text, table.value)
                if counts is not None:
                    nz = np.flatnonzero(counts)
                    at.append(nz.astype(np.int32))
                    tf.append(counts[nz].astype(np.int32))
                    lang.append(c)
                    h.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32())), pa.array(lang, pa.string()), pa.array(h, pa.int64())],
                names=["at", "tf", "lang", "h"])

    sample = arrow_batches(picked, run, "at array<int>, tf array<int>, lang string, h long").toArrow()   # bounded by fit_rows
    number = {c: i for i, c in enumerate(classes)}
    order = np.lexsort([np.array([len(x) for x in sample["at"]], np.int64), sample["h"].to_numpy()]) if sample.num_rows else []
    examples, labels = [], []
    for i in order:
        counts = np.zeros(1 << BITS, np.int64)
        counts[sample["at"][int(i)].values.to_numpy()] = sample["tf"][int(i)].values.to_numpy()
        examples.append(tfidf(counts, idf))
        labels.append(number[sample["lang"][int(i)].as_py()])
    tune = [i for i in range(len(examples)) if i % 5 == 0] if len(examples) >= 50 else []
    train = sorted(set(range(len(examples))) - set(tune))
    weights = ftrl([examples[i] for i in train], [labels[i] for i in train], len(classes))
    logits = [weights[:, examples[i][0]] @ examples[i][1] + weights[:, -1] for i in tune]
    return {"classes": classes, "idf": idf, "weights": weights, "temperature": temperature(logits, [labels[i] for i in tune])}


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Columns ``keep`` (default ``doc_id``), ``lang_pred`` and ``score`` (calibrated probability)
    under ``prefix``, one row per row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no
    language could be learnt. Whole texts are read; ties go to the language first in order.
    Repeated rows get equal rows, null ids stay, an empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    classes = model["classes"]
    shared = broadcast_bytes(docs, (model, fold_table()))
    df = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([field(df, c) for c in keep] + [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())])

    def run(batches):
        model, table = shared.value
        for b in batches:
            langs, scores = [], []
            for text in b.column(len(keep)).to_pylist():
                counts = ngram_counts(text, table) if classes else None
                if counts is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, x = tfidf(counts, model["idf"])
                p = softmax((model["weights"][:, at] @ x + model["weights"][:, -1]) / model["temperature"])
                best = int(np.argmax(p))
                langs.append(classes[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays(b.columns[:len(keep)] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return arrow_batches(df, run, schema)


def accept(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, with all its columns, whose language is recognised with a score of at
    least ``least``; a null ``lang`` is filled with the prediction. Null texts and texts without a letter go; repeated rows and
    null ids are judged as any other; an empty table gives no rows; other columns may have any name."""
    def known(df: DataFrame) -> DataFrame:
        found = predict(df, model, keep=df.columns, prefix="__")
        found = found.where((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least))
        return found.select(*[F.coalesce("lang", "__lang_pred").alias("lang") if c == "lang" else c for c in df.columns])

    return set_apart(docs, ["text", "lang"], known)

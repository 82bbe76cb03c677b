"""Operator 1: a classifier chain over toxicity categories.

Categories are predicted one after the other. The model of a category is linear over hashed word indicators and over
the probabilities of all categories before it; it is trained with those categories' out-of-fold predictions, so that
it sees at training the kind of probabilities it will see later. Cutoffs come from out-of-fold predictions too.

Training uses at most `sample` labelled documents, picked by a hash of their identifier; that is the only bounded
sample here, and every document is scored. Words are hashed by Spark; what Python gets is arrays of feature numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
SAMPLE = 12_000
FOLDS = 5
#: Categories in the order of the chain. `toxic` is the table's own label; `insulting` and `dense` grade a labelled
#: document by its insults (words that labelled toxic documents hold far more often): one at least, and many.
CATEGORIES = ["insulting", "dense", "toxic"]
DENSE_SHARE = 0.02
#: Features of one document are at most its distinct hashed words, so at most 2 ** BITS whatever its length.


def hashed(docs: DataFrame, *more: str, bits: int = BITS) -> DataFrame:
    """doc_id, x: the distinct numbers of a document's words (lower case, edge punctuation dropped); and `more`, in SQL."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}']+"), F.lit(0))
    number = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(1 << bits)).cast("int"))
    return docs.select(F.col("doc_id").cast("long"), F.array_distinct(number).alias("x"), *map(F.expr, more))


class Linear:
    """Logistic regression over present features and `k` dense inputs, fitted by accelerated gradient descent.

    A feature counts by the log-ratio of how often it is found in positive and negative documents, smoothed by one;
    features of fewer than `least` documents count nothing. A document is scaled by the root of its features' norm."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, size: int, l2: float = 1e-3, steps: int = 80, least: int = 3):
        flat, at = flattened(rows)
        bad, good = np.bincount(flat, y[at], size), np.bincount(flat, 1 - y[at], size)
        ratio = np.log((bad + 1) / (y.sum() + 2)) - np.log((good + 1) / (len(y) - y.sum() + 2))
        ratio[bad + good < least] = 0
        used = ratio[flat] != 0
        flat, at = flat[used], at[used]
        value = ratio[flat]
        value *= scales(np.bincount(at, value**2, len(rows)))[at]
        n, pos = max(1, len(y)), max(1.0, y.sum())
        weight = np.where(y > 0, 0.5 * n / pos, 0.5 * n / max(1.0, n - pos)) / n
        w, d, b = np.zeros(size), np.zeros(dense.shape[1]), 0.0
        mw, md, mb = w.copy(), d.copy(), b
        rate = 4.0
        for t in range(steps):
            z = np.bincount(at, mw[flat] * value, len(rows)) + dense @ md + mb
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
            nw = mw - rate * (np.bincount(flat, g[at] * value, size) * 8 + l2 * mw)
            nd, nb = md - rate * (dense.T @ g + l2 * md), mb - rate * g.sum()
            k = t / (t + 3)
            mw, md, mb = nw + k * (nw - w), nd + k * (nd - d), nb + k * (nb - b)
            w, d, b = nw, nd, nb
        self.w, self.norm, self.d, self.b = (w * ratio).astype(np.float32), (ratio**2).astype(np.float32), d, b

    def __call__(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        flat, at = flattened(rows)
        z = np.bincount(at, self.w[flat], len(rows)) * scales(np.bincount(at, self.norm[flat], len(rows))) + dense @ self.d + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def flattened(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All features, and the row of each."""
    return np.concatenate([*rows, np.zeros(0, np.int32)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def scales(norms: np.ndarray) -> np.ndarray:
    return 1 / np.maximum(norms, 1e-9) ** 0.25


class Chain:
    """Models, cutoffs and out-of-fold scores of a chain. y: one column of 0 and 1 for each category."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray, size: int = 1 << BITS):
        n, k = y.shape
        self.models, self.cutoffs, before = [], [], np.zeros((n, 0))
        for c in range(k):
            out = np.zeros(n)
            for f in np.unique(fold):
                train, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                model = Linear([rows[i] for i in train], before[train], y[train, c], size)
                out[held] = model([rows[i] for i in held], before[held])
            self.models.append(Linear(rows, before, y[:, c], size))
            self.cutoffs.append(best_cutoff(out, y[:, c]))
            before = np.column_stack([before, out])
        self.out_of_fold = before

    def __call__(self, rows: list[np.ndarray]) -> np.ndarray:
        p = np.zeros((len(rows), 0))
        for model in self.models:
            p = np.column_stack([p, model(rows, p)])
        return p


def best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """The midpoint cutoff with the best F1 out of fold; without positives, one that nothing reaches."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    after = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + after) / 2)


def graded(rows: list[np.ndarray], toxic: np.ndarray, size: int = 1 << BITS) -> np.ndarray:
    """Labels of CATEGORIES from the one label there is: insults are features at least 8 times as frequent, smoothed,
    in toxic documents as in others, and present in at least 1 % of the toxic ones."""
    flat = np.concatenate([*rows, np.zeros(0, np.int32)])
    own = np.repeat(toxic, [len(r) for r in rows])
    bad, good = np.bincount(flat, own, size), np.bincount(flat, 1 - own, size)
    n_bad, n_good = max(1.0, toxic.sum()), max(1.0, (1 - toxic).sum())
    insult = ((bad + 0.5) / n_bad >= 8 * (good + 0.5) / n_good) & (bad >= max(3.0, 0.01 * n_bad))
    found = np.array([insult[r].sum() for r in rows], float)
    share = found / np.maximum(1, [len(r) for r in rows])
    return np.column_stack([toxic * (found > 0), toxic * (share >= DENSE_SHARE), toxic])


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """Repeated labels of a document count once (toxic if any says so); labels that are null or of no document are left
    out. A labelled doc_id with several texts counts by the one of the smallest digest. Folds are dealt by a hash of the
    features, so that copies never lie on both sides of a fold."""
    known = labelled.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    spread = F.xxhash64("doc_id", F.lit(17))
    picked = known.orderBy(spread, "doc_id").limit(sample)
    some = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked.select("doc_id")), "doc_id")  # at most `sample` rows are broadcast
    one = hashed(some, "sha2(text, 256) AS own").groupBy("doc_id").agg(F.min_by("x", "own").alias("x"))
    got = one.join(F.broadcast(picked), "doc_id").select("doc_id", F.array_sort("x").alias("x"), "toxic").withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(folds))).orderBy("doc_id").toArrow()
    x = got.column("x").combine_chunks()
    ends = np.cumsum([0, *(x.value_lengths().to_numpy() if len(x) else [])]).astype(np.int64)
    flat = np.asarray(x.flatten(), np.int32) if len(x) else np.zeros(0, np.int32)
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    toxic = np.asarray(got.column("toxic"), float)
    return Chain(rows, graded(rows, toxic), np.asarray(got.column("fold")))


def classify(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, p_<category> for each category of the chain, toxic.

    Null and empty texts have no features: they get the intercepts' probabilities and are never called toxic.
    Without labels nothing is called toxic. Very long texts are read whole; their features are at most 2 ** BITS.
    Repeated rows are scored each, and so are rows without doc_id, which no label can name; an empty table gives no rows.
    A probability that equals the cutoff is toxic. Only doc_id and text are read, whatever other columns are called.
    """
    chain = fit(docs, labelled, sample, folds)
    shared = docs.sparkSession.sparkContext.broadcast((chain.models, chain.cutoffs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, cutoffs = shared.value
        ask = Chain.__new__(Chain)
        ask.models = models
        for batch in batches:
            column = batch.column("x")
            flat, ends = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_numpy()])
            rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            p = ask(rows)
            toxic = (p[:, -1] >= cutoffs[-1]) & (np.diff(ends) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.round(c, 6)) for c in p.T), pa.array(toxic)], names=["doc_id", *names, "toxic"])

    names = [f"p_{c}" for c in CATEGORIES]
    return hashed(docs).mapInArrow(score, ", ".join(["doc_id long", *(f"{n} double" for n in names), "toxic boolean"]))

"""Operator 2: quality rules whose cutoffs are risk-controlled.

A labelled holdout of good documents limits what each rule may reject. For every stratum (language) and rule, a fixed
ladder of cutoffs, from lenient to strict, is tested in order: a cutoff is accepted while the exact binomial test
rejects "this rule rejects more than its share of good documents" at the corrected level. The ladder is a fixed
sequence, so it costs no correction in itself; rules and strata are corrected by Bonferroni: each ladder has `delta`
over their number. The shares of the rules add up to `risk`, so that with probability `1 - delta` no stratum loses more
than `risk` of its good documents to the method.

Text is read by Python in Arrow batches, one document at a time; what leaves it is a few numbers per document. Holdout
counts are summed by Spark over all labelled documents; what reaches the driver is one row for each stratum that has
labels enough for any rule to pass. The others count among the tests, but need not be named.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm._common import discard, staged

RISK = 0.05
DELTA = 0.05
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_digits long, n_long_words long, top_word long"
SYMBOLS = re.compile(r"[#*$%&|<>]")
DIGITS = re.compile(r"[0-9]")
LONG_WORD = 30

#: Rules: name -> (value of a document in SQL, ladder of cutoffs from lenient to strict). Documents above a cutoff are rejected.
RULES = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05]),
    "digits_per_char": ("n_digits / greatest(word_chars, 1)", [0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06]),
    "long_words": ("n_long_words / greatest(n_words, 1)", [0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]),
    "word_length": ("word_chars / greatest(n_words, 1)", [30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0]),
    "top_word_share": ("top_word / greatest(n_words, 1)", [0.9, 0.7, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
}


def repeated_words(ids: np.ndarray, window: int = 5) -> int:
    """Words in windows of `window` words that are found twice or more, the first finding included. `ids`: equal for
    equal words. Windows are compared exactly, by ranks of ever longer pieces."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank, have = ids.astype(np.int64), 1
    while have < window:
        step = min(have, window - have)
        pair = rank[: len(rank) - step] * (np.int64(len(ids)) + 1) + rank[step:]
        rank, have = np.unique(pair, return_inverse=True)[1], have + step
    often = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(often), 1)
    np.add.at(cover, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def describe(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_digits, n_long_words, top_word."""
    if not text:
        return (0,) * 9
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return (0,) * 9
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x and not x.strip(" \t\n\v\f\r") == ""]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(DIGITS.findall(text)),
        sum(1 for w in seen if len(w) > LONG_WORD),
        int(np.bincount(ids).max()),
    )


NAMES = [c.split()[0] for c in FEATURES.split(", ")]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([describe(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(NAMES) - 2)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stratum"), *map(pa.array, rows.T)], names=NAMES)


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    own = F.coalesce(F.col(stratum), F.lit("")) if stratum in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("long"), own.cast("string").alias("stratum"), "text").mapInArrow(_features, FEATURES)


def tail(k: int, n: int, share: float) -> float:
    """P(X <= k) for X binomial(n, share): the exact p-value of `k` rejections of `n` against "more than `share`". It is
    the regularised incomplete beta function at (n - k, k + 1), by its continued fraction, so its cost hardly grows with n."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - share
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, share)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) for x up to about its mean, by the modified Lentz method."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14 or m > 100_000:
            return min(1.0, front * value)


def choose(counts: list[tuple[str, str, int, int, int]], risk: float = RISK, delta: float = DELTA, strata: int = 0) -> dict[tuple[str, str], float]:
    """counts: stratum, rule, rung, rejected good documents, good documents. Returns the strictest accepted cutoff by
    stratum and rule; where none is accepted there is no entry and the rule does not act. `strata`: how many there are,
    if `counts` leaves out some that cannot pass. Every ladder is tested at the same level, `delta` over the number of
    ladders, from its first rung to the first that does not pass; no ladder's level is ever used by another."""
    share, tests = risk / len(RULES), {}
    for stratum, rule, rung, k, n in counts:
        tests.setdefault((stratum, rule), {})[rung] = (k, n)
    level, chosen = delta / max(1, len(tests), strata * len(RULES)), {}
    for key in sorted(tests):
        for rung, cutoff in enumerate(RULES[key[1]][1]):
            if tail(*tests[key][rung], share) > level:
                break
            chosen[key] = cutoff
    return chosen


def least_documents(risk: float = RISK, delta: float = DELTA) -> int:
    """With fewer good documents than this no test can pass, even if none of them is rejected and it is the only test."""
    return math.ceil(math.log(delta) / math.log1p(-risk / len(RULES))) - 1


def holdout_counts(found: DataFrame, labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> tuple[list[tuple[str, str, int, int, int]], int]:
    """Rejections of good documents (quality = 1) that pass the base rules, by stratum, rule and rung, of all strata with
    `least_documents` at least; and the number of all strata."""
    good = found.join(labelled.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").filter(~base_failed())
    sums = [F.sum((F.expr(value) > cut).cast("long")).alias(f"{rule}|{i}") for rule, (value, ladder) in RULES.items() for i, cut in enumerate(ladder)]
    rows = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums).filter(F.col("n") >= least_documents(risk, delta)).collect()
    counts = [(r.stratum, rule, i, r[f"{rule}|{i}"], r.n) for r in rows for rule, (_, ladder) in RULES.items() for i in range(len(ladder))]
    return counts, good.select("stratum").distinct().count()


def base_failed():
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def rejected_by(chosen: dict[tuple[str, str], float]):
    """The first rule that rejects a document, else null."""
    tests = []
    for rule, (value, _) in RULES.items():
        cutoffs = {s: c for (s, r), c in chosen.items() if r == rule}
        if cutoffs:
            by = F.from_json(F.lit(json.dumps(dict(sorted(cutoffs.items())))), "map<string,double>")  # one literal, however many strata
            tests.append(F.when(F.expr(value) > F.try_element_at(by, F.col("stratum")), F.lit(rule)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def judged(found: DataFrame, chosen: dict[tuple[str, str], float]) -> DataFrame:
    rule = rejected_by(chosen)
    return found.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & rule.isNull()).alias("kept"), rule.alias("rule"))


def cutoffs_for(docs: DataFrame, labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> tuple[DataFrame, dict]:
    found = staged(features(docs), "quality-features")
    counts, strata = holdout_counts(found, labelled, risk, delta)
    return found, choose(counts, risk, delta, strata)


def quality_rules(docs: DataFrame, labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, the base figures, base_failed, kept, rule.

    Null, empty and blank texts have no words: they fail the base and are not kept. A null language is a stratum of
    its own; strata without labels, or with too few for the test to pass, have no cutoffs
    and face the base rules only, as the guarantee cannot be given there. Without labels no rule acts. A document that is
    labelled both good and bad counts as good, so that cutoffs are the more careful. Repeated
    rows are judged each, and rows without doc_id by their text; an empty table gives no rows; columns with other names,
    those used inside included, are not read. A figure that equals a cutoff passes.
    """
    found, chosen = cutoffs_for(docs, labelled, risk, delta)
    return judged(found, chosen)


def keep_good(docs: DataFrame, labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of `docs` that `quality_rules` keeps, with all their columns, in the cases told there. Figures are worked out again beside the
    text, so that texts are not shuffled to meet a verdict."""
    found, chosen = cutoffs_for(docs, labelled, risk, delta)
    discard(found)
    own = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.cast("string").alias("stratum"))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([describe(t.as_py()) for t in pc.struct_field(batch.column("row"), "text")], np.int64).reshape(-1, len(NAMES) - 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found.T)], names=["row", "stratum", *NAMES[2:]])

    flat = rows.mapInArrow(figures, StructType([*rows.schema.fields, *(StructField(n, LongType()) for n in NAMES[2:])]))
    return flat.filter(~base_failed() & rejected_by(chosen).isNull()).select("row.*")

"""Operator 11: periodic runs of words by harmonic grid probing.

A run is a stretch of words with smallest period p, at least `min_exponent` periods long, that no neighbouring word
extends. Such a run holds several neighbours of the grid 0, p, 2p, ..., so for every p the words at jp and (j+1)p are
compared, n ln n comparisons for all p together; only where as many of them in a row agree as every run must show are
the words around compared, in growing chunks, to the run's ends. Grid points inside a run whose period divides p are
skipped. Short periods are probed one p at a time over all j, long ones one j at a time over all p, so that there are
about four roots of n array operations a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import WORD, text_or_empty

MIN_LENGTH = 6
MIN_EXPONENT = 4
CHUNK = 64
LARGEST_CHUNK = 1 << 16
#: Bytes of texts after which a batch goes back to Spark.
BATCH_BYTES = 1 << 23
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def agreeing(a: np.ndarray, x: int, p: int) -> tuple[int, int]:
    """The widest [lo, hi) around x in which every word is the one p words on."""
    n, hi, chunk = len(a) - p, x, CHUNK
    while hi < n:
        same = a[hi : min(hi + chunk, n)] == a[hi + p : min(hi + chunk, n) + p]
        if not same.all():
            hi += int(same.argmin())
            break
        hi, chunk = min(hi + chunk, n), min(chunk * 2, LARGEST_CHUNK)
    lo, chunk = x, CHUNK
    while lo > 0:
        at = max(0, lo - chunk)
        same = (a[at:lo] == a[at + p : lo + p])[::-1]
        if not same.all():
            lo -= int(same.argmin())
            break
        lo, chunk = at, min(chunk * 2, LARGEST_CHUNK)
    return lo, hi


def probed(a: np.ndarray, first: int, last: int, in_a_row: int) -> tuple[np.ndarray, np.ndarray]:
    """(p, x) for periods first..last-1: grid points x = jp that end `in_a_row` agreeing neighbours of the grid."""
    n, periods, places = len(a), [], []
    if first * first <= n:
        for p in range(first, last):
            grid = a[::p]
            same = grid[:-1] == grid[1:]
            hit = same[in_a_row - 1 :].copy()
            for k in range(1, in_a_row):
                hit &= same[in_a_row - 1 - k : len(same) - k]
            j = np.flatnonzero(hit) + in_a_row - 1
            if len(j):
                periods.append(np.full(len(j), p))
                places.append(j * p)
    else:
        p = np.arange(first, last)
        count = np.zeros(len(p), np.int64)
        for j in range(n // first):
            p = p[: np.searchsorted(p, -(-n // (j + 1)))]  # those with (j + 1) p < n
            if not len(p):
                break
            count = (count[: len(p)] + 1) * (a[j * p] == a[(j + 1) * p])
            hit = np.flatnonzero(count >= in_a_row)
            if len(hit):
                periods.append(p[hit])
                places.append(j * p[hit])
    if not periods:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(periods), np.concatenate(places)


def inside(periods: np.ndarray, places: np.ndarray, runs: dict[int, list]) -> np.ndarray:
    """Which points lie, with the point a period on, in a known run whose period divides theirs."""
    out = np.zeros(len(places), bool)
    for q, known in runs.items():
        some = np.flatnonzero(periods % q == 0)
        if len(some):
            starts, ends = np.array(known).T
            at = np.searchsorted(starts, places[some], "right") - 1
            out[some] |= (at >= 0) & (places[some] + periods[some] < ends[at])
    return out


def runs_of(a: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, given as numbers, by start and then period. Exact: a run
    of period p spans at least `min_exponent` - 1 agreeing grid points, and one of a multiple of its smallest period
    is the same stretch, found before. `min_exponent` is a whole number, 2 or more."""
    n, found = len(a), {}
    first = 1
    while first <= n // min_exponent:
        last = min(2 * first, n // min_exponent + 1)
        periods, places = probed(a, first, last, min_exponent - 1)
        if len(places):
            new = ~inside(periods, places, found)
            order = np.lexsort((places[new], periods[new]))
            periods, places = periods[new][order], places[new][order]
            i = 0
            while i < len(places):
                p, x = int(periods[i]), int(places[i])
                lo, hi = agreeing(a, x, p)
                if hi - lo + p >= max(min_length, min_exponent * p):
                    found.setdefault(p, []).append((lo, hi + p))
                end = np.searchsorted(periods, p, "right")
                i += int(np.searchsorted(places[i:end], hi))
        first = last
    return sorted((lo, hi - lo, p) for p, known in found.items() for lo, hi in known)


def numbers_of(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, runs (start, length, period in words; by start, then
    period), collapsed (the words that no run holds after its first period, joined by one space).

    Words are what ASCII white space separates. A null text is empty: no words, no runs, an empty `collapsed`. Texts are
    read whole, one at a time; memory is a text's own words. Runs may overlap; equal longest ones are all there. Rows
    that repeat a doc_id are judged each, and rows without one too. An empty table gives no rows; other columns are not
    read. Every row is worked on alone, so a hot source or very many copies weigh on no task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids, begin, held, sizes, runs, texts = batch.column("doc_id"), 0, 0, [], [], []
            for i, cell in enumerate(batch.column("text")):
                words = (cell.as_py() or "").encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space only
                found = runs_of(numbers_of(words), min_length, min_exponent)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(kept_words(words, found)))
                held += len(texts[-1])
                if held > BATCH_BYTES or i + 1 == batch.num_rows:
                    columns = [ids.slice(begin, i + 1 - begin), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])
                    begin, held, sizes, runs, texts = i + 1, 0, [], [], []

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of every row, in which one doc_id in ten (by CRC-32) has had its words from some place on replaced by
    a repetition of the first of them: what is to be found. A row without doc_id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int"))), " ")
    chosen = (h % 10 == 0) & text_or_empty().rlike(WORD)
    return docs.select("doc_id", F.when(chosen, whole).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Of `find_runs`: doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of
    the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_l"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("_l.start")).alias("start"), F.col("_l.length").alias("length"), (-F.col("_l.period")).alias("period"),
        F.expr("1000 * _l.length div -_l.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)

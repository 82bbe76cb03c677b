"""Pairs of sets that may reach a Jaccard similarity, without comparing every set with every other.

The tokens of a set have one order for all sets, the rarest first (by a sample, then by hash). Two sets as similar as the
threshold share a token within the first few of each, its prefix: as many as may differ and one more. Sets meet by class of
sizes, that of the larger one of a pair; a smaller set also stands in the classes of those that it may be near to.
Prefixes are shuffled once, in packed rows of a batch and a bucket (a class and a share of the tokens), and with them, once a
set and bucket, parities: how many tokens fall on each bit, odd or even. Two sets differ in at least as many tokens as
parities. Pairs are made bucket by bucket, in blocks, from the sets of a token that are of a fit size; what their places in
the order, or the parities, rule out is never written. Near copies meet at the first token of each run that both have.

Pairs of unrelated sets that share a token of their prefixes still grow with the square of the sets, but they are few of all
pairs (about one in a hundred of invented prose), they cost some tens of nanoseconds, and buckets grow in number with the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that tells how common tokens are, and tokens that it may name. They only order the tokens.
SAMPLE, NAMED = 20_000, 500_000
#: Tokens of a bucket, and pairs of a block (few enough for a core's cache).
BUCKET, PAIRS = 1_000_000, 1 << 16
#: Growth of classes of sizes, and tokens for each bit of the parities.
STEP, FOLD = 1.2, 4 / 3
#: Sets that are put in order at once.
SLICE = 1 << 11
#: A token (its place in the order of tokens, mixed with the class), the one before it (0: none), the set, and how many it has from this one on.
SIGN = np.dtype([("key", "<u8"), ("prev", "<u8"), ("set", "<u4"), ("rest", "<u4")])
#: own: it is of the bucket's class of sizes. lead: so long is its prefix for partners of its own size or larger ones.
SET = np.dtype([("no", "<i8"), ("n", "<i4"), ("lead", "<i4"), ("own", "?")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def classes(most: int) -> np.ndarray:
    """The least sizes of the classes, one class beyond `most`."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, math.ceil(starts[-1] * STEP)))
    return np.array(starts + [max(starts[-1] + 1, math.ceil(starts[-1] * STEP))], np.int64)


def widths(starts: np.ndarray) -> np.ndarray:
    """Words of parities of each class."""
    return np.ceil(starts[1:] / (64 * FOLD)).astype(np.int64) + 1


def prefix(n: np.ndarray, other: np.ndarray, share: float) -> np.ndarray:
    """How many tokens of a set of n hold one that it shares with any similar set of `other` or more (see `fits`)."""
    return n - np.ceil((n + other) * (1 - share) / 2 - 1e-6).astype(np.int64) + 1


def distinct(codes: np.ndarray) -> np.ndarray:
    """In order; for many numbers a sort takes a fraction of np.unique's time."""
    codes = np.sort(codes)
    return codes[np.r_[True, codes[1:] != codes[:-1]]] if len(codes) else codes


def weights(sets: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the tokens that a sample holds more than once; their weights; and that of all others."""
    share = F.pmod(F.xxhash64(F.lit(7), "no"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, rows)))
    # explode() would ask for the size of `hashes` first, and so work them out for all sets
    met = sets.filter(share).select(F.explode_outer("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    told = met.orderBy(F.desc("n"), "h").limit(NAMED).toArrow()
    h, n = told["h"].to_numpy().astype(np.int64).view(np.uint64), told["n"].to_numpy()
    top = min(rows, SAMPLE) + 1
    return h, np.rint(16 * np.log2(top / np.minimum(n, top - 1))).astype(np.uint16) + 1, round(16 * math.log2(top)) + 1


def spread(h: np.ndarray, w: np.ndarray, other: int) -> np.ndarray:
    """Weights by the last bits of a hash. Few of the other tokens meet a named one there and take its weight; all sets agree on that."""
    table = np.full(1 << min(24, max(10, (32 * len(h)).bit_length())), other, np.uint16)
    np.minimum.at(table, (h & np.uint64(len(table) - 1)).astype(np.int64), w)
    return table


def signed(batch: pa.RecordBatch, weight: np.ndarray, share: float, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a batch of at most SLICE sets (no, cls as a hash, hashes): their own class, then those of larger sets, each as the
    sets in it (SET), their classes, their parities (flat, with where each set's begin and end), and the tokens of their
    prefixes (SIGN, by place among these sets)."""
    lists = batch.column(2)
    s = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    no, cls = batch.column(0).to_numpy(), mixed(batch.column(1).to_numpy().view(np.uint64))
    row = np.repeat(np.arange(len(s)), s)
    weight = weight[(h & np.uint64(len(weight) - 1)).astype(np.int64)].astype(np.uint64)
    h = mixed(h)
    # set, weight and hash in one number; tokens that these 40 bits of a hash don't tell apart count as one token twice
    token = np.sort(row.astype(np.uint64) << np.uint64(50) | (np.uint64(1023) - weight) << np.uint64(40) | h >> np.uint64(24))
    token &= np.uint64((1 << 50) - 1)
    begin, h = np.cumsum(s) - s, h & np.uint64(0xFFFFFFFF)
    most = np.floor(s / threshold + 1e-9).astype(np.int64)
    starts = classes(int(most.max(initial=1)))
    wide = widths(starts)
    first, last = (np.searchsorted(starts, x, "right") - 1 for x in (s, most))
    for e in range(int((last - first).max(initial=-1)) + 1):
        own = np.flatnonzero(first + e <= last)
        k, n = first[own] + e, s[own]
        lead = prefix(n, np.maximum(n, starts[k]), share)
        sent = prefix(n, np.ceil(n * threshold - 1e-9).astype(np.int64), share) if e == 0 else lead
        sent = np.clip(sent, 0, n)
        doc = np.repeat(np.arange(len(own)), sent)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sent) - sent, sent)
        sets, signs = np.empty(len(own), SET), np.empty(len(doc), SIGN)
        sets["no"], sets["n"], sets["lead"], sets["own"] = no[own], n, lead, e == 0
        key = mixed(token[begin[own][doc] + place] ^ cls[own][doc])
        signs["key"], signs["set"], signs["rest"] = key, doc, n[doc] - place
        signs["prev"] = np.where(place > 0, np.roll(key, 1), np.uint64(0))
        words = wide[k]
        off = np.cumsum(words) - words
        odd = np.zeros(int(words.sum()), np.uint64)
        there = np.repeat(first + e <= last, s)
        bit = h[there] * np.repeat(words * 64, n).astype(np.uint64) >> np.uint64(32)
        np.bitwise_xor.at(odd, np.repeat(off, n) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        yield sets, k, odd, np.append(off, len(odd)), signs


def paired(sets: np.ndarray, odd: np.ndarray, signs: np.ndarray, share: float, threshold: float) -> np.ndarray:
    """Pairs of numbers (2 columns, each pair once) that share a key, the larger one in its own class, where neither sizes nor
    places nor parities (a row a set) rule them out."""
    order = np.argsort(sets["n"], kind="stable")
    sets, odd, rank = sets[order], np.ascontiguousarray(odd[order].T), np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    low = np.uint64(max(1, len(sets) - 1).bit_length())  # a few keys may so become one: more pairs, never fewer
    code = (signs["key"] >> low << low) | rank[signs["set"]]
    order = np.argsort(code)
    code, rest, prev = code[order], signs["rest"][order].astype(np.int32), signs["prev"][order]
    of = (code & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    n, c = sets["n"].astype(np.int32), (1 - share) / 2
    # of a pair the larger set asks, and those of the smaller ones that lie before it under the same key are asked
    asked = np.flatnonzero(n[of] - rest < sets["lead"][of])
    least = np.searchsorted(n, np.ceil(n * threshold - 1e-9).astype(np.int64)).astype(np.uint64)
    asks = np.flatnonzero(sets["own"][of])
    end = np.searchsorted(asked, asks)
    many = end - np.searchsorted(code[asked], (code[asks] >> low << low) | least[of[asks]])
    asks, end, many = asks[many > 0], end[many > 0], many[many > 0]
    half = c * n - 5e-7  # a pair needs the halves of both
    rest_b, of_b, prev_b, half_b = rest[asked], of[asked], prev[asked], half[of[asked]]
    prev[prev == 0] = ~np.uint64(0)  # the first tokens of two sets have none before them in common
    out, held, summed, at = [np.empty(0, np.int64)], 0, np.cumsum(many), 0
    while at < len(asks):
        to = max(at + 1, int(np.searchsorted(summed, (summed[at - 1] if at else 0) + PAIRS, "right")))
        each, e = many[at:to], asks[at:to]
        a, b = np.repeat(np.arange(len(e)), each), np.arange(each.sum()) + np.repeat(end[at:to] - np.cumsum(each), each)
        good = np.flatnonzero(np.minimum(rest[e][a], rest_b[b]) >= half[of[e]][a] + half_b[b])
        a, b, at = a[good], b[good], to
        good = prev[e][a] != prev_b[b]
        x, y = of[e][a[good]], of_b[b[good]]
        differ = np.zeros(len(x), np.int32)
        for word in odd:
            differ += np.bitwise_count(word[x] ^ word[y])
        good = (differ <= share * (n[x] + n[y])) & (x != y)
        out.append(distinct(x[good] * len(sets) + y[good]))
        held += len(out[-1])
        if held > max(1 << 21, len(out[0])):
            out, held = [distinct(np.concatenate(out))], 0
    codes = distinct(np.concatenate(out))
    return sets["no"][np.stack([codes // max(1, len(sets)), codes % max(1, len(sets))], 1)]


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """x, y (numbers, each pair once) of `sets` (no: a number of its own, cls, hashes: 64-bit hashes of distinct tokens; n:
    how many, where it is known) that may reach the threshold when rounded to six places and have the same cls. Null
    classes meet nothing."""
    sets = sets if "n" in sets.columns else sets.withColumn("n", F.size("hashes"))
    sets = sets.filter("cls IS NOT NULL AND n > 0")
    t = threshold - 1e-6
    share = (1 - t) / (1 + t) + 1e-9
    sizes = sets.groupBy(F.col("n").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a size
    starts = classes(max((math.floor(r.s / t + 1e-9) for r in sizes), default=1))
    signs = np.zeros(len(starts))
    for r in sizes:
        first, last = (np.searchsorted(starts, x, "right") - 1 for x in (r.s, math.floor(r.s / t + 1e-9)))
        for k in range(first, last + 1):
            signs[k] += r.n * max(0, int(prefix(np.int64(r.s), np.int64(math.ceil(r.s * t) if k == first else starts[k]), share)))
    parts = np.maximum(1, np.ceil(signs / BUCKET)).astype(np.uint64)  # buckets of each class of sizes
    sent = sets.sparkSession.sparkContext.broadcast((weights(sets, sum(r.n for r in sizes)), parts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, parts = spread(*sent.value[0]), sent.value[1]
        base = np.cumsum(parts) - parts
        kind = np.min_scalar_type(int(parts.sum()))  # short numbers are sorted faster
        for whole in batches:
            for batch in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                for own, k, odd, off, found in signed(batch, weight, share, t):
                    k = k[found["set"]]
                    bucket = (base[k] + (found["key"] >> np.uint64(8)) % parts[k]).astype(kind)
                    order = np.argsort(bucket, kind="stable")
                    found, bucket = found[order], bucket[order]
                    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
                    rows = []
                    for i, j in zip(at, np.r_[at[1:], len(found)], strict=True):
                        some = found[i:j].copy()
                        fresh = np.r_[True, some["set"][1:] != some["set"][:-1]]  # a set's tokens lie together
                        held = some["set"][fresh]
                        some["set"] = np.cumsum(fresh) - 1
                        words = np.arange(off[held[0] + 1] - off[held[0]])  # as many for all sets of a class
                        rows.append((own[held].tobytes(), odd[off[held][:, None] + words].tobytes(), some.tobytes()))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int64)), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=["bucket", "sets", "odd", "signs"])

    def pair(group: pa.Table) -> pa.Table:
        own = np.frombuffer(b"".join(group["sets"].to_pylist()), SET)
        odd = np.frombuffer(b"".join(group["odd"].to_pylist()), np.uint64).reshape(len(own), -1)
        signs, at, before = np.empty(sum(len(b.as_py()) for b in group["signs"]) // SIGN.itemsize, SIGN), 0, 0
        for b, held in zip(group["signs"], group["sets"], strict=True):
            some = np.frombuffer(b.as_py(), SIGN)
            signs[at : at + len(some)] = some
            signs["set"][at : at + len(some)] += before
            at, before = at + len(some), before + len(held.as_py()) // SET.itemsize
        pairs = paired(own, odd, signs, share, t)
        return pa.table({"x": pa.array(pairs.min(1)), "y": pa.array(pairs.max(1))})

    packed = sets.select("no", F.xxhash64("cls").alias("cls"), "hashes").mapInArrow(sign, "bucket long, sets binary, odd binary, signs binary")
    return packed.groupBy("bucket").applyInArrow(pair, "x long, y long").distinct()

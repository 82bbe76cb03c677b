"""Operators 11 and 12 against plain versions: random texts, the smallest tables, and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import mixing, periodic_runs

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} word{i % 31}." for i in range(30_000))
ODD = [
    (900_001, None, "a"), (900_002, "", "a"), (900_003, " \n\t ", None), (900_004, "a b", "Zoë"), (900_005, "x " * 50_000, "zz"), (900_006, LONG, "a"), (900_007, "a b a b a b a b c c c c c c c", None), (900_008, "é\x1cb\x85c « ’s 🙂 " * 9, "ï"),
    (900_009, "same text here", "zz"), (900_009, "same text here", "zz"), (900_009, "another text under this doc_id", "zz"), (None, "no name at all", "a"), (None, "no name at all", "a"), (None, None, None),
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return real.union(odd).withColumns({c: F.lit(7) for c in ("k", "size", "code", "target", "copies", "edge", "left", "tied", "n_rows", "place", "runs", "start", "length", "period", "collapsed", "_row", "_copy")})


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "source").collect()


# ---- 11 --------------------------------------------------------------------------------------------------------------


def plain_runs(w, least=6, times=4):
    """By the definition: every stretch that a period holds and no neighbour extends, unless a smaller period holds it."""
    a, out = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if len(w) else np.zeros(0, int), []
    for p in range(1, len(w) // times + 1):
        same = np.concatenate([[False], a[:-p] == a[p:], [False]])
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            part = a[lo : hi + p]
            if len(part) >= max(least, times * p) and all((part[:-q] != part[q:]).any() for q in range(1, p)):
                out.append((int(lo), len(part), p))
    return sorted(out)


def plain_row(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *found, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12)), max_size=12))
def test_runs_of_random_repetitions(parts):
    a = np.array([x for block, times in parts for x in block * times], np.int64)
    assert periodic_runs.runs_of(a) == plain_runs(a.tolist())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=300), st.integers(2, 5), st.integers(1, 9))
def test_runs_of_two_words_at_any_exponent(a, times, least):
    assert periodic_runs.runs_of(np.array(a, np.int64), least, times) == plain_runs(a, least, times)


@pytest.mark.parametrize("p", [1, 2, 63, 64, 65, 700, 4999, 5000])
def test_long_runs_of_any_period(p):
    rng = random.Random(p)
    core = [rng.random() for _ in range(p)]
    w = [-1.0, -2.0] + (core * (20_000 // p + 1))[:20_000] + [-3.0]
    assert periodic_runs.runs_of(np.unique(np.array(w), return_inverse=True)[1]) == [(2, 20_000, p)]


def test_a_text_of_one_word_takes_no_square_time():
    assert periodic_runs.runs_of(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]


def test_periodic_runs(docs, rows):
    got = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.planted(docs))).collect()
    want = collections.Counter(plain_row(r.doc_id, r.text) for r in rows if r.doc_id not in (900_005, 900_006))
    assert collections.Counter(tuple(r) for r in got if r.doc_id not in (900_005, 900_006)) == want and len(got) == len(rows)
    assert sum(r.n_runs for r in got) > 20
    assert [c for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")] == list(got[0].asDict())
    long = next(r for r in got if r.doc_id == 900_005)
    assert (long.start, long.length, long.period, long.exponent_milli) == (0, 50_000, 1, 50_000_000)
    assert periodic_runs.find_runs(docs.filter("false")).count() == 0


def test_runs_and_texts_of_the_operator(docs):
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs.filter("doc_id > 900000")).collect()}
    r = got[900_007]
    assert [(x.start, x.length, x.period) for x in r.runs] == [(0, 8, 2), (8, 7, 1)] and r.collapsed == "a b c"
    assert got[900_001].n_words == 0 and got[900_001].runs == [] and got[900_001].collapsed == ""


# ---- 12 --------------------------------------------------------------------------------------------------------------


def plain_targets(size, weights=(3, 1, 2), share=1.5, epochs=2):
    """The words round by round: what is over is shared again by weight among sources that are not full."""
    names = sorted(size, key=lambda s: (s is None, s or ""))  # Python orders by code point
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, over, room = dict.fromkeys(names, 0.0), share * sum(size.values()), {s for s in names if size[s]}
    while over > 1e-7 and room:
        unit = over / sum(weight[s] for s in room)
        over = 0.0
        for s in sorted(room, key=names.index):
            got[s] += unit * weight[s]
        for s in list(room):
            if got[s] >= epochs * size[s]:
                over += got[s] - epochs * size[s]
                got[s] = float(epochs * size[s])
                room.discard(s)
    return got


def check_mix(out, rows, share=1.5):
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(words(r.text))
    target = plain_targets(size, share=share)
    taken, whole = collections.Counter(), collections.defaultdict(list)
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(r.doc_id for r in rows)
    named = collections.defaultdict(list)
    for r in rows:
        named[(r.doc_id, len(words(r.text)), size[r.source])].append(r.source)
    for r in out:
        source = named[(r.doc_id, r.size, r.source_size)][0]
        assert r.target == pytest.approx(target[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
        whole[source].append(r.size and r.taken % r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= 3  # repeated rows on the boundary may lose less than a word each
        assert sum(x > 0 for x in whole[s]) <= 3


def test_mix(docs, rows, spark):
    out = mixing.mix(docs).collect()
    check_mix(out, rows)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(out, key=key) == sorted(again, key=key)
    assert mixing.mix(docs.filter("false")).count() == 0
    assert [(r.taken, r.target) for r in mixing.mix(docs.filter("doc_id IN (900001, 900003)")).collect()] == [(0, 0.0)] * 2  # no words at all


@pytest.mark.parametrize("bits", [3, 10, 60])
def test_thresholds_at_any_width(spark, bits):
    rng = random.Random(bits)
    data = [(k, rng.randrange(50), rng.randrange(1 << 60) if rng.random() < 0.8 else 77) for k in "abc" for _ in range(200)]
    wanted = {"a": 1, "b": sum(s for k, s, _ in data if k == "b") // 3, "c": 10**9}
    frame = spark.createDataFrame(data, "k string, size long, code long")
    if bits == 60:  # one level would be as many buckets as codes
        frame = frame.withColumn("code", F.shiftright("code", 50))
        data = [tuple(r) for r in frame.collect()]
    got = {r.k: r for r in mixing.thresholds(frame, spark.createDataFrame([*wanted.items(), ("d", 5)], "k string, words long"), bits).collect()}
    assert set(got) == set(wanted)
    for k, w in wanted.items():
        total = 0
        for c in sorted({c for kk, _, c in data if kk == k}):
            tied = sum(s for kk, s, cc in data if kk == k and cc == c)
            if tied and total + tied >= min(w, sum(s for kk, s, _ in data if kk == k)):
                break
            total += tied
        assert (got[k].edge, got[k].left, got[k].tied) == (c, min(w - total, tied), tied)


def test_smaller_mixes_lie_within_larger_ones(docs):
    name = ("doc_id", "size")
    mixes = [{tuple(r[c] for c in name): r.taken for r in mixing.mix(docs.filter("doc_id < 900000"), percent=p).collect()} for p in (40, 90, 150, 199)]
    for small, large in zip(mixes, mixes[1:]):
        assert all(small[d] <= large[d] for d in small)


def test_mixture_is_what_the_mix_takes(docs):
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    got = collections.Counter()
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
    assert +got == +taken


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    size = {f"s{i:04d}": int(10 ** rng.uniform(0, 6)) for i in range(3000)}
    frame = spark.createDataFrame([("+" + s, n) for s, n in size.items()], "k string, source_size long")
    want = plain_targets(size)
    got = {r.k[1:]: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1.5 * sum(size.values()))

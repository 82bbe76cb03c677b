"""Classes of near duplicates against comparing every pair."""

import random

from pyspark.sql import functions as F

from corpusloom.operators.cleaning import near_duplicate_classes
from corpusloom.operators.graphs import classes_of


def test_classes_against_every_pair(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(12)] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
        rows.append((i, words, rng.choice(["en", "de"])))
    rows += [(1000, [], "en"), (1001, None, "en"), (1002, [], None), (1003, ["a", "b"], None), (1004, ["b", "a", "a"], None)]
    df = spark.createDataFrame(rows, "id long, words array<string>, lang string").withColumns({c: F.lit(7) for c in ("rep", "cls", "name", "copies")})
    got = {r.id: (r.representative, r.copies, r.n_links, r.class_id) for r in near_duplicate_classes(df, "id", "words", "lang", 0.72).collect()}
    assert len(got) == len(rows)
    sets = {i: (g, frozenset(w or [])) for i, w, g in rows}
    groups: dict = {}
    for i, s in sets.items():
        groups.setdefault(s, []).append(i)
    rep = {i: min(groups[s]) for i, s in sets.items()}
    linked = {r: set() for r in rep.values()}
    for a in linked:
        for b in linked:
            (g, x), (h, y) = sets[a], sets[b]
            if a != b and g is not None and g == h and x and y and round(len(x & y) / len(x | y), 6) >= 0.72:
                linked[a].add(b)
    for i in rep:
        reach, todo = {rep[i]}, [rep[i]]
        while todo:
            todo = [b for a in todo for b in linked[a] if b not in reach]
            reach |= set(todo)
        assert got[i] == (rep[i], len(groups[sets[i]]), len(linked[rep[i]]), min(reach)), i
    assert sum(n > 0 for _, _, n, _ in got.values()) > 20


def test_classes_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (301, 300)], "a long, b long")
    assert {r.id: r.class_id for r in classes_of(chain).collect()} == {i: 0 for i in range(201)} | {300: 300, 301: 300}
    assert classes_of(chain.filter("false")).count() == 0


def test_candidates_miss_no_pair_and_name_few_others(spark, monkeypatch):
    """Sets of many sizes with planted near copies, in several buckets and blocks: every link, by comparing all pairs."""
    import random

    from pyspark.sql import functions as F

    from corpusloom.operators import cleaning, near_sets

    monkeypatch.setattr(near_sets, "BUCKET", 500)
    monkeypatch.setattr(near_sets, "PAIRS", 50)
    monkeypatch.setattr(cleaning, "BLOCK_SETS", 2)
    rng = random.Random(3)
    rows = []
    for i in range(150):
        words = [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60, 200]))]
        rows += [(len(rows) + j, [w for w in words if j == 0 or rng.random() > 0.1], rng.choice(["a", "b"]) if i % 10 == 0 else "a") for j in range(3)]
    df = spark.createDataFrame(rows, "id long, w array<string>, cls string")
    want = {(a, b) for a, x, c in rows for b, y, d in rows if a < b and c == d and x and y and round(len({*x} & {*y}) / len({*x} | {*y}), 6) >= 0.72}
    got = cleaning.near_duplicate_pairs(df, "id", "w", "cls", 0.72)
    assert len(want) > 50 and {(r.a, r.b) for r in got.collect()} == want
    hashed = df.select(F.col("id").alias("no"), "cls", F.transform(F.array_distinct("w"), lambda t: F.xxhash64(t)).alias("hashes"))
    assert near_sets.candidates(hashed, 0.72).count() < 2 * len(want)


def prose(n, rng, words=4000):
    """Sets of unrelated invented prose: every text draws from the same words, few of them common."""
    import numpy as np

    odds = 1 / np.arange(1, words + 1)
    return [np.unique(rng.choice(words, rng.integers(100, 200), p=odds / odds.sum())).astype(np.int64) for _ in range(n)]


def test_unrelated_sets_are_rarely_compared_and_near_copies_not_once_a_token(monkeypatch):
    """Sets of unrelated texts share rare words too; the pairs whose parities are counted are few of those of fit sizes."""
    import numpy as np
    import pyarrow as pa

    from corpusloom.operators import near_sets

    rng = np.random.default_rng(5)
    copies = [np.union1d(x[rng.random(len(x)) > 0.02], [9000 + i]) for i, x in enumerate(prose(1, rng) * 60)]
    asked, count = [], np.bitwise_count
    monkeypatch.setattr(near_sets.np, "bitwise_count", lambda x: asked.append(len(x)) or count(x))

    def looked_at(sets):
        """Pairs that were compared, those found, and those of fit sizes."""
        asked.clear()
        t, n = 0.72 - 1e-6, np.array([len(s) for s in sets])
        share = (1 - t) / (1 + t) + 1e-9
        token, many = np.unique(np.concatenate(sets), return_counts=True)
        weight = near_sets.spread(near_sets.mixed(token.view(np.uint64)), np.rint(16 * np.log2(len(sets) / many)).astype(np.uint16) + 1, 300)
        hashes = pa.array([near_sets.mixed(s.view(np.uint64)).view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([7] * len(sets)), hashes], names=["no", "cls", "hashes"])
        met: dict = {}
        for own, k, odd, off, signs in near_sets.signed(batch, weight, share, t):
            for c in np.unique(k):
                of = np.flatnonzero(k == c)
                place = np.full(len(k), -1)
                place[of] = np.arange(len(of))
                some = signs[k[signs["set"]] == c].copy()
                some["set"] = place[some["set"]] + sum(len(x[0]) for x in met.get(c, []))
                met.setdefault(c, []).append((own[of], np.stack([odd[off[i] : off[i + 1]] for i in of]), some))
        found, compared = set(), 0
        for parts in met.values():
            asked.clear()
            own, odd, signs = (np.concatenate(x) for x in zip(*parts, strict=True))
            found |= {tuple(sorted(p)) for p in near_sets.paired(own, odd, signs, share, t).tolist()}
            compared += sum(asked) // odd.shape[1]
        fit = sum(min(a, b) >= 0.72 * max(a, b) for i, a in enumerate(n) for b in n[:i])
        true = {(j, i) for i in range(len(sets)) for j in range(i) if round(len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])), 6) >= 0.72}
        assert true <= found
        return compared, len(found), fit

    compared, found, fit = looked_at(prose(300, rng))
    assert found == 0 and compared < 0.1 * fit
    compared, found, fit = looked_at(copies)
    assert found == fit == 60 * 59 / 2 and compared < 8 * found


def test_small_components_share_a_group_of_rows(spark, monkeypatch):
    """A task's cost is that of its groups of rows; a group each for thousands of components of two or three sets is most of the time."""
    from corpusloom.operators import cleaning

    frames, kept = {}, cleaning.kept
    monkeypatch.setattr(cleaning, "kept", lambda df, what: frames.setdefault(what, kept(df, what)))
    rows = [(3 * i + j, [f"w{i}-{k}" for k in range(12)] + [f"x{j}"], "a") for i in range(40) for j in range(3)]
    df = spark.createDataFrame(rows, "id long, w array<string>, cls string")
    got = {(r.a, r.b, r.jaccard) for r in cleaning.near_duplicate_pairs(df, "id", "w", "cls", 0.72).collect()}
    assert got == {(3 * i + a, 3 * i + b, round(12 / 14, 6)) for i in range(40) for a, b in ((0, 1), (0, 2), (1, 2))}
    groups = frames["places"].drop("id", "part").distinct()
    assert frames["places"].count() == 120 and groups.count() < 5


def test_overlaps_by_matrices_and_by_sets(monkeypatch):
    import numpy as np

    from corpusloom.operators import cleaning

    rng = np.random.default_rng(0)
    sets = [rng.permutation(np.unique(np.r_[np.flatnonzero(rng.random(40) < 0.9), rng.integers(0, 300, 10)])) for _ in range(60)]
    token, starts = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]
    a, b = np.array([(i, j) for i in range(60) for j in range(i) if (i + j) % 3]).T
    want = [len({*sets[i]} & {*sets[j]}) for i, j in zip(a, b, strict=True)]
    for dense, rows, columns in ((0, 1, 1), (16, 1024, 4096), (16, 7, 5)):
        monkeypatch.setattr(cleaning, "DENSE", dense)
        monkeypatch.setattr(cleaning, "ROWS", rows)
        monkeypatch.setattr(cleaning, "COLUMNS", columns)
        assert cleaning.overlaps(token, starts, a, b).tolist() == want
    assert len(cleaning.overlaps(token, starts, a[:0], b[:0])) == 0

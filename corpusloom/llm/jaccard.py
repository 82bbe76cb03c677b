"""Operator 10: exact Jaccard self-join on word shingles by a token-group matrix, down to its connected components.

1. Each document becomes the set of its hashed shingles. Sets are named by a number of their own, verified to name one
   set in the whole corpus; documents with the same set share it.
2. Tokens meet in buckets (packed, a few bytes a token) and each learns in how many sets it lies. Tokens of one set
   alone can't be part of an overlap, so a set lives on only if its shared tokens reach the threshold. What is left of
   the corpus are the sets that have a chance of a partner.
3. Similar sets are partitioned into groups: sets that share a smallest hash are compared with one centre each, where
   sizes and sketches don't rule it out, and the components of these links are the groups, in pieces of about `GROUP`
   sets; sets still alone are grouped by that smallest hash.
4. The token-group matrix: groups that share a token of their sets' prefixes (a set and a partner must share one) meet,
   unless they are of one component. For each set of one group the union of the other's tokens bounds the overlap; only
   groups whose bound reaches the threshold are opened, and their sets are compared exactly.
5. Links of both kinds are verified on the shingles themselves. Were two shingles ever to share a hash in a link, the
   join would begin again with another hash.
6. The links, and doc_ids that several sets share, give the components.

Pairs within a component are never formed, so a group of very many near copies costs one comparison a copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import discard, staged, with_group
from corpusloom.llm.components import components
from corpusloom.llm.packets import PACKET, buckets_of, by_bucket, by_document, homes_of, packed, runs

WORDS = 5
SHARE = 75  # per cent
GROUP = 128
SLICE = 2000
DOCS_PER_BUCKET = 2000
QUERIES_PER_TASK = 256


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, words: int = WORDS, seed: int = 0) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of the whole text where it has fewer words."""
    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    mix = np.full(len(h) - n + 1, n + (seed << 8), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
            mix ^= mix >> np.uint64(31)
        mix *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mix ^ (mix >> np.uint64(29)))


def least_overlap(n: int, share: int = SHARE) -> int:
    """Tokens that a set of n must share with any partner."""
    return -(-share * n // 100)


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def set_number(key: bytes, turn: int = 0) -> int:
    """The number that names a set; in another turn another one."""
    return int.from_bytes(key[:8] if not turn else xxhash.xxh3_64_digest(key, turn), "little", signed=True)


def profiles(docs: DataFrame, words: int = WORDS, seed: int = 0) -> DataFrame:
    """doc_id, n (set size), set_key (equal for equal sets; null for empty ones), rep (the set's number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words, seed) for t in batch.column("text")]
            keys = [set_key(s) if len(s) else None for s in sets]
            numbers = [None if k is None else set_number(k) for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(numbers, pa.int64())], names=["doc_id", "n", "set_key", "rep"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, set_key binary, rep long")


def renamed(sets: DataFrame) -> dict[bytes, int]:
    """Numbers for the sets whose own number another set has too, all but one of each. Two of k sets share one of 2 ** 64
    numbers by chance only, so there are about k ** 2 / 2 ** 65 of these: none for some billions of sets, and for a
    hundred billion a few hundred."""
    new: dict[bytes, int] = {}
    clash = sets.groupBy("rep").agg(F.sort_array(F.collect_list("set_key")).alias("keys")).filter(F.size("keys") > 1).select("keys").toArrow()
    for keys in clash.column("keys").to_pylist():
        for turn, key in enumerate(keys):
            if turn:
                new[bytes(key)] = set_number(bytes(key), turn)
    return new


def with_numbers(rows: DataFrame, new: dict[bytes, int]) -> DataFrame:
    if not new:
        return rows
    spark = rows.sparkSession
    other = spark.createDataFrame(pa.table({"set_key": pa.array(list(new), pa.binary()), "other": pa.array(list(new.values()), pa.int64())}))
    return rows.join(F.broadcast(other), "set_key", "left").withColumn("rep", F.coalesce("other", "rep")).drop("other")  # see `renamed`


MESSAGE = "bucket int, sets binary, ord binary, top binary, hi binary, lo binary"


def messages(docs: DataFrame, buckets: int, words: int = WORDS, seed: int = 0, new: dict[bytes, int] | None = None) -> DataFrame:
    """The tokens of each slice of documents, packed by bucket. Equal sets of a slice go once. Within a message tokens are
    in the order of their upper bits, which so take next to no room."""

    def sliced(ids: list[int], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        for i, t in zip(ids, texts, strict=True):
            s = shingles(t, words, seed)
            if len(s) and i is not None:
                sets[set_key(s)] = s
        if not sets:
            return
        tokens = np.concatenate(list(sets.values()))
        own = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets.values()])
        order = by_bucket(tokens, buckets)
        tokens, own = tokens[order], own[order]
        bucket = buckets_of(tokens, buckets)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        names = np.array([(new or {}).get(k, set_number(k)) for k in sets], "<i8")
        for a, b in zip(first.tolist(), np.append(first[1:], len(tokens)).tolist(), strict=True):
            part = tokens[a:b]
            here, ord_ = np.unique(own[a:b], return_inverse=True)
            row = [names[here].tobytes(), ord_.astype("<u2").tobytes(), (part >> np.uint64(48)).astype("<u2").tobytes(), (part >> np.uint64(32)).astype("<u2").tobytes(), part.astype("<u4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names=[c.split()[0] for c in MESSAGE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield from sliced(part.column("doc_id").to_pylist(), part.column("text").to_pylist())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MESSAGE)


#: A token that other sets hold too, and in how many sets it lies.
SHARED = np.dtype([("token", "<u8"), ("df", "<u4")])


def shared_tokens(table: pa.Table, homes: int) -> pa.Table:
    """Of one bucket: for each set its tokens that other sets hold too, packed by the sets' homes."""
    names, tokens = [], []
    for r in range(table.num_rows):
        names.append(np.frombuffer(table["sets"][r].as_buffer(), "<i8")[np.frombuffer(table["ord"][r].as_buffer(), "<u2")])
        top, hi = (np.frombuffer(table[c][r].as_buffer(), "<u2").astype(np.uint64) for c in ("top", "hi"))
        tokens.append(top << np.uint64(48) | hi << np.uint64(32) | np.frombuffer(table["lo"][r].as_buffer(), "<u4"))
    name, token = np.concatenate(names), np.concatenate(tokens)
    del names, tokens
    order = np.argsort(token, kind="stable")
    name, token = name[order], token[order]
    del order
    starts, ends = runs(token)
    many = np.repeat(ends - starts > 1, ends - starts)
    name, token = name[many], token[many]  # most tokens have one set, and go before the rest is sorted
    order = np.lexsort((name, token))
    name, token = name[order], token[order]
    fresh = np.concatenate([np.ones(min(1, len(name)), bool), (token[1:] != token[:-1]) | (name[1:] != name[:-1])])  # a set comes from many slices
    name, token = name[fresh], token[fresh]
    starts, ends = runs(token)
    df = np.repeat(ends - starts, ends - starts)
    keep = df > 1
    found = np.empty(int(keep.sum()), SHARED)
    found["token"], found["df"] = token[keep], df[keep]
    return packed(name[keep], found, homes)


#: rep: the number of a set.
LIVE = "rep long, n long, k long, sketch array<long>, tokens binary, prefix array<long>, keys array<long>"
#: Odd multipliers: one for each key of similarity, and the sketch's.
KEYS, SKETCH = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], 0x94D049BB133111EB
SKETCH_BITS = 2048


def with_homes(rows: DataFrame, key: str, homes: int) -> DataFrame:
    """Adds home, dealt as `packets` deals documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = homes_of(batch.column(key).to_numpy(), homes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], names=[*batch.schema.names, "home"])

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", home int")


def live_sets(sets: DataFrame, met: DataFrame, buckets: int, share: int = SHARE) -> DataFrame:
    """Of the `messages` in `met`, the sets whose shared tokens reach the threshold, with these tokens (sorted), the prefix under which any
    partner is met (rarest first), smallest hashes as keys of similarity, and a sketch: the parity of how many tokens
    fall on each of SKETCH_BITS bits."""
    met = met.groupBy("bucket").applyInArrow(lambda t: shared_tokens(t, buckets), PACKET)
    known = with_homes(sets.select("rep", "n"), "rep", buckets)

    def gather(own: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in LIVE.split(", ")]
        if own.num_rows and found.num_rows:
            size = dict(zip(own["rep"].to_pylist(), own["n"].to_pylist(), strict=True))
            for rep, record in by_document(found, SHARED):
                n = size.get(rep)
                if n is None or len(record) * 100 < n * share:
                    continue
                token, df = record["token"].copy(), record["df"]
                first = np.lexsort((token, df))[: len(token) - least_overlap(n, share) + 1]
                with np.errstate(over="ignore"):
                    keys = [int((token * np.uint64(m) >> np.uint64(1)).min()) for m in KEYS]
                    odd = np.bincount((token * np.uint64(SKETCH) >> np.uint64(53)).astype(np.int64), minlength=SKETCH_BITS) & 1
                sketch = np.packbits(odd.astype(np.uint8)).view("<i8")
                for column, x in zip(rows, (rep, n, len(token), sketch, np.sort(token).tobytes(), token[first].astype(np.int64), keys), strict=True):
                    column.append(x)
        many = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int64(), pa.int64(), many, pa.binary(), many, many]
        return pa.table([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[c.split()[0] for c in LIVE.split(", ")])

    return known.groupBy("home").cogroup(met.groupBy("home")).applyInArrow(gather, LIVE)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens that two sorted sets share."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum()) if len(large) else 0


def links(shared: int, n: int, m: int, share: int = SHARE) -> bool:
    return 100 * shared >= share * (n + m - shared)


def may_link(a: Column, b: Column, share: int = SHARE) -> Column:
    """False only where sizes or sketches show that two sets cannot link: each bit on which sketches differ stands for
    a token at least that one of them has alone."""
    apart = F.aggregate(F.zip_with(a["sketch"], b["sketch"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = (a["k"] + b["k"] - apart) / 2
    return (F.greatest(a["n"], b["n"]) * share <= F.least(a["n"], b["n"]) * 100) & (most * 100 >= (a["n"] + b["n"] - most) * share)


def linked_to_centres(live: DataFrame, share: int = SHARE) -> DataFrame:
    """a, b: links between sets and the centre (smallest number) of those that share a key with them. A centre's tokens
    go once to each task that compares up to QUERIES_PER_TASK sets with them."""
    light = F.struct("rep", "n", "k", "sketch").alias("own")
    by_key = live.select(light, F.explode(F.array(*[F.struct(F.lit(i).alias("key"), F.element_at("keys", i + 1).alias("v")) for i in range(len(KEYS))])).alias("key"))
    centres = staged(by_key.groupBy("key").agg(F.min_by("own", "own.rep").alias("centre"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "jaccard-centres")
    near = with_group(by_key, centres, "key", "c").filter("own.rep <> centre.rep").filter(may_link(F.col("own"), F.col("centre"), share))
    edges = staged(near.select(F.col("own.rep").alias("rep"), F.col("centre.rep").alias("centre")).distinct(), "jaccard-edges")
    parts = staged(edges.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).alias("salts"), F.count(F.lit(1)).alias("c")), "jaccard-parts")
    asking = with_group(edges, parts, "centre", "c").select("centre", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("long").alias("salt"), "rep")
    asked = parts.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("centre").alias("rep"))
    whole = asking.unionByName(asked).join(live.select("rep", "n", "tokens"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        rep, n = table["rep"].to_pylist(), table["n"].to_pylist()
        tokens, own = [np.frombuffer(x.as_buffer(), "<u8") for x in table["tokens"]], table["centre"][0].as_py()
        c = rep.index(own)
        near = [r for r, m, t in zip(rep, n, tokens, strict=True) if r != own and links(overlap(t, tokens[c]), m, n[c], share)]
        return pa.table({"a": pa.array(near, pa.int64()), "b": pa.array([own] * len(near), pa.int64())})

    out = staged(whole.groupBy("centre", "salt").applyInArrow(compare, "a long, b long"), "jaccard-near")
    discard(centres, edges, parts)
    return out


def open_group(table: pa.Table, share: int) -> pa.Table:
    """Links between the queries of one group and its sets, as many as join their components."""
    asking = table["asks"].to_numpy()
    members, queries = table.filter(pa.array(~asking)), table.filter(pa.array(asking))
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in members["tokens"]]
    out, above = [], {}

    def top(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = above.get(up, up)
            c = up
        return c

    if sets and queries.num_rows:
        union = np.unique(np.concatenate(sets))
        n, k, rep, comp = (members[c].to_numpy() for c in ("n", "k", "rep", "comp"))
        sketches, mine = (np.concatenate([np.asarray(x.as_py(), np.int64) for x in t["sketch"]]).view(np.uint64).reshape(t.num_rows, -1) for t in (members, queries))
        for row, (q_rep, q_comp, q_n, q_k) in enumerate(zip(*(queries[c].to_pylist() for c in ("rep", "comp", "n", "k")), strict=True)):
            own = np.frombuffer(queries["tokens"][row].as_buffer(), "<u8")
            if overlap(own, union) < least_overlap(q_n, share):
                continue  # the group's bound
            most = (k + q_k - np.bitwise_count(sketches ^ mine[row]).sum(1)) / 2
            fits = (np.maximum(n, q_n) * share <= np.minimum(n, q_n) * 100) & (most * 100 >= (n + q_n - most) * share) & (comp != q_comp)
            for i in np.flatnonzero(fits):
                if top(int(comp[i])) != top(q_comp) and links(overlap(own, sets[i]), q_n, int(n[i]), share):
                    out.append((q_rep, int(rep[i])))
                    above[top(int(comp[i]))] = top(q_comp)
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def linked_across(live: DataFrame, comps: DataFrame, share: int = SHARE) -> DataFrame:
    """a, b: links between different components so far, as many as join what is joined at all.

    Groups are the components in pieces of about GROUP sets, and lone sets with the same smallest hash. The matrix is
    joined with itself by token, a row for each token and group, so that a token that very many sets hold costs the
    square of its groups, not of its sets; groups of one and the same component never meet."""
    sized = comps.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    known = comps.join(sized, "label").select(F.col("id").alias("rep"), F.col("label").alias("comp"), "size")
    one = live.select("rep", "n", "prefix", F.element_at("keys", 1).alias("key")).join(known, "rep", "left")
    lone = F.coalesce("size", F.lit(1)) == 1
    one = one.select("rep", "n", "prefix", F.coalesce("comp", "rep").alias("comp"), F.xxhash64(lone, F.when(lone, F.col("key")).otherwise(F.col("comp"))).alias("family"))
    pieces = one.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("pieces"))
    grouped = staged(one.join(pieces, "family").withColumn("grp", F.xxhash64("family", F.pmod(F.xxhash64("rep"), F.col("pieces")))).drop("family", "pieces"), "matrix-sets")
    posts = grouped.select("grp", "n", "comp", F.explode("prefix").alias("token"))
    mixed = posts.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    columns = posts.join(mixed, "token", "left_semi").groupBy("token", "grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    columns = staged(columns, "matrix-columns")
    side = lambda p: columns.select("token", *[F.col(c).alias(f"{p}_{c}") for c in ("grp", "lo", "hi", "least", "most")])
    fits = (F.col("a_least") * share <= F.col("b_most") * 100) & (F.col("b_least") * share <= F.col("a_most") * 100)
    apart = F.least("a_lo", "b_lo") < F.greatest("a_hi", "b_hi")
    met = side("a").join(side("b"), "token").filter((F.col("a_grp") <= F.col("b_grp")) & fits & apart).select("a_grp", "b_grp").distinct()
    counts = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("n").alias("most"))
    about = lambda p: counts.select(*[F.col(c).alias(f"{p}_{c}") for c in counts.columns])
    both = met.join(about("a"), "a_grp").join(about("b"), "b_grp")
    # of two groups the smaller one's sets are the queries
    pick = lambda c: F.when(F.col("a_c") <= F.col("b_c"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    other = lambda c: F.when(F.col("a_c") <= F.col("b_c"), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    pairs = both.select(pick("grp").alias("grp"), other("grp").alias("opened"), other("least").alias("least"), other("most").alias("most"))
    in_range = (F.col("n") * share <= F.col("most") * 100) & (F.col("least") * share <= F.col("n") * 100)
    asked = staged(pairs.join(grouped.select("grp", "rep", "comp", "n"), "grp").filter(in_range).select(F.col("opened").alias("grp"), "rep", "comp"), "matrix-asked")
    salts = asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).alias("salts"))
    members = grouped.select("grp", "rep", "comp").join(salts, "grp").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "rep", "comp", F.lit(False).alias("asks"))
    queries = asked.join(salts, "grp").select("grp", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("long").alias("salt"), "rep", "comp", F.lit(True).alias("asks"))
    whole = members.unionByName(queries).join(live.select("rep", "n", "k", "sketch", "tokens"), "rep")
    out = staged(whole.groupBy("grp", "salt").applyInArrow(lambda t: open_group(t, share), "a long, b long"), "matrix-links")
    discard(grouped, columns, asked)
    return out


def verified(links_: DataFrame, sets: DataFrame, docs: DataFrame, share: int = SHARE, words: int = WORDS, seed: int = 0) -> DataFrame:
    """a, b, real: whether the shingles themselves of two linked sets reach the threshold. A set's text is that of one of
    its documents; texts move once for a link, whatever the number of their copies."""
    asked = staged(links_.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(sets.select("rep", "set_key", F.col("first").alias("doc_id")), "rep"), "jaccard-asked")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(asked.hint("shuffle_hash"), "doc_id")  # as many as sets with links

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a doc_id may have other texts too
            keep = [set_key(shingles(t.as_py(), words, seed)) == k.as_py() for t, k in zip(batch.column("text"), batch.column("set_key"), strict=True)]
            yield batch.select(["rep", "text"]).filter(pa.array(keep, pa.bool_()))

    told = staged(texts.select("text", "set_key", "rep").mapInArrow(own, "rep long, text string").dropDuplicates(["rep"]), "jaccard-texts")
    side = lambda c: told.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def exact(text: str) -> set:
            w = words_of(text)
            return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}

        for batch in batches:
            real = []
            for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                x, y = exact(x.as_py()), exact(y.as_py())
                real.append(links(len(x & y), len(x), len(y), share))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(real, pa.bool_())], names=["a", "b", "real"])

    out = staged(links_.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, "a long, b long, real boolean"), "jaccard-links")
    discard(asked, told)
    return out


def linked(docs: DataFrame, share: int, words: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (see `profiles`), sets (set_key, rep, n, first doc_id, rows), and verified links between sets by which all
    reach each other that do by any links."""
    rows = staged(profiles(docs, words, seed), "jaccard-profiles")
    named = rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    sets = staged(named.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("rep").alias("rep"), F.count(F.lit(1)).alias("rows")), "jaccard-sets")
    new = renamed(sets)
    rows, sets = with_numbers(rows, new), with_numbers(sets, new)
    buckets = max(8, rows.count() // DOCS_PER_BUCKET)
    live = staged(live_sets(sets, messages(docs, buckets, words, seed, new), buckets, share), "jaccard-live")
    near = linked_to_centres(live, share)
    across = linked_across(live, components(near), share)
    links_ = verified(near.union(across), sets, docs, share, words, seed)
    discard(live, near, across)
    return rows, sets, links_


def join_components(docs: DataFrame, share: int = SHARE, words: int = WORDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null, empty and blank texts have no shingles and are their own component; a text with fewer than `words` words is
    one shingle. Rows that repeat a doc_id, with the same text or others, are linked through it. Rows whose doc_id is
    null are linked with nothing and have no component. An empty table gives no rows. Very long texts are read whole. Only
    doc_id and text are read, whatever other columns are called.
    """
    seed = 0
    while True:
        rows, sets, links_ = linked(docs, share, words, seed)
        if not links_.filter("NOT real").limit(1).count():
            break
        seed += 1
    named = rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    shared = named.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("b <> most").select("doc_id", "b")
    through = named.join(shared, "doc_id").select(F.col("rep").alias("a"), "b")
    final = components(links_.select("a", "b").union(through))
    by_set = staged(sets.join(final, sets["rep"] == final["id"], "left").select("set_key", "first", "rows", F.coalesce("label", "rep").alias("label")), "jaccard-labels")
    by_label = staged(by_set.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")), "jaccard-components")
    known = staged(with_group(by_set, by_label, "label", "members").select("set_key", "component_id", "rows"), "jaccard-known")
    discard(by_set, by_label)
    out = with_group(rows.withColumn("set_key", F.coalesce("set_key", F.lit(b""))), known, "set_key", "rows", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, share: int = SHARE, words: int = WORDS) -> DataFrame:
    """The rows of `docs` that are the first (smallest doc_id) of their component, with all their columns. Rows that
    repeat a doc_id are of one component: all that have its smallest doc_id stay, as they name one document; rows
    without doc_id, without words, or linked with nothing stay. An empty table gives no rows."""
    found = staged(join_components(docs, share, words).filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-dropped")
    return docs.join(found.hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

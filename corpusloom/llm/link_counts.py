"""Operator 10's other output: for each document, with how many other sets its own set links.

The join's components need a forest of links only. All links lie within components, so they are counted there: sets of a
component are dealt into classes of size, of which only neighbours can link, and classes into blocks of `BLOCK` sets;
blocks meet two at a time. Only counts come out, never pairs, and copies of a set are one set. The work is that of
comparing the sets of one component and size with each other, which no filter spares where all of them do link; it is
dealt over as many tasks as pairs of blocks, and a task holds two blocks."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import discard, staged, with_group
from corpusloom.llm.jaccard import SHARE, WORDS, join_components, profiles, set_key, shingles

BLOCK = 256
COLUMNS = 8192
BLOCKED = "set_key binary, component_id long, class long, n long, tokens binary"


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Tokens that each set of `a` shares with each of `b`: products of membership matrices, COLUMNS tokens at a time."""
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, len(both), COLUMNS):
        some = both[at : at + COLUMNS]
        left, right = (np.stack([np.isin(some, s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], "right")], assume_unique=True) for s in side]).astype(np.float32) for side in (a, b))
        out += (left @ right.T).astype(np.int64)  # whole numbers below 2 ** 24 are exact
    return out


def counted(table: pa.Table, share: int = SHARE) -> pa.Table:
    """set_key, n_links of the sets of two blocks (side 0 and 1), by links between them; of one block within it."""
    side = table["side"].to_numpy()
    same = not side.any()
    parts = [table.filter(pa.array(side == s)) for s in ((0, 0) if same else (0, 1))]
    sets = [[np.frombuffer(x.as_buffer(), "<u8") for x in p["tokens"]] for p in parts]
    n, m = (p["n"].to_numpy() for p in parts)
    shared = overlaps(*sets)
    linked = 100 * shared >= share * (n[:, None] + m[None, :] - shared)
    if same:
        np.fill_diagonal(linked, False)
        keys, degree = parts[0]["set_key"].combine_chunks(), linked.sum(1)
    else:
        keys, degree = pa.concat_arrays([p["set_key"].combine_chunks() for p in parts]), np.concatenate([linked.sum(1), linked.sum(0)])
    return pa.table({"set_key": keys, "n_links": pa.array(degree, pa.int64())})


def count_links(docs: DataFrame, share: int = SHARE, words: int = WORDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id as `join_components` has them, copies
    (rows with the same set, this one included) and n_links (other sets that its own links with). Equal texts and
    repeated rows are one set, and so link with nothing through each other. Rows without words or without doc_id have no
    copies and no links. An empty table gives no rows. Very long texts are read whole. Links are counted by 64-bit hashes
    of shingles. Only doc_id and text are read, whatever other columns are called."""
    joined = staged(join_components(docs, share, words).filter("doc_id IS NOT NULL").select("doc_id", "component_id").distinct(), "links-components")
    rows = staged(profiles(docs, words), "links-profiles")
    named = rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    sets = named.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    sets = staged(sets.join(joined, "doc_id"), "links-sets")  # a doc_id's texts are of one component
    sizes = staged(sets.groupBy("component_id").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "links-sizes")
    several = with_group(sets, sizes, "component_id", "members").withColumn("class", F.floor(F.log("n") / log(100 / share)))
    asked = staged(several.select("doc_id", F.col("set_key").alias("key"), "component_id", "class", "n"), "links-asked")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a doc_id may have other texts too
            for i, text in enumerate(batch.column("text")):
                tokens = shingles(text.as_py(), words)
                if set_key(tokens) == batch.column("key")[i].as_py():
                    own = [batch.column(c).slice(i, 1) for c in ("key", "component_id", "class", "n")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([tokens.tobytes()], pa.binary())], names=[c.split()[0] for c in BLOCKED.split(", ")])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(asked.hint("shuffle_hash"), "doc_id").select("text", "key", "component_id", "class", "n")
    whole = staged(texts.mapInArrow(told, BLOCKED).dropDuplicates(["set_key"]), "links-tokens")
    by = ["component_id", "class"]
    blocks = staged(whole.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "links-blocks")
    # which blocks meet: the earlier one's class is the other's, or the one below it
    one = blocks.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    here = one.select("component_id", F.col("class").alias("class_a"), F.col("block").alias("block_a"))
    there = one.select("component_id", F.col("class").alias("class_b"), F.col("block").alias("block_b"))
    near = F.explode(F.array(F.col("class_a"), F.col("class_a") + 1))
    meets = here.withColumn("class_b", near).join(there, ["component_id", "class_b"]).filter("class_a < class_b OR block_a <= block_b")
    meets = staged(meets.withColumn("meeting", F.xxhash64("component_id", "class_a", "block_a", "class_b", "block_b")), "links-meetings")
    dealt = whole.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
    names = ["component_id", "class_a", "block_a", "class_b", "block_b"]
    left = meets.select(*names, F.col("class_a").alias("class"), F.col("block_a").alias("block"), F.lit(0).alias("side"))
    right = meets.filter("class_a < class_b OR block_a < block_b").select(*names, F.col("class_b").alias("class"), F.col("block_b").alias("block"), F.lit(1).alias("side"))
    met = left.union(right).join(dealt, ["component_id", "class", "block"]).select(*names, "side", "set_key", "n", "tokens")
    filled = met.groupBy(*names).applyInArrow(lambda t: counted(t, share) if both_sides(t) else NOTHING, "set_key binary, n_links long")
    degree = staged(filled.groupBy("set_key").agg(F.sum("n_links").alias("n_links")), "links-degrees")
    known = staged(sets.join(degree, "set_key", "left").select("set_key", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id"), "links-known")
    discard(joined, sizes, asked, whole, blocks, meets, degree, sets)
    out = with_group(rows.withColumn("set_key", F.when(F.col("doc_id").isNotNull(), F.col("set_key"))).withColumn("set_key", F.coalesce("set_key", F.lit(b""))), known, "set_key", "copies", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


NOTHING = pa.table({"set_key": pa.array([], pa.binary()), "n_links": pa.array([], pa.int64())})


def both_sides(table: pa.Table) -> bool:
    """Whether there is anything to compare: blocks are dealt by hash, so that one of them may be empty."""
    side = set(table["side"].to_pylist())
    same = table["class_a"][0] == table["class_b"][0] and table["block_a"][0] == table["block_b"][0]
    return side == ({0} if same else {0, 1})

"""Finding and resolving duplicates, orphans and merges in content tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.graphs import kept, classes_of
from corpusloom.operators.near_sets import candidates
from corpusloom.operators.ranks import placed


def duplicate_groups(rows: DataFrame, key: str, digest: Column) -> DataFrame:
    """digest, n, ids (sorted) of digests that more than one row has."""
    grouped = rows.select(F.col(key).alias("_k"), digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("_k")).alias("ids"))
    return grouped.filter("n > 1")


def canonical_rows(rows: DataFrame, key: str, digest: str, excluded: str, preferred: Column, overrides: DataFrame | None = None) -> DataFrame:
    """One row per duplicate group: digest, n, canonical, ambiguous, overridden, blocked.

    A row that is not excluded comes first, then a preferred one, then the lowest id. A group is ambiguous if several
    rows are left before ids decide. Rows for which a null leaves that open count but are never chosen by rule. An
    override (digest, canonical_id) wins if it names a row of the group; ambiguous groups without one are blocked."""
    tier = F.col(excluded).cast("int") * 2 + (~preferred).cast("int")
    by_tier = rows.groupBy(digest, tier.alias("_tier")).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_low"))  # at most five rows a group
    groups = by_tier.groupBy(digest).agg(F.sum("_n").alias("n"), F.min(F.when(F.col("_tier").isNotNull(), F.struct("_tier", "_n", "_low"))).alias("_first")).filter("n > 1")
    groups = groups.select(digest, "n", F.col("_first._low").alias("by_rule"), F.coalesce(F.col("_first._n") > 1, F.lit(False)).alias("ambiguous"))
    if overrides is None:
        groups = groups.withColumns({"canonical_id": F.lit(None).cast("long"), "_named": F.lit(False)})
    else:
        held = rows.select(digest, F.col(key).alias("canonical_id"))
        groups = groups.join(overrides.join(held, [digest, "canonical_id"], "left_semi").withColumn("_named", F.lit(True)), digest, "left")
    hit = F.coalesce("_named", F.lit(False))
    return groups.select(digest, "n", F.when(hit, F.col("canonical_id")).otherwise(F.col("by_rule")).alias("canonical"), "ambiguous", hit.alias("overridden"), (F.col("ambiguous") & ~hit).alias("blocked"))


def exclude_duplicates(rows: DataFrame, key: str, digest: str, groups: DataFrame, reason: str) -> DataFrame:
    """`rows` with excluded and exclusion_reason brought up to date and `changed`: losers of groups that aren't blocked
    are excluded, and the reason is appended to another one that doesn't hold it. Applying it twice changes nothing."""
    joined = rows.join(groups.filter("NOT blocked").select(digest, "canonical"), digest, "left")
    loser = F.col("canonical").isNotNull() & (F.col("canonical") != F.col(key))
    old = F.col("exclusion_reason")
    new = F.when(old.isNull() | (old == ""), F.lit(reason)).when(F.contains(old, F.lit(reason)), old).otherwise(F.concat_ws("; ", old, F.lit(reason)))
    return joined.withColumns({"changed": loser & (~F.col("excluded") | ~new.eqNullSafe(old)), "exclusion_reason": F.when(loser, new).otherwise(old), "excluded": F.col("excluded") | loser}).drop("canonical")


def merged_parents(parents: DataFrame, children: DataFrame, key: str, natural: list[str], foreign: str, live: Column) -> DataFrame:
    """Old parent -> the one that is kept: of parents with the same natural key, that with most live children, ties by
    the lowest id. Only parents that change are returned."""
    counts = children.groupBy(F.col(foreign).alias(key)).agg(F.count_if(live).alias("_live"))
    ranked = parents.join(counts, key, "left").withColumn("_live", F.coalesce("_live", F.lit(0)))
    by = Window.partitionBy(*natural).orderBy(F.desc("_live"), key)
    return ranked.withColumn("kept", F.first(key).over(by)).filter(F.col("kept") != F.col(key)).select(key, "kept")


def orphans(parents: DataFrame, children: DataFrame, key: str, foreign: str) -> DataFrame:
    """Parents without children."""
    return parents.join(children.select(F.col(foreign).alias(key)), key, "left_anti")


def near_duplicate_pairs(rows: DataFrame, key: str, tokens: str, within: str, threshold: float) -> DataFrame:
    """Pairs (a < b) of the same class whose token sets reach a Jaccard similarity. Candidates share a signature
    (`near_sets`); all of them are then compared by their tokens."""
    sets = rows.select(F.col(key).alias("id"), F.col(within).alias("cls"), F.array_distinct(tokens).alias("set")).filter(F.size("set") > 0)
    return linked(kept(sets.withColumns({"n": F.size("set"), "no": F.monotonically_increasing_id()}), "sets"), threshold)


#: Sets of candidates' components that a task holds at once, at most twice over; larger components are cut into blocks.
BLOCK_SETS = 2048
#: Pairs of every so many that sets could form, from which on all are counted by matrices, of so many rows and columns at once.
DENSE, ROWS, COLUMNS = 16, 1024, 4096


def overlaps(token: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens sets a[i] and b[i] share; set s has the distinct numbers token[starts[s]:starts[s + 1]]."""
    (left, x), (right, y) = (np.unique(side, return_inverse=True) for side in (a, b))
    if len(a) * DENSE < len(left) * len(right):
        words = {s: set(token[starts[s] : starts[s + 1]].tolist()) for s in np.union1d(left, right).tolist()}
        return np.array([len(words[i] & words[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int32)

    def numbered(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and tokens of `sets`, by token."""
        many = starts[sets + 1] - starts[sets]
        at = np.arange(many.sum()) + np.repeat(starts[sets] - np.cumsum(many) + many, many)
        order = np.argsort(token[at], kind="stable")
        return np.repeat(np.arange(len(sets)), many)[order], token[at][order]

    (row_l, token_l), (row_r, token_r) = numbered(left), numbered(right)
    both = np.intersect1d(token_l, token_r)
    out = np.zeros(len(a), np.int32)
    pairs = np.argsort(x, kind="stable")
    for top in range(0, len(left), ROWS):
        here = pairs[np.searchsorted(x[pairs], top) : np.searchsorted(x[pairs], top + ROWS)]
        rows = (row_l >= top) & (row_l < top + ROWS)
        found = np.zeros((min(ROWS, len(left) - top), len(right)), np.float32)  # whole numbers below 2 ** 24 are exact
        for at in range(0, len(both), COLUMNS):
            some = both[at : at + COLUMNS]
            sides = []
            for row, held, n in ((row_l[rows] - top, token_l[rows], len(found)), (row_r, token_r, len(right))):
                i, j = np.searchsorted(held, some[0]), np.searchsorted(held, some[-1], "right")
                place = np.minimum(np.searchsorted(some, held[i:j]), len(some) - 1)
                met = some[place] == held[i:j]
                side = np.zeros((n, len(some)), np.float32)
                side[row[i:j][met], place[met]] = 1
                sides.append(side)
            found += sides[0] @ sides[1].T
        out[here] = found[x[here] - top, y[here]]
    return out


def linked(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard of stored `sets` (no: a number of its own, id, cls, set, n: its size). Sets that candidates connect are brought
    together once and compared there, so that a set does not move with each of its pairs. Small components share a home,
    as a group of rows costs a task more than comparing the few sets of one."""
    hashed = sets.select("no", "cls", "n", F.transform("set", lambda t: F.xxhash64(t)).alias("hashes"))
    pairs = kept(candidates(hashed, threshold), "candidates")
    of = kept(classes_of(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))), "components")
    homes = math.ceil(of.count() / BLOCK_SETS)
    count = F.count(F.lit(1))
    parts = of.groupBy("class_id").agg(F.ceil(count / BLOCK_SETS).cast("int").alias("parts"), (count > BLOCK_SETS / 16).alias("alone"))
    home = F.when(F.col("alone"), F.col("class_id")).otherwise(F.pmod(F.xxhash64("class_id"), F.lit(max(1, homes))))
    at = kept(of.join(parts, "class_id").select("id", "alone", home.alias("home"), "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")), "places")
    x, y = (at.select(F.col("id").alias(n), "alone", "home", F.col("part").alias(f"p{n}")) for n in ("x", "y"))
    met = pairs.join(x, "x").join(y.drop("alone", "home"), "y").select("alone", "home", F.least("px", "py").alias("i"), F.greatest("px", "py").alias("j"), "x", "y")
    other = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = sets.select("no", "id", "set").join(other.withColumnRenamed("id", "no"), "no").select(F.col("alone").alias("_alone"), F.col("home").alias("_home"), F.least("part", "other").alias("_i"), F.greatest("part", "other").alias("_j"), "no", "id", "set")

    def compare(asked: pa.Table, own: pa.Table) -> pa.Table:
        own = own if asked.num_rows else own.slice(0, 0)
        ids, no, lists = (own[c].combine_chunks() for c in ("id", "no", "set"))
        token = lists.flatten().dictionary_encode().indices.to_numpy()  # equal tokens, equal numbers
        starts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
        order = np.argsort(no.to_numpy())
        a, b = (order[np.searchsorted(no.to_numpy()[order], asked[c].to_numpy())] for c in ("x", "y"))
        shared, total = overlaps(token, starts, a, b), np.diff(starts)[a] + np.diff(starts)[b]
        return pa.table({"ix": ids.take(pa.array(a, pa.int64())), "iy": ids.take(pa.array(b, pa.int64())), "shared": pa.array(shared, pa.int32()), "total": pa.array(total, pa.int32())})

    kind = dict(sets.dtypes)["id"]
    by = ["alone", "home", "i", "j"]
    counted = met.groupBy(*by).cogroup(held.groupBy(*[f"_{c}" for c in by])).applyInArrow(compare, f"ix {kind}, iy {kind}, shared int, total int")
    scored = counted.withColumn("jaccard", F.round(F.col("shared") / (F.col("total") - F.col("shared")), 6))
    return scored.filter((F.col("jaccard") >= threshold) & (F.col("ix") != F.col("iy"))).select(F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b"), "jaccard")


def near_duplicate_classes(rows: DataFrame, key: str, tokens: str, within: str, threshold: float) -> DataFrame:
    """One row a row: key, representative (the smallest key with the same token set), copies (rows with that set),
    n_links (other token sets of the class `within` that are linked with it), class_id (smallest key that links reach).

    Equal sets are one representative, so that copies are never paired; no link between different sets is lost. Rows
    without tokens (none or null) stand for each other and are linked with nothing; a null `within` is linked with nothing."""
    own = rows.select(F.col(key).alias("id"), F.col(within).alias("cls"), F.sort_array(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>")))).alias("set"))
    own = own.withColumn("name", F.sha2(F.array_join("set", " ").cast("binary"), 256))  # tokens hold no spaces
    own = kept(own.withColumns({"n": F.size("set"), "no": F.monotonically_increasing_id()}), "named-sets")
    reps = kept(own.groupBy("cls", "name").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("no").alias("no")), "representatives")
    sets = kept(own.select("no", "cls", "set", "n").filter("n > 0").join(reps.select("no", F.col("rep").alias("id")).hint("shuffle_hash"), "no"), "token-sets")
    links = kept(linked(sets, threshold).select("a", "b"), "near-links")
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    told = reps.select("cls", "name", "rep", "copies").join(degree, "rep", "left").join(classes_of(links).withColumnRenamed("id", "rep"), "rep", "left")
    told = told.select(F.col("cls").alias("_c"), F.col("name").alias("_n"), F.col("rep").alias("representative"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id"))
    met = own.select("id", "cls", "name").join(told, F.col("cls").eqNullSafe(F.col("_c")) & (F.col("name") == F.col("_n")))
    return met.select(F.col("id").alias(key), "representative", "copies", "n_links", "class_id")


def interleaved(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds turn and place, both from 1: groups take turns, in the order in which they first appear. Both are places in a
    distributed order, so neither all rows nor those of one group meet in a task."""
    keyed = rows.withColumn("_group", F.struct(*group))
    inner = placed(keyed, ["_group", order], "_at")
    starts = inner.groupBy("_group").agg(F.min("_at").alias("_start"), F.min(order).alias("_first"))
    same = F.col("_group") == F.col("_own")
    turned = inner.join(starts.withColumnRenamed("_group", "_own"), same).withColumn("turn", F.col("_at") - F.col("_start") + 1)
    out = placed(turned.select(*rows.columns, "turn", "_first"), ["turn", "_first", order])
    return out.withColumn("place", F.col("place") + 1).drop("_first")

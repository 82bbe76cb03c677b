"""An inverted-file index of vectors: built once, stored, loaded by later searches. No query meets the whole corpus.

Cells come from a seeded k-means over a bounded sample; every vector is filed under its nearest centroid. A cell's
vectors lie in blocks of about BLOCK_ROWS as residual codes (a signed byte for each dimension of what the centroid
leaves over, with the length of the coding error), and once more as they were, for exact scores.

A search takes the cells whose centroids are nearest to a query, scores their codes, and works out exact cosines of the
best. `search_exact` goes on where that may have missed something: no member of a cell is nearer than the query's angle to
the centroid less the cell's widest angle allows, and no vector than its code's score and error do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import lexical_index, retrieval

#: Cells are about the root of the number of vectors, at most so many: their centroids are sent to all tasks.
MAX_CELLS = 4096
#: Rows of the sample for each cell; the sample alone reaches the driver.
SAMPLE_PER_CELL = 64
ROUNDS = 12
BLOCK_ROWS = 4096
#: Queries that meet a block together.
PACK = 256
#: Share of a query's neighbours whose cells a search shall take, and vectors of the sample on which it is measured.
RECALL = 0.95
ASKED = 256
#: Candidates by code, for each result asked for, whose exact score is worked out.
RESCORED = 8
#: What exact scores, rounded to six places, may differ from those of 32-bit floats.
SLACK = 4e-6


@dataclass(frozen=True)
class VectorIndex:
    """cells: cell, centroid, n, min_cos, probes (cells that a search takes, as measured at the build). codes: cell, block, keys, codes, scales, errors. vectors: cell, key, vector."""

    key: str
    cells: DataFrame
    codes: DataFrame
    vectors: DataFrame


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Vectors of length one; zeros stay zeros."""
    dims = len(lists[0]) if len(lists) else 0
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(lists), dims)
    n = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(n == 0, 1, n)


def centroids_of(sample: np.ndarray, cells: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: centroids of length one. A centroid that is left without members takes the row that is worst
    served."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        best, served = np.zeros(len(sample), np.int64), np.zeros(len(sample))
        for at in range(0, len(sample), BLOCK_ROWS):
            sims = sample[at : at + BLOCK_ROWS] @ centres.T
            best[at : at + BLOCK_ROWS], served[at : at + BLOCK_ROWS] = sims.argmax(1), sims.max(1)
        order = np.argsort(best, kind="stable")
        held, starts = np.unique(best[order], return_index=True)
        sums = np.zeros_like(centres)
        sums[held] = np.add.reduceat(sample[order], starts, axis=0)
        empty = np.setdiff1d(np.arange(len(centres)), held)
        sums[empty] = sample[np.argsort(served, kind="stable")[: len(empty)]]
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(n == 0, centres, sums / np.where(n == 0, 1, n))
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, seed: int, recall: float = RECALL, k: int = 10) -> int:
    """How many of its nearest cells a query has to look into to meet `recall` of its k nearest: measured with rows of
    the sample as queries, against the sample. The corpus is denser, so its nearest are nearer, and this errs upwards."""
    asked = np.random.default_rng(seed).choice(len(sample), min(ASKED, len(sample)), replace=False)
    sims = sample[asked] @ sample.T
    sims[np.arange(len(asked)), asked] = -2  # not itself
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    own = np.concatenate([(sample[i : i + BLOCK_ROWS] @ centres.T).argmax(1) for i in range(0, len(sample), BLOCK_ROWS)])
    place = np.argsort(np.argsort(-(sample[asked] @ centres.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], 1), recall, method="higher")) + 1


def filed(rows: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """`rows` (key, vector) with the cell of the nearest centroid."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # MAX_CELLS rows at most
    kinds = dict(rows.dtypes)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = (unit_rows(batch.column(1)) @ sent.value.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], names=[key, vector, "cell"])

    return rows.select(key, vector).mapInArrow(file, f"`{key}` {kinds[key]}, `{vector}` {kinds[vector]}, cell int")


def coded(filed_rows: DataFrame, key: str, centres: np.ndarray) -> DataFrame:
    """One row a block: keys, codes (n x dims signed bytes), scales and errors (n 32-bit floats), n, and the least cosine
    of a member with its centroid. Blocks are as many as a cell's size asks for, so a hot cell is many tasks' work."""
    sent = filed_rows.sparkSession.sparkContext.broadcast(centres)
    kind = dict(filed_rows.dtypes)[key]
    sizes = filed_rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    block = F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / BLOCK_ROWS))

    def code(group: pa.Table) -> pa.Table:
        group = group.sort_by(key).combine_chunks()  # so that equal scores are taken in the order of keys
        x, cell = unit_rows(group["vector"].chunk(0)), group["cell"][0].as_py()
        rest = x - sent.value[cell]
        scale = (np.abs(rest).max(1) / 127).astype("<f4").astype(np.float64)
        codes = np.rint(rest / np.where(scale == 0, 1, scale)[:, None]).astype(np.int8)
        error = np.linalg.norm(rest - codes * scale[:, None], axis=1)
        keys = pa.ListArray.from_arrays([0, len(x)], group[key].chunk(0))
        row = [pa.array([cell], pa.int32()), pa.array([group["block"][0].as_py()], pa.int64()), keys, *(pa.array([b], pa.binary()) for b in (codes.tobytes(), scale.astype("<f4").tobytes(), np.nextafter(error.astype("<f4"), np.float32(9)).tobytes()))]
        return pa.table([*row, pa.array([len(x)], pa.int64()), pa.array([float((x @ sent.value[cell]).min())])], names=["cell", "block", "keys", "codes", "scales", "errors", "n", "min_cos"])

    rows = filed_rows.join(F.broadcast(sizes), "cell").select(key, "vector", "cell", block.alias("block"))  # one row a cell
    return rows.groupBy("cell", "block").applyInArrow(code, f"cell int, block long, keys array<{kind}>, codes binary, scales binary, errors binary, n long, min_cos double")


def stored(rows: DataFrame, key: str, vector: str, folder: str, cells: int | None = None, seed: int = 1) -> VectorIndex:
    """The index of `rows` (key, vector), loaded if `folder` holds it, else built there first.

    Rows without a key or vector are not filed. All vectors have the same number of dimensions; one of zeros is filed and
    scores 0. Keys are taken to be unique: rows that repeat one are found each. An empty table gives an empty index. The
    table of cells is written last: where it is complete, so is the index. The sample for the cells is chosen by a hash of
    the key, about SAMPLE_PER_CELL rows a cell; every row is filed."""
    spark = rows.sparkSession
    rows = rows.select(key, vector).filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    at = f"{folder}/vectors-{lexical_index.fingerprint(rows, key, vector, f'ivf {cells} {seed}')}"
    if not lexical_index.complete(spark, f"{at}/cells"):
        build(rows, key, vector, at, cells, seed)
    return loaded(spark, key, at)


def build(rows: DataFrame, key: str, vector: str, at: str, cells: int | None, seed: int) -> None:
    spark, n = rows.sparkSession, rows.count()
    cells = cells or max(1, min(MAX_CELLS, math.isqrt(n)))
    share = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_PER_CELL * cells / max(1, n)))
    found = rows.filter(share).select(key, vector).orderBy(key).toArrow()[vector].combine_chunks()
    if not len(found):  # so few rows that the hash chose none
        found = rows.select(key, vector).orderBy(key).limit(cells).toArrow()[vector].combine_chunks()
    sample = unit_rows(found)
    centres = centroids_of(sample, cells, seed) if len(found) else np.zeros((0, 0))
    probes = probes_for(sample, centres, seed) if len(found) else 1
    filed(rows.withColumnRenamed(vector, "vector"), key, "vector", centres).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{at}/vectors")
    schema = f"`{key}` {dict(rows.dtypes)[key]}, vector {dict(rows.dtypes)[vector]}, cell int"
    coded(spark.read.schema(schema).parquet(f"{at}/vectors"), key, centres).write.mode("overwrite").partitionBy("cell").parquet(f"{at}/codes")
    codes = spark.read.schema("n long, min_cos double, cell int").parquet(f"{at}/codes")
    lines = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>")
    summed = codes.groupBy("cell").agg(F.sum("n").alias("n"), F.min("min_cos").alias("min_cos"))
    lines.join(summed, "cell").withColumns({"probes": F.lit(probes), "kind": F.lit(schema)}).write.mode("overwrite").parquet(f"{at}/cells")


def loaded(spark: SparkSession, key: str, at: str) -> VectorIndex:
    cells = spark.read.schema("cell int, centroid array<double>, n long, min_cos double, probes int, kind string").parquet(f"{at}/cells")
    first = cells.select("kind").first()
    schema = first[0] if first else f"`{key}` long, vector array<float>, cell int"
    kind = schema.split("`")[2].split(",")[0].strip()
    codes = spark.read.schema(f"block long, keys array<{kind}>, codes binary, scales binary, errors binary, n long, min_cos double, cell int").parquet(f"{at}/codes")
    return VectorIndex(key, cells.drop("kind"), codes, spark.read.schema(schema).parquet(f"{at}/vectors"))


class _Cells:
    """Centroids and reaches of all cells, in the order of their numbers."""

    def __init__(self, index: VectorIndex):
        rows = sorted(index.cells.collect(), key=lambda r: r.cell)  # MAX_CELLS at most
        self.ids = np.array([r.cell for r in rows], np.int32)
        self.centres = np.array([r.centroid for r in rows])
        self.reach = np.arccos(np.clip([r.min_cos for r in rows], -1, 1))
        self.probes = max([r.probes for r in rows], default=1)
        self.place = {int(c): i for i, c in enumerate(self.ids)}


def probed(queries: DataFrame, query: str, vector: str, cells, probes: int, floor: str | None = None) -> DataFrame:
    """query, qv (64-bit floats of length one), cell: the `probes` nearest cells of each query; with `floor`, a column of
    the least score that counts, those behind them that may hold one as good."""
    kind = dict(queries.dtypes)[query]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cells.value
        for batch in batches:
            if not batch.num_rows or not len(own.ids):
                continue
            q = unit_rows(batch.column(1))
            sims = q @ own.centres.T
            order = np.argsort(-sims, axis=1, kind="stable")
            if floor is None:
                row, place = np.repeat(np.arange(len(q)), min(probes, len(own.ids))), order[:, :probes].ravel()
            else:
                bound = np.cos(np.maximum(0, np.arccos(np.clip(sims, -1, 1)) - own.reach))
                later = np.take_along_axis(bound, order, 1)[:, probes:] >= batch.column(2).to_numpy(zero_copy_only=False)[:, None] - SLACK
                row, at = np.nonzero(later)
                place = order[row, at + probes]
            sent = pa.array([v.tobytes() for v in q], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), sent, pa.array(own.ids[place])], names=[query, "qv", "cell"])

    columns = [query, vector] + ([floor] if floor else [])
    return queries.select(*columns).mapInArrow(probe, f"`{query}` {kind}, qv binary, cell int")


def candidates(index: VectorIndex, asked: DataFrame, query: str, cells, keep: int, sure: bool) -> DataFrame:
    """query, cell, key, score, error: of each block that a query asks, its `keep` best by code; if `sure`, all that may
    be among them. Queries of a cell meet its blocks in packs."""
    kinds, key, kind = dict(asked.dtypes), index.key, dict(index.vectors.dtypes)[index.key]
    packs = F.pmod(F.xxhash64(query), F.lit(max(1, math.ceil(asked.select(query).distinct().count() / PACK))))
    packed = asked.groupBy("cell", packs.alias("pack")).agg(F.collect_list(F.struct(query, "qv")).alias("asked"))
    packed = packed.select("cell", F.col(f"asked.{query}").alias("queries"), F.col("asked.qv").alias("qvs"))
    met = index.codes.select("cell", "keys", "codes", "scales", "errors").join(packed, "cell")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cells.value
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                cell, keys, asked_ids = c["cell"][i].as_py(), c["keys"][i].values, c["queries"][i].values
                q = np.frombuffer(b"".join(v.as_py() for v in c["qvs"][i].values)).reshape(len(asked_ids), -1)
                codes = np.frombuffer(c["codes"][i].as_py(), np.int8).reshape(len(keys), -1)
                scales, errors = (np.frombuffer(c[x][i].as_py(), "<f4").astype(np.float64) for x in ("scales", "errors"))
                scores = (q @ own.centres[own.place[cell]])[:, None] + (q @ codes.T.astype(np.float64)) * scales
                if len(keys) <= keep:
                    row, at = np.divmod(np.arange(scores.size), len(keys))
                elif sure:
                    least = np.partition(scores - errors, len(keys) - keep, axis=1)[:, len(keys) - keep]
                    row, at = np.nonzero(scores + errors >= least[:, None] - SLACK)
                else:
                    at = np.argsort(-scores, axis=1, kind="stable")[:, :keep].ravel()
                    row = np.repeat(np.arange(len(q)), keep)
                names = [query, "cell", key, "score", "error"]
                yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(row)), pa.array(np.full(len(row), cell, np.int32)), keys.take(pa.array(at)), pa.array(scores[row, at]), pa.array(errors[at])], names=names)

    return met.mapInArrow(score, f"`{query}` {kinds[query]}, cell int, `{key}` {kind}, score double, error double")


def rescored(index: VectorIndex, found: DataFrame, queries: DataFrame, query: str, vector: str, k: int) -> DataFrame:
    """query, key, score (exact cosine, rounded to 6), rank: the k best of the candidates, ties by key."""
    held = found.select(query, "cell", index.key).join(index.vectors, ["cell", index.key]).join(queries.select(query, F.col(vector).alias("_qv")), query)
    return retrieval.top_k(held.select(query, index.key, F.round(V.cosine(F.col("_qv"), F.col("vector")), 6).alias("score")), query, index.key, k)


def sent(index: VectorIndex, queries: DataFrame, vector: str, probes: int | None) -> tuple:
    """The cells as a broadcast, the number of probes, and the queries that have a vector."""
    cells = _Cells(index)
    return queries.sparkSession.sparkContext.broadcast(cells), probes or cells.probes, queries.filter(F.col(vector).isNotNull())


def search(index: VectorIndex, queries: DataFrame, query: str, vector: str, k: int, probes: int | None = None, more: int = RESCORED) -> DataFrame:
    """query, key, score, rank: about the k best of each query, from its `probes` nearest cells (as many as the build
    found to be needed) and the `more` x k best by code there; scores are exact. Queries have a name of their own each;
    those without a vector get no rows."""
    cells, probes, queries = sent(index, queries, vector, probes)
    found = candidates(index, probed(queries, query, vector, cells, probes), query, cells, more * k, sure=False)
    by = Window.partitionBy(query).orderBy(F.desc("score"), index.key)
    return rescored(index, found.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= more * k), queries, query, vector, k)


def search_exact(index: VectorIndex, queries: DataFrame, query: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
    """query, key, score, rank: exactly the k best of each query, ties by key, as by comparing it with every vector.

    The nearest cells give a score that the k-th best reaches at least; then all cells and vectors that may reach it are
    looked at. Where vectors have no structure that may be most of them."""
    cells, probes, queries = sent(index, queries, vector, probes)
    near = candidates(index, probed(queries, query, vector, cells, probes), query, cells, k, sure=True)
    least = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.col("score") - F.col("error"))))
    floor = near.withColumn("_r", least).filter(F.col("_r") == k).select(query, (F.col("score") - F.col("error")).alias("_floor"))
    floored = queries.select(query, vector).join(floor, query, "left").withColumn("_floor", F.coalesce("_floor", F.lit(-2.0)))
    far = candidates(index, probed(floored, query, vector, cells, probes, "_floor"), query, cells, k, sure=True)
    both = near.unionByName(far).join(floored.select(query, "_floor"), query).filter(F.col("score") + F.col("error") >= F.col("_floor") - SLACK)
    return rescored(index, both, queries, query, vector, k)

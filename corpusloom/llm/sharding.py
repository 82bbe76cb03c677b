"""Operator 4: longest-processing-time sharding of documents whose equal texts stay together.

Groups of equal texts go, largest first, to the least-loaded shard through a heap. Groups of equal size are a class: it
makes no difference which of them goes where, only how many go to each shard. So the heap runs over classes on the
driver, which gets one row a distinct group size and never one a group. (Distinct sizes add up to at most all bytes, so
there are fewer than the root of twice the bytes of the corpus.) Large classes are dealt out in one step, with the same
counts as one group after the other. Groups then learn their shard from their rank among the groups of their size.

Group sizes are summed where the documents are before they move, only digests and sizes are shuffled, and ranks and
slots are numbered by two-level counts instead of one window for each size or shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import discard, staged, text_or_empty, with_group

SHARDS = 24
ROWS_PER_STRIP = 20_000
#: Classes of more groups than this are dealt out in one step.
ONE_BY_ONE = 64


def dealt(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size go to each shard, if each goes to the least-loaded (ties: the lowest
    number). A shard's next group comes at its load, the one after at its load plus the size and so on: the `count`
    smallest of all these."""
    load = np.array(loads, np.int64)
    lo, hi = int(load.min()), int(load.max()) + size * (count // len(loads) + 1)
    below = lambda t: np.maximum(0, -((load - t) // size))  # noqa: E731  places under t
    while lo < hi:  # the largest t with no more than `count` places under it
        t = (lo + hi + 1) // 2
        if int(below(t).sum()) <= count:
            lo = t
        else:
            hi = t - 1
    out = below(lo)
    left = count - int(out.sum())
    at = np.flatnonzero(load + out * size == lo)[:left]
    out[at] += 1
    return out.tolist()


def lpt(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """classes: size and number of groups. Returns size, shards and how many of the groups go to each, largest first."""
    heap, out = [(0, s) for s in range(shards)], []
    for size, count in sorted(classes, reverse=True):
        given: dict[int, int] = {}
        if count > ONE_BY_ONE:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            given = {s: n for s, n in enumerate(dealt(loads, size, count)) if n}
            heap = [(load + size * given.get(s, 0), s) for load, s in heap]
            heapq.heapify(heap)
        else:
            for _ in range(count):
                load, s = heap[0]
                given[s] = given.get(s, 0) + 1
                heapq.heapreplace(heap, (load + size, s))
        out.append((size, list(given), list(given.values())))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, digest. A null text has no bytes, the CRC of no bytes (0) and
    a group of its own, apart from the empty text's."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("digest"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, rows_per_strip: int = ROWS_PER_STRIP) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are left alone): doc_id, size, text_crc32, law, shard,
    slot, grown_shard.

    An empty table gives no rows. Repeated rows are rows of their own in the same group. Null and empty texts: see
    `measured`. A group as large as a third of the table fills its shard alone; that is the price of never cutting it. Rows
    without doc_id are placed with the group of their text. Groups of one size are ties, told apart
    by their digests.
    """
    rows = staged(measured(docs), "lpt-rows")
    groups = staged(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "lpt-groups")
    placed_groups = staged(with_shards(groups, shards, rows_per_strip), "lpt-shards")
    placed = staged(with_group(rows, placed_groups, "digest", "rows").select("doc_id", "size", "text_crc32", "shard"), "lpt-placed")
    discard(rows, groups, placed_groups)
    return numbered(placed, "shard", ["doc_id", "text_crc32"], "slot", rows_per_strip).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def with_shards(groups: DataFrame, shards: int, rows_per_strip: int = ROWS_PER_STRIP) -> DataFrame:
    """digest, rows, shard: by each group's rank among the groups of its size."""
    spark = groups.sparkSession
    told = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()
    classes = list(zip(told.column("bytes").to_pylist(), told.column("n").to_pylist(), strict=True))
    plan = lpt(classes, shards)
    upto = [np.cumsum(n).tolist() for _, _, n in plan]
    table = pa.table({"bytes": pa.array([p[0] for p in plan], pa.int64()), "to": pa.array([p[1] for p in plan], pa.list_(pa.int32())), "upto": pa.array(upto, pa.list_(pa.int64())), "n": pa.array([sum(p[2]) for p in plan], pa.int64())})
    ranked = numbered(groups, "bytes", ["digest"], "rank", rows_per_strip)
    known = with_group(ranked.select("digest", "rows", "bytes", "rank"), spark.createDataFrame(table), "bytes", "n")
    return known.select("digest", "rows", F.element_at("to", F.size(F.filter("upto", lambda u: u <= F.col("rank"))) + 1).alias("shard"))


def numbered(rows: DataFrame, key: str, order: list[str], name: str, rows_per_strip: int = ROWS_PER_STRIP) -> DataFrame:
    """Adds `name`, gapless from 0 for each value of `key`: rows are numbered within strips of a key, and strips are
    offset by the counts of those before them, so that no task ever holds all rows of a key. `rows` is read twice."""
    largest = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    strips = max(1, -(-largest // rows_per_strip))
    cut = rows.withColumn("strip", F.pmod(F.xxhash64(*order), F.lit(strips)).cast("int"))
    before = Window.partitionBy(key).orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(key, "strip").count().select(F.struct(key, "strip").alias("place"), F.col("count").alias("held"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(key, "strip").orderBy(*order)
    own = cut.withColumn("inside", F.row_number().over(inside)).withColumn("place", F.struct(key, "strip")).drop("strip")
    return own.join(starts, "place").withColumn(name, (F.col("start") + F.col("inside") - 1).cast("long")).drop("place", "inside", "start", "held")

"""What a cache of the least recently used would have held: hits and misses of a long log of requests, worked on by many
tasks.

A cache's content is the last `capacity` distinct keys, so what a stretch of the log does to any cache is told by the last
distinct keys of the stretch alone, and two stretches are told by what remains of both. The log is cut into stretches;
their tellings are combined over spans of stretches, spans of spans and so on, which gives each stretch the content it
begins with; then all stretches are gone through side by side.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranks import placed
from corpusloom.streaming.sinks import shared_dir

CAPACITY = 512
#: Requests of a stretch, and stretches of a span.
STRETCH = 100_000
SPAN = 256
TOLD = "no long, keys array<string>"


def touched(held: OrderedDict, keys: list, capacity: int) -> list[bool]:
    """Goes through requests; says which were hits. A null key is never held."""
    hits = []
    for key in keys:
        if key is None:
            hits.append(False)
            continue
        hit = key in held
        hits.append(hit)
        if hit:
            held.move_to_end(key)
        else:
            held[key] = None
            if len(held) > capacity:
                held.popitem(last=False)
    return hits


def _told(no: int, held: OrderedDict) -> pa.Table:
    return pa.table({"no": pa.array([no], pa.int64()), "keys": pa.array([list(held)], pa.list_(pa.string()))})


def contents_before(told: DataFrame, n: int, capacity: int, span: int) -> DataFrame:
    """no, keys: the content that each of `n` stretches begins with; `told` holds each one's last distinct keys, oldest
    first. A task sees at most `span` of them."""
    grouped = told.withColumn("span", F.floor(F.col("no") / span).cast("long"))

    def combine(rows: pa.Table) -> pa.Table:
        held: OrderedDict = OrderedDict()
        for keys in rows.sort_by("no")["keys"].to_pylist():
            touched(held, keys, capacity)
        return _told(rows["span"][0].as_py(), held)

    def spread(rows: pa.Table, begin: pa.Table) -> pa.Table:
        held: OrderedDict = OrderedDict()
        for keys in begin["keys"].to_pylist():
            touched(held, keys, capacity)
        rows = rows.sort_by("no")
        out = []
        for keys in rows["keys"].to_pylist():
            out.append(list(held))
            touched(held, keys, capacity)
        return pa.table({"no": rows["no"], "keys": pa.array(out, pa.list_(pa.string()))})

    if n <= 1:
        return told.select("no", F.array().cast("array<string>").alias("keys"))
    above = grouped.groupBy("span").applyInArrow(combine, TOLD)
    begin = contents_before(above, -(-n // span), capacity, span).withColumnRenamed("no", "span")
    return grouped.groupBy("span").cogroup(begin.groupBy("span")).applyInArrow(spread, TOLD)


def least_recently_used(requests: DataFrame, order: list[str], key: str | Column, capacity: int = CAPACITY, stretch: int = STRETCH, span: int = SPAN) -> DataFrame:
    """`order` and hit: whether each request of the log, in the order of the columns `order`, finds its key (a string) in
    a cache of `capacity` keys that drops the least recently used one, and is empty at first.

    A null key is a miss and is not held. Requests that `order` does not tell apart come in any order. An empty log has
    no rows."""
    spark = requests.sparkSession
    log = placed(requests.select(*order, (F.col(key) if isinstance(key, str) else key).cast("string").alias("_key")), order, "_place").withColumn("no", F.floor(F.col("_place") / stretch).cast("long"))
    n = (log.agg(F.max("no")).first()[0] or 0) + 1

    def tell(rows: pa.Table) -> pa.Table:
        held: OrderedDict = OrderedDict()
        touched(held, rows.sort_by("_place")["_key"].to_pylist(), capacity)
        return _told(rows["no"][0].as_py(), held)

    def go_through(rows: pa.Table, begin: pa.Table) -> pa.Table:
        held: OrderedDict = OrderedDict()
        for keys in begin["keys"].to_pylist():
            touched(held, keys, capacity)
        rows = rows.sort_by("_place")
        return rows.select(order).append_column("hit", pa.array(touched(held, rows["_key"].to_pylist(), capacity)))

    at = f"{shared_dir(spark)}/lru-{uuid.uuid4().hex}"  # each telling is read on two ways
    log.groupBy("no").applyInArrow(tell, TOLD).write.parquet(at)
    begin = contents_before(spark.read.schema(TOLD).parquet(at), n, capacity, span)
    kinds = dict(requests.dtypes)
    return log.groupBy("no").cogroup(begin.groupBy("no")).applyInArrow(go_through, ", ".join(f"`{c}` {kinds[c]}" for c in order) + ", hit boolean")

"""Which of very many patterns stand in a text, without comparing every text with every pattern: each text is read once
for each few million characters of patterns, by an Aho-Corasick automaton, in Arrow batches.

Patterns are sent to the tasks in shards of about SHARD_CHARS characters (an automaton takes some fifty bytes for each),
so what a task holds does not grow with the number of patterns; further shards are further passes over the texts, side
by side in one plan. Texts are not shuffled.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_CHARS = 4_000_000
_BUILT: dict = {}


def automaton(name: str, patterns: list[str], values: list) -> ahocorasick.Automaton:
    """One per worker, and the last one only."""
    if name not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for pattern, value in zip(patterns, values, strict=True):
            built.add_word(pattern, value)
        built.make_automaton()
        _BUILT[name] = built
    return _BUILT[name]


def _scanned(texts: DataFrame, key: str, text: str, shard: DataFrame, kind: str, value: str, least: bool) -> DataFrame:
    """key, value: of each text the values of the shard's patterns that stand in it, or the least one alone."""
    held = shard.toArrow()  # about SHARD_CHARS characters
    sent = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, held.column(0).to_pylist(), held.column(1).to_pylist()))
    type_ = held.schema.field(1).type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(*sent.value) if sent.value[1] else None
        for batch in batches:
            row, found = [], []
            for i, cell in enumerate(batch.column(1) if own else ()):
                if cell.is_valid and (met := {v for _, v in own.iter(cell.as_py())}):
                    met = [min(met)] if least else sorted(met)
                    found += met
                    row += [i] * len(met)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(found, type_)], names=[key, value])

    return texts.select(key, text).mapInArrow(scan, f"`{key}` {dict(texts.dtypes)[key]}, `{value}` {kind}")


def contained(texts: DataFrame, key: str, text: str, patterns: DataFrame, name: str, pattern: str, least: bool = False) -> DataFrame:
    """key, name: for each row of `texts` (key, text) the names of `patterns` (name, pattern) that stand in its text, once
    each; with `least` only the smallest name (of all rows of a key), and null for a row whose key has none.

    Null texts and null or empty patterns stand nowhere. Several names may share a pattern and several patterns a name. A
    null name is a name, but never the smallest. Rows without a key have no least. No patterns give no names."""
    real = patterns.filter(F.length(pattern) > 0).select(F.col(name).alias("_name"), F.col(pattern).alias("_pattern"))
    told = real.filter("_name IS NOT NULL").groupBy("_pattern").agg(F.min("_name").alias("_name")) if least else real.select("_pattern").distinct().withColumn("_name", F.col("_pattern"))
    shards = max(1, math.ceil((told.agg(F.sum(F.length("_pattern"))).first()[0] or 0) / SHARD_CHARS))
    kind = dict(told.dtypes)["_name"]
    out = None
    for shard in range(shards):
        own = told.filter(F.pmod(F.xxhash64("_pattern"), F.lit(shards)) == shard) if shards > 1 else told
        one = _scanned(texts, key, text, own, kind, "_name", least)
        out = one if out is None else out.unionByName(one)
    if least:
        best = out.groupBy(key).agg(F.min("_name").alias(name))
        return texts.select(key).join(best, key, "left")
    return out.withColumnRenamed("_name", "_pattern").join(real.distinct(), "_pattern").select(key, F.col("_name").alias(name)).distinct()

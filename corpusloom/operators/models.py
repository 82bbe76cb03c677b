"""Model calls as column functions with deterministic stand-ins; a deployment swaps the function, not the plan."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from corpusloom.functions import language as L
from corpusloom.functions import text as T
from corpusloom.streaming.sinks import shared_dir

DIMS = 64


@F.pandas_udf(ArrayType(FloatType()))
def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Hashed character trigrams, of length one. The iterator form is where a model would be loaded once per worker."""
    for texts in batches:
        out = []
        for text in texts:
            raw = (text or "").lower().encode()
            v = np.zeros(DIMS, np.float32)
            if len(raw) >= 3:
                a = np.frombuffer(raw, np.uint8).astype(np.int64)
                v += np.bincount((a[:-2] * 7919 + a[1:-1] * 104729 + a[2:] * 1299709) % DIMS, minlength=DIMS)
            out.append(v / (np.linalg.norm(v) or 1))
        yield pd.Series(out)


@F.pandas_udf(StringType())
def complete(prompts: pd.Series) -> pd.Series:
    """An extractive stand-in: the first sentence and a checksum of the prompt."""
    return prompts.map(lambda p: None if p is None else f"{p.split('.')[0][:120]} #{zlib.crc32(p.encode()) & 0xFFFF}")


def called(asked: DataFrame, prompt: str, reply: str, rewrite: Callable[[Column, int], Column], attempt: int) -> DataFrame:
    """`asked` with a reply for each prompt. Equal prompts are one call, and rows without a prompt none. Replies are
    written to a table of the shared folder first, so that no later step, second use or lost executor calls again."""
    spark = asked.sparkSession
    prompts = asked.filter(F.col(prompt).isNotNull()).select(F.col(prompt).alias("_prompt")).distinct()
    at = f"{shared_dir(spark)}/replies-{uuid.uuid4().hex}"
    prompts.select("_prompt", rewrite(F.col("_prompt"), attempt).alias(reply)).write.parquet(at)
    replies = spark.read.schema(f"_prompt string, `{reply}` string").parquet(at)
    return asked.join(replies, F.col(prompt) == F.col("_prompt"), "left").drop("_prompt")


def expand_query(queries: DataFrame, query: str, primed: str | None = None, rewrite: Callable[[Column, int], Column] = lambda q, attempt: complete(q)) -> DataFrame:
    """`queries` with variants (array) and fallback: none for an empty query; the query itself where all its letters are
    Bengali; else a primed rewrite, or the first of two tries, that is at least 80 % Bengali; else the query, as a
    fallback. A null reply is a call that failed and ends the tries.

    The model is called once for each distinct query that needs it, and a second time only for those whose first reply
    was not good. Columns of `queries` whose names are used here (_q, _first, ...) are not allowed."""
    good = lambda c: F.col(c).isNotNull() & (F.col(c) != "") & L.bengali_output(F.col(c))
    q = T.normalise(F.coalesce(F.col(query), F.lit("")))
    rows = queries.withColumn("_q", q).withColumn("_primed", T.normalise(F.col(primed)) if primed else F.lit(None).cast("string"))
    settled = (F.col("_q") == "") | F.coalesce(L.share_of(F.col("_q"), L.BENGALI_LETTER) == 1, F.lit(False))
    rows = rows.withColumn("_own", settled).withColumn("_ask", F.when(~settled & ~F.coalesce(good("_primed"), F.lit(False)), F.col("_q")))
    rows = called(rows, "_ask", "_first", rewrite, 0).withColumn("_first", T.normalise(F.col("_first")))
    rows = rows.withColumn("_again", F.when(F.col("_first").isNotNull() & ~good("_first"), F.col("_ask")))
    rows = called(rows, "_again", "_second", rewrite, 1).withColumn("_second", T.normalise(F.col("_second")))
    best = F.when(F.col("_own"), F.col("_q")).when(F.col("_ask").isNull(), F.col("_primed")).when(good("_first"), F.col("_first")).when(good("_second"), F.col("_second"))
    variants = F.when(F.col("_q") == "", F.array().cast("array<string>")).otherwise(F.array(F.coalesce(best, F.col("_q"))))
    return rows.select(*[F.col(f"`{c}`") for c in queries.columns], variants.alias("variants"), best.isNull().alias("fallback"))


def cleanest(candidates: DataFrame, key: str, bad: str, order: str) -> DataFrame:
    """Of the answers made for a request, the first with the fewest bad tokens."""
    by = Window.partitionBy(key).orderBy(bad, order)
    return candidates.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def map_reduce_notes(pages: DataFrame, key: str, part: str, text: str, call=complete) -> DataFrame:
    """A note for each part, then one for each key from its parts' notes in order."""
    mapped = pages.select(key, part, call(text).alias("note"))
    ordered = F.array_sort(F.collect_list(F.struct(part, "note")))
    return mapped.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["note"]), "\n").alias("notes")).select(key, call("notes").alias("note"))


def first_valid(attempts: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """The first attempt that passes; keys none of whose attempts do are left out."""
    by = Window.partitionBy(key).orderBy(order)
    return attempts.filter(ok).withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")

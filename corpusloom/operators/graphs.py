"""Classes of linked rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.streaming.sinks import shared_dir


def kept(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read again, so that a round is never worked out twice."""
    at = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def classes_of(links: DataFrame) -> DataFrame:
    """id, class_id (the smallest id that links reach) of every id on a link (a, b).

    Each round an id takes the smallest class among its own and its neighbours', and then that class's own class, so that
    the rounds are about the logarithm of the longest way. Minima are formed before rows move."""
    both = kept(links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a")).filter("id <> other").distinct(), "links")
    known = kept(both.groupBy("id").agg(F.least("id", F.min("other")).alias("class_id")), "classes")
    while True:
        near = both.join(known, "id").groupBy(F.col("other").alias("id")).agg(F.min("class_id").alias("near"))
        lower = known.join(near, "id").select("id", "class_id", F.least("class_id", "near").alias("_low"))
        up = known.select(F.col("id").alias("_low"), F.col("class_id").alias("_up"))
        after = kept(lower.join(up, "_low").select("id", F.col("class_id").alias("_was"), F.least("_low", "_up").alias("class_id")), "classes")
        if not after.filter("class_id < _was").limit(1).count():
            return after.select("id", "class_id")
        known = after.select("id", "class_id")

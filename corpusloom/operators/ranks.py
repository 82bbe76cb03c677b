"""Places in a global order and exact order statistics, without a task that sees all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.streaming.sinks import shared_dir


def placed(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """`rows` with their place from 0 in `order`, as a table of the shared folder. Rows are sorted by ranges of the order
    and numbered within them; all that is known of a range elsewhere is how many rows it has. Of rows that `order` does
    not tell apart any may come first."""
    held, offsets = _ranged(rows, order, F.lit(1))
    return held.join(offsets, "_part").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_within")).alias(name))


def _ranged(rows: DataFrame, order: list[Column | str], weight: Column) -> tuple[DataFrame, DataFrame]:
    """`rows` as a table sorted by ranges (_part) and numbered within them (_within), and one row a range with the weight
    of all rows before it, as a broadcast."""
    spark, at = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/ranged-{uuid.uuid4().hex}"
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), within.alias("_within"))
    ranged.write.parquet(at)
    held = spark.read.schema(ranged.schema).parquet(at)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    return held, F.broadcast(held.groupBy("_part").agg(F.sum(weight).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before")))


def selected(rows: DataFrame, group: str, value: str, index: Column) -> DataFrame:
    """group, `value`: of each group the value at place `index` (from 0; an expression over `n`, the number of its values)
    of its values in order, exactly. Nulls and NaN are no values; a group without one is left out.

    Equal values are counted before they move, and the counts are summed over ranges of (group, value), so a group or a
    value that most rows share is no single task's."""
    real = rows.select(group, value).filter(F.col(value).isNotNull() & ~F.isnan(value))
    held, offsets = _ranged(real.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c")), [group, value], F.col("_c"))
    inner = Window.partitionBy("_part").orderBy("_within").rowsBetween(Window.unboundedPreceding, -1)  # a range a task
    summed = held.withColumn("_in", F.coalesce(F.sum("_c").over(inner), F.lit(0))).join(offsets, "_part").withColumn("_first", F.col("_before") + F.col("_in"))
    groups = summed.groupBy(F.col(group).alias("_g")).agg(F.min("_first").alias("_start"), F.sum("_c").alias("n"))
    sought = F.col("_start") + index
    return summed.join(groups, F.col(group).eqNullSafe(F.col("_g"))).filter((F.col("_first") <= sought) & (sought < F.col("_first") + F.col("_c"))).select(group, value)

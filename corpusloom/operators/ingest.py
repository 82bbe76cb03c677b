"""Incremental ingest and keyed mutation. Every function returns the table as it is afterwards; writing is apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_due(has_exclusion: bool = True) -> Column:
    """Published, not excluded, and new or changed since it was embedded."""
    stale = F.col("embedded_at").isNull() | (F.col("updated_at") > F.col("embedded_at"))
    due = (F.col("status") == "published") & stale
    return due & ~F.col("excluded") if has_exclusion else due


def to_sweep(has_exclusion: bool = True) -> Column:
    """Embedded, but no longer eligible."""
    gone = F.col("status") != "published"
    return F.col("embedded_at").isNotNull() & (gone | F.col("excluded") if has_exclusion else gone)


def swept(rows: DataFrame, chunks: DataFrame, key: str, has_exclusion: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows with embedded_at cleared where they are to be swept (updated_at untouched), and the chunks that stay."""
    out = to_sweep(has_exclusion)
    gone = rows.filter(out).select(key)
    return rows.withColumn("embedded_at", F.when(~out | out.isNull(), F.col("embedded_at"))), chunks.join(gone, key, "left_anti")


def replaced_chunks(chunks: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The chunks of re-made rows replaced whole, so that no higher index is left over."""
    return chunks.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upserted(current: DataFrame, incoming: DataFrame, key: list[str], fields: list[str], now: Column, publish: bool) -> DataFrame:
    """The table after an upsert by natural key, with `action`: inserted, updated, unchanged or kept.

    Only real changes move updated_at. New rows are drafts unless `publish`; publishing never takes back."""
    new = incoming.select(*key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_in"))
    both = current.withColumn("_cur", F.lit(True)).join(new, key, "full")
    has, was = F.coalesce("_in", F.lit(False)), F.coalesce("_cur", F.lit(False))
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    promoted = F.lit(publish) & (F.col("status") != "published")
    changed = has & was & (differs | promoted)
    action = F.when(~was, "inserted").when(changed, "updated").when(has, "unchanged").otherwise("kept")
    status = F.when(~was, F.lit("published" if publish else "draft")).when(has & F.lit(publish), "published").otherwise(F.col("status"))
    values = [F.when(has, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    return both.select(*key, *values, status.alias("status"), F.when(~was | changed, now).otherwise(F.col("updated_at")).alias("updated_at"), action.alias("action"))


def superseded(rows: DataFrame, legacy: DataFrame, key: str, live: Column, now: Column) -> DataFrame:
    """Live rows that a new row replaces become drafts."""
    hit = rows.join(legacy.select(key).distinct().withColumn("_old", F.lit(True)), key, "left")
    down = F.coalesce("_old", F.lit(False)) & live
    return hit.withColumns({"status": F.when(down, "draft").otherwise(F.col("status")), "updated_at": F.when(down, now).otherwise(F.col("updated_at")), "superseded": down}).drop("_old")


def merged_by_key(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows overwrite current ones of the same key."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def expired(cutoff: Column) -> Column:
    """Conversations of guests that were idle before the cutoff, or that were deleted before it."""
    return (F.col("user_id").isNull() & (F.col("updated_at") < cutoff)) | F.coalesce(F.col("deleted_at") < cutoff, F.lit(False))


def purged(parents: DataFrame, children: DataFrame, key: str, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Parents that stay and the children that stay with them."""
    out = parents.filter(F.coalesce(gone, F.lit(False))).select(key)
    return parents.join(out, key, "left_anti"), children.join(out, key, "left_anti")

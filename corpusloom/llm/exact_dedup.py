"""Operator 6: exact deduplication by content-defined chunk recipes. DataFrame functions only.

Each normalised text is cut where its own content says so (after a sentence mark and a space, between MIN and MAX
characters), and each chunk gets a short identifier. Short identifiers are verified over the whole corpus: one that
stands for two different digests is not used, and the digests are then the identifiers. Two texts are equal when
their ordered identifier lists are; only these lists move, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import SPACE, staged, text_or_empty, with_group

MIN_CHARS = 256
MAX_CHARS = 4096


def normalised(column: str = "text"):
    return F.regexp_replace(text_or_empty(column), f"{SPACE}+", " ")


def chunk_pattern(lo: int = MIN_CHARS, hi: int = MAX_CHARS) -> str:
    """Matches tile the text: up to the first sentence end after `lo` characters, else `hi` characters or the rest."""
    return rf"(?s).{{{lo},{hi}}}?[.!?,;] |.{{1,{hi}}}"


def recipes(docs: DataFrame, lo: int = MIN_CHARS, hi: int = MAX_CHARS) -> DataFrame:
    """doc_id, own (SHA-256 of the text as it is), text_sha256 (normalised), ids (short chunk identifiers in order),
    digests (SHA-256 of each chunk, in order)."""
    cut = docs.select("doc_id", own_digest().alias("own"), normalised().alias("norm")).select(
        "doc_id", "own", "norm", F.regexp_extract_all("norm", F.lit(chunk_pattern(lo, hi)), F.lit(0)).alias("chunks")
    )
    return cut.select(
        "doc_id",
        "own",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform("chunks", lambda c: F.xxhash64(c)).alias("ids"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c.cast("binary"), 256))).alias("digests"),
    )


def own_digest() -> Column:
    """Digest of a row's text; null and empty texts count as the same."""
    return F.unhex(F.sha2(text_or_empty().cast("binary"), 256))


def verified(found: DataFrame) -> DataFrame:
    """doc_id, own, text_sha256, recipe. The recipe holds the short identifiers if each stands for one digest in the
    whole corpus, else the digests."""
    pairs = found.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests").distinct()
    clash = pairs.groupBy("ids").count().filter("count > 1").limit(1).count()
    recipe = F.col("digests" if clash else "ids")
    return found.select("doc_id", "own", "text_sha256", recipe.alias("recipe"))


def grouped(docs: DataFrame, lo: int = MIN_CHARS, hi: int = MAX_CHARS) -> DataFrame:
    """Rows of `verified` with their group's keep_id, keep_own (the digest of the text that stays, where its doc_id has
    several) and group_size."""
    found = staged(recipes(docs, lo, hi), "recipes")
    rows = verified(found)
    first = F.min(F.struct("doc_id", "own"))  # of rows that have a doc_id, where any has
    least = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "own"))), first)
    groups = staged(rows.groupBy("recipe").agg(least.alias("least"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    groups = groups.select("recipe", F.col("least.doc_id").alias("keep_id"), F.col("least.own").alias("keep_own"), "group_size")
    return with_group(rows, groups, "recipe", "group_size")


def deduplicate(docs: DataFrame, lo: int = MIN_CHARS, hi: int = MAX_CHARS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and all empty texts are one group (an empty recipe). Rows that repeat a doc_id are
    counted each; those with the smallest doc_id of their group are kept. A row without doc_id is kept by nothing: its
    `kept` is null. An empty table gives no rows. A group of a third of all rows is summed before it moves, and what is
    known of it is brought to its rows by broadcast. Only doc_id and text are read, whatever other columns are called.
    """
    return grouped(docs, lo, hi).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the smallest doc_id, with all its columns. A doc_id with several texts is several
    documents: each is judged by its own text. Of rows that repeat doc_id and text alike one stays (any: a tie), and of
    equal texts under one doc_id that differ in white space the one of the smallest digest. Rows without doc_id have no
    place in the order of doc_ids and stay. An empty table gives no rows."""
    judged = grouped(docs).filter("doc_id IS NOT NULL")
    # a row is named by its doc_id and its own text, so that what is dropped is that text only
    gone = staged(judged.filter("doc_id <> keep_id OR own <> keep_own").select("doc_id", "own").distinct(), "recipe-dropped")
    again = staged(judged.groupBy("doc_id", "own").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id", "own"), "recipe-repeated")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").alias("_id"), own_digest().alias("_own"))
    same = lambda t: (F.col("_id") == t["doc_id"]) & (F.col("_own") == t["own"])
    left = packed.join(gone.hint("shuffle_hash"), same(gone), "left_anti")  # as many as there are copies: not to be broadcast
    if again.limit(1).count():
        one = left.join(again, same(again), "left_semi").dropDuplicates(["_id", "_own"])
        left = left.join(again, same(again), "left_anti").unionByName(one)
    return left.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

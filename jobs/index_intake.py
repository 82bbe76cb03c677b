"""Job 1: new and changed documents go into the search index.

A corpus grows by files of documents, and a document may be sent again with another text. Each run takes the files that
no run has taken before (a file stream with a checkpoint, drained and ended), normalises the texts, refuses what is not
fit for search, leaves out what has not changed, and writes the terms of the rest.

    out/documents/batch=N/lang=..            one row a document that was sent: doc_id, seen_us, digest, n_words, reason,
                                             status (new, changed, unchanged, stale, refused)
    out/postings/batch=N/lang=../bucket=..   its terms: doc_id, term, tf, dl; sorted by term within files

A batch writes folders of its own and looks only at earlier ones, so that a batch which is broken off and run again
gives the same files. Nothing is ever rewritten: `current` picks the newest version of each document. A document that
is sent again without fit text thereby leaves the index.

    python -m jobs.index_intake --documents PATH --out PATH [--checkpoint PATH] [--config PATH]
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import lexical_index
from jobs._common import command_line_session, log, settings

VERSION = "doc_id long, seen_us long, digest string, n_words long, reason string, status string"
STATUSES = ("new", "changed", "unchanged", "stale", "refused")
ARRIVAL = "doc_id long, text string, lang string"
POSTING = "doc_id long, term string, tf long, dl long"


def as_pattern(path: str) -> str:
    """A pattern that only `path` meets: a stream may then read a single file, or a folder that files are added to."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def refusal(n_words: Column, min_words: int) -> Column:
    return F.when(F.col("doc_id").isNull(), "no id").when(n_words == 0, "empty").when(n_words < min_words, "short")


def prepared(arrived: DataFrame, min_words: int) -> DataFrame:
    """doc_id, seen_us, digest, lang, words, n_words, reason: one row a document, the newest of this batch. Of rows from
    equally new files the one with the greatest digest (then language) counts, wherever it stands."""
    text = T.normalise(F.coalesce("text", F.lit("")))
    lang = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("unknown"))
    rows = arrived.select(F.col("doc_id").cast("long").alias("doc_id"), F.unix_micros("seen").alias("seen_us"), lang.alias("lang"), text.alias("text"))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    newest = rows.groupBy("doc_id").agg(F.max_by("text", F.struct("seen_us", "digest", "lang")).alias("text"), F.max(F.struct("seen_us", "digest", "lang")).alias("v"))
    said = newest.select("doc_id", "v.*", T.words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    return said.withColumn("reason", refusal(F.col("n_words"), min_words))


def versions(spark: SparkSession, out: str) -> DataFrame:
    sent = spark.read.schema(f"{VERSION}, batch long, lang string").parquet(f"{out}/documents")
    return sent.filter(F.col("status").isin("new", "changed"))


def newest_versions(known: DataFrame) -> DataFrame:
    """One row a document: its version from the newest file; of equally new files, that of the last batch."""
    return known.groupBy("doc_id").agg(F.max(F.struct("seen_us", "batch", "digest", "lang", "n_words", "reason")).alias("v")).select("doc_id", "v.*")


def take(arrived: DataFrame, batch: int, out: str, config: dict) -> dict:
    """One batch: what it writes, and how much of each kind it saw."""
    spark = arrived.sparkSession
    before = newest_versions(versions(spark, out).filter(F.col("batch") < batch)).select("doc_id", F.col("seen_us").alias("was_us"), F.col("digest").alias("was"), F.col("lang").alias("was_lang"))
    # rows without doc_id cannot be told from one another: they are one refused row, and no version is made of them
    rows = prepared(arrived, config["min_words"]).join(before, "doc_id", "left")
    same = (F.col("digest") == F.col("was")) & (F.col("lang") == F.col("was_lang"))
    status = F.when(F.col("doc_id").isNull(), "refused").when(F.col("was").isNull(), "new").when(F.col("seen_us") < F.col("was_us"), "stale").when(same, "unchanged").otherwise("changed")

    documents, postings = f"{out}/documents/batch={batch}", f"{out}/postings/batch={batch}"
    rows.select("doc_id", "seen_us", "digest", "n_words", "reason", status.alias("status"), "lang").write.mode("overwrite").partitionBy("lang").parquet(documents)
    written = spark.read.schema(f"{VERSION}, lang string").parquet(documents)
    fit = written.filter("reason IS NULL AND status IN ('new', 'changed')").select("doc_id", "lang")
    words = rows.filter("reason IS NULL").select("doc_id", "words")
    terms = lexical_index.counted(words, "doc_id", F.col("words")).filter("term IS NOT NULL").join(fit, "doc_id")
    terms = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(config["term_buckets"])).cast("int"))
    terms.hint("rebalance", "lang", "bucket").sortWithinPartitions("lang", "bucket", "term").write.mode("overwrite").partitionBy("lang", "bucket").parquet(postings)

    # counts come from file footers and from the table of versions
    kinds = {r.status: r["count"] for r in written.groupBy("status").count().collect()}
    got = {"batch": batch, "read": arrived.count(), **{k: kinds.get(k, 0) for k in STATUSES}, "fit": fit.count(), "postings": spark.read.schema(f"{POSTING}, lang string, bucket int").parquet(postings).count()}
    log.info("index_intake batch %(batch)d: read %(read)d rows; new %(new)d, changed %(changed)d, unchanged %(unchanged)d, stale %(stale)d, refused %(refused)d; wrote %(fit)d documents with %(postings)d postings", got)
    return got


def run(spark: SparkSession, documents: str, out: str, checkpoint: str | None = None, config: dict | None = None) -> list[dict]:
    """Takes what is new at `documents` (Parquet: doc_id, text, lang; other columns are not read) into `out`, and returns
    the counts of each batch. A run without new files takes no batch and changes nothing. Null texts are empty, null or
    blank languages are `unknown`; rows without doc_id are counted only."""
    config = config or settings(spark, __file__)
    for name, schema, parts in (("documents", f"{VERSION}, batch long, lang string", ["batch", "lang"]), ("postings", f"{POSTING}, batch long, lang string, bucket int", ["batch", "lang", "bucket"])):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*parts).parquet(f"{out}/{name}")  # so that they can be read from the first batch on
    raw = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", config["max_files_per_batch"]).parquet(as_pattern(documents))
    arrived = raw.select("doc_id", "text", "lang", F.col("_metadata.file_modification_time").alias("seen"))
    done: list[dict] = []
    query = arrived.writeStream.foreachBatch(lambda df, n: done.append(take(df, n, out, config))).option("checkpointLocation", checkpoint or f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("index_intake: %d batches, %d rows read, %d postings written to %s", len(done), sum(d["read"] for d in done), sum(d["postings"] for d in done), out)
    return done


def current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The newest version of each document (doc_id, lang, digest, n_words, reason), and the postings of those that are
    fit (doc_id, lang, term, tf, dl)."""
    known = newest_versions(versions(spark, out))
    postings = spark.read.schema(f"{POSTING}, batch long, lang string, bucket int").parquet(f"{out}/postings")
    live = known.filter("reason IS NULL").select("doc_id", "batch")
    return known.select("doc_id", "lang", "digest", "n_words", "reason"), postings.join(live, ["doc_id", "batch"]).select("doc_id", "lang", "term", "tf", "dl")


def search_index(spark: SparkSession, out: str) -> lexical_index.Index:
    """The whole of what has been taken in, for `lexical_index.search`; it counts documents that are fit."""
    documents, postings = current(spark, out)
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = documents.filter("reason IS NULL").agg(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("avgdl"))
    return lexical_index.Index("doc_id", postings, terms, sizes)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name, needed in (("documents", True), ("out", True), ("checkpoint", False), ("config", False)):
        args.add_argument(f"--{name}", required=needed)
    said = args.parse_args()
    spark = command_line_session("index_intake")
    try:
        run(spark, said.documents, said.out, said.checkpoint, settings(spark, __file__, said.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

"""Job 2: a cleaned release of the corpus, one row a distinct text, with the reason of everything that was left out.

    out/corpus/release=R/lang=../source=..   doc_id, text (normalised), n_words, digest: what is published
    out/decisions/release=R/reason=..        doc_id, lang, source, n_words, digest, canonical, reasons: every distinct row
                                             and why it was left out; reason=none is published
    out/report/release=R/lang=..             rows and words by source and reason (JSON)

Of equal texts (white space at the ends apart) the row that stays is one without a fault, then one labelled good, then
the smallest doc_id. Reasons add up ("toxic; duplicate"); the first one names the folder. A run with the same release
name replaces that release whole and touches no other.

    python -m jobs.corpus_release --documents PATH --labels PATH --out PATH --release NAME [--config PATH]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import cleaning as C
from jobs._common import command_line_session, log, settings

DECISION = "doc_id long, lang string, source string, n_words long, digest string, canonical long, reasons string, reason string"
KEPT = "doc_id long, text string, n_words long, digest string"


def facts(documents: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """One row a distinct (doc_id, digest): lang, source, n_words, good, excluded, exclusion_reason (the first fault)."""
    text = F.coalesce("text", F.lit(""))
    blank = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), blank("lang").alias("lang"), blank("source").alias("source"), T.content_hash(text).alias("digest"), F.size(T.words(text)).cast("long").alias("n_words"))
    one = rows.groupBy("doc_id", "digest").agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.first("n_words").alias("n_words"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    joined = one.join(marks, "doc_id", "left")
    fault = F.when(F.col("doc_id").isNull(), "no id").when(F.col("n_words") == 0, "empty").when(F.col("n_words") < config["min_words"], "short")
    if config["refuse_toxic"]:
        fault = fault.when(F.col("toxic") == 1, "toxic")
    if config["refuse_low_quality"]:
        fault = fault.when(F.col("quality") == 0, "low quality")
    return joined.select("doc_id", "digest", "lang", "source", "n_words", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), fault.isNotNull().alias("excluded"), fault.alias("exclusion_reason"))


def decided(rows: DataFrame, config: dict) -> DataFrame:
    """`rows` with excluded and exclusion_reason brought up to date with duplicates, and canonical (the doc_id that
    stands for the text; null where the text has one row)."""
    groups = C.canonical_rows(rows, "doc_id", "digest", "excluded", F.col("good"))
    if not config["hold_ambiguous"]:  # the smallest doc_id settles it
        groups = groups.withColumn("blocked", F.lit(False))
    named = rows.join(groups.filter("NOT blocked").select("digest", F.col("canonical").alias("stands")), "digest", "left")
    return C.exclude_duplicates(named, "doc_id", "digest", groups, "duplicate").withColumnRenamed("stands", "canonical")


def run(spark: SparkSession, documents: str, labels: str, out: str, release: str, config: dict | None = None) -> dict:
    """Writes one release and returns its counts. Null texts are empty; null or blank languages and sources are
    `unknown`; a row without doc_id is left out ("no id"); rows that repeat doc_id and text alike are one row."""
    config = config or settings(spark, __file__)
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang", "source")
    at = {name: f"{out}/{name}/release={release}" for name in ("decisions", "corpus", "report")}
    first = F.coalesce(F.substring_index("exclusion_reason", ";", 1), F.lit("none"))
    every = decided(facts(docs, spark.read.parquet(labels).select("doc_id", "quality", "toxic"), config), config)
    every.select("doc_id", "lang", "source", "n_words", "digest", "canonical", F.col("exclusion_reason").alias("reasons"), first.alias("reason")).write.mode("overwrite").partitionBy("reason").parquet(at["decisions"])
    decisions = spark.read.schema(DECISION).parquet(at["decisions"])

    kept = decisions.filter("reason = 'none'").select("doc_id", "digest", "n_words", F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    text = F.coalesce("text", F.lit(""))
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", T.content_hash(text).alias("digest")).join(kept, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    corpus = met.select("doc_id", T.normalise(text).alias("text"), "n_words", "digest", F.col("_lang").alias("lang"), F.col("_source").alias("source"))
    corpus.hint("rebalance", "lang", "source").write.mode("overwrite").partitionBy("lang", "source").parquet(at["corpus"])
    report = decisions.groupBy("lang", "source", "reason").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_words").alias("words"), F.count_if(F.contains("reasons", F.lit("duplicate"))).alias("duplicates"))
    report.write.mode("overwrite").partitionBy("lang").json(at["report"])

    texts, published, words = decisions.agg(F.count(F.lit(1)), F.count_if(F.col("reason") == "none"), F.coalesce(F.sum(F.when(F.col("reason") == "none", F.col("n_words"))), F.lit(0))).first()
    got = {"release": release, "read": docs.count(), "texts": texts, "published": published, "words": words, "left_out": texts - published}
    log.info("corpus_release %(release)s: read %(read)d rows, %(texts)d distinct; published %(published)d with %(words)d words, left out %(left_out)d", got)
    return got


def released(spark: SparkSession, out: str, release: str) -> tuple[DataFrame, DataFrame]:
    """What a release publishes, and what it leaves out."""
    corpus = spark.read.schema(f"{KEPT}, lang string, source string").parquet(f"{out}/corpus/release={release}")
    return corpus, spark.read.schema(DECISION).parquet(f"{out}/decisions/release={release}").filter("reason <> 'none'")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name, needed in (("documents", True), ("labels", True), ("out", True), ("release", True), ("config", False)):
        args.add_argument(f"--{name}", required=needed)
    said = args.parse_args()
    spark = command_line_session("corpus_release")
    try:
        run(spark, said.documents, said.labels, said.out, said.release, settings(spark, __file__, said.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

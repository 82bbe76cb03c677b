"""A BM25 index that is built once, stored, and loaded by every later search of the same corpus.

Documents are tokenised in one pass: a document's terms are counted where it is, so only finished postings are
shuffled, once. Tables lie under a name made of the corpus' fingerprint, so a changed corpus gets an index of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R

#: Files over which the postings of one term are dealt, so that a term that most documents hold is no single task's.
STRIPS = 16


@dataclass(frozen=True)
class Index:
    """postings: doc, term, tf, dl. terms: term, df. sizes: one row with n and avgdl."""

    doc: str
    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame


def fingerprint(docs: DataFrame, doc: str, text: str, tokenizer: str) -> str:
    """Names a corpus and the way it is cut: rows, and two order-free sums over 64-bit hashes of (doc, text)."""
    h = F.xxhash64(doc, F.col(text).isNull(), text)
    parts = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s"))
    return parts.select(F.sha2(F.concat_ws("|", F.lit(tokenizer), "n", "x", "s"), 256)).first()[0]


def complete(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def counted(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """doc, term, tf, dl for each distinct term of a document, and one row with no term for the document itself."""
    kind = dict(docs.dtypes)[doc]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys = batch.column("_t"), batch.column(doc)
            dl = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            size = len(coded.dictionary) + 1
            at, tf = np.unique(np.repeat(np.arange(len(dl), dtype=np.int64), dl) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = np.concatenate([at // size, np.arange(len(dl), dtype=np.int64)])
            term = pa.concat_arrays([coded.dictionary.take(pa.array(at % size)), pa.nulls(len(dl), coded.dictionary.type)])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), term.cast(pa.string()), pa.array(np.concatenate([tf, np.zeros(len(dl), np.int64)])), pa.array(dl[row])], names=[doc, "term", "tf", "dl"])

    return docs.select(doc, tokens.alias("_t")).mapInArrow(count, f"`{doc}` {kind}, term string, tf long, dl long")


def stored(docs: DataFrame, doc: str, text: str, tokens: Column, folder: str, tokenizer: str) -> Index:
    """The index of `docs` (doc, text), loaded if `folder` holds it, else built there first.

    `tokenizer` names the way `tokens` cuts a text. Null texts have whatever `tokens` makes of them; a document without
    tokens counts in n and avgdl; an empty table gives an empty index. The table of sizes is written last: where it is
    complete, so is the index, and a build that was broken off is begun again."""
    spark = docs.sparkSession
    at = f"{folder}/bm25-{fingerprint(docs, doc, text, tokenizer)}"
    if not complete(spark, f"{at}/sizes"):
        strip = F.when(F.col("term").isNull(), F.xxhash64(doc)).otherwise(F.pmod(F.xxhash64(doc), F.lit(STRIPS)))
        counted(docs, doc, tokens).repartition("term", strip).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/postings")
        held = spark.read.parquet(f"{at}/postings")
        held.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{at}/terms")
        held.filter("term IS NULL").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{at}/sizes")
    return Index(doc, spark.read.parquet(f"{at}/postings").filter("term IS NOT NULL"), spark.read.parquet(f"{at}/terms"), spark.read.parquet(f"{at}/sizes"))


def search(index: Index, queries: DataFrame, query: str, tokens: Column, k: int) -> DataFrame:
    """query, doc, score (rounded to 6, above zero), rank: the k best of each query, ties by doc. Nothing is tokenised
    but the queries; Spark sends their terms to the postings if their size allows."""
    asked = R.query_terms(queries, query, tokens).join(index.terms, "term").crossJoin(F.broadcast(index.sizes))  # sizes is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = index.postings.join(asked.select(query, "term", idf.alias("idf"), "avgdl"), "term")
    weight = F.col("idf") * F.col("tf") / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("dl") / F.col("avgdl")))
    scored = weighted.groupBy(query, index.doc).agg(F.round(F.sum(weight), 6).alias("score")).filter("score > 0")
    return R.top_k(scored, query, index.doc, k)

"""Operator 8: token counts of documents in flat, unindexed token files, by a separator scan.

A flat file is a run of token identifiers in which an end-of-document identifier closes each document; nothing says
where documents begin. Files are read in blocks; a block is searched for separators with one vectorised comparison,
and what crosses block edges is stitched by a prefix scan over block summaries (tokens, separators, last separator),
in two levels so that no task ever sees more than the summaries of `SPAN` blocks, or one row for each such span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import staged
from corpusloom.llm.bpe import read_ranks, read_vocabulary

BLOCK_TOKENS = 1 << 16
SPAN = 1024
#: Bytes of a flat file that one task reads.
AT_ONCE = 1 << 28
EOD = 50256
BLOCKS = "file_id long, block_no long, tokens binary, first_ordinal long, doc_ids array<long>"
_ENCODINGS: dict = {}


def flat_files(docs: DataFrame, vocabulary: str, pattern: str, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents as flat token files in blocks of `block_tokens` unsigned 16-bit identifiers: one file for each
    partition of `docs`; documents run across blocks. Rows without tokens are the writer's list of doc_ids, in order."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(read_vocabulary(vocabulary))  # a fixed file of a tokenizer

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pattern not in _ENCODINGS:
            _ENCODINGS[pattern] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=read_ranks(data.value), special_tokens={})
        encode, file_id = _ENCODINGS[pattern].encode_ordinary, TaskContext.get().partitionId()
        rest, held, block, ordinal = [], 0, 0, 0

        def rows(payload: list, first: int | None, ids: list | None) -> pa.RecordBatch:
            nonlocal block
            n = max(1, len(payload))
            numbers = list(range(block, block + len(payload))) or [None]
            block += len(payload)
            return pa.RecordBatch.from_arrays(
                [pa.array([file_id] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array(payload or [None], pa.binary()), pa.array([first] * n, pa.int64()), pa.array([ids] * n, pa.list_(pa.int64()))],
                names=["file_id", "block_no", "tokens", "first_ordinal", "doc_ids"],
            )

        for batch in batches:
            for cell in batch.column("text"):
                ids = encode(cell.as_py() or "")
                ids.append(eod)
                rest.append(np.array(ids, "<u2"))
                held += len(ids)
                if held >= block_tokens:
                    flat = np.concatenate(rest)
                    full = len(flat) // block_tokens
                    yield rows([flat[i * block_tokens : (i + 1) * block_tokens].tobytes() for i in range(full)], None, None)
                    rest, held = [flat[full * block_tokens :]], len(flat) - full * block_tokens
            if batch.num_rows:
                yield rows([], ordinal, batch.column("doc_id").to_pylist())
                ordinal += batch.num_rows
        if held:
            yield rows([np.concatenate(rest).tobytes()], None, None)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, BLOCKS)


def read_flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2, at_once: int = AT_ONCE) -> DataFrame:
    """Flat token files of a folder as blocks (file_id is a file's path). Files of up to `at_once` bytes are read by
    Spark, from any store that it reads; of larger ones a task reads a range of blocks, so that neither a file's length
    nor its task's memory is bounded by the other. A range is read through Arrow's file systems."""
    size = block_tokens * width
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content", "length").filter("length > 0")
    cut = whole.filter(F.col("length") <= at_once).select("file_id", "content", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("block_no"))
    small = cut.select("file_id", "block_no", F.substring(F.col("content"), (F.col("block_no") * size + 1).cast("int"), F.lit(size)).alias("tokens"))
    step = max(1, at_once // size)
    ranges = whole.filter(F.col("length") > at_once).select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size), F.lit(step).cast("long"))).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("file_id").to_pylist(), batch.column("first").to_pylist(), strict=True):
                store, at = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with store.open_input_file(at) as f:
                    f.seek(first * size)
                    for block in range(first, first + step):
                        data = f.read(size)
                        if not data:
                            break
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file_id", "block_no", "tokens"])

    large = ranges.repartition("file_id", "first").mapInArrow(read, "file_id string, block_no long, tokens binary")
    return small.unionByName(large)


def scan_separators(blocks: DataFrame, eod: int = EOD, dtype: str = "<u2") -> DataFrame:
    """One row per document of the files in `blocks` (file_id, block_no, tokens): file_id, ordinal, start, n_tokens
    (without the separator), closed (false for tokens after a file's last separator).

    Two separators in a row close an empty document. Null or empty blocks hold no tokens. Files without blocks give
    no rows. Blocks of a file may have any lengths; their numbers give their order and must not repeat.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flats = [np.frombuffer(cell.as_buffer() or b"", dtype) if cell.is_valid else np.zeros(0, dtype) for cell in batch.column("tokens")]
            at = [np.flatnonzero(x == eod) for x in flats]
            ends = np.cumsum([0, *map(len, at)])
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*at, np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("block_no"), pa.array([len(x) for x in flats], pa.int64()), found], names=["file_id", "block_no", "n", "at"])

    kind = dict(blocks.dtypes)["file_id"]
    found = staged(blocks.select("file_id", F.col("block_no").cast("long"), "tokens").mapInArrow(find, f"file_id {kind}, block_no long, n long, at array<long>"), "separators")
    last = F.when(F.size("at") > 0, F.element_at("at", -1))
    one = found.select("*", F.floor(F.col("block_no") / SPAN).alias("span"), F.size("at").cast("long").alias("k"))
    inner = Window.partitionBy("file_id", "span").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("n0", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("k0", F.coalesce(F.sum("k").over(inner), F.lit(0))).withColumn("end0", F.max(F.col("n0") + last).over(inner))
    spans = one.groupBy("file_id", "span").agg(F.sum("n").alias("sn"), F.sum("k").alias("sk"), F.max(F.col("n0") + last).alias("send"))
    outer = Window.partitionBy("file_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("n1", F.coalesce(F.sum("sn").over(outer), F.lit(0))).withColumn("k1", F.coalesce(F.sum("sk").over(outer), F.lit(0))).withColumn("end1", F.max(F.col("n1") + F.col("send")).over(outer))
    whole = one.join(spans.select("file_id", "span", "n1", "k1", "end1"), ["file_id", "span"])
    start, before = F.col("n1") + F.col("n0"), F.coalesce(F.col("n1") + F.col("end0"), "end1", F.lit(-1))
    closed = whole.select("file_id", start.alias("s"), (F.col("k1") + F.col("k0")).alias("k"), before.alias("b"), "at", F.posexplode("at").alias("i", "x")).select(
        "file_id", (F.col("k") + F.col("i")).alias("ordinal"), (F.when(F.col("i") > 0, F.col("s") + F.get("at", F.col("i") - 1)).otherwise(F.col("b")) + 1).alias("start"), (F.col("s") + F.col("x")).alias("end")
    )
    tails = spans.groupBy("file_id").agg(F.sum("sn").alias("end"), F.sum("sk").alias("ordinal"), F.coalesce(F.max(F.col("n1") + F.col("send")) + 1, F.lit(0)).alias("start")).filter("end > start")
    out = ["file_id", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens")]
    return closed.select(*out, F.lit(True).alias("closed")).unionByName(tails.select(*out, F.lit(False).alias("closed")))


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, file_id, ordinal, start, n_tokens, as found by scanning the
    flat files that the documents were written to.

    Null counts as empty: a document of no tokens. Repeated rows are documents of their own; an empty table gives no
    rows; very long texts fill as many blocks as they need. Rows without doc_id are written and counted like others. Only
    doc_id and text are read, whatever other columns are called.
    """
    files = staged(flat_files(docs, vocabulary, pattern, eod, block_tokens), "flat-tokens")
    found = scan_separators(files.filter("tokens IS NOT NULL").select("file_id", "block_no", "tokens"), eod)
    listed = files.filter("tokens IS NULL").select("file_id", "first_ordinal", F.posexplode("doc_ids").alias("i", "doc_id")).select("file_id", (F.col("first_ordinal") + F.col("i")).alias("ordinal"), "doc_id")
    return listed.join(found, ["file_id", "ordinal"]).select("doc_id", "file_id", "ordinal", "start", "n_tokens")

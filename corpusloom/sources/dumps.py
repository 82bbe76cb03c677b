"""SQL dumps as DataFrames: MySQL INSERT blocks and pg_dump COPY blocks.

Lines are read by Spark, a large file by many tasks; a block's header is carried forward to its rows within a task and,
by what each piece of a file tells, from piece to piece. Only the tuple itself is taken apart in Python, in Arrow batches.
Lines that cannot be read are kept apart and counted, never raised.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.streaming.sinks import shared_dir

#: What a backslash stands for in MySQL strings (others stand for themselves; \\% and \\_ keep theirs).
MYSQL_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "%": "\\%", "_": "\\_"}
_PIECE = re.compile(r"""\s*(?:'(?P<text>(?:[^'\\]|\\.|'')*)'|(?P<null>NULL)\b|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?))\s*(?P<end>[,)])""", re.DOTALL)


_ESCAPE = re.compile(r"\\(.)|''", re.DOTALL)


def unescaped(text: str) -> str:
    """A string literal's value: from left to right, a backslash and its character, or a doubled quote, are one."""
    return _ESCAPE.sub(lambda m: "'" if m[1] is None else MYSQL_ESCAPES.get(m[1], m[1]), text)


def tuple_values(line: str | None) -> list[str | None] | None:
    """Values of the tuple that a line begins with, as text; None if it is malformed."""
    if not line or not re.match(r"\(\d+,", line):
        return None
    at, out = 1, []
    while m := _PIECE.match(line, at):
        out.append(unescaped(m["text"]) if m["text"] is not None else m["number"])
        if m["end"] == ")":
            return out
        at = m.end()
    return None


@F.pandas_udf(ArrayType(StringType()))
def parse_tuple(lines: pd.Series) -> pd.Series:
    return lines.map(tuple_values)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, at, line: the lines of all files at `path`, a large file read by many tasks. `split` is where a task's
    piece of the file begins, and `at` ascends in it; rows of a split lie in one partition and in order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


#: Splits up to which what is known of them is sent to all tasks: a few dozen bytes each.
SENT_SPLITS = 200_000


def with_blocks(lines: DataFrame, mark: Column) -> DataFrame:
    """file, no, line, mark, block: lines of `numbered_lines`, numbered within their file, with the last mark before each,
    however far back it stands. `mark` is a struct, null on lines that begin or end no block.

    In two levels: a task carries marks forward within its splits, without moving a line; from each split only its
    number of lines and its last mark are told, and these are carried forward over the splits of a file."""
    spark = lines.sparkSession
    marked = lines.withColumn("mark", mark)
    kind = marked.schema["mark"].dataType.simpleString()
    last = F.max(F.when(F.col("mark").isNotNull(), F.struct("at", "mark")))["mark"]
    told = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    marked.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), last.alias("last")).write.parquet(told)
    splits = spark.read.schema(f"file string, split long, n long, last {kind}").parquet(told)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    start = splits.select(F.col("file").alias("_file"), F.col("split").alias("_split"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.last("last", ignorenulls=True).over(before).alias("before"))
    start = F.broadcast(start) if splits.count() <= SENT_SPLITS else start

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, done = None, None, 0  # the split that the last batch ended in, its last mark, its lines so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file, split, line, marks = batch.columns
            name, at, row = file.dictionary_encode().indices.to_numpy(), split.to_numpy(), np.arange(n)
            new = np.concatenate([[own != (file[0].as_py(), int(at[0]))], (name[1:] != name[:-1]) | (at[1:] != at[:-1])])
            begin = np.maximum.accumulate(np.where(new, row, -1))  # -1: begun in an earlier batch
            seen = np.maximum.accumulate(np.where(marks.is_valid().to_numpy(zero_copy_only=False), row, -1))
            prior = np.concatenate([[-1], seen[:-1]])
            here = (prior >= 0) & (prior >= begin)
            earlier = ~here & (begin < 0) & (held is not None)
            source = marks if held is None else pa.concat_arrays([marks, held])
            block = source.take(pa.array(np.where(here, prior, n), pa.int64(), mask=~(here | earlier)))
            place = np.where(begin < 0, done + row, row - begin)
            yield pa.RecordBatch.from_arrays([file, split, pa.array(place), line, marks, block, pa.array(here | earlier)], names=["file", "split", "place", "line", "mark", "held", "known"])
            if seen[-1] >= 0 and seen[-1] >= begin[-1]:
                held = marks.slice(int(seen[-1]), 1)
            elif begin[-1] >= 0:
                held = None
            own, done = (file[-1].as_py(), int(at[-1])), int(place[-1]) + 1

    inside = marked.select("file", "split", "line", "mark").mapInArrow(carry, f"file string, split long, place long, line string, mark {kind}, held {kind}, known boolean")
    met = inside.join(start, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    return met.select("file", (F.col("base") + F.col("place")).alias("no"), "line", "mark", F.when(F.col("known"), F.col("held")).otherwise(F.col("before")).alias("block"))


def mysql_rows(lines: DataFrame, table: str) -> DataFrame:
    """file, no, columns, vals (null: malformed) of the rows of a table."""
    header = r"^INSERT INTO `?([A-Za-z0-9_]+)`? \(([^)]*)\) VALUES"
    is_header, closes = F.col("line").rlike(header), F.rtrim("line").endswith(";")
    mark = F.when(is_header, F.struct(F.lit(True).alias("open"), F.regexp_extract("line", header, 1).alias("table"), F.regexp_extract("line", header, 2).alias("columns"))).when(
        closes, F.struct(F.lit(False).alias("open"), F.lit("").alias("table"), F.lit("").alias("columns"))
    )
    header_line = F.coalesce(F.col("mark.open"), F.lit(False))
    inside = with_blocks(lines, mark).filter(~header_line & F.col("block.open") & (F.col("block.table") == table) & (F.trim("line") != ""))
    names = F.transform(F.split("block.columns", ","), lambda c: F.trim(F.replace(c, F.lit("`"), F.lit(""))))
    return inside.select("file", "no", names.alias("columns"), parse_tuple("line").alias("vals"))


def by_name(rows: DataFrame) -> DataFrame:
    """Rows whose width is the declared one, as a map from column to value."""
    return rows.filter(F.size("vals") == F.size("columns")).select("file", "no", F.map_from_arrays("columns", "vals").alias("row"))


#: Places of fields in rows that still have sixteen columns.
SIXTEEN = {"id": 0, "title": 2, "published_date": 5, "description": 8, "byline": 11}


def by_name_or_place(rows: DataFrame, places: dict[str, int] = SIXTEEN) -> DataFrame:
    """As `by_name`, and rows of sixteen values by place."""
    old = F.create_map(*[x for k, i in places.items() for x in (F.lit(k), F.get("vals", F.lit(i)))])
    row = F.when(F.size("vals") == F.size("columns"), F.map_from_arrays("columns", "vals")).when(F.size("vals") == 16, old)
    return rows.withColumn("row", row).filter("row IS NOT NULL").select("file", "no", "row")


def read_stats(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows and skipped."""
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(kept.agg(F.count(F.lit(1)).alias("rows"))).select("rows", (F.col("n") - F.col("rows")).alias("skipped"))


#: What a backslash stands for in COPY text.
COPY_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}


@F.pandas_udf(ArrayType(StringType()))
def copy_fields(lines: pd.Series) -> pd.Series:
    field = lambda v: None if v == "\\N" else re.sub(r"\\(.)", lambda m: COPY_ESCAPES.get(m[1], m[1]), v)
    return lines.map(lambda x: None if x is None else [field(v) for v in x.split("\t")])


def copy_blocks(lines: DataFrame) -> DataFrame:
    """Lines inside COPY blocks, with the block's table and columns."""
    header = r"^COPY (?:public\.)?([A-Za-z0-9_]+) \(([^)]*)\) FROM stdin;"
    is_header, ends = F.col("line").rlike(header), F.col("line") == "\\."
    mark = F.when(is_header, F.struct(F.regexp_extract("line", header, 1).alias("table"), F.regexp_extract("line", header, 2).alias("columns"))).when(ends, F.struct(F.lit("").alias("table"), F.lit("").alias("columns")))
    return with_blocks(lines, mark).filter(F.col("mark").isNull() & (F.col("block.table") != ""))


def copy_rows(lines: DataFrame, table: str) -> DataFrame:
    """file, no, row (map) of the table's first COPY block; rows of another width are left out."""
    own = copy_blocks(lines).filter(F.col("block.table") == table)
    names = F.transform(F.split("block.columns", ","), lambda c: F.trim(c))
    read = own.select("file", "no", names.alias("columns"), copy_fields("line").alias("vals"))
    return read.filter(F.size("vals") == F.size("columns")).select("file", "no", F.map_from_arrays("columns", "vals").alias("row"))


def copy_counts(lines: DataFrame) -> DataFrame:
    """table, n: rows inside each table's COPY blocks."""
    return copy_blocks(lines).groupBy(F.col("block.table").alias("table")).agg(F.count(F.lit(1)).alias("n"))


#: Lines that only some versions understand.
NOISE = ["\\restrict", "\\unrestrict", "SET transaction_timeout"]


def without_noise(lines: DataFrame) -> DataFrame:
    """A pg_dump without the lines that older servers reject."""
    noise = F.lit(False)
    for start in NOISE:
        noise = noise | F.startswith("line", F.lit(start))
    return lines.filter(~noise)

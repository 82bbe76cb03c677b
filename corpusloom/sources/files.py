"""Delimited files, JSON lists, SQLite exports, and sinks."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType


def csv_terms(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a headerless sheet whose first cell is a number and whose fifth and sixth aren't empty; six cells each."""
    cells = StructType([StructField(f"c{i}", StringType()) for i in range(6)])
    clean = [F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(f"c{i}", F.lit("")), "^\\x{FEFF}", ""), r"\s+", " ")).alias(f"c{i}") for i in range(6)]
    return spark.read.schema(cells).option("mode", "PERMISSIVE").csv(path).select(*clean).filter("c0 RLIKE '^[0-9]+$' AND c4 <> '' AND c5 <> ''")


def csv_by_header(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A sheet with a header, typed; an empty table where there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    text = StructType([StructField(f.name, StringType()) for f in schema])
    read = spark.read.option("header", True).schema(text).csv(path)
    return read.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


QUESTION = StructType([
    *[StructField(c, StringType()) for c in ("id", "query", "question", "slice", "category", "language", "variant_of", "review", "previous_turn")],
    StructField("answerable", BooleanType()), StructField("relevant_ids", ArrayType(StringType())), StructField("expected_row_keys", ArrayType(StringType())),
])


def eval_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions of either layout: a list, or an object with a list of questions; gold keys of
    unanswerable ones are emptied."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    either = F.when(F.col("t").startswith("["), F.from_json("t", ArrayType(QUESTION))).otherwise(F.from_json("t", StructType([StructField("questions", ArrayType(QUESTION))]))["questions"])
    q = text.select(F.explode(either).alias("q")).select("q.*")
    gold = F.coalesce("expected_row_keys", "relevant_ids", F.array().cast("array<string>"))
    yes = F.coalesce("answerable", F.lit(True))
    return q.select("id", F.coalesce("question", "query").alias("question"), yes.alias("answerable"), F.when(yes, gold).otherwise(F.array().cast("array<string>")).alias("gold"), "slice", "category", "language", "variant_of", "review")


def sqlite_table(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """A table of a SQLite file in rowid order, read in one task by streaming: place and the columns as text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                quoted = ", ".join(f'CAST("{c}" AS TEXT)' for c in columns)
                cursor, place = db.execute(f'SELECT {quoted} FROM "{table}" ORDER BY rowid'), 0
                while rows := cursor.fetchmany(5000):
                    out = pd.DataFrame(rows, columns=columns)
                    out.insert(0, "place", range(place, place + len(rows)))
                    place += len(rows)
                    yield out

    return spark.range(1).coalesce(1).mapInPandas(read, ", ".join(["place long", *(f"`{c}` string" for c in columns)]))


def with_notes(verses: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of each verse by (sura, number), in order of their markers; markers without a note are counted."""
    marks = F.regexp_extract_all("text", F.lit("([০-৯]+)(\\s*\\(ক\\))?"), F.lit(0))
    n = F.translate(F.regexp_replace("mark", "\\s*\\(ক\\)", ""), "০১২৩৪৫৬৭৮৯", "0123456789").cast("int")
    asked = verses.select("sura", "verse", F.posexplode(marks).alias("place", "mark")).withColumn("key", F.when(F.col("mark").contains("(ক)"), -n).otherwise(n))
    met = asked.join(notes.select("sura", "key", "note"), ["sura", "key"], "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("place", "note"))))
    return met.groupBy("sura", "verse").agg(F.transform(ordered, lambda x: x["note"]).alias("notes"), F.count_if(F.col("note").isNull()).alias("orphans"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def insert_statements(df: DataFrame, table: str, key: str, keep: list[str]) -> DataFrame:
    """One upsert statement a row; columns in `keep` are set at first only."""
    quoted = lambda c: F.when(F.col(c).isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")))
    names = ", ".join(df.columns)
    sets = ", ".join(f"{c} = EXCLUDED.{c}" for c in df.columns if c not in (key, *keep))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), F.concat_ws(", ", *[quoted(c) for c in df.columns]), F.lit(f") ON CONFLICT ({key}) DO UPDATE SET {sets};")).alias("statement"))


def report_json(df: DataFrame, by: str) -> DataFrame:
    """One JSON document for each value of `by`, its rows in a list."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows")).select(by, F.to_json(F.struct(by, "rows")).alias("report"))

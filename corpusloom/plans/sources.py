"""Dumps and files made from the driver's tables and read back: what a scan returns must be the table again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.plans._base import Family, table
from corpusloom.sources import dumps as D
from corpusloom.sources import files as S
from corpusloom.sources.sqlite import SqliteFiles
from corpusloom.streaming.sinks import shared_dir

fam = Family()
QUERIES, ORACLES = fam.queries, fam.oracles


def quoted(c):
    text = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("'"))


def dumped(lines: DataFrame) -> DataFrame:
    """`lines` (file, no, line) written as one text file for each `file`, and read again as dumps are."""
    spark = lines.sparkSession
    at = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    lines.repartition("file").sortWithinPartitions("file", "no").select("file", "line").write.partitionBy("file").text(at)
    return D.numbered_lines(spark, at)


def dump_of(path) -> Column:
    return F.regexp_extract(path, "file=([^/]*)/", 1)


def mysql_lines(spark, sf_dir) -> DataFrame:
    """A file for each source: an INSERT block of documents with a damaged line, and a block of another table."""
    d = table(spark, sf_dir, "documents")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    end = F.when(place == F.count(F.lit(1)).over(Window.partitionBy("source")), ";").otherwise(",")
    row = F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(", "), F.when(F.expr("doc_id % 6 = 0"), "NULL").otherwise(quoted("lang")), F.lit(", "), quoted("text"), F.lit(", "), F.col("n_chars").cast("string"), F.lit(".5e0)"), end)
    rows = d.select(F.col("source").alias("file"), (place + 2).alias("no"), row.alias("line"))
    files = d.select(F.col("source").alias("file")).distinct()
    extra = [(0, "-- dump"), (1, "INSERT INTO `posts` (`id`, `lang`, `text`, `n`) VALUES"), (2, "(12, 'cut off"), (10_000_000, "INSERT INTO `users` (`id`, `name`) VALUES"), (10_000_001, "(1, 'nobody');")]
    fixed = files.crossJoin(spark.sql("SELECT * FROM VALUES " + ", ".join(f"({n}, r\"{t}\")" for n, t in extra) + " AS t(no, line)"))
    return dumped(fixed.select("file", "no", "line").union(rows))


@fam.query("SELECT source AS file, doc_id, CASE WHEN doc_id % 6 > 0 THEN lang END AS lang, text, n_chars || '.5e0' AS n FROM documents")
def mysql_dump_scan(spark, sf_dir):
    rows = D.by_name(D.mysql_rows(mysql_lines(spark, sf_dir), "posts").filter("vals IS NOT NULL"))
    return rows.select(dump_of("file").alias("file"), F.col("row")["id"].cast("long").alias("doc_id"), F.col("row")["lang"].alias("lang"), F.col("row")["text"].alias("text"), F.col("row")["n"].alias("n"))


@fam.query("SELECT count(*) AS rows, count(DISTINCT source) AS skipped FROM documents")
def mysql_dump_stats(spark, sf_dir):
    rows = D.mysql_rows(mysql_lines(spark, sf_dir), "posts")
    return D.read_stats(rows, D.by_name(rows.filter("vals IS NOT NULL")))


@fam.query("SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'by ' || o_custkey ELSE '' END AS byline FROM orders WHERE o_orderkey % 3 < 2")
def sixteen_column_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    empty = F.lit(None).cast("string")
    old = F.array(*[{0: k.cast("string"), 2: F.col("o_orderpriority"), 11: F.concat(F.lit("by "), F.col("o_custkey").cast("string"))}.get(i, empty) for i in range(16)])
    new = F.array(k.cast("string"), F.col("o_orderpriority"), empty, empty, empty)
    vals = F.when(k % 3 == 0, old).when(k % 3 == 1, new).otherwise(F.array(k.cast("string")))
    rows = o.select(F.lit("f").alias("file"), k.alias("no"), F.lit(["id", "title", "published_date", "description", "video_url"]).alias("columns"), vals.alias("vals"))
    r = F.col("row")
    return D.by_name_or_place(rows).select(r["id"].alias("id"), r["title"].alias("title"), F.coalesce(F.try_element_at(r, F.lit("byline")), F.lit("")).alias("byline"))


def copy_lines(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    esc = F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    row = F.concat_ws("\t", F.col("doc_id").cast("string"), F.when(F.expr("doc_id % 6 = 0"), "\\N").otherwise(F.col("lang")), esc)
    rows = d.select(F.col("source").alias("file"), (place + 2).alias("no"), row.alias("line"))
    files = d.select(F.col("source").alias("file")).distinct()
    extra = [(0, "SET transaction_timeout = 0;"), (1, "COPY public.docs (id, lang, body) FROM stdin;"), (2, "narrow"), (10_000_000, "\\."), (10_000_001, "COPY public.users (id) FROM stdin;"), (10_000_002, "1"), (10_000_003, "\\.")]
    fixed = files.crossJoin(spark.sql("SELECT * FROM VALUES " + ", ".join(f"({n}, r\"{t}\")" for n, t in extra) + " AS t(no, line)"))
    return dumped(fixed.select("file", "no", "line").union(rows))


@fam.query("SELECT source AS file, doc_id, CASE WHEN doc_id % 6 > 0 THEN lang END AS lang, text AS body FROM documents")
def copy_dump_scan(spark, sf_dir):
    r = F.col("row")
    return D.copy_rows(copy_lines(spark, sf_dir), "docs").select(dump_of("file").alias("file"), r["id"].cast("long").alias("doc_id"), r["lang"].alias("lang"), r["body"].alias("body"))


@fam.query("SELECT 'docs' AS \"table\", count(*) + count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'users', count(DISTINCT source) FROM documents")
def copy_row_counts(spark, sf_dir):
    return D.copy_counts(D.without_noise(copy_lines(spark, sf_dir)))


@fam.query("SELECT c_custkey, 'INSERT INTO customer (c_custkey, c_name, embedded_at) VALUES (''' || c_custkey || ''', ''' || c_name || ''', NULL) ON CONFLICT (c_custkey) DO UPDATE SET c_name = EXCLUDED.c_name;' AS statement FROM customer")
def export_statements(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(None).cast("timestamp").alias("embedded_at"))
    s = S.insert_statements(c, "customer", "c_custkey", ["embedded_at"])
    return s.select(F.regexp_extract("statement", r"VALUES \('(\d+)'", 1).cast("long").alias("c_custkey"), "statement")


@fam.query("""WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)
SELECT quality, '{"quality":' || quality || ',"rows":[' || string_agg('{"toxic":' || toxic || ',"n":' || n || '}', ',' ORDER BY toxic, n) || ']}' AS report FROM c GROUP BY quality""")
def json_reports(spark, sf_dir):
    counts = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return S.report_json(counts, "quality")


@fam.query("""WITH c AS (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS said FROM conversations GROUP BY 1), w AS (SELECT conv_id, n, regexp_extract_all(said, '\\S+') AS tokens FROM c),
e AS (SELECT conv_id, 0 AS i, 'sources' AS kind, n::VARCHAR AS body FROM w UNION ALL SELECT conv_id, unnest(generate_series(1, len(tokens))), 'token', unnest(tokens) FROM w UNION ALL SELECT conv_id, len(tokens) + 1, 'done', '' FROM w)
SELECT conv_id, (i + 1)::BIGINT AS event_no, kind, body FROM e""")
def answer_events(spark, sf_dir):
    """The events of an answer in order: its sources, a token at a time, the end. Answers are the conversations' openings."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "turn").alias("said"))
    tokens = F.regexp_extract_all("said", F.lit(r"\S+"), F.lit(0))
    event = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("body"))
    events = F.concat(F.array(event("sources", F.col("n").cast("string"))), F.transform(tokens, lambda t: event("token", t)), F.array(event("done", F.lit(""))))
    return c.select("conv_id", F.posexplode(events).alias("i", "e")).select("conv_id", (F.col("i") + 1).cast("long").alias("event_no"), "e.kind", "e.body")


# ---- sheets, question lists, notes -----------------------------------------------------------------------------------


def written(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


SPACED = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@fam.query(f"""SELECT doc_id::VARCHAR AS no, {SPACED.format(c="'  ' || source || '   of ' || lang")} AS head, lang AS tail FROM documents WHERE source <> '' AND lang <> ''""")
def sheet_of_terms(spark, sf_dir):
    """S8: a headerless sheet with spaces to clean, title rows and rows of too few cells, which go."""
    at, d = written(spark, "sheet"), table(spark, sf_dir, "documents")
    row = F.concat_ws(",", F.col("doc_id").cast("string"), F.lit(""), F.lit("x"), F.lit(""), F.concat(F.lit('"  '), "source", F.lit("   of "), "lang", F.lit('"')), F.coalesce("lang", F.lit("")))
    title, short = d.select(F.lit("No,a,b,c,Term,Meaning")).distinct(), d.select(F.concat_ws(",", F.col("doc_id").cast("string"), F.lit("a"), F.lit("b")))
    d.filter("source IS NOT NULL AND lang IS NOT NULL").select(row).union(title).union(short).toDF("value").write.text(at)
    return S.csv_terms(spark, at).select(F.col("c0").alias("no"), F.col("c4").alias("head"), F.col("c5").alias("tail"))


@fam.query("SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN quality END::INT AS quality, toxic::INT AS toxic FROM labels")
def sheet_by_header(spark, sf_dir):
    """S9: typed cells, null where a cell isn't of its type; a sheet that isn't there has no rows."""
    at, kind = written(spark, "sheet"), StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])
    quality = F.when(F.expr("doc_id % 10 > 0"), F.col("quality").cast("string")).otherwise("unknown")
    table(spark, sf_dir, "labels").select("doc_id", quality.alias("quality"), "toxic").write.option("header", True).csv(at)
    return S.csv_by_header(spark, at, kind).unionByName(S.csv_by_header(spark, f"{at}-nowhere", kind))


@fam.query("""SELECT 'q' || item_id AS id, text AS question, item_id % 3 > 0 AS answerable, CASE WHEN item_id % 3 > 0 THEN ['page_' || item_id] ELSE [] END AS gold FROM benchmark""")
def question_lists(spark, sf_dir):
    """S10: files of fifty questions of either layout; gold of questions without an answer is emptied."""
    at, b = written(spark, "questions"), table(spark, sf_dir, "benchmark").withColumn("file", F.expr("item_id div 50"))
    keys, yes, name = F.array(F.concat(F.lit("page_"), F.col("item_id").cast("string"))), F.expr("item_id % 3 > 0").alias("answerable"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id")
    older = F.to_json(F.collect_list(F.struct(name, F.col("text").alias("query"), yes, keys.alias("relevant_ids"))))
    newer = F.to_json(F.struct(F.collect_list(F.struct(name, F.col("text").alias("question"), yes, keys.alias("expected_row_keys"))).alias("questions")))
    b.groupBy("file").agg(F.when(F.col("file") % 2 == 0, older).otherwise(newer).alias("value")).write.partitionBy("file").text(at)
    return S.eval_questions(spark, f"{at}/file=*").select("id", "question", "answerable", "gold")


DIGITS = "translate(turn::VARCHAR, '0123456789', '০১২৩৪৫৬৭৮৯')"


@fam.query(f"""WITH v AS (SELECT conv_id, turn, text || ' ' || {DIGITS} || ' (ক) ' || {DIGITS} AS t FROM conversations),
m AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '[০-৯]+(\\s*\\(ক\\))?')) AS mark, generate_subscripts(regexp_extract_all(t, '[০-৯]+(\\s*\\(ক\\))?'), 1) AS place FROM v),
k AS (SELECT *, TRY_CAST(translate(regexp_replace(mark, '\\s*\\(ক\\)', ''), '০১২৩৪৫৬৭৮৯', '0123456789') AS INT) * CASE WHEN mark LIKE '%(ক)%' THEN -1 ELSE 1 END AS key FROM m),
n AS (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN turn ELSE -turn END AS key, role || turn AS note FROM conversations)
SELECT conv_id, turn, coalesce(list(note ORDER BY place) FILTER (note IS NOT NULL), []) AS notes, count(*) FILTER (note IS NULL) AS orphans FROM k LEFT JOIN n USING (conv_id, key) GROUP BY ALL""")
def notes_by_key(spark, sf_dir):
    """J8: notes by (conversation, number), never by number alone; a marked number is another key than a plain one."""
    c, n = table(spark, sf_dir, "conversations"), T.bengali_digits(F.col("turn"))
    verses = c.select(F.col("conv_id").alias("sura"), F.col("turn").alias("verse"), F.concat("text", F.lit(" "), n, F.lit(" (ক) "), n).alias("text"))
    notes = c.select(F.col("conv_id").alias("sura"), F.when(F.expr("turn % 2 = 0"), F.col("turn")).otherwise(-F.col("turn")).cast("int").alias("key"), F.concat("role", F.col("turn").cast("string")).alias("note"))
    return S.with_notes(verses, notes).select(F.col("sura").alias("conv_id"), F.col("verse").alias("turn"), "notes", "orphans")


@fam.query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer")
def sqlite_round_trip(spark, sf_dir):
    """Customers written as SQLite files, one a task, and read again by ranges of row numbers."""
    spark.dataSource.register(SqliteFiles)
    at = f"{shared_dir(spark)}/sqlite-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.when(F.expr("c_custkey % 5 > 0"), F.col("c_mktsegment")).alias("segment"))
    c.repartition(4, "c_custkey").write.format("sqlite_files").option("table", "legacy customer").mode("append").save(at)
    return spark.read.format("sqlite_files").schema(c.schema).option("table", "legacy customer").option("rows_per_task", 500).load(at)


@fam.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def sqlite_migration_resumed(spark, sf_dir):
    """Line items of a SQLite copy that are new by their natural key: what was migrated before (finished orders) is left
    out by an anti join."""
    spark.dataSource.register(SqliteFiles)
    at = f"{shared_dir(spark)}/sqlite-{uuid.uuid4().hex}"
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"))
    items.write.format("sqlite_files").option("table", "items").mode("append").save(at)
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return spark.read.format("sqlite_files").schema(items.schema).option("table", "items").load(at).join(done, "l_orderkey", "left_anti")

"""Incremental ingest, on orders and line items as content rows and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import ingest as I
from corpusloom.operators.migrations import AddColumn, UniqueKey, migrated
from corpusloom.plans._base import Family, table

fam = Family()
QUERIES, ORACLES = fam.queries, fam.oracles

ROWS_SQL = """content AS (SELECT o_orderkey AS id, 'page_' || o_orderkey AS row_key, o_custkey AS book_id, o_orderdate AS updated_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 1 DAY END AS embedded_at,
 CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'published' END AS status, o_orderpriority = '1-URGENT' AS excluded, o_totalprice AS price, o_orderpriority AS prio FROM orders)"""


def content(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.expr("INTERVAL 1 DAY")
    made = F.when(F.expr("o_orderkey % 3 = 1"), F.col("o_orderdate") - day).when(F.expr("o_orderkey % 3 = 2"), F.col("o_orderdate") + day)
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("page_"), F.col("o_orderkey").cast("string")).alias("row_key"), F.col("o_custkey").alias("book_id"), F.col("o_orderdate").alias("updated_at"), made.alias("embedded_at"),
        F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("excluded"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("prio"),
    )


def chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_extendedprice").alias("body"))


@fam.query(f"WITH {ROWS_SQL} SELECT id, row_key FROM content WHERE status = 'published' AND NOT excluded AND (embedded_at IS NULL OR updated_at > embedded_at)")
def due_rows(spark, sf_dir):
    return content(spark, sf_dir).filter(I.is_due()).select("id", "row_key")


@fam.query(f"WITH {ROWS_SQL} SELECT id, embedded_at IS NOT NULL AND (status <> 'published' OR excluded) AS swept, CASE WHEN NOT (embedded_at IS NOT NULL AND (status <> 'published' OR excluded)) THEN epoch_us(embedded_at) END AS embedded_us, epoch_us(updated_at) AS updated_us FROM content")
def sweep_rows(spark, sf_dir):
    rows = content(spark, sf_dir)
    after, _ = I.swept(rows.withColumn("swept", I.to_sweep()), chunks(spark, sf_dir), "id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return after.select("id", "swept", us("embedded_at").alias("embedded_us"), us("updated_at").alias("updated_us"))


@fam.query(f"WITH {ROWS_SQL} SELECT l_orderkey AS id, l_linenumber AS chunk_index FROM lineitem ANTI JOIN (SELECT id FROM content WHERE embedded_at IS NOT NULL AND (status <> 'published' OR excluded)) s ON s.id = l_orderkey")
def sweep_chunks(spark, sf_dir):
    return I.swept(content(spark, sf_dir), chunks(spark, sf_dir), "id")[1].select("id", "chunk_index")


DUE_SQL = ROWS_SQL + ", due AS (SELECT * FROM content WHERE status = 'published' AND NOT excluded AND (embedded_at IS NULL OR updated_at > embedded_at))"


@fam.query(f"WITH {DUE_SQL} SELECT l_orderkey AS id, l_linenumber AS chunk_index, l_extendedprice AS body FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM due) UNION ALL SELECT id, 1, price FROM due")
def replace_chunks(spark, sf_dir):
    new = content(spark, sf_dir).filter(I.is_due()).select("id", F.lit(1).alias("chunk_index"), F.col("price").alias("body"))
    return I.replaced_chunks(chunks(spark, sf_dir), new, "id")


INCOMING_SQL = "incoming AS (SELECT id + CASE WHEN id % 5 = 0 THEN 1000000000 ELSE 0 END AS id, price + CASE WHEN id % 5 = 1 THEN 1 ELSE 0 END AS price, CASE WHEN id % 5 <> 2 THEN prio END AS prio FROM content WHERE book_id % 2 = 0)"
UPSERT_SQL = f"""WITH {ROWS_SQL}, {INCOMING_SQL}, j AS (SELECT coalesce(c.id, i.id) AS id, c.id IS NOT NULL AS was, i.id IS NOT NULL AS has, c.price AS cp, i.price AS ip, c.prio AS cr, i.prio AS ir, c.status, c.updated_at FROM content c FULL JOIN incoming i ON c.id = i.id),
k AS (SELECT *, has AND was AND (cp IS DISTINCT FROM ip OR cr IS DISTINCT FROM ir OR ({{publish}} AND status <> 'published')) AS changed FROM j),
up AS (SELECT id, CASE WHEN has THEN ip ELSE cp END AS price, CASE WHEN has THEN ir ELSE cr END AS prio, CASE WHEN NOT was THEN {{new}} WHEN has AND {{publish}} THEN 'published' ELSE status END AS status,
 CASE WHEN NOT was OR changed THEN 1704067200000000 ELSE epoch_us(updated_at) END AS updated_us, CASE WHEN NOT was THEN 'inserted' WHEN changed THEN 'updated' WHEN has THEN 'unchanged' ELSE 'kept' END AS action FROM k)"""


def upsert(spark, sf_dir, publish: bool) -> DataFrame:
    rows = content(spark, sf_dir)
    i = F.col("id")
    new = rows.filter("book_id % 2 = 0").select((i + F.when(i % 5 == 0, 1000000000).otherwise(0)).alias("id"), (F.col("price") + F.when(i % 5 == 1, 1).otherwise(0)).alias("price"), F.when(i % 5 != 2, F.col("prio")).alias("prio"))
    return I.upserted(rows, new, ["id"], ["price", "prio"], F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), publish)


@fam.query(UPSERT_SQL.format(publish="false", new="'draft'") + " SELECT id, price, prio, status, updated_us, action FROM up")
def upsert_draft(spark, sf_dir):
    return upsert(spark, sf_dir, False).select("id", "price", "prio", "status", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"), "action")


@fam.query(UPSERT_SQL.format(publish="true", new="'published'") + " SELECT action, status, count(*) AS n FROM up GROUP BY ALL")
def upsert_action_counts(spark, sf_dir):
    return upsert(spark, sf_dir, True).groupBy("action", "status").agg(F.count(F.lit(1)).alias("n"))


@fam.query(f"WITH {ROWS_SQL}, old AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R') SELECT id, CASE WHEN status = 'published' AND id IN (SELECT id FROM old) THEN 'draft' ELSE status END AS status, status = 'published' AND id IN (SELECT id FROM old) AS superseded FROM content")
def supersede_legacy(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return I.superseded(content(spark, sf_dir), old, "id", F.col("status") == "published", F.lit("2024-01-01").cast("timestamp_ntz")).select("id", "status", "superseded")


@fam.query("""SELECT o_orderkey, coalesce(c_name, 'Unknown') AS book, coalesce(n_name, 'Unknown') AS category, coalesce(r_name, 'Unknown') AS chapter FROM orders
 LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def eager_parents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    full = o.join(c, "o_custkey", "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    known = lambda c, name: F.coalesce(c, F.lit("Unknown")).alias(name)
    return full.select("o_orderkey", known("c_name", "book"), known("n_name", "category"), known("r_name", "chapter"))


@fam.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') AND l_suppkey IN (SELECT s_suppkey FROM supplier)")
def migrate_new_rows(spark, sf_dir):
    """Rows that were not migrated before (by natural key) and that are not orphans."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    parents = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").join(done, "l_orderkey", "left_anti").join(parents, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


@fam.query("""SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT doc_id, -1 FROM labels WHERE quality = 0""")
def vector_upsert(spark, sf_dir):
    new = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("vec_id"), F.lit(-1).alias("label"))
    return I.merged_by_key(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label")), new, "vec_id")


DOMAINS_SQL = f"""WITH {ROWS_SQL}, live AS (SELECT * FROM content WHERE status = 'published' AND NOT excluded)"""


@fam.query(DOMAINS_SQL + """ SELECT 'books' AS domain, 'page' AS kind, id, NULL::BIGINT AS embedded_us FROM live UNION ALL SELECT 'books', 'book', c_custkey, NULL FROM customer WHERE c_custkey IN (SELECT book_id FROM live)
 UNION ALL SELECT 'books', 'category', n_nationkey, NULL FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT book_id FROM live))""")
def export_by_domain(spark, sf_dir):
    """Published rows and, by nested semi joins, their parents; embedded_at is not exported."""
    live = content(spark, sf_dir).filter("status = 'published' AND NOT excluded")
    books = table(spark, sf_dir, "customer").join(live.select(F.col("book_id").alias("c_custkey")), "c_custkey", "left_semi")
    cats = table(spark, sf_dir, "nation").join(books.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    row = lambda df, kind, key: df.select(F.lit("books").alias("domain"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.lit(None).cast("long").alias("embedded_us"))
    return row(live, "page", "id").union(row(books, "book", "c_custkey")).union(row(cats, "category", "n_nationkey"))


@fam.query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 4 > 0 THEN source END, ''), 'page_' || doc_id) AS row_key, coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id::INT END, 0) AS chunk_index, coalesce(CASE WHEN lang <> 'fr' THEN lang END, 'Unknown') AS book FROM documents""")
def metadata_defaults(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = F.when(F.expr("doc_id % 4 > 0"), F.col("source"))
    return d.select(
        "doc_id", F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("page_"), F.col("doc_id").cast("string"))).alias("row_key"),
        F.coalesce(F.when(F.expr("doc_id % 3 > 0"), F.col("doc_id").cast("int")), F.lit(0)).alias("chunk_index"), F.coalesce(F.when(F.col("lang") != "fr", F.col("lang")), F.lit("Unknown")).alias("book"),
    )


@fam.query("SELECT doc_id, CASE WHEN n_chars < 80 THEN 'short' WHEN n_chars > 20000 THEN 'long' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'toxic' END AS reason FROM documents")
def reject_reasons(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("bad", F.lit(True))
    d = table(spark, sf_dir, "documents").join(bad, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("n_chars") < 80, "short").when(F.col("n_chars") > 20000, "long").when(F.col("bad"), "toxic").alias("reason"))


@fam.query("SELECT doc_id, text, coalesce(source, 'src0') AS source FROM documents SEMI JOIN (SELECT doc_id, source FROM (SELECT doc_id, source FROM documents WHERE n_chars > 5000)) k USING (doc_id, source)")
def tuple_in_filter(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").filter("n_chars > 5000").select("doc_id", "source")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source").join(keys, ["doc_id", "source"], "left_semi").select("doc_id", "text", F.coalesce("source", F.lit("src0")).alias("source"))


STEPS = [AddColumn("excluded_from_index", "boolean", False), AddColumn("exclusion_reason", "string"), AddColumn("lang", "string", "xx"), UniqueKey(("doc_id",)), UniqueKey(("source", "text"))]


@fam.query("SELECT doc_id, lang, n_chars, false AS excluded_from_index, NULL::VARCHAR AS exclusion_reason FROM documents")
def migrated_documents(spark, sf_dir):
    """Documents after their migration was run three times, once without a ledger: added columns are added once."""
    once, ledger = migrated(table(spark, sf_dir, "documents"), None, STEPS)
    again, _ = migrated(once, ledger, STEPS)
    return migrated(again, None, STEPS)[0].select("doc_id", "lang", "n_chars", "excluded_from_index", "exclusion_reason")


@fam.query("""WITH i AS (SELECT count(*) AS n FROM (SELECT 1 FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1)), t AS (SELECT count(*) AS n FROM (SELECT 1 FROM documents WHERE text IS NOT NULL GROUP BY source, text HAVING count(*) > 1))
SELECT 'add excluded_from_index' AS step, 'applied' AS outcome, 0::BIGINT AS duplicates UNION ALL SELECT 'add exclusion_reason', 'applied', 0 UNION ALL SELECT 'add lang', 'present', 0
UNION ALL SELECT 'unique doc_id', CASE WHEN n > 0 THEN 'skipped' ELSE 'applied' END, n FROM i UNION ALL SELECT 'unique source, text', CASE WHEN n > 0 THEN 'skipped' ELSE 'applied' END, n FROM t""")
def migration_ledger(spark, sf_dir):
    """What the migration of documents says it has done, after a second run over the same table."""
    once, ledger = migrated(table(spark, sf_dir, "documents"), None, STEPS)
    return migrated(once, ledger, STEPS)[1]

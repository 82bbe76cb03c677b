"""Deduplicating and cleaning, on documents, orders and the parts of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import cleaning as C
from corpusloom.plans._base import Family, table

fam = Family()
QUERIES, ORACLES = fam.queries, fam.oracles

STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
CONTENT_HASH = f"md5({STRIP.format(c='text')})"
EXCLUDED = "(doc_id % 10 = 3)"
PAGES_SQL = f"""pages_dim AS (SELECT doc_id, {CONTENT_HASH} AS digest, lang, source, n_chars, {EXCLUDED} AS excluded, CASE WHEN doc_id % 20 = 3 THEN 'orphan' WHEN {EXCLUDED} THEN 'duplicate of canonical' END AS exclusion_reason,
 CASE WHEN doc_id % 4 = 1 THEN 'draft' ELSE 'published' END AS status FROM documents)"""


def pages_dim(spark, sf_dir) -> DataFrame:
    """documents as a content table: digest, excluded, exclusion_reason, status."""
    d = table(spark, sf_dir, "documents")
    reason = F.when(F.expr("doc_id % 20 = 3"), "orphan").when(F.expr(EXCLUDED), "duplicate of canonical")
    status = F.when(F.expr("doc_id % 4 = 1"), "draft").otherwise("published")
    return d.select("doc_id", T.content_hash(F.col("text")).alias("digest"), "lang", "source", "n_chars", F.expr(EXCLUDED).alias("excluded"), reason.alias("exclusion_reason"), status.alias("status"))


@fam.query(f"WITH {PAGES_SQL} SELECT digest, count(*) AS n, list_sort(list(doc_id)) AS ids FROM pages_dim GROUP BY digest HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    return C.duplicate_groups(pages_dim(spark, sf_dir), "doc_id", F.col("digest"))


OVERRIDES_SQL = "overrides AS (SELECT digest, max(doc_id) AS canonical_id FROM pages_dim WHERE lang = 'en' GROUP BY digest HAVING count(*) > 2)"
GROUPS_SQL = f"""WITH {PAGES_SQL}, {OVERRIDES_SQL}, t AS (SELECT *, excluded::INT * 2 + (source <> 'src0')::INT AS tier FROM pages_dim), u AS (SELECT *, min(tier) OVER (PARTITION BY digest) AS best FROM t),
g AS (SELECT digest, count(*) AS n, min(doc_id) FILTER (tier = best) AS by_rule, count(*) FILTER (tier = best) > 1 AS ambiguous, list(doc_id) AS ids FROM u GROUP BY digest HAVING count(*) > 1),
groups AS (SELECT digest, n, CASE WHEN list_contains(ids, canonical_id) THEN canonical_id ELSE by_rule END AS canonical, ambiguous, coalesce(list_contains(ids, canonical_id), false) AS overridden, ambiguous AND NOT coalesce(list_contains(ids, canonical_id), false) AS blocked FROM g LEFT JOIN overrides USING (digest))"""


def groups(spark, sf_dir) -> DataFrame:
    pages = pages_dim(spark, sf_dir)
    overrides = pages.filter("lang = 'en'").groupBy("digest").agg(F.max("doc_id").alias("canonical_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 2").drop("_n")
    return C.canonical_rows(pages, "doc_id", "digest", "excluded", F.col("source") == "src0", overrides)


@fam.query(GROUPS_SQL + " SELECT digest, n, canonical, ambiguous, overridden, blocked FROM groups")
def canonical_row_per_group(spark, sf_dir):
    return groups(spark, sf_dir)


APPLY_SQL = GROUPS_SQL + """, j AS (SELECT p.*, canonical IS NOT NULL AND canonical <> doc_id AS loser, CASE WHEN exclusion_reason IS NULL OR exclusion_reason = '' THEN 'duplicate of canonical' WHEN contains(exclusion_reason, 'duplicate of canonical') THEN exclusion_reason ELSE exclusion_reason || '; duplicate of canonical' END AS new_reason
 FROM pages_dim p LEFT JOIN (SELECT * FROM groups WHERE NOT blocked) USING (digest)),
applied AS (SELECT doc_id, excluded OR loser AS excluded, CASE WHEN loser THEN new_reason ELSE exclusion_reason END AS exclusion_reason, loser AND (NOT excluded OR new_reason IS DISTINCT FROM exclusion_reason) AS changed, excluded AS was FROM j)"""


def applied(spark, sf_dir) -> DataFrame:
    return C.exclude_duplicates(pages_dim(spark, sf_dir), "doc_id", "digest", groups(spark, sf_dir), "duplicate of canonical")


@fam.query(APPLY_SQL + " SELECT doc_id, excluded, exclusion_reason, changed FROM applied")
def apply_duplicate_exclusion(spark, sf_dir):
    return applied(spark, sf_dir).select("doc_id", "excluded", "exclusion_reason", "changed")


@fam.query(APPLY_SQL + """ SELECT (SELECT count(*) FROM groups WHERE NOT blocked AND NOT overridden) AS auto_groups, (SELECT count(*) FROM groups WHERE overridden) AS overridden_groups, (SELECT count(*) FROM groups WHERE blocked) AS blocked_groups,
 count(*) FILTER (was) AS already, count(*) FILTER (excluded AND NOT was) AS newly FROM applied""")
def dedupe_dry_run_report(spark, sf_dir):
    g = groups(spark, sf_dir).agg(F.count_if(~F.col("blocked") & ~F.col("overridden")).alias("auto_groups"), F.count_if("overridden").alias("overridden_groups"), F.count_if("blocked").alias("blocked_groups"))
    a = applied(spark, sf_dir).withColumn("was", F.expr(EXCLUDED)).agg(F.count_if("was").alias("already"), F.count_if(F.col("excluded") & ~F.col("was")).alias("newly"))
    return g.crossJoin(a)


@fam.query(APPLY_SQL + " SELECT d.source, count(*) AS n FROM applied JOIN documents d USING (doc_id) WHERE applied.excluded GROUP BY d.source")
def exclusions_by_source(spark, sf_dir):
    return applied(spark, sf_dir).filter("excluded").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@fam.query("SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def ambiguous_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct("lang").alias("n")).filter("n > 1")


@fam.query("SELECT p_name, list_sort(list(p_partkey)) AS ids, count(*) AS n FROM part SEMI JOIN lineitem ON p_partkey = l_partkey GROUP BY p_name HAVING count(*) > 1")
def duplicate_titles(spark, sf_dir):
    live = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    return live.groupBy("p_name").agg(F.sort_array(F.collect_list("p_partkey")).alias("ids"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@fam.query(f"WITH {PAGES_SQL} SELECT count(*) AS pages, count(*) FILTER (status = 'published') AS published, count(*) FILTER (excluded) AS excluded, count(DISTINCT source) AS books, (SELECT count(*) FROM customer) AS categories, (SELECT count(*) FROM orders) AS chapters FROM pages_dim")
def snapshot_counts(spark, sf_dir):
    p = pages_dim(spark, sf_dir).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "published").alias("published"), F.count_if("excluded").alias("excluded"), F.countDistinct("source").alias("books"))
    return p.crossJoin(table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("categories"))).crossJoin(table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("chapters")))


@fam.query("""WITH c AS (SELECT c_custkey, c_mktsegment AS name, c_nationkey AS lang, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS live FROM customer)
SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY name, lang ORDER BY live DESC, c_custkey) AS kept FROM c QUALIFY kept <> c_custkey""")
def category_merge(spark, sf_dir):
    return C.merged_parents(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", ["c_mktsegment", "c_nationkey"], "o_custkey", F.col("o_orderstatus") == "F")


@fam.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def empty_parents(spark, sf_dir):
    return C.orphans(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select("c_custkey")


@fam.query("SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def correlated_count(spark, sf_dir):
    rows = {"c": table(spark, sf_dir, "customer"), "o": table(spark, sf_dir, "orders")}  # named for this statement only
    return spark.sql("SELECT c_custkey, c_name, (SELECT count(*) FROM {o} WHERE o_custkey = c_custkey) AS n_orders FROM {c}", **rows)


TOKENS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'))"


@fam.query(f"""WITH r AS (SELECT text, lang, min(doc_id) AS id FROM documents GROUP BY text, lang), t AS (SELECT id, lang, {TOKENS} AS s FROM r WHERE len({TOKENS}) > 0)
SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 6) AS jaccard FROM t x JOIN t y ON x.lang = y.lang AND x.id < y.id
 AND least(len(x.s), len(y.s)) >= greatest(len(x.s), len(y.s)) * 0.72 WHERE jaccard >= 0.72""")
def near_duplicate_texts(spark, sf_dir):
    """Of equal texts the first stands for all."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))
    firsts = table(spark, sf_dir, "documents").groupBy("text", "lang").agg(F.min("doc_id").alias("id"))
    return C.near_duplicate_pairs(firsts.select("id", w.alias("w"), "lang"), "id", "w", "lang", 0.72)


@fam.query(f"""WITH RECURSIVE r AS (SELECT doc_id, lang, list_sort({TOKENS}) AS s FROM documents), t AS (SELECT lang, s, min(doc_id) AS id, count(*) AS copies FROM r GROUP BY ALL),
p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS n FROM t x JOIN t y ON x.lang = y.lang AND x.id < y.id AND len(x.s) > 0 AND len(y.s) > 0 AND least(len(x.s), len(y.s)) >= greatest(len(x.s), len(y.s)) * 0.72),
q AS MATERIALIZED (SELECT a, b FROM p WHERE round(i / (n - i), 6) >= 0.72), l AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT r.doc_id, t.id AS representative, t.copies, (SELECT count(*) FROM l WHERE l.a = t.id) AS n_links, coalesce((SELECT least(min(c.b), t.id) FROM c WHERE c.a = t.id), t.id) AS class_id FROM r JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.s = t.s""")
def near_duplicate_classes(spark, sf_dir):
    """Every document with the first of its token set, the links of that set to others, and the class they form."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))
    return C.near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", w.alias("w"), "lang"), "doc_id", "w", "lang", 0.72)


@fam.query(f"""WITH {PAGES_SQL}, reasons AS (SELECT doc_id, 'orphan page' AS reason FROM pages_dim WHERE n_chars < 200 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'low quality' FROM labels WHERE quality = 0)
SELECT doc_id, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM reasons GROUP BY doc_id""")
def union_of_reasons(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    parts = [pages_dim(spark, sf_dir).filter("n_chars < 200").select("doc_id", F.lit("orphan page").alias("reason")), lab.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("reason")), lab.filter("quality = 0").select("doc_id", F.lit("low quality").alias("reason"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias("reasons"))


@fam.query("""SELECT 'both' AS part, doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'only_good', doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'unlabelled', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def set_operations(spark, sf_dir):
    lab, ids = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id")
    good, bad = lab.filter("quality = 1").select("doc_id"), lab.filter("toxic = 1").select("doc_id")
    tag = lambda df, name: df.select(F.lit(name).alias("part"), "doc_id")
    return tag(good.intersect(bad), "both").union(tag(good.subtract(bad), "only_good")).union(tag(ids.subtract(lab.select("doc_id")), "unlabelled"))


@fam.query(APPLY_SQL + """ SELECT 'losers not excluded' AS check_name, count(*) AS violations FROM applied JOIN pages_dim p USING (doc_id) JOIN groups g USING (digest) WHERE NOT blocked AND canonical <> doc_id AND NOT applied.excluded
UNION ALL SELECT 'excluded without reason', count(*) FROM applied WHERE excluded AND exclusion_reason IS NULL UNION ALL SELECT 'missing canonical', count(*) FROM groups WHERE canonical IS NULL""")
def post_conditions(spark, sf_dir):
    g = groups(spark, sf_dir)
    a = applied(spark, sf_dir)
    one = a.join(g.filter("NOT blocked").select("digest", "canonical"), "digest").filter("canonical <> doc_id AND NOT excluded").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("losers not excluded").alias("check_name"), "violations")
    two = a.filter("excluded AND exclusion_reason IS NULL").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("excluded without reason").alias("check_name"), "violations")
    three = g.filter("canonical IS NULL").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("missing canonical").alias("check_name"), "violations")
    return one.union(two).union(three)


@fam.query("""WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY lang, source) AS f FROM documents)
SELECT doc_id, lang, source, turn, row_number() OVER (ORDER BY turn, f, doc_id) AS place FROM t""")
def round_robin_interleave(spark, sf_dir):
    return C.interleaved(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id").select("doc_id", "lang", "source", "turn", "place")


@fam.query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, CASE WHEN n <= 1 THEN 'unknown' WHEN pos / (n - 1) <= 0.33 THEN 'early' WHEN pos / (n - 1) <= 0.66 THEN 'mid' ELSE 'late' END AS bucket FROM p""")
def position_bucket(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("source")
    p = table(spark, sf_dir, "documents").select("doc_id", (F.row_number().over(by.orderBy("doc_id")) - 1).alias("pos"), F.count(F.lit(1)).over(by).alias("n"))
    at = F.col("pos") / (F.col("n") - 1)
    return p.select("doc_id", F.when(F.col("n") <= 1, "unknown").when(at <= 0.33, "early").when(at <= 0.66, "mid").otherwise("late").alias("bucket"))


@fam.query(r"""WITH k AS (SELECT doc_id, CASE WHEN regexp_matches(text, '^\s*[#*$%&|<>]') THEN 'stub' WHEN n_chars < 80 THEN 'short' ELSE 'none' END AS kind FROM documents)
SELECT kind, count(*) AS n, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM k GROUP BY kind""")
def defect_breakdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("text").rlike(r"^\s*[#*$%&|<>]"), "stub").when(F.col("n_chars") < 80, "short").otherwise("none")
    lab = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    return d.join(lab, "doc_id", "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has").isNull()).alias("unlabelled"))


@fam.query("""WITH l AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0)
SELECT doc_id, doc_id IN (SELECT doc_id FROM l) OR doc_id % 10 = 3 AS excluded, doc_id IN (SELECT doc_id FROM l) AND NOT doc_id % 10 = 3 AS changed, vec_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM l) AS chunk_kept FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def apply_exclusion_list(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    bad = lab.filter("toxic = 1").select("doc_id").union(lab.filter("quality = 0").select("doc_id")).distinct().withColumn("listed", F.lit(True))
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has_chunk")).join(bad, "doc_id", "left_anti")
    d = table(spark, sf_dir, "documents").select("doc_id").join(bad, "doc_id", "left").join(chunks, "doc_id", "left")
    listed, before = F.coalesce("listed", F.lit(False)), F.expr("doc_id % 10 = 3")
    return d.select("doc_id", (listed | before).alias("excluded"), (listed & ~before).alias("changed"), F.coalesce("has_chunk", F.lit(False)).alias("chunk_kept"))


@fam.query("""SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars < 80""")
def bad_id_set(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.filter("quality = 0").select("doc_id").union(lab.filter("toxic = 1").select("doc_id")).union(table(spark, sf_dir, "documents").filter("n_chars < 80").select("doc_id")).distinct()


@fam.query(f"""WITH {PAGES_SQL} SELECT doc_id FROM pages_dim p JOIN documents USING (doc_id) WHERE NOT p.excluded AND status = 'published' AND length({STRIP.format(c='text')}) >= 600 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND doc_id IN (SELECT vec_id FROM embeddings)""")
def sample_eligibility(spark, sf_dir):
    p = pages_dim(spark, sf_dir).filter("NOT excluded AND status = 'published'").select("doc_id")
    d = table(spark, sf_dir, "documents").filter(F.length(T.strip(F.col("text"))) >= 600).select("doc_id")
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    live = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return p.join(d, "doc_id", "left_semi").join(bad, "doc_id", "left_anti").join(live, "doc_id", "left_semi")


@fam.query("WITH s AS (SELECT DISTINCT o_custkey AS serial FROM orders WHERE o_orderstatus = 'P') SELECT r.i AS missing FROM (SELECT unnest(range(1, (SELECT max(serial) + 1 FROM s))) AS i) r ANTI JOIN s ON s.serial = r.i")
def serial_gaps(spark, sf_dir):
    s = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("missing")).distinct()
    top = s.agg(F.max("missing")).first()[0] or 0  # one number
    return spark.range(1, top + 1).toDF("missing").join(s, "missing", "left_anti")

"""Evaluation of the hybrid retriever, of gates and of classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluation as E
from corpusloom.operators import retrieval as R
from corpusloom.operators.containment import contained
from corpusloom.operators.graphs import kept
from corpusloom.plans import retrieval as P
from corpusloom.plans._base import Family, table

fam = Family()
QUERIES, ORACLES = fam.queries, fam.oracles

KS = [1, 3, 5, 10]


def gold(spark, sf_dir) -> DataFrame:
    """Documents that hold a question, whole; written down, since most readers need them several times."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return kept(contained(d, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "doc_id"), "gold")


GOLD = "gold AS (SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
RANKED = P.HYBRID_SQL + f", {GOLD}"
METRICS = RANKED + """, g AS (SELECT item_id, count(*) AS n_gold FROM gold GROUP BY 1), n AS (SELECT item_id, max(rank) AS n FROM ranked GROUP BY 1),
h AS (SELECT r.item_id, r.rank FROM ranked r SEMI JOIN gold USING (item_id, doc_id)),
m AS (SELECT g.item_id, k, n_gold, (count(h.rank) > 0)::INT::DOUBLE AS hit, round(count(h.rank) / n_gold, 6) AS recall, round(coalesce(1.0::DOUBLE / min(h.rank), 0), 6) AS mrr,
 round(CASE WHEN least(coalesce(any_value(n.n), 0), k) > 0 THEN count(h.rank) / least(any_value(n.n), k) ELSE 0 END, 6) AS precision
 FROM g CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) LEFT JOIN n USING (item_id) LEFT JOIN h ON h.item_id = g.item_id AND h.rank <= k GROUP BY g.item_id, k, n_gold)"""


def metrics(spark, sf_dir) -> DataFrame:
    return E.metrics_at(P.hybrid(spark, sf_dir).select("item_id", "doc_id", "rank"), gold(spark, sf_dir), "item_id", "doc_id", KS)


@fam.query(f"WITH {GOLD} SELECT item_id, doc_id FROM gold")
def gold_match_join(spark, sf_dir):
    return gold(spark, sf_dir)


@fam.query(METRICS + " SELECT item_id, k, n_gold, hit, recall, mrr, precision FROM m")
def metrics_at_k(spark, sf_dir):
    return metrics(spark, sf_dir)


@fam.query(METRICS + " SELECT k, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(precision), 6) AS precision FROM m GROUP BY k")
def mean_metrics(spark, sf_dir):
    return E.mean_of(metrics(spark, sf_dir), "k")


SLICES = "CASE item_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'follow_up' ELSE 'mixed' END"


@fam.query(METRICS + f""", s AS (SELECT *, {SLICES} AS slice, 'c' || (item_id % 2) AS category FROM m)
SELECT slice, category, k, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM s GROUP BY GROUPING SETS ((slice, k), (category, k))""")
def breakdown_grouping_sets(spark, sf_dir):
    s = metrics(spark, sf_dir).withColumn("slice", F.expr(SLICES)).withColumn("category", F.concat(F.lit("c"), (F.col("item_id") % 2).cast("string")))
    cols = [F.col("slice"), F.col("category"), F.col("k")]
    return s.groupingSets([[cols[0], cols[2]], [cols[1], cols[2]]], *cols).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "mrr")])


@fam.query(RANKED + """, b AS (SELECT g.item_id, min(r.rank) AS best_pool_rank FROM gold g LEFT JOIN ranked r USING (item_id, doc_id) GROUP BY 1)
SELECT item_id, best_pool_rank, CASE WHEN best_pool_rank IS NULL THEN 'retrieval loss' ELSE 'rerank loss' END AS loss FROM b WHERE best_pool_rank IS NULL OR best_pool_rank > 1""")
def miss_analysis(spark, sf_dir):
    return E.misses(gold(spark, sf_dir), P.hybrid(spark, sf_dir).select("item_id", "doc_id", "rank"), "item_id", "doc_id", 1)


# ---- scores of first hits --------------------------------------------------------------------------------------------

TOP_SQL = P.RERANK_SQL + f""", {GOLD}, answerable AS (SELECT DISTINCT item_id FROM gold),
best AS (SELECT item_id, arg_max(rerank_score, rerank_score * 1000 - new_rank) AS top_score, arg_max(doc_id, rerank_score * 1000 - new_rank) AS top_doc FROM scored GROUP BY 1),
tops AS (SELECT b.item_id, a.item_id IS NOT NULL AS answerable, round(top_score, 3) AS top_score, top_doc, CASE WHEN a.item_id IS NOT NULL THEN EXISTS (SELECT 1 FROM gold g WHERE g.item_id = b.item_id AND g.doc_id = best.top_doc) END AS top_is_gold
 FROM benchmark b LEFT JOIN best USING (item_id) LEFT JOIN answerable a USING (item_id))"""


def tops(spark, sf_dir) -> DataFrame:
    """item_id, answerable, top_score (null where nothing was found), top_doc, top_is_gold (null where unlabelled); a row a
    question, written down."""
    found = R.reranked(P.hybrid_reranked(spark, sf_dir), "item_id", 1).select("item_id", F.round("rerank_score", 3).alias("top_score"), F.col("doc_id").alias("top_doc"))
    g = gold(spark, sf_dir)
    one = table(spark, sf_dir, "benchmark").select("item_id").join(found, "item_id", "left").join(g.select("item_id").distinct().withColumn("answerable", F.lit(True)), "item_id", "left")
    right = g.select("item_id", F.col("doc_id").alias("top_doc")).distinct().withColumn("right", F.lit(True))
    yes = F.coalesce("answerable", F.lit(False))
    said = one.join(right, ["item_id", "top_doc"], "left").select("item_id", yes.alias("answerable"), "top_score", "top_doc", F.when(yes, F.coalesce("right", F.lit(False))).alias("top_is_gold"))
    return kept(said, "tops")


@fam.query(TOP_SQL + " SELECT item_id, answerable, top_score, top_doc, top_is_gold FROM tops")
def top_per_question(spark, sf_dir):
    return tops(spark, sf_dir)


COUNTS = "count(*) FILTER (answerable AND coalesce(top_score >= {t}, false)) AS tp, count(*) FILTER (answerable AND NOT coalesce(top_score >= {t}, false)) AS fn, count(*) FILTER (NOT answerable AND coalesce(top_score >= {t}, false)) AS fp, count(*) FILTER (NOT answerable AND NOT coalesce(top_score >= {t}, false)) AS tn"
RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) {e} END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) {e} END, 4) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) {e} END, 4) AS f1, round(CASE WHEN tp + fn + fp + tn > 0 THEN (tp + tn) / (tp + fn + fp + tn) {e} END, 4) AS accuracy"""


@fam.query(TOP_SQL + f", c AS (SELECT {COUNTS.format(t=0.5)} FROM tops) SELECT *, {RATES.format(e='')} FROM c")
def gate_confusion(spark, sf_dir):
    return E.rates(tops(spark, sf_dir).agg(*E.confusion(F.lit(0.5))), None)


SWEEP_SQL = TOP_SQL + f""", v AS (SELECT DISTINCT top_score AS s FROM tops WHERE top_score IS NOT NULL),
t AS (SELECT DISTINCT round(x, 6) AS threshold FROM (SELECT (s + lead(s) OVER (ORDER BY s)) / 2 AS x FROM v UNION ALL SELECT min(s) - 0.01 FROM v UNION ALL SELECT max(s) + 0.01 FROM v) WHERE x IS NOT NULL),
c AS (SELECT threshold, {COUNTS.format(t='threshold')} FROM t CROSS JOIN tops GROUP BY threshold), sweep AS (SELECT *, {RATES.format(e='ELSE 0')} FROM c)"""


@fam.query(SWEEP_SQL + " SELECT threshold, tp, fn, fp, tn, precision, recall, f1, accuracy FROM sweep")
def threshold_sweep(spark, sf_dir):
    return E.sweep(tops(spark, sf_dir))


@fam.query(SWEEP_SQL + """ SELECT 'balanced' AS pick, threshold, f1, fp, fn FROM (SELECT * FROM sweep ORDER BY f1 DESC, fp + fn, threshold LIMIT 1)
UNION ALL SELECT 'conservative', threshold, f1, fp, fn FROM (SELECT * FROM sweep ORDER BY fp, fn, threshold LIMIT 1)""")
def threshold_picks(spark, sf_dir):
    swept = E.sweep(tops(spark, sf_dir)).persist()
    cols = ["threshold", "f1", "fp", "fn"]
    return E.balanced(swept).select(F.lit("balanced").alias("pick"), *cols).union(E.conservative(swept).select(F.lit("conservative").alias("pick"), *cols))


@fam.query(TOP_SQL + """ SELECT answerable, count(top_score) AS n, round(min(top_score), 6) AS lo, round(quantile_cont(top_score, 0.25), 6) AS p25, round(quantile_cont(top_score, 0.5), 6) AS median, round(quantile_cont(top_score, 0.75), 6) AS p75, round(max(top_score), 6) AS hi FROM tops GROUP BY answerable""")
def score_quantiles(spark, sf_dir):
    q = F.percentile("top_score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = tops(spark, sf_dir).groupBy("answerable").agg(F.count("top_score").alias("n"), F.min("top_score").alias("lo"), q.alias("q"), F.max("top_score").alias("hi"))
    return d.select("answerable", "n", F.round("lo", 6).alias("lo"), *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("p25", "median", "p75"))], F.round("hi", 6).alias("hi"))


@fam.query(TOP_SQL + """, e AS (SELECT min(top_score) FILTER (answerable) AS a, max(top_score) FILTER (answerable) AS b, min(top_score) FILTER (NOT answerable) AS c, max(top_score) FILTER (NOT answerable) AS d, median(top_score) FILTER (answerable) AS m, median(top_score) FILTER (NOT answerable) AS n FROM tops)
SELECT any_value(a > d) AS clean_split, any_value(round(m - n, 4)) AS median_gap, count(*) FILTER (top_score BETWEEN greatest(a, c) AND least(b, d)) AS inside, any_value(round(m - n, 4) < 0.15) AS heavy FROM e CROSS JOIN tops""")
def overlap_report(spark, sf_dir):
    return E.overlap(tops(spark, sf_dir))


@fam.query(TOP_SQL + """ SELECT count(*) AS n, round(count(*) FILTER (top_score IS NOT NULL) / count(*), 6) AS raw_rate, round(count(*) FILTER (top_score >= 0.5) / count(*), 6) AS gated_rate FROM tops WHERE NOT answerable""")
def false_positive_rates(spark, sf_dir):
    """Where every question has an answer there is nothing to take a share of: the rates are NaN, as in SQL."""
    n = F.count(F.lit(1))
    rate = lambda c: F.coalesce(F.round(F.try_divide(F.count_if(c), n), 6), F.lit(float("nan")))
    unanswerable = tops(spark, sf_dir).filter("NOT answerable")
    return unanswerable.agg(n.alias("n"), rate(F.col("top_score").isNotNull()).alias("raw_rate"), rate(F.col("top_score") >= 0.5).alias("gated_rate"))


@fam.query(TOP_SQL + """, m AS (SELECT *, (top_score >= 0.5) IS TRUE AS got FROM tops) SELECT answerable, got, count(*) AS n, sum((got = answerable)::INT)::BIGINT AS matches FROM m GROUP BY ALL""")
def expectation_match(spark, sf_dir):
    m = tops(spark, sf_dir).withColumn("got", F.coalesce(F.col("top_score") >= 0.5, F.lit(False)))
    return m.groupBy("answerable", "got").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("got") == F.col("answerable")).alias("matches"))


@fam.query(RANKED + """, pages AS (SELECT item_id, source, min(rank) AS best FROM ranked JOIN documents USING (doc_id) GROUP BY ALL)
SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY best, source) AS rank FROM pages WHERE item_id NOT IN (SELECT item_id FROM gold) QUALIFY rank <= 10""")
def label_candidates(spark, sf_dir):
    paged = P.met(P.hybrid(spark, sf_dir), P.corpus(spark, sf_dir).select("doc_id", "source"))
    unlabelled = paged.join(gold(spark, sf_dir).select("item_id").distinct(), "item_id", "left_anti")
    return R.first_of_page(unlabelled, "item_id", "source", 10).select("item_id", "source", "rank")


@fam.query(f"""WITH {P.bm25_sql('w', P.WORD_TOKENS, 25)}, {P.bm25_sql('x', P.PREFIX_TOKENS, 25)}, {GOLD},
h AS (SELECT 'on' AS arm, item_id, min(rank) AS r FROM w_top SEMI JOIN gold USING (item_id, doc_id) GROUP BY ALL UNION ALL SELECT 'off', item_id, min(rank) FROM x_top SEMI JOIN gold USING (item_id, doc_id) GROUP BY ALL),
q AS (SELECT DISTINCT item_id FROM gold),
s AS (SELECT arm, k, q.item_id, (h.r <= k) IS TRUE AS hit, CASE WHEN h.r <= k THEN 1.0::DOUBLE / h.r ELSE 0 END AS mrr FROM q CROSS JOIN (VALUES ('on'), ('off')) a(arm) CROSS JOIN (SELECT unnest([1, 5, 25]) AS k) LEFT JOIN h USING (arm, item_id)),
m AS (SELECT arm, k, avg(hit::INT) AS hit, avg(mrr) AS mrr FROM s GROUP BY ALL)
SELECT k, round(a.hit - b.hit, 6) + 0 AS hit_delta, round(a.mrr - b.mrr, 6) + 0 AS mrr_delta FROM (SELECT * FROM m WHERE arm = 'on') a JOIN (SELECT * FROM m WHERE arm = 'off') b USING (k)""")
def ablation_delta(spark, sf_dir):
    g, both = gold(spark, sf_dir), kept(P.legs(spark, sf_dir, "words", "prefixes"), "legs")
    arms = None
    for arm, cut in (("on", "words"), ("off", "prefixes")):
        m = E.metrics_at(both.filter(F.col("cut") == cut).select("item_id", "doc_id", "rank"), g, "item_id", "doc_id", [1, 5, 25]).withColumn("arm", F.lit(arm))
        arms = m if arms is None else arms.unionByName(m)
    wide = arms.groupBy("k").pivot("arm", ["on", "off"]).agg(F.avg("hit").alias("hit"), F.avg(F.col("mrr")).alias("mrr"))
    return wide.select("k", (F.round(F.col("on_hit") - F.col("off_hit"), 6) + 0.0).alias("hit_delta"), (F.round(F.col("on_mrr") - F.col("off_mrr"), 6) + 0.0).alias("mrr_delta"))


# ---- runs of classifiers and generators, on the event log ------------------------------------------------------------

#: The four real modes.
MODES = ["QA", "NOTE", "ROLEPLAY", "SUGGESTION"]
RUNS = """runs AS (SELECT event_id, user_id % 3 AS model, ['QA', 'NOTE', 'ROLEPLAY', 'SUGGESTION'][1 + event_id % 4] AS expected,
 CASE event_type WHEN 'view' THEN 'QA' WHEN 'click' THEN 'NOTE' WHEN 'signup' THEN 'ROLEPLAY' WHEN 'purchase' THEN 'SUGGESTION' END AS actual, value, json_extract(props, '$.k')::INT AS k FROM events)"""


def model_runs(spark, sf_dir) -> DataFrame:
    """event_id, model, expected, actual (null: an error), value (seconds), k (tokens)."""
    e = table(spark, sf_dir, "events")
    actual = F.when(F.col("event_type") == "view", "QA").when(F.col("event_type") == "click", "NOTE").when(F.col("event_type") == "signup", "ROLEPLAY").when(F.col("event_type") == "purchase", "SUGGESTION")
    expected = F.element_at(F.lit(MODES), (1 + F.col("event_id") % 4).cast("int"))
    return e.select("event_id", (F.col("user_id") % 3).alias("model"), expected.alias("expected"), actual.alias("actual"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@fam.query(f"WITH {RUNS} SELECT expected, count(*) FILTER (actual = 'QA') AS QA, count(*) FILTER (actual = 'NOTE') AS NOTE, count(*) FILTER (actual = 'ROLEPLAY') AS ROLEPLAY, count(*) FILTER (actual = 'SUGGESTION') AS SUGGESTION FROM runs GROUP BY expected")
def intent_confusion(spark, sf_dir):
    return model_runs(spark, sf_dir).groupBy("expected").pivot("actual", MODES).count().na.fill(0)


@fam.query(f"WITH {RUNS} SELECT model, count(*) AS n, round(avg((actual = expected)::INT), 6) AS accuracy, round(avg(value), 6) AS mean_seconds FROM runs WHERE actual IS NOT NULL GROUP BY model")
def intent_accuracy(spark, sf_dir):
    r = model_runs(spark, sf_dir).filter("actual IS NOT NULL")
    return r.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("actual") == F.col("expected")).cast("int")), 6).alias("accuracy"), F.round(F.avg("value"), 6).alias("mean_seconds"))


@fam.query(f"""WITH {RUNS} SELECT model, count(*) AS n, count(*) FILTER (actual IS NULL) AS errors, round(avg(CASE WHEN actual IS NOT NULL THEN (k % 10 <> 0)::INT END), 6) AS valid_rate,
 round(avg(CASE WHEN actual IS NOT NULL AND k < 20 THEN (k % 2 = 0)::INT END), 6) AS refusal_rate, round(sum(k * 0.15 + value * 0.6) / 1e6, 9) AS cost FROM runs GROUP BY model""")
def model_ab_summary(spark, sf_dir):
    ok = F.col("actual").isNotNull()
    return model_runs(spark, sf_dir).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("errors"), F.round(F.avg(F.when(ok, (F.col("k") % 10 != 0).cast("int"))), 6).alias("valid_rate"),
        F.round(F.avg(F.when(ok & (F.col("k") < 20), (F.col("k") % 2 == 0).cast("int"))), 6).alias("refusal_rate"), F.round(F.sum(F.col("k") * 0.15 + F.col("value") * 0.6) / 1e6, 9).alias("cost"),
    )


@fam.query(f"WITH {RUNS}, v AS (SELECT model, list_sort(list(value)) AS vs FROM runs GROUP BY model) SELECT model, round(list_avg(vs), 6) AS mean, vs[len(vs) // 2 + 1] AS upper_median, vs[1] AS least FROM v")
def mean_upper_median_min(spark, sf_dir):
    runs = model_runs(spark, sf_dir)
    return runs.groupBy("model").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least")).join(E.upper_medians(runs, "model", "value"), "model")


@fam.query(f"WITH {RUNS} SELECT model, metric, event_id, x FROM (SELECT model, 'slow' AS metric, event_id, value AS x, row_number() OVER (PARTITION BY model ORDER BY value DESC, event_id) AS r FROM runs UNION ALL SELECT model, 'tokens', event_id, k, row_number() OVER (PARTITION BY model ORDER BY k DESC, event_id) FROM runs) WHERE r <= 5")
def worst_k(spark, sf_dir):
    r = model_runs(spark, sf_dir)
    long = r.select("model", "event_id", F.explode(F.create_map(F.lit("slow"), F.col("value"), F.lit("tokens"), F.col("k").cast("double"))).alias("metric", "x"))
    by = Window.partitionBy("model", "metric").orderBy(F.desc("x"), "event_id")
    return long.withColumn("r", F.row_number().over(by)).filter("r <= 5").select("model", "metric", "event_id", "x")


@fam.query(f"""WITH {RUNS}, m AS (SELECT model, avg((actual = expected)::INT) AS hit, avg((actual IS NOT NULL)::INT) AS recall FROM runs GROUP BY model), base AS (SELECT hit AS b FROM m WHERE model = 0)
SELECT model, round(hit, 6) AS hit, round(hit - b, 6) + 0 AS gain, hit - b > 0.02 AND hit = (SELECT max(hit) FROM m) AS winner FROM m CROSS JOIN base""")
def winner_with_margin(spark, sf_dir):
    m = model_runs(spark, sf_dir).groupBy("model").agg(F.avg((F.col("actual") == F.col("expected")).cast("int")).alias("hit"))
    base = m.filter("model = 0").select(F.col("hit").alias("b"))
    best = m.agg(F.max("hit").alias("top"))
    return m.crossJoin(base).crossJoin(best).select("model", F.round("hit", 6).alias("hit"), (F.round(F.col("hit") - F.col("b"), 6) + 0.0).alias("gain"), ((F.col("hit") - F.col("b") > 0.02) & (F.col("hit") == F.col("top"))).alias("winner"))


@fam.query("""WITH t(slice, target) AS (VALUES ('en', 0.6), ('fr', 0.15), ('de', 0.15), ('bn', 0.1)), c AS (SELECT lang AS slice, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT count(*) AS total FROM documents)
SELECT slice, target::DOUBLE AS target, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 6) AS share, abs(coalesce(n, 0) / total - target) > 0.05 AS drift FROM t LEFT JOIN c USING (slice) CROSS JOIN s""")
def slice_share_vs_target(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    targets = spark.sql("SELECT * FROM VALUES ('en', 0.6D), ('fr', 0.15D), ('de', 0.15D), ('bn', 0.1D) AS t(slice, target)")
    counts, total = d.groupBy(F.col("lang").alias("slice")).agg(F.count(F.lit(1)).alias("n")), d.agg(F.count(F.lit(1)).alias("total"))
    share = F.coalesce("n", F.lit(0)) / F.col("total")
    return targets.join(counts, "slice", "left").crossJoin(total).select("slice", "target", F.coalesce("n", F.lit(0)).alias("n"), F.round(share, 6).alias("share"), (F.abs(share - F.col("target")) > 0.05).alias("drift"))


@fam.query("""WITH l(lang) AS (VALUES ('en'), ('fr'), ('bn')), q AS (SELECT lang, quality FROM documents JOIN labels USING (doc_id))
SELECT l.lang, count(quality) AS n_labelled, round(coalesce(avg(quality), 0), 6) AS rate, count(quality) < 10 AS weak FROM l LEFT JOIN q USING (lang) GROUP BY l.lang""")
def language_breakdown(spark, sf_dir):
    langs = spark.sql("SELECT * FROM VALUES ('en'), ('fr'), ('bn') AS l(lang)")
    q = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "quality")
    return langs.join(q, "lang", "left").groupBy("lang").agg(F.count("quality").alias("n_labelled"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("rate"), (F.count("quality") < 10).alias("weak"))


@fam.query("""WITH f AS (SELECT doc_id, doc_id // 3 AS family, lang, quality FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
g AS (SELECT family, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7' || family)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT family, lang FROM f))
SELECT doc_id, family, lang, CASE WHEN r <= CASE WHEN n >= 2 THEN floor(n * 0.3 + 0.5) ELSE 0 END THEN 'test' ELSE 'train' END AS part FROM f JOIN g USING (family, lang)""")
def stratified_family_split(spark, sf_dir):
    f = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select("doc_id", F.expr("doc_id div 3").alias("family"), "lang")
    return E.family_split(f, "doc_id", "family", ["lang"], 0.3, "7").select("doc_id", "family", "lang", "part")


@fam.query("""WITH gold AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1), rest AS (SELECT doc_id FROM documents ANTI JOIN gold USING (doc_id) ORDER BY md5('s' || doc_id), doc_id LIMIT 50)
SELECT doc_id, true AS is_gold FROM documents SEMI JOIN gold USING (doc_id) UNION ALL SELECT doc_id, false FROM rest""")
def sample_keeping_gold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    wanted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 1").select("doc_id")
    rest = d.join(wanted, "doc_id", "left_anti").orderBy(F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(50)
    return d.join(wanted, "doc_id", "left_semi").withColumn("is_gold", F.lit(True)).union(rest.withColumn("is_gold", F.lit(False)))


@fam.query("""WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'page_' || o_custkey ELSE 'article_' || o_orderkey END AS row_key FROM orders)
SELECT o_orderkey, row_key, c_name AS title, c_mktsegment AS chapter FROM k JOIN customer ON starts_with(row_key, 'page_') AND c_custkey = split_part(row_key, '_', 2)::BIGINT
UNION ALL SELECT o_orderkey, row_key, 'part ' || p_name, 'article' FROM k JOIN part ON starts_with(row_key, 'article_') AND p_partkey = split_part(row_key, '_', 2)::BIGINT""")
def gold_by_mixed_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("page_"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("article_"), F.col("o_orderkey").cast("string")))
    k = o.select("o_orderkey", key.alias("row_key")).withColumn("id", F.split_part("row_key", F.lit("_"), F.lit(2)).cast("long"))
    pages = k.filter("startswith(row_key, 'page_')").join(table(spark, sf_dir, "customer"), F.col("id") == F.col("c_custkey")).select("o_orderkey", "row_key", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("chapter"))
    articles = k.filter("startswith(row_key, 'article_')").join(table(spark, sf_dir, "part"), F.col("id") == F.col("p_partkey")).select("o_orderkey", "row_key", F.concat(F.lit("part "), "p_name").alias("title"), F.lit("article").alias("chapter"))
    return pages.union(articles)


@fam.query("""SELECT lang, count(*) AS n, sum(ceil(length(text) / 1.5))::BIGINT AS tokens, round(sum(ceil(length(text) / 1.5)) * 0.15 / 1e6, 9) AS cost FROM documents GROUP BY lang""")
def cost_estimate(spark, sf_dir):
    t = F.sum(F.ceil(F.length("text") / 1.5))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), t.cast("long").alias("tokens"), F.round(t * 0.15 / 1e6, 9).alias("cost"))


@fam.query()
def chunk_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    configs = {"900/150": (900, 150), "1200/200": (1200, 200), "600/100": (600, 100)}
    out = None
    for name, (size, overlap) in configs.items():
        n = d.select(F.size(T.chunker(size, overlap)("text")).alias("n")).agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("chunks"), F.round(F.avg("n"), 4).alias("per_page")).withColumn("config", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out

"""Evaluating rankings, gates and classifiers, in long form: one row per query, stage, k and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranks import selected


def metrics_at(ranked: DataFrame, gold: DataFrame, query: str, key: str, ks: list[int]) -> DataFrame:
    """query, k, n_gold, hit, recall, mrr, precision for every query with gold keys. Recall divides by distinct gold
    keys, precision by what was returned, up to k."""
    own = gold.select(query, key).distinct()
    golds = own.groupBy(query).agg(F.count(F.lit(1)).alias("n_gold"))
    returned = ranked.groupBy(query).agg(F.max("rank").alias("n"))
    hits = ranked.join(own, [query, key], "left_semi").groupBy(query).agg(F.collect_list("rank").alias("ranks"))
    each = golds.join(returned, query, "left").join(hits, query, "left").withColumn("k", F.explode(F.lit(ks)))
    inside = F.filter(F.coalesce("ranks", F.array().cast("array<int>")), lambda r: r <= F.col("k"))
    shown = F.least(F.coalesce("n", F.lit(0)), F.col("k"))
    return each.select(
        query,
        "k",
        "n_gold",
        (F.size(inside) > 0).cast("double").alias("hit"),
        F.round(F.size(inside) / F.col("n_gold"), 6).alias("recall"),
        F.round(F.when(F.size(inside) > 0, 1.0 / F.array_min(inside)).otherwise(0.0), 6).alias("mrr"),
        F.round(F.when(shown > 0, F.size(inside) / shown).otherwise(0.0), 6).alias("precision"),
    )


def mean_of(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over scorable queries; 0 where there are none."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[mean(c) for c in ("hit", "recall", "mrr", "precision")])


def misses(gold: DataFrame, pool: DataFrame, query: str, key: str, top: int) -> DataFrame:
    """Queries without a gold key in the first `top`: lost by the reranker if the pool holds one, else by retrieval."""
    own = gold.select(query, key).distinct()
    best = own.join(pool, [query, key], "left").groupBy(query).agg(F.min("rank").alias("best_pool_rank"))
    lost = best.filter(F.col("best_pool_rank").isNull() | (F.col("best_pool_rank") > top))
    return lost.withColumn("loss", F.when(F.col("best_pool_rank").isNull(), "retrieval loss").otherwise("rerank loss"))


def cleared(score: Column, threshold: Column) -> Column:
    """A missing score does not clear a gate."""
    return F.coalesce(score >= threshold, F.lit(False))


def confusion(threshold: Column, answerable: str = "answerable", score: str = "top_score") -> list[Column]:
    ok, yes = cleared(F.col(score), threshold), F.col(answerable)
    return [F.count_if(yes & ok).alias("tp"), F.count_if(yes & ~ok).alias("fn"), F.count_if(~yes & ok).alias("fp"), F.count_if(~yes & ~ok).alias("tn")]


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double")), 4)


def rates(counted: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """precision, recall, f1 and accuracy of tp, fn, fp, tn."""
    c = F.col
    p, r = ratio(c("tp"), c("tp") + c("fp"), empty), ratio(c("tp"), c("tp") + c("fn"), empty)
    f1 = F.round(F.when(2 * c("tp") + c("fp") + c("fn") > 0, 2 * c("tp") / (2 * c("tp") + c("fp") + c("fn"))).otherwise(F.lit(empty).cast("double")), 4)
    return counted.withColumns({"precision": p, "recall": r, "f1": f1, "accuracy": ratio(c("tp") + c("tn"), c("tp") + c("fn") + c("fp") + c("tn"), empty)})


def candidate_thresholds(scores: DataFrame, score: str = "top_score") -> DataFrame:
    """Just below the least score, the midpoints between distinct scores, just above the largest; rounded to 6."""
    distinct = scores.filter(F.col(score).isNotNull()).select(F.col(score).alias("s")).distinct()
    by = Window.orderBy("s")  # as many rows as distinct rounded scores
    mids = distinct.select(((F.col("s") + F.lead("s").over(by)) / 2).alias("threshold")).filter("threshold IS NOT NULL")
    ends = distinct.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).select(F.explode(F.array(F.col("lo") - 0.01, F.col("hi") + 0.01)).alias("threshold")).filter("threshold IS NOT NULL")
    return mids.union(ends).select(F.round("threshold", 6).alias("threshold")).distinct()


def sweep(scores: DataFrame) -> DataFrame:
    """Rates at every candidate threshold. Records are first counted by score, so that thresholds meet counts, not records."""
    counts = scores.groupBy("top_score").agg(F.count_if("answerable").alias("yes"), F.count_if(~F.col("answerable")).alias("no"))
    ok = cleared(F.col("top_score"), F.col("threshold"))
    part = lambda c, cond, name: F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(name)
    at = candidate_thresholds(scores).crossJoin(counts).groupBy("threshold").agg(part("yes", ok, "tp"), part("yes", ~ok, "fn"), part("no", ok, "fp"), part("no", ~ok, "tn"))
    return rates(at)


def balanced(swept: DataFrame) -> DataFrame:
    """Best F1, then fewest errors, then the lowest threshold."""
    return swept.orderBy(F.desc("f1"), F.col("fp") + F.col("fn"), "threshold").limit(1)


def conservative(swept: DataFrame) -> DataFrame:
    """Of the thresholds with the fewest false answers, the fewest false refusals, then the lowest."""
    return swept.orderBy("fp", "fn", "threshold").limit(1)


def overlap(scores: DataFrame) -> DataFrame:
    """Whether a threshold can part answerable from unanswerable scores, and how much they overlap."""
    pos, neg = F.when(F.col("answerable"), F.col("top_score")), F.when(~F.col("answerable"), F.col("top_score"))
    ends = scores.agg(F.min(pos).alias("pos_min"), F.max(pos).alias("pos_max"), F.min(neg).alias("neg_min"), F.max(neg).alias("neg_max"), F.median(pos).alias("pos_median"), F.median(neg).alias("neg_median"))
    lo, hi = F.greatest("pos_min", "neg_min"), F.least("pos_max", "neg_max")
    inside = scores.crossJoin(ends.select(lo.alias("lo"), hi.alias("hi"))).agg(F.count_if(F.col("top_score").between(F.col("lo"), F.col("hi"))).alias("inside"))
    gap = F.round(F.col("pos_median") - F.col("neg_median"), 4)
    return ends.crossJoin(inside).select((F.col("pos_min") > F.col("neg_max")).alias("clean_split"), gap.alias("median_gap"), "inside", (gap < 0.15).alias("heavy"))


def upper_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, upper_median: the element at n div 2 of each group's sorted values that are numbers."""
    return selected(rows, group, value, F.floor(F.col("n") / 2)).withColumnRenamed(value, "upper_median")


def family_split(records: DataFrame, key: str, family: str, stratum: list[str], share: float, seed: str) -> DataFrame:
    """Adds part ('test' or 'train'): whole families, a share of each stratum's families (none of one family alone),
    picked by a hash of the seed and the family."""
    families = records.groupBy(family, *stratum).agg(F.count(F.lit(1)).alias("_size"))
    mixed = F.md5(F.concat(F.lit(seed), F.col(family).cast("string")).cast("binary"))
    by = Window.partitionBy(*stratum)
    n = F.count(F.lit(1)).over(by)
    placed = families.withColumn("_n", F.when(n >= 2, F.floor(n * share + 0.5)).otherwise(0)).withColumn("_r", F.row_number().over(by.orderBy(mixed)))
    return records.join(placed.select(family, *stratum, F.when(F.col("_r") <= F.col("_n"), "test").otherwise("train").alias("part")), [family, *stratum])

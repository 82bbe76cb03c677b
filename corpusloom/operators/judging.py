"""Anonymous judging, drafted questions with serial identifiers, counters with a cap on keys, and dumps of steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anonymised(candidates: DataFrame, key: str, model: str, seed: int) -> DataFrame:
    """Adds label (A, B, ...): the candidates of a key in an order that hangs on nothing but the seed, the key and the
    candidate's name, so that a judge cannot tell who wrote which and a second run asks the same."""
    shuffle = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col(model)).cast("binary"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(shuffle, model))
    return candidates.withColumn("label", F.char(64 + place))


def judged(candidates: DataFrame, key: str, model: str, answer: str, judge: Callable[[Column, Column], Column], seed: int = 0) -> DataFrame:
    """key, model, label, score, best. `judge` sees labels and answers alone: from a key's array<struct<label, answer>> it
    makes a map from label to score. Labels that it invents are dropped, and candidates that it leaves out get no score."""
    known = anonymised(candidates, key, model, seed)
    asked = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("label", F.col(answer).alias("answer")))).alias("asked"))
    said = asked.select(key, judge(F.col(key), F.col("asked")).alias("said"))
    scored = known.join(said, key).withColumn("score", F.try_element_at("said", F.col("label")))
    return scored.select(key, model, "label", "score", (F.col("score") == F.max("score").over(Window.partitionBy(key))).alias("best"))


def by_length(_: Column, asked: Column) -> Column:
    """A judge for tests and plans: the number of words."""
    return F.map_from_entries(F.transform(asked, lambda x: F.struct(x["label"], F.size(F.regexp_extract_all(x["answer"], F.lit(r"\S+"), F.lit(0))).cast("long"))))


def serials(rows: DataFrame, key: str, order: str, per_task: int = 50_000) -> DataFrame:
    """Adds serial, from 1 for each key in the order of the long `order`. Ranges of `order` are numbered side by side and
    offset by the counts of those before them, so that no task holds all rows of a frequent key."""
    lo, hi, n = rows.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    if not n:
        return rows.withColumn("serial", F.lit(None).cast("long"))
    width = max(1, -(-(hi - lo + 1) // max(1, -(-n // per_task))))
    cut = rows.withColumn("_range", F.expr(f"({order} - {lo}) div {width}"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(key, "_range").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order))
    return cut.withColumn("_inside", inside).join(starts, [key, "_range"]).withColumn("serial", F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")


def drafted(pages: DataFrame, key: str, order: str, text: str, draft: Callable[[Column], Column], first: int = 1) -> DataFrame:
    """Question records of pages: id (key and serial number, from `first` on), key, order, question (squeezed), review."""
    made = serials(pages, key, order).withColumn("question", F.trim(F.regexp_replace(draft(F.col(text)), r"\s+", " ")))
    number = F.col("serial") + (first - 1)
    return made.select(F.format_string("%s-%04d", key, number).alias("id"), key, order, "question", F.lit("pending").alias("review"))


def capped_keys(last_seen: DataFrame, key: str, at: str, now: Column, window_us: int, most: int) -> DataFrame:
    """What becomes of a limiter's keys: `idle` ones, whose window is over, go with a sweep; of the others the `most` used
    last stay (ties: the smaller key) and the rest are `evicted`. The last key that stays is found by a top-k."""
    live = last_seen.filter(F.col(at) > now - window_us)
    edge = live.orderBy(F.desc(at), key).limit(most).agg(F.min_by(F.struct(at, key), F.struct(F.col(at), -F.col(key))).alias("edge"))
    found = last_seen.crossJoin(F.broadcast(edge))  # one row
    stays = (F.col(at) > F.col(f"edge.{at}")) | ((F.col(at) == F.col(f"edge.{at}")) & (F.col(key) <= F.col(f"edge.{key}")))
    return found.select(key, at, F.when(F.col(at) <= now - window_us, "idle").when(stays, "kept").otherwise("evicted").alias("state"))


def readable_seconds(s: Column) -> Column:
    """Seconds under a minute and a half, minutes under an hour and a half, hours."""
    return F.when(s < 90, F.concat(F.bround(s).cast("int").cast("string"), F.lit("s"))).when(s < 5400, F.format_string("%.1fmin", F.bround(s / 60, 1))).otherwise(F.format_string("%.1fh", F.bround(s / 3600, 1)))


def rates(rows: DataFrame, by: str, micros: str, left: Column) -> DataFrame:
    """by, n, per_second (of the time between its first and last row; null where that is none), to_go (how long `left`
    more would take at that rate, readable)."""
    took = (F.max(micros) - F.min(micros)) / 1_000_000
    told = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.when(took > 0, F.count(F.lit(1)) / took).alias("_rate"), left.alias("_left"))
    return told.select(by, "n", F.round("_rate", 6).alias("per_second"), F.when(F.col("_rate").isNotNull(), readable_seconds(F.col("_left") / F.col("_rate"))).alias("to_go"))


def dumped(steps: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """One row for each step of a plan, in order: step_no, step, rows, keys (distinct), least and most of `key`."""
    out: DataFrame | None = None
    for i, (name, df) in enumerate(steps, 1):
        told = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.min(key).alias("least"), F.max(key).alias("most")).select(F.lit(i).cast("long").alias("step_no"), F.lit(name).alias("step"), "rows", "keys", "least", "most")
        out = told if out is None else out.unionByName(told)
    return out

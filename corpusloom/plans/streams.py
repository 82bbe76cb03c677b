"""Streams over the event log. In append mode a window is given out once the watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans._base import Family
from corpusloom.plans.state import CHAIN_SQL, sliding_sql
from corpusloom.streaming import limits, ordered, windows
from corpusloom.streaming.sinks import ROCKS, STORE, drained, setting

fam = Family()
QUERIES, ORACLES = fam.queries, fam.oracles

DAY, HOUR = 86_400_000_000, 3_600_000_000


def stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return raw.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")


LATE = "(SELECT max(epoch_us(ts)) - {late} FROM events)"


@fam.query(f"""WITH w AS (SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type, value FROM events)
SELECT start_us, start_us + 3600000000 AS end_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE start_us + 3600000000 <= {LATE.format(late=600_000_000)} GROUP BY ALL""")
def stream_tumbling_hours(spark, sf_dir):
    return drained(windows.windowed(stream(spark, sf_dir), "1 hour", None, "10 minutes", "event_type"))


@fam.query(f"""WITH w AS (SELECT epoch_us(ts) // 1800000000 * 1800000000 - unnest([0, 1800000000]) AS start_us, value FROM events)
SELECT start_us, start_us + 3600000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE start_us + 3600000000 <= {LATE.format(late=600_000_000)} GROUP BY ALL""")
def stream_sliding_hours(spark, sf_dir):
    return drained(windows.windowed(stream(spark, sf_dir), "1 hour", "30 minutes", "10 minutes"))


@fam.query(f"""WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g), t AS (SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k)
SELECT * FROM t WHERE end_us <= {LATE.format(late=600_000_000)}""")
def stream_sessions(spark, sf_dir):
    return drained(windows.sessions(stream(spark, sf_dir), "2 hours", "10 minutes", "user_id"))


@fam.query("SELECT event_id, user_id FROM events")
def stream_deduplicated(spark, sf_dir):
    one = stream(spark, sf_dir)
    return drained(windows.without_duplicates(one.union(one), "1 hour", "event_id").select("event_id", "user_id"))


@fam.query(f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // {DAY} ORDER BY ts, event_id) <= 2 AS accepted FROM events")
def stream_daily_limit(spark, sf_dir):
    return drained(limits.daily_counter(stream(spark, sf_dir), 2)).select("user_id", "event_id", "accepted")


@fam.query(f"WITH RECURSIVE req AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events), {sliding_sql('req', 'f', 3, DAY)} SELECT user_id, event_id, accepted, wait_us FROM f")
def stream_sliding_limiter(spark, sf_dir):
    return drained(limits.sliding_limit(stream(spark, sf_dir), 3, DAY))


@fam.query(f"{CHAIN_SQL} WHERE us <= (SELECT (max(us) - 600000000) // 1000 * 1000 FROM req)")
def stream_limit_chain(spark, sf_dir):
    """Address, owner, daily and budget limits as four stages of one stream: the same decisions as limit_chain, for all
    requests that the watermark has passed. The budget is one key a day, so it is thinned by groups first."""
    user = F.col("user_id")
    stages = [ordered.Stage(user, ordered.Sliding(3, DAY)), ordered.Stage(user, ordered.Sliding(1, HOUR)), ordered.Stage(user, ordered.Daily(2)), ordered.Stage(F.lit("all"), ordered.Daily(50), dealt=16)]
    with setting(spark, STORE, ROCKS):
        decided = drained(ordered.chained(stream(spark, sf_dir).select("ts", "us", "event_id", "user_id"), stages))
    return decided.select("event_id", (1 + F.coalesce(ordered.REJECTED, F.lit(len(stages)))).cast("long").alias("stages_passed"))

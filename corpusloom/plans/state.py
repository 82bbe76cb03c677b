"""Sessions, histories and limits, on conversations, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import ingest as I
from corpusloom.operators import state as S
from corpusloom.plans._base import Family, table

fam = Family()
QUERIES, ORACLES = fam.queries, fam.oracles

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def requests(spark, sf_dir) -> DataFrame:
    """The event log as requests: event_id, user_id, event_type, us (microseconds), value."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")


REQ = "req AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value FROM events)"
TURNS = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)"


@fam.query(f"SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, {TURNS} AS b FROM conversations) WHERE b <= 3")
def history_window(spark, sf_dir):
    return S.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role", "place")


@fam.query(f"SELECT conv_id, turn, role FROM (SELECT *, {TURNS} AS b FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE b <= 4")
def qa_history(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant') AND trim(text) <> ''")
    return S.last_turns(m, "conv_id", "turn", 4).select("conv_id", "turn", "role")


@fam.query(f"SELECT conv_id, turn, role, left(text, 600) AS content FROM (SELECT *, {TURNS} AS b FROM conversations) WHERE b <= 6 AND role IN ('user', 'assistant') AND trim(text) <> ''")
def chitchat_history(spark, sf_dir):
    m = S.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 6).filter("role IN ('user', 'assistant') AND trim(text) <> ''")
    return m.select("conv_id", "turn", "role", F.substring("text", 1, 600).alias("content"))


CONV = """conv AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS user_id, epoch_us(o_orderdate) AS updated_us, o_orderdate AS updated_at, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 5 DAY END AS deleted_at, o_orderpriority AS title FROM orders)"""


def sessions(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.when(F.expr("o_orderkey % 3 <> 0"), F.col("o_custkey")).alias("user_id"), F.col("o_orderdate").alias("updated_at"),
        F.when(F.expr("o_orderkey % 7 = 0"), F.col("o_orderdate") + F.expr("INTERVAL 5 DAY")).alias("deleted_at"), F.col("o_orderpriority").alias("title"),
    )


@fam.query(f"WITH {CONV} SELECT id, owner FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, id DESC) AS r FROM conv WHERE deleted_at IS NULL) WHERE r > 7")
def lru_cap_eviction(spark, sf_dir):
    live = sessions(spark, sf_dir).filter("deleted_at IS NULL")
    return S.beyond_newest(live, "owner", [F.desc("updated_at"), F.desc("id")], 8 - 1).select("id", "owner")


@fam.query(f"WITH {CONV} SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) AS r FROM conv WHERE user_id IS NOT NULL) WHERE r > 10")
def max_sessions(spark, sf_dir):
    s = sessions(spark, sf_dir).filter("user_id IS NOT NULL")
    return S.beyond_newest(s, "user_id", [F.desc("updated_at"), F.desc("id")], 10).select("id", "user_id")


@fam.query(f"WITH {CONV}, n AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT owner, id, coalesce(title, 'untitled') AS title, coalesce(n, 0) AS messages, row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, id) AS place FROM conv LEFT JOIN n USING (id) WHERE deleted_at IS NULL")
def conversation_list(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("updated_at"), "id"))
    return sessions(spark, sf_dir).filter("deleted_at IS NULL").join(n, "id", "left").select("owner", "id", F.coalesce("title", F.lit("untitled")).alias("title"), F.coalesce("n", F.lit(0)).alias("messages"), place.alias("place"))


CUT = "TIMESTAMP '1997-01-01'"
GONE = f"((user_id IS NULL AND updated_at < {CUT}) OR coalesce(deleted_at < {CUT}, false))"


@fam.query(f"WITH {CONV} SELECT id, {GONE} AS expired FROM conv")
def retention_predicate(spark, sf_dir):
    return sessions(spark, sf_dir).select("id", I.expired(F.lit("1997-01-01").cast("timestamp_ntz")).alias("expired"))


@fam.query(f"WITH {CONV} SELECT l_orderkey AS id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM conv WHERE {GONE})")
def retention_cascade(spark, sf_dir):
    messages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return I.purged(sessions(spark, sf_dir), messages, "id", I.expired(F.lit("1997-01-01").cast("timestamp_ntz")))[1]


@fam.query(f"WITH {CONV} SELECT count(*) FILTER (user_id IS NULL AND updated_at < {CUT}) AS idle_guests, count(*) FILTER (deleted_at < {CUT}) AS deleted, count(*) FILTER ({GONE}) AS total FROM conv")
def retention_counts(spark, sf_dir):
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    return sessions(spark, sf_dir).agg(F.count_if(F.col("user_id").isNull() & (F.col("updated_at") < cut)).alias("idle_guests"), F.count_if(F.col("deleted_at") < cut).alias("deleted"), F.count_if(I.expired(cut)).alias("total"))


@fam.query(f"WITH {CONV}, moved AS (SELECT id, CASE WHEN deleted_at IS NULL AND owner % 10 = 1 THEN owner - 1 ELSE owner END AS owner, updated_at, deleted_at FROM conv) SELECT id, owner, deleted_at IS NULL AND row_number() OVER (PARTITION BY owner, deleted_at IS NULL ORDER BY updated_at DESC, id DESC) > 20 AS evicted FROM moved")
def owner_reassignment(spark, sf_dir):
    moved = sessions(spark, sf_dir).withColumn("owner", F.when(F.col("deleted_at").isNull() & (F.col("owner") % 10 == 1), F.col("owner") - 1).otherwise(F.col("owner")))
    place = F.row_number().over(Window.partitionBy("owner", F.col("deleted_at").isNull()).orderBy(F.desc("updated_at"), F.desc("id")))
    return moved.select("id", "owner", (F.col("deleted_at").isNull() & (place > 20)).alias("evicted"))


@fam.query(f"WITH {CONV} SELECT id, deleted_at IS NOT NULL OR owner % 4 = 0 AS gone, deleted_at IS NULL AND owner % 4 = 0 AS deleted_now FROM conv")
def soft_delete(spark, sf_dir):
    mine = F.col("owner") % 4 == 0
    return sessions(spark, sf_dir).select("id", (F.col("deleted_at").isNotNull() | mine).alias("gone"), (F.col("deleted_at").isNull() & mine).alias("deleted_now"))


@fam.query(f"""WITH {CONV}, s AS (SELECT conv.*, c_custkey AS u, c_acctbal >= 0 AS is_active, CASE WHEN id % 11 = 0 THEN updated_at END AS revoked_at, updated_at + INTERVAL 30 DAY AS absolute_expires, least(updated_at + INTERVAL 7 DAY, updated_at + INTERVAL 30 DAY) AS idle_expires FROM conv LEFT JOIN customer ON c_custkey = user_id)
SELECT id, CASE WHEN u IS NULL THEN 'unknown' WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN absolute_expires <= TIMESTAMP '1998-08-01' THEN 'absolute_expired' WHEN idle_expires <= TIMESTAMP '1998-08-01' THEN 'idle_expired' WHEN NOT is_active THEN 'inactive_user' ELSE 'live' END AS state FROM s""")
def session_liveness(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") >= 0).alias("is_active"), F.lit(True).alias("known"))
    days = lambda n: F.col("updated_at") + F.expr(f"INTERVAL {n} DAY")
    s = sessions(spark, sf_dir).join(users, "user_id", "left").withColumns({"user_id": F.when(F.col("known"), F.col("user_id")), "revoked_at": F.when(F.col("id") % 11 == 0, F.col("updated_at")), "absolute_expires": days(30), "idle_expires": F.least(days(7), days(30))})
    return s.select("id", S.liveness(F.lit("1998-08-01").cast("timestamp_ntz")).alias("state"))


@fam.query(f"WITH {CONV} SELECT id, CASE WHEN owner % 5 = 0 AND id % 11 <> 0 THEN true ELSE false END AS revoked_now FROM conv")
def revoke_sessions(spark, sf_dir):
    return sessions(spark, sf_dir).select("id", ((F.col("owner") % 5 == 0) & (F.col("id") % 11 != 0)).alias("revoked_now"))


@fam.query(f"WITH {CONV} SELECT id, epoch_us(least(updated_at + INTERVAL 7 DAY, TIMESTAMP '1998-01-01')) AS idle_us, TIMESTAMP '1998-08-01' - updated_at >= INTERVAL 5 MINUTE AS slides FROM conv")
def sliding_expiry(spark, sf_dir):
    ends = F.least(F.col("updated_at") + F.expr("INTERVAL 7 DAY"), F.lit("1998-01-01").cast("timestamp_ntz"))
    slides = F.lit("1998-08-01").cast("timestamp_ntz") - F.col("updated_at") >= F.expr("INTERVAL 5 MINUTE")
    return sessions(spark, sf_dir).select("id", F.unix_micros(ends.cast("timestamp")).alias("idle_us"), slides.alias("slides"))


# ---- limits ----------------------------------------------------------------------------------------------------------


@fam.query(f"WITH {REQ} SELECT event_id, row_number() OVER (PARTITION BY us // {DAY} ORDER BY us, event_id) <= 100 AS accepted FROM req")
def daily_budget(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.select("event_id", S.first_n(r, [F.expr(f"us div {DAY}")], ["us", "event_id"], 100).alias("accepted"))


@fam.query(f"WITH {REQ} SELECT event_id, row_number() OVER (PARTITION BY user_id, us // {DAY} ORDER BY us, event_id) <= 2 AS accepted FROM req")
def keyed_daily_limit(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.select("event_id", S.first_n(r, ["user_id", F.expr(f"us div {DAY}")], ["us", "event_id"], 2).alias("accepted"))


@fam.query(f"WITH {REQ} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) <= 5 AS accepted FROM req")
def guest_lifetime_quota(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.select("event_id", S.first_n(r, ["user_id"], ["us", "event_id"], 5).alias("accepted"))


@fam.query(f"WITH {REQ} SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW) AS n, n > 3 AS over FROM req")
def sliding_demand(spark, sf_dir):
    r = requests(spark, sf_dir).select("event_id", "event_type", "us")
    return S.trailing_counts(r, "event_type", "us", HOUR).select("event_id", "n", (F.col("n") > 3).alias("over"))


@fam.query(f"WITH {REQ} SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS failures FROM req")
def blocked_check(spark, sf_dir):
    n = F.count_if(F.col("event_type") == "error").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-(DAY - 1), 0))
    return requests(spark, sf_dir).select("event_id", n.alias("failures"))


def sliding_sql(rows: str, name: str, limit: int, window_us: int) -> str:
    """CTEs {name}_o and {name}: user_id, i, event_id, us, accepted, wait_us, held: a request after the other of each user,
    with the times of the accepted ones that still count."""
    return f"""{name}_o AS (SELECT event_id, user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM {rows}),
{name} AS (SELECT user_id, i, event_id, us, true AS accepted, 0::BIGINT AS wait_us, [us] AS held FROM {name}_o WHERE i = 1
 UNION ALL SELECT user_id, i, event_id, us, len(h) < {limit}, CASE WHEN len(h) < {limit} THEN 0 ELSE h[1] + {window_us} - us END, CASE WHEN len(h) < {limit} THEN list_append(h, us) ELSE h END
 FROM (SELECT o.*, list_filter(f.held, lambda x: x > o.us - {window_us}) AS h FROM {name} f JOIN {name}_o o ON o.user_id = f.user_id AND o.i = f.i + 1))"""


@fam.query(f"WITH RECURSIVE {REQ}, {sliding_sql('req', 'f', 3, DAY)} SELECT user_id, event_id, accepted, wait_us FROM f")
def sliding_window_limiter(spark, sf_dir):
    return S.folded(requests(spark, sf_dir), "user_id", "us", "event_id", lambda: S.sliding_log(3, DAY), "wait_us")


@fam.query(f"""WITH RECURSIVE {REQ}, o AS (SELECT event_id, user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM req),
f AS (SELECT user_id, i, event_id, us AS start, true AS accepted, 1::BIGINT AS taken FROM o WHERE i = 1
 UNION ALL SELECT user_id, i, event_id, start, base < 2, base + (base < 2)::BIGINT FROM (SELECT o.user_id, o.i, o.event_id, CASE WHEN f.start <= o.us - {DAY} THEN o.us ELSE f.start END AS start, CASE WHEN f.start <= o.us - {DAY} THEN 0 ELSE f.taken END AS base FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
SELECT user_id, event_id, accepted, taken FROM f""")
def guest_ip_window(spark, sf_dir):
    return S.folded(requests(spark, sf_dir), "user_id", "us", "event_id", lambda: S.anchored_window(2, DAY), "taken")


CHAIN_SQL = f"""WITH RECURSIVE {REQ}, {sliding_sql('req', 'a', 3, DAY)}, one AS (SELECT event_id, user_id, us FROM a WHERE accepted), {sliding_sql('one', 'b', 1, HOUR)}, two AS (SELECT event_id, user_id, us FROM b WHERE accepted),
three AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY user_id, us // {DAY} ORDER BY us, event_id) <= 2), four AS (SELECT * FROM three QUALIFY row_number() OVER (PARTITION BY us // {DAY} ORDER BY us, event_id) <= 50)
SELECT event_id, 1 + (event_id IN (SELECT event_id FROM one))::BIGINT + (event_id IN (SELECT event_id FROM two))::BIGINT + (event_id IN (SELECT event_id FROM three))::BIGINT + (event_id IN (SELECT event_id FROM four))::BIGINT AS stages_passed FROM req"""


@fam.query(CHAIN_SQL)
def limit_chain(spark, sf_dir):
    """Address, owner, daily and budget limits one behind the other: what one rejects does not spend the next.
    The log knows users only: they stand for addresses and for owners."""
    r = requests(spark, sf_dir)
    one = r.join(S.folded(r, "user_id", "us", "event_id", lambda: S.sliding_log(3, DAY), "wait_us").filter("accepted").select("event_id"), "event_id")
    two = one.join(S.folded(one, "user_id", "us", "event_id", lambda: S.sliding_log(1, HOUR), "wait_us").filter("accepted").select("event_id"), "event_id")
    three = two.withColumn("ok", S.first_n(two, ["user_id", F.expr(f"us div {DAY}")], ["us", "event_id"], 2)).filter("ok").drop("ok")
    day, order = F.expr(f"us div {DAY}"), ["us", "event_id"]
    thinned = three.withColumn("ok", S.first_n(three, [day, F.pmod(F.xxhash64("event_id"), F.lit(16))], order, 50)).filter("ok")  # the first 50 of all are among the first 50 of each group
    four = thinned.withColumn("ok", S.first_n(thinned, [day], order, 50)).filter("ok")
    stage = lambda df, name: df.select("event_id", F.lit(name).alias("passed"))
    stages = stage(r, "asked").union(stage(one, "address")).union(stage(two, "owner")).union(stage(three, "daily")).union(stage(four, "budget"))
    return stages.groupBy("event_id").agg(F.count(F.lit(1)).alias("stages_passed"))


@fam.query(f"""WITH {REQ}, d AS (SELECT *, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS unit FROM req) SELECT event_id, sum(unit) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS taken, greatest(15 - taken, 0)::BIGINT AS remaining FROM d""")
def reserve_and_refund(spark, sf_dir):
    unit = F.when(F.col("event_type") == "error", -1).otherwise(1)
    taken = F.sum(unit).over(Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return requests(spark, sf_dir).select("event_id", taken.alias("taken"), F.greatest(15 - taken, F.lit(0)).cast("long").alias("remaining"))


@fam.query(f"WITH {REQ}, last AS (SELECT user_id, max(us) AS seen FROM req GROUP BY 1), t AS (SELECT max(seen) AS now FROM last) SELECT user_id, seen FROM last, t WHERE seen < now - {DAY} ORDER BY seen, user_id LIMIT 500")
def idle_purge(spark, sf_dir):
    last = requests(spark, sf_dir).groupBy("user_id").agg(F.max("us").alias("seen"))
    return last.crossJoin(last.agg(F.max("seen").alias("now"))).filter(F.col("seen") < F.col("now") - DAY).select("user_id", "seen").orderBy("seen", "user_id").limit(500)


@fam.query(f"WITH {REQ}, i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM req), s AS (SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY us, event_id)::BIGINT AS streak FROM i) SELECT event_id, streak, CASE WHEN streak + 8 >= 10 THEN least(900, 30 * 2 ** least(streak - 2, 10))::INT ELSE 0 END AS lock_seconds FROM s")
def failure_streak_lock(spark, sf_dir):
    s = S.streaks(requests(spark, sf_dir), "user_id", ["us", "event_id"], F.col("event_type") == "error")
    return s.select("event_id", "streak", S.lock_seconds(F.col("streak") + 8).alias("lock_seconds"))


@fam.query(f"""WITH {REQ}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < {2 * HOUR} THEN 0 ELSE 1 END AS fresh FROM req), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS sess FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY user_id, sess""")
def idle_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros("a").alias("start_us"), F.unix_micros("b").alias("last_us"), "n")


LEVELS = "['beginner', 'intermediate', 'advanced'][1 + event_id % 3]"


@fam.query(f"""WITH l AS (SELECT event_id, user_id, {LEVELS} AS level FROM events), w AS (SELECT event_id, user_id, list(level) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) AS seen FROM l)
SELECT event_id, list_sort(list_transform(range(1, len(seen) + 1), lambda i: len(list_filter(seen, lambda y: y = seen[i])) * 10 + i), 'DESC')[1] % 10 AS pick, seen[list_sort(list_transform(range(1, len(seen) + 1), lambda i: len(list_filter(seen, lambda y: y = seen[i])) * 10 + i), 'DESC')[1] % 10] AS level FROM w""")
def smoothed_level(spark, sf_dir):
    level = F.element_at(F.lit(["beginner", "intermediate", "advanced"]), (1 + F.col("event_id") % 3).cast("int"))
    seen = F.collect_list("level").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0))
    one = table(spark, sf_dir, "events").select("event_id", "user_id", level.alias("level"))
    best = F.array_max(F.transform(seen, lambda x, i: F.size(F.filter(seen, lambda y: y == x)) * 10 + i + 1)) % 10
    return one.select("event_id", best.cast("long").alias("pick"), S.majority_of_last("level", "user_id", "event_id").alias("level"))


@fam.query("""SELECT conv_id, turn, lag(role) OVER w = 'assistant' AS after_answer, CASE WHEN lag(role) OVER w = 'assistant' THEN lag(left(text, 20)) OVER w END AS carried FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def previous_turn_keys(spark, sf_dir):
    before = F.lag(F.struct("role", "text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    m = table(spark, sf_dir, "conversations").withColumn("p", before)
    return m.select("conv_id", "turn", (F.col("p.role") == "assistant").alias("after_answer"), F.when(F.col("p.role") == "assistant", F.substring("p.text", 1, 20)).alias("carried"))

"""Judging, drafting, key caps, reservations and step dumps over the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusloom.operators import judging as J
from corpusloom.operators import routing as R
from corpusloom.operators import state as S
from corpusloom.operators.remote import Patience, Refused, Remote
from corpusloom.plans._base import Family, table

fam = Family()
QUERIES, ORACLES = fam.queries, fam.oracles

DAY = 86_400_000_000
REQ = "req AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events)"


def requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@fam.query("""WITH c AS (SELECT conv_id, 'opening' AS model, arg_min(text, turn) AS answer FROM conversations GROUP BY 1 UNION ALL SELECT conv_id, 'closing', arg_max(text, turn) FROM conversations GROUP BY 1 UNION ALL SELECT conv_id, 'longest', arg_max(text, (length(text), -turn)) FROM conversations GROUP BY 1),
l AS (SELECT *, chr((64 + row_number() OVER (PARTITION BY conv_id ORDER BY md5('7:' || conv_id || ':' || model), model))::INT) AS label, len(regexp_extract_all(answer, '\\S+'))::BIGINT AS score FROM c)
SELECT conv_id, model, label, score, score = max(score) OVER (PARTITION BY conv_id) AS best FROM l""")
def judged_answers(spark, sf_dir):
    """Three answers of each conversation before a judge that does not know whose they are; of equally long ones the
    earliest is the longest."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"), F.max_by("text", "turn").alias("closing"), F.max_by("text", F.struct(F.length("text"), -F.col("turn"))).alias("longest"))
    c = t.select("conv_id", F.explode(F.create_map(*[x for m in ("opening", "closing", "longest") for x in (F.lit(m), F.col(m))])).alias("model", "answer"))
    return J.judged(c, "conv_id", "model", "answer", J.by_length, seed=7)


@fam.query("""SELECT format('{}-{:04d}', lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)) AS id, lang, doc_id, trim(regexp_replace(regexp_extract(text, '^[^.?!]*'), '[\\s]+', ' ', 'g')) || '?' AS question, 'pending' AS review FROM documents""")
def drafted_questions(spark, sf_dir):
    """A record with a serial identifier for each document; the draft is its first sentence as a question."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return J.drafted(d, "lang", "doc_id", "text", lambda t: F.concat(F.trim(F.regexp_replace(F.regexp_extract(t, r"^[^.?!]*", 0), r"\s+", " ")), F.lit("?")))


@fam.query(f"""WITH {REQ}, last AS (SELECT user_id, max(us) AS seen FROM req GROUP BY 1), t AS (SELECT max(seen) AS now FROM last), r AS (SELECT *, seen <= now - {DAY} AS idle, row_number() OVER (PARTITION BY seen <= now - {DAY} ORDER BY seen DESC, user_id) AS place FROM last, t)
SELECT user_id, seen, CASE WHEN idle THEN 'idle' WHEN place <= 50 THEN 'kept' ELSE 'evicted' END AS state FROM r""")
def limiter_keys(spark, sf_dir):
    """The keys of a limiter with a window of a day and room for 50."""
    last = requests(spark, sf_dir).groupBy("user_id").agg(F.max("us").alias("seen"))
    now = last.agg(F.max("seen")).first()[0] or 0
    return J.capped_keys(last, "user_id", "seen", F.lit(now), DAY, 50)


@fam.query(f"""WITH {REQ}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) <= 4 AS ok FROM req), b AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) <= 15 AS both_ok FROM a WHERE ok)
SELECT event_id, coalesce(both_ok, false) AS reserved FROM req LEFT JOIN b USING (event_id)""")
def reserved_on_both_or_neither(spark, sf_dir):
    """A unit of the kind's counter (4 a user) and of the user's (15), or of neither. What one refuses takes nothing from
    the other: only requests that the first grants reach the second, and a user who is at an end stays there."""
    r = requests(spark, sf_dir)
    one = r.withColumn("ok", S.first_n(r, ["user_id", "event_type"], ["us", "event_id"], 4)).filter("ok")
    both = one.withColumn("reserved", S.first_n(one, ["user_id"], ["us", "event_id"], 15)).select("event_id", "reserved")
    return r.select("event_id").join(both, "event_id", "left").select("event_id", F.coalesce("reserved", F.lit(False)).alias("reserved"))


@fam.query("""SELECT o_orderkey, CASE WHEN s < 90 THEN round_even(s, 0)::INT || 's' WHEN s < 5400 THEN format('{:.1f}min', round_even(s / 60, 1)) ELSE format('{:.1f}h', round_even(s / 3600, 1)) END AS took FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 90 + 0.25::DOUBLE ELSE o_totalprice END AS s FROM orders)""")
def readable_durations(spark, sf_dir):
    s = F.when(F.expr("o_orderkey % 3 = 0"), F.expr("o_orderkey % 90") + F.lit(0.25)).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", J.readable_seconds(s).alias("took"))


@fam.query(f"""WITH {REQ}, r AS (SELECT user_id, count(*) AS n, CASE WHEN max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1000000.0::DOUBLE) END AS rate, count(*) FILTER (event_type = 'error') AS todo FROM req GROUP BY user_id), s AS (SELECT *, todo / rate AS s FROM r)
SELECT user_id, n, round(rate, 6) AS per_second, CASE WHEN s < 90 THEN round_even(s, 0)::INT || 's' WHEN s < 5400 THEN format('{{:.1f}}min', round_even(s / 60, 1)) WHEN s IS NOT NULL THEN format('{{:.1f}}h', round_even(s / 3600, 1)) END AS to_go FROM s""")
def request_rates(spark, sf_dir):
    """Requests a second of each user, and how long as many more as failed would take."""
    return J.rates(requests(spark, sf_dir), "user_id", "us", F.count_if(F.col("event_type") == "error"))


STEPS = [("read", "true"), ("long enough", "n_chars >= 200"), ("English", "n_chars >= 200 AND lang = 'en'"), ("of the first sources", "n_chars >= 200 AND lang = 'en' AND source < 'src2'")]


@fam.query(" UNION ALL ".join(f"SELECT {i}::BIGINT AS step_no, '{n}' AS step, count(*) AS rows, count(DISTINCT doc_id) AS keys, min(doc_id) AS least, max(doc_id) AS most FROM documents WHERE {c}" for i, (n, c) in enumerate(STEPS, 1)))
def pipeline_steps(spark, sf_dir):
    """What is left after each step of a selection."""
    d = table(spark, sf_dir, "documents")
    return J.dumped([(name, d.filter(c)) for name, c in STEPS], "doc_id")


ROUTES = R.Routes(default="broad", models={"broad": "max_tokens", "brief": "max_completion_tokens"}, tasks={"title": "brief"}, caps={"title": 12, "answer": 0})


def stand_in_service() -> Remote:
    """A service whose model says the first words of a prompt, as many as its cap. It is overloaded when first asked, and
    refuses a cap under a name that its model does not know."""
    asked = []

    def send(payload, timeout):
        model, parameters, prompts = payload
        asked.append(model)
        if len(asked) == 1:
            raise Refused(429)
        if set(parameters) - {ROUTES.models[model]}:
            raise Refused(400)
        cap = parameters.get(ROUTES.models[model])
        return [f"{model}: " + " ".join(re.findall(r"[^\x20\x09-\x0D]+", p)[:cap]) for p in prompts]

    return Remote(send, Patience(pause=0.0))


@fam.query(r"""WITH c AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'title' WHEN 'assistant' THEN 'answer' ELSE 'rules' END AS task, CASE WHEN contains(text, '?') THEN 5 END AS budget FROM conversations),
r AS (SELECT *, CASE task WHEN 'title' THEN 'brief' ELSE 'broad' END AS model, coalesce(budget, CASE task WHEN 'title' THEN 12 END)::BIGINT AS cap, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM c)
SELECT conv_id, turn, task, model, CASE WHEN cap IS NULL THEN '{}' ELSE '{"' || CASE model WHEN 'brief' THEN 'max_completion_tokens' ELSE 'max_tokens' END || '":' || cap || '}' END AS parameters,
 model || ': ' || array_to_string(CASE WHEN cap IS NULL THEN words ELSE words[:cap] END, ' ') AS reply FROM r""".replace("\\\\x", "\\x"))
def routed_calls(spark, sf_dir):
    """Every turn is asked about: the task decides on the model and on the cap, questions have a budget of their own."""
    task = F.when(F.col("role") == "user", "title").when(F.col("role") == "assistant", "answer").otherwise("rules")
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", task.alias("task"), F.when(F.contains("text", F.lit("?")), 5).alias("budget"))
    return R.answered(calls, "text", ROUTES, "task", stand_in_service, "budget").select("conv_id", "turn", "task", "model", "parameters", "reply")

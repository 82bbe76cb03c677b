"""The jobs as queries: each runs its job twice into one new folder and gives the whole output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.streaming.sinks import shared_dir
from jobs import corpus_release, index_intake

STRIPPED = r"regexp_replace({c}, '^[\s\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"
NORMAL = STRIPPED.format(c=r"regexp_replace(regexp_replace(replace(replace(nfc_normalize(coalesce(text, '')), chr(8204), ''), chr(8205), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{M}}\p{{N}}]+')"


def new_folder(spark, job: str) -> str:
    return f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"


def job1_index_intake(spark, sf_dir):
    """Documents without a term say what was refused; the others have a row a term."""
    out = new_folder(spark, "job1")
    for _ in range(2):
        index_intake.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint")
    documents, postings = index_intake.current(spark, out)
    rows = documents.select("doc_id", "lang", "digest", "reason", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"), F.col("n_words").alias("dl"))
    none = F.lit(None).cast("string")
    return rows.unionByName(postings.select("doc_id", "lang", none.alias("digest"), none.alias("reason"), "term", "tf", "dl"))


def job2_corpus_release(spark, sf_dir):
    """Published rows with a digest of the text as it was written, and rows that were left out with their reasons."""
    out = new_folder(spark, "job2")
    for _ in range(2):
        corpus_release.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, "whole")
    corpus, gone = corpus_release.released(spark, out, "whole")
    shown = corpus.select("doc_id", "lang", "source", "n_words", "digest", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.lit(None).cast("string").alias("reasons"))
    return shown.unionByName(gone.select("doc_id", "lang", "source", "n_words", "digest", F.lit(None).cast("string").alias("text_md5"), "reasons"))


QUERIES = {f.__name__: f for f in (job1_index_intake, job2_corpus_release)}

ORACLES = {
    "job1_index_intake": f"""
WITH d AS (SELECT doc_id, coalesce(nullif(trim(lang), ''), 'unknown') AS lang, {NORMAL} AS t FROM documents WHERE doc_id IS NOT NULL),
v AS (SELECT *, md5(t) AS digest FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(t) DESC, lang DESC) = 1),
w AS (SELECT *, {WORDS.format(c="t")} AS words FROM v),
j AS (SELECT *, len(words) AS n, CASE WHEN len(words) = 0 THEN 'empty' WHEN len(words) < 3 THEN 'short' END AS reason FROM w)
SELECT doc_id, lang, digest, reason, NULL AS term, 0::BIGINT AS tf, n AS dl FROM j
UNION ALL
SELECT doc_id, lang, NULL, NULL, term, count(*), any_value(n) FROM (SELECT doc_id, lang, n, unnest(words) AS term FROM j WHERE reason IS NULL) GROUP BY doc_id, lang, term""",
    "job2_corpus_release": f"""
WITH d AS (SELECT doc_id, coalesce(nullif(trim(lang), ''), 'unknown') AS lang, coalesce(nullif(trim(source), ''), 'unknown') AS source, {NORMAL} AS t,
                  md5({STRIPPED.format(c="coalesce(text, '')")}) AS digest, len({WORDS.format(c="coalesce(text, '')")}) AS n_words FROM documents),
u AS (SELECT doc_id, digest, min(lang) AS lang, min(source) AS source, any_value(n_words) AS n_words, any_value(t) AS t FROM d GROUP BY doc_id, digest),
m AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT u.*, coalesce(quality = 1, false) AS good, CASE WHEN u.doc_id IS NULL THEN 'no id' WHEN n_words = 0 THEN 'empty' WHEN n_words < 5 THEN 'short' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low quality' END AS fault
      FROM u LEFT JOIN m ON m.doc_id = u.doc_id),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY digest ORDER BY (fault IS NOT NULL)::INT * 2 + (NOT good)::INT, doc_id) AS canonical FROM f),
e AS (SELECT *, CASE WHEN doc_id = canonical THEN fault WHEN fault IS NULL THEN 'duplicate' ELSE fault || '; duplicate' END AS reasons FROM r)
SELECT doc_id, lang, source, n_words, digest, CASE WHEN reasons IS NULL THEN md5(t) END AS text_md5, reasons FROM e""",
}

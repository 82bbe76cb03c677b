"""The runnable jobs: over growing input, run again, on odd rows, and against their SQL."""

import collections
import json
import logging
import os
import re
import subprocess
import sys
import unicodedata
import uuid
from pathlib import Path

import duckdb
import pytest
from compare import cell
from pyspark.sql import functions as F

from jobs import corpus_release, index_intake, queries
from jobs._common import settings

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, term string"  # a further column of a clashing name


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def send(spark, folder, rows):
    """One more file of documents."""
    spark.createDataFrame([(*r, None, "x")[:5] for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/documents")


def files(at):
    return {p: p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet")}


def indexed(spark, out):
    docs, postings = index_intake.current(spark, out)
    terms = collections.defaultdict(dict)
    for r in postings.collect():
        terms[r.doc_id][r.term] = r.tf
        assert r.dl >= r.tf
    return {r.doc_id: (r.lang, r.reason) for r in docs.collect()}, dict(terms)


def plain(rows):
    """The newest text of each document, whole."""
    docs, terms = {}, {}
    for d, text, lang in rows:
        if d is None:
            continue
        words = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text or "").lower())
        docs[d] = ((lang or "").strip() or "unknown", "empty" if not words else "short" if len(words) < 3 else None)
        terms.pop(d, None)
        if len(words) >= 3:
            terms[d] = dict(collections.Counter(words))
    return docs, terms


FIRST = [(1, "The old house by the river", "en"), (2, "two words", "en"), (3, None, None), (4, "", " "), (5, "Grüße aus aller Welt " * 4000, "de"), (None, "nobody knows whose this is", "en")]
SECOND = [(1, "The new house by the river, by the sea", "en"), (2, "two words", "en"), (6, "a sixth one comes later", "en"), (5, None, "de"), (3, "now there is some text", "fr/é=?"), (7, "Café au lait", "fr")]


def test_intake_takes_only_what_is_new(spark, folder):
    out = f"{folder}/out"
    send(spark, folder, FIRST)
    first = index_intake.run(spark, f"{folder}/documents", out)
    assert [(b["read"], b["new"], b["changed"], b["fit"]) for b in first] == [(6, 5, 0, 2)]
    assert indexed(spark, out) == plain(FIRST)
    before = files(out)
    assert index_intake.run(spark, f"{folder}/documents", out) == [] and files(out) == before
    send(spark, folder, SECOND)
    second = index_intake.run(spark, f"{folder}/documents", out)
    assert [(b["read"], b["new"], b["changed"], b["unchanged"], b["stale"]) for b in second] == [(6, 2, 3, 1, 0)]
    assert indexed(spark, out) == plain(FIRST + SECOND)
    after = files(out)
    assert before.items() <= after.items()  # nothing that was written is touched again
    one = f"{folder}/at_once"
    index_intake.run(spark, f"{folder}/documents", one)
    assert indexed(spark, one) == indexed(spark, out)


def test_intake_of_a_batch_that_broke_off(spark, folder, monkeypatch):
    out = f"{folder}/out"
    send(spark, folder, FIRST)
    index_intake.run(spark, f"{folder}/documents", out)
    send(spark, folder, SECOND)
    real = index_intake.lexical_index.counted

    def broken(*a):
        raise RuntimeError("an executor is gone")

    monkeypatch.setattr(index_intake.lexical_index, "counted", broken)  # after the documents, before the postings
    with pytest.raises(Exception, match="an executor is gone"):
        index_intake.run(spark, f"{folder}/documents", out)
    monkeypatch.setattr(index_intake.lexical_index, "counted", real)
    again = index_intake.run(spark, f"{folder}/documents", out)
    assert [(b["batch"], b["new"], b["changed"], b["unchanged"]) for b in again] == [(1, 2, 3, 1)]
    assert indexed(spark, out) == plain(FIRST + SECOND)


def test_intake_in_many_batches_and_of_nothing(spark, folder):
    sent = []
    for i in range(4):
        rows = [(d, f"text {i} of document {d} with words", "en") for d in range(i, 6)]
        send(spark, folder, rows)
        for p in Path(f"{folder}/documents").glob("*.parquet"):
            if p not in sent:
                sent.append(p)
                os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    config = {**settings(spark, index_intake.__file__), "max_files_per_batch": 1}
    done = index_intake.run(spark, f"{folder}/documents", f"{folder}/out", config=config)
    assert len(done) == 4 and sum(b["changed"] for b in done) == 5 + 4 + 3 - 0
    want = {d: min(d, 3) for d in range(6)}
    assert {d: next(int(t) for t in terms if t in "0123" and f"text {t}" == f"text {want[d]}") for d, terms in indexed(spark, f"{folder}/out")[1].items()} == want
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/none/documents")
    index_intake.run(spark, f"{folder}/none/documents", f"{folder}/none/out")
    assert indexed(spark, f"{folder}/none/out") == ({}, {})


def test_search_over_what_was_taken_in(spark, folder):
    """The same hits as from an index that is built at once of the newest texts."""
    send(spark, folder, FIRST)
    index_intake.run(spark, f"{folder}/documents/", f"{folder}/out")
    send(spark, folder, SECOND)
    index_intake.run(spark, f"{folder}/documents/", f"{folder}/out")
    fit = {d for d, (_, reason) in plain(FIRST + SECOND)[0].items() if reason is None}
    newest = {d: t for d, t, _ in FIRST + SECOND if d in fit}
    words = index_intake.T.words
    asked = spark.createDataFrame([(1, "a house by the river"), (2, "now or later"), (3, "nothing of it")], "q long, text string")
    at_once = index_intake.lexical_index.stored(spark.createDataFrame(list(newest.items()), "doc_id long, text string"), "doc_id", "text", words(F.col("text")), f"{folder}/index", "words")
    hits = lambda index: sorted(tuple(r) for r in index_intake.lexical_index.search(index, asked, "q", words(F.col("text")), 5).select("q", "doc_id", "score", "rank").collect())
    assert hits(index_intake.search_index(spark, f"{folder}/out")) == hits(at_once) != []


def test_intake_of_a_folder_without_files(spark, folder):
    Path(f"{folder}/documents").mkdir()
    assert index_intake.run(spark, f"{folder}/documents", f"{folder}/out") == []
    send(spark, folder, FIRST)
    assert [b["new"] for b in index_intake.run(spark, f"{folder}/documents", f"{folder}/out")] == [5]


LABELS = "doc_id long, quality int, toxic int"


def test_release(spark, folder):
    rows = [(1, "one good text about rivers", "en", "a"), (2, " one good text about rivers\n", "en", "b"), (3, "one good text about rivers", "en", "c"), (4, "toxic words are in here now", "en", "a"), (5, "short", "en", "a"), (6, None, None, None), (7, "", "", " "),
            (8, "nobody says that this is bad", "de", "a/b=c"), (8, "nobody says that this is bad", "de", "a/b=c"), (8, "the same doc_id has another text", "de", "a"), (None, "a row without a name is left out", "en", "a"), (9, "toxic words are in here now", "en", "a"), (10, "Café  au lait et   du pain", "fr", "a")]
    send(spark, folder, rows)
    spark.createDataFrame([(3, 1, 0), (1, None, None), (4, 1, 1), (9, 1, 0), (9, 0, 0), (None, 1, 1), (99, 1, 1)], LABELS).write.parquet(f"{folder}/labels")
    run = lambda release: corpus_release.run(spark, f"{folder}/documents", f"{folder}/labels", f"{folder}/out", release)
    got = run("may")
    corpus, gone = corpus_release.released(spark, f"{folder}/out", "may")
    assert sorted((r.doc_id, r.text) for r in corpus.collect()) == [(3, rows[2][1]), (8, rows[7][1]), (8, rows[9][1]), (10, "Café au lait et du pain")]
    assert {(r.doc_id, r.reasons, r.canonical) for r in gone.collect()} == {
        (1, "duplicate", 3), (2, "duplicate", 3), (4, "toxic", 4), (5, "short", None), (6, "empty", 6), (7, "empty; duplicate", 6), (9, "low quality; duplicate", 4), (None, "no id", None)}
    assert (got["read"], got["texts"], got["published"], got["left_out"]) == (13, 12, 4, 8)
    first = sorted(map(tuple, corpus.collect()))
    other = run("june")
    assert run("may") == got and {**other, "release": "may"} == got  # again, and beside another release
    assert sorted(map(tuple, corpus_release.released(spark, f"{folder}/out", "may")[0].collect())) == first
    assert sum(r.rows for r in spark.read.json(f"{folder}/out/report/release=may").collect()) == 12


def test_release_holds_ambiguous_groups_back(spark, folder):
    send(spark, folder, [(1, "the very same text here", "en", "a"), (2, "the very same text here", "en", "b")])
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels")
    config = {**settings(spark, corpus_release.__file__), "hold_ambiguous": True}
    corpus_release.run(spark, f"{folder}/documents", f"{folder}/labels", f"{folder}/out", "r", config)
    corpus, gone = corpus_release.released(spark, f"{folder}/out", "r")
    assert corpus.count() == 2 and gone.count() == 0


def test_release_of_nothing(spark, folder):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents")
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels")
    got = corpus_release.run(spark, f"{folder}/documents", f"{folder}/labels", f"{folder}/out", "r")
    assert got == {"release": "r", "read": 0, "texts": 0, "published": 0, "words": 0, "left_out": 0}


def test_settings(spark, folder):
    path = f"{folder}/own.json"
    Path(path).write_text(json.dumps({"min_words": 9}))
    assert settings(spark, corpus_release.__file__, path)["min_words"] == 9
    Path(path).write_text(json.dumps({"min_word": 9}))
    with pytest.raises(ValueError, match="min_word"):
        settings(spark, corpus_release.__file__, path)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_against_its_sql(spark, name, caplog):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions")
    with caplog.at_level(logging.INFO, "jobs"):
        df = queries.QUERIES[name](spark, str(DATA))
    assert "read" in caplog.text and "200" in caplog.text
    cursor = con.execute(queries.ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(theirs) == columns
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(cell(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall())
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions"))


def test_command_line(folder):
    """The job as a user starts it, in a session of its own."""
    root = Path(__file__).parent.parent
    out = f"{folder}/{uuid.uuid4().hex}"
    call = [sys.executable, "-m", "jobs.corpus_release", "--documents", str(DATA / "documents.parquet"), "--labels", str(DATA / "labels.parquet"), "--out", out, "--release", "r1"]
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g pyspark-shell"}
    done = subprocess.run(call, cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "published" in done.stderr
    assert list(Path(out).glob("corpus/release=r1/lang=*/source=*/*.parquet"))

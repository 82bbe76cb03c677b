"""Functions that SQL cannot check, on literal cases."""

from pyspark.sql import functions as F

from corpusloom.functions import language as L
from corpusloom.functions import text as T
from corpusloom.operators import state as S
from corpusloom.sources import dumps as D


def test_html():
    page = "<head><style>x</style></head><p>para1</p><script>bad()</script><div>para2&nbsp;&amp; more</div>"
    assert T.read_html(page) == "para1\n\npara2 & more"
    assert T.read_html("a &amp; b") == "a &amp; b"
    assert T.read_html(None) is None


def test_repeated_sentences(spark):
    body = "This sentence is long enough to count. Short. "
    cases = {
        body + body.strip(): "This sentence is long enough to count. Short. Short.",
        "One long sentence stands here.\n\nONE  long sentence\nstands here. And more?": "One long sentence stands here.\n\nAnd more?",
        "One long sentence stands here.\n\none long sentence stands here.": "One long sentence stands here.",
        "": "", "  \n\n ": "", None: None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = rows.select("i", T.without_repeated_sentences(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == list(cases.values())


def test_repetitive(spark):
    rows = spark.createDataFrame([("spam again " * 60,), ("short",), (None,)], "t string").select(T.is_repetitive("t").alias("r")).collect()
    assert [r.r for r in rows] == [True, False, None]


def test_tokens(spark):
    row = spark.sql("SELECT 'Salah ok' AS t").select(T.tokens(F.col("t")).alias("t")).first()
    assert row.t == ["salah", "sal", "ala", "lah", "sala", "alah", "ok"]


def test_chunks():
    text = "\n\n".join(" ".join(f"word{i}{j}" for j in range(80)) + "." for i in range(12))
    chunks = T.chunks_of(text, 900, 150)
    assert all(len(c) <= 900 + 151 for c in chunks) and len(chunks) > 5
    assert all(w in " ".join(chunks) for w in text.split())
    assert T.chunks_of("") == [] and T.chunks_of(None) == []
    assert T.chunks_of("x" * 2000, 900, 0) == ["x" * 900, "x" * 900, "x" * 200]
    assert T.safe_cut("one two. three", 12) == 8


def test_reflow_and_pages():
    wide = "a" * 40
    assert T.reflow_lines(f"{wide}\n{wide}\nend\n\n{wide}") == [f"{wide} {wide} end", wide]
    assert T.pack(["a" * 1500, "b" * 600, "c" * 100], 2000, 2, 300) == ["a" * 1500, "b" * 600 + "\n\n" + "c" * 100]


def test_citations(spark):
    rows = spark.createDataFrame([("ok [1] [২]", 2), ("bad [3]", 2), ("none", 0), ("[1]", 0), ("[ 1 ]", 1), (None, 0)], "a string, n int")
    assert [r.v for r in rows.select(T.citations_valid(F.col("a"), F.col("n")).alias("v")).collect()] == [True, False, True, False, True, True]


def test_stray_scripts():
    assert L.clean_scripts("plain text") == (0, "plain text")
    assert L.clean_scripts("বাংলা текст") == (1, "বাংলা ")
    assert L.clean_scripts("word قال end")[0] == 1
    assert L.clean_scripts("word قال الله end")[0] == 0
    assert L.clean_scripts("mixпed") == (1, "mixed")
    assert L.clean_scripts("peace ﷺ be")[0] == 0


def test_small_talk():
    assert L.small_talk("Hi!") == ("SALAM", "")
    assert L.small_talk("assalamu alaikum, kemon achen?") == ("WELLBEING", "")
    assert L.small_talk("thanks! What is prayer?") == ("THANKS", "What is prayer?")
    assert L.small_talk("thanks giving history") == (None, None)
    assert L.small_talk("who are you today in the park") == (None, None)
    assert L.small_talk("") == (None, None)


def test_languages(spark):
    said = ["নামাজ কী", "ami kivabe namaz pori", "what is prayer", "ما هي الصلاة", "123"]
    rows = spark.createDataFrame([(s,) for s in said], "t string").select(L.detect_language(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == ["BENGALI", "BANGLISH", "ENGLISH_ARABIC", "ENGLISH_ARABIC", "ENGLISH_ARABIC"]


def test_tuples():
    assert D.tuple_values(r"(1, 'it''s \'q\' \n', NULL, -2.5e3, ''),") == ["1", "it's 'q' \n", None, "-2.5e3", ""]
    assert D.tuple_values("(1, 'cut") is None and D.tuple_values("no") is None and D.tuple_values("(1, 2") is None


def test_folds():
    log, window = S.sliding_log(2, 10), S.anchored_window(2, 10)
    assert [log(t)[0] for t in (0, 1, 2, 10, 11)] == [True, True, False, True, True]
    assert [window(t) for t in (0, 5, 9, 10, 11)] == [(True, 1), (True, 2), (False, 2), (True, 1), (True, 2)]


def test_lines_of_dumps(spark, tmp_path):
    (tmp_path / "a.sql").write_text("INSERT INTO `posts` (`id`, `t`) VALUES\n(1, 'a'),\n(2, 'b;'),\nbroken\n(3, 'c');\nINSERT INTO `x` (`id`) VALUES\n(9, 'z');\n")
    rows = D.mysql_rows(D.numbered_lines(spark, f"file://{tmp_path}"), "posts").orderBy("no").collect()
    assert [r.vals for r in rows] == [["1", "a"], ["2", "b;"], None, ["3", "c"]]


def test_files(spark, tmp_path):
    import json
    import sqlite3

    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    from corpusloom.sources import files as S

    (tmp_path / "terms.csv").write_text("﻿title\n1,a  b,c,d,2001,2002\n2,x,y,z,,2003\nno,x,y,z,1,2\n", encoding="utf-8")
    assert [(r.c0, r.c1) for r in S.csv_terms(spark, f"file://{tmp_path}/terms.csv").collect()] == [("1", "a b")]
    schema = StructType([StructField("id", IntegerType()), StructField("why", StringType())])
    (tmp_path / "list.csv").write_text("id,why\n3,dup\nx,bad\n")
    assert [(r.id, r.why) for r in S.csv_by_header(spark, f"file://{tmp_path}/list.csv", schema).collect()] == [(3, "dup"), (None, "bad")]
    assert S.csv_by_header(spark, f"file://{tmp_path}/absent.csv", schema).count() == 0
    (tmp_path / "v1.json").write_text(json.dumps([{"query": "q", "answerable": False, "relevant_ids": ["page_1"]}]))
    (tmp_path / "v2.json").write_text(json.dumps({"questions": [{"id": "a", "question": "q2", "slice": "bn", "expected_row_keys": ["page_2"]}]}))
    assert [(r.question, r.answerable, r.gold) for r in S.eval_questions(spark, f"file://{tmp_path}/v1.json").collect()] == [("q", False, [])]
    assert [(r.question, r.answerable, r.gold) for r in S.eval_questions(spark, f"file://{tmp_path}/v2.json").collect()] == [("q2", True, ["page_2"])]
    with sqlite3.connect(tmp_path / "t.db") as db:
        db.execute("CREATE TABLE v (sura INTEGER, t TEXT)")
        db.executemany("INSERT INTO v VALUES (?, ?)", [(2, "b"), (1, "a"), (1, None)])
    assert [(r.place, r.sura, r.t) for r in S.sqlite_table(spark, str(tmp_path / "t.db"), "v", ["sura", "t"]).orderBy("place").collect()] == [(0, "2", "b"), (1, "1", "a"), (2, "1", None)]
    verses = spark.createDataFrame([(1, 1, "x১ y২(ক) z৩")], "sura int, verse int, text string")
    notes = spark.createDataFrame([(1, 1, "one"), (1, -2, "two"), (2, 3, "other")], "sura int, key int, note string")
    got = S.with_notes(verses, notes).first()
    assert (got.notes, got.orphans) == (["one", "two"], 1)

"""The pipeline: each stage on what the stage before kept, its decisions in effect."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, brute_components
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from corpusloom.llm import pii, quality
from corpusloom.llm._common import documents, labels, staged

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, kept = documents(spark, DATA), []
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = staged(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False)) and kept[-1] == kept[-2]
    texts = [r.text for r in docs.select("text").collect()]
    assert len(set(texts)) == len(texts)
    last = cp.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in last} == kept[-1]
    want = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in last)
    got = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in cp.run(spark, DATA).collect())
    assert sum(c for c in got.values()) > 0 and {k[0] for k in got} == {k[0] for k in want}


def test_entry_lists_the_operators():
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with odd rows, near and exact copies, several texts under a doc_id, and columns of names used inside."""
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    long = " ".join(f"n{i}" for i in range(90))
    more = [*ODD, (900_020, long), (900_021, long + " tail"), (900_022, long), (900_022, "another text under the same name"), (900_023, "mail me: a@b.co or +1 (555) 123-4567 now, or a@b.co"), (None, None)]
    rows = spark.createDataFrame([(d, t, None if i % 2 else "en", None, None) for i, (d, t) in enumerate(more)], "doc_id long, text string, lang string, source string, n_chars long")
    return real.union(rows).withColumns({c: F.lit(5) for c in ("_row", "own", "rep", "n", "kept", "row", "stratum", "spans", "name", "set_key", "first", "route")})


def told(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_on_odd_rows_against_plain_versions(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    out = {name: stage(spark, odd, DATA) for name, stage in cp.STAGES}
    for name, _ in cp.STAGES[:-1]:
        assert out[name].columns == odd.columns
    # 1: the verdict of the operator, which has a plain version in test_operators
    verdict = quality.quality_rules(odd, labels(spark, DATA)).select("doc_id", "kept").collect()
    assert sum(told(out["quality_rules"]).values()) == sum(r.kept for r in verdict)
    # 2
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least: dict = {}
    for d, t in rows:
        if d is not None:
            least[norm(t)] = min(d, least.get(norm(t), d))
    got = told(out["exact_dedup"])
    assert {(d, norm(t)) for d, t in got if d is not None} == {(d, t) for t, d in least.items()}
    assert all(n == 1 for (d, _), n in got.items() if d is not None) and sum(n for (d, _), n in got.items() if d is None) == 2
    # 3
    want, _ = brute_components([(d, t) for d, t in rows if d is not None])
    assert told(out["ngram_jaccard_join"]) == collections.Counter((d, t) for d, t in rows if d is None or want[d] == d)
    # 4
    spans = collections.defaultdict(list)
    for r in pii.find_personal_data(odd).collect():
        spans[r.doc_id].append([(int(a), int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)])
    plain = collections.Counter()
    for d, t in rows:
        own = next((x for x in spans[d] if not x or x[-1][1] <= len(t or "")), []) if len({norm(y) for e, y in rows if e == d}) == 1 else None
        if own is not None:
            text, at = "" if t is not None else None, 0
            for a, b, k in own:
                if a >= at:
                    text += t[at:a] + f"[{k.upper()}]"
                at = max(at, b)
            plain[d, None if t is None else text + t[at:]] += 1
    masked = told(out["personal_data"])
    assert all(masked[k] >= n for k, n in plain.items()) and sum(masked.values()) == len(rows)
    assert all(r.n_chars == len(r.text) for r in out["personal_data"].filter("text IS NOT NULL").collect())
    # 5
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    pieces = collections.defaultdict(list)
    for r in out["retrieval_packing"].collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for d, t in rows:
        if d is not None and sum(e == d for e, _ in rows) == 1:
            ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
            for start, length, crc in sorted(pieces[d]):
                assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
                at += length
            assert at == len(ids)


def test_stages_on_no_rows(spark, odd):
    for name, stage in cp.STAGES:
        assert stage(spark, odd.filter("false"), DATA).count() == 0, name

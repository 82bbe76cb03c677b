"""Operator 12: mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Sources get targets in words by weight; a source gives whole copies of all its documents and, for what is left of its
target, those documents whose 60-bit code lies under a threshold. To find the threshold, words are summed by source and
bucket of codes; the bucket that holds the boundary alone is looked into again, by the next bits of the codes, until one
code is left. No row is ever sorted: documents are then filtered by comparing their code with their source's threshold.

Codes hang on doc_id and text only, so thresholds of growing targets are nested: what a smaller mix takes, a larger one
takes too. Each level of the search reads only rows of the boundary buckets, about a thousandth of the level before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import WORD, discard, staged, text_or_empty, with_group

WEIGHTS = (3, 1, 2)
#: Words of the mix, in per cent of all words.
PERCENT = 150
#: No source gives more than so many times its words.
EPOCHS = 2
SEED = 12
CODE_BITS = 60
#: Bits of a code that one level of the search looks at.
BITS = 10


def n_words(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def code(seed: int = SEED) -> Column:
    """A row's place in its source: 60 bits of a digest of doc_id and text."""
    name = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "text").cast("binary"))
    return F.conv(F.substring(name, 1, CODE_BITS // 4), 16, 10).cast("long")


def source_key(column: str = "source") -> Column:
    """Orders sources by code point, null last, and joins null like any other."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(column)))


def numbered(rows: DataFrame, order: str, what: str) -> DataFrame:
    """A written table of `rows` with `place`, from 0 in order of `order`. Rows are sorted by ranges, and what all tasks
    know is one count a range."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = staged(rows.orderBy(order).select("*", F.spark_partition_id().alias("_part"), within.alias("_within")), what)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    return ranged.join(offsets, "_part").select(*rows.columns, (F.col("_before") + F.col("_within")).alias("place"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, percent: float = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """`sources` (k, source_size, ...) with `target`: `percent` of all words shared by weights, which repeat in order of
    k; none above `epochs` times its own words, what is over is shared again by weight among the others."""
    weighed = numbered(sources, "k", "mix-sources").withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    top = F.col("source_size") * epochs
    budget = percent * (weighed.agg(F.sum("source_size")).first()[0] or 0) / 100
    level, full = 0.0, F.lit(False)
    n_full = -1
    while True:  # the words of a unit of weight grow with every source that is full; a round an own row of three numbers
        taken, weight, n = weighed.agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("_w"))), F.count_if(full)).first()
        if n <= n_full or not weight:
            break
        level, n_full = (budget - (taken or 0)) / weight, n
        full = top <= F.lit(level) * F.col("_w")
    target = F.when(top <= F.lit(level) * F.col("_w"), top.cast("double")).otherwise(F.lit(level) * F.col("_w"))
    return weighed.withColumn("target", target).drop("place", "_w")


def thresholds(rows: DataFrame, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """k, edge, left, tied: of `rows` (k, size, code) those of a code under `edge` hold `left` words less than `wanted`
    (k, words) asks for, and those of the code `edge` hold `tied` words, at least `left`. A source that wants no words,
    or has none, is left out; one that wants more than it has ends at its last code."""
    cut, found, shift = wanted.filter("words > 0").select("k", F.col("words").alias("left")), None, CODE_BITS
    inside, copies = rows.join(cut.select("k"), "k", "left_semi"), []
    while True:
        shift = max(0, shift - bits)
        bucket = F.shiftright("code", shift)
        sums = inside.groupBy("k", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("code").alias("lo"), F.max("code").alias("hi"))
        up_to = F.sum("words").over(Window.partitionBy("k").orderBy("bucket"))  # at most 2^bits buckets of a source
        held = sums.withColumn("up_to", up_to).join(cut, "k")
        last = F.max("up_to").over(Window.partitionBy("k"))
        held = held.withColumn("left", F.least("left", last)).filter((F.col("up_to") >= F.col("left")) & (F.col("up_to") - F.col("words") < F.col("left")))
        edges = staged(held.select("k", "bucket", (F.col("left") - F.col("up_to") + F.col("words")).alias("left"), "words", "lo", "hi"), "mix-edges")
        done = edges.filter("lo = hi").select("k", F.col("lo").alias("edge"), "left", F.col("words").alias("tied"))
        found = done if found is None else found.unionByName(done)
        if not edges.filter("lo < hi").limit(1).count():
            discard(*copies)
            return found
        open_ = edges.filter("lo < hi")
        inside = staged(inside.withColumn("bucket", bucket).join(open_.select("k", "bucket"), ["k", "bucket"], "left_semi").drop("bucket"), "mix-inside")
        copies.append(inside)
        cut = open_.select("k", "left")


def taken_words() -> Column:
    """Words that the mix takes of a row: whole copies, one more under the edge, and of the rows of the edge's code their
    share of the words that are left (all rows but one row's worth, where codes differ)."""
    more = F.when(F.col("code") < F.col("edge"), F.col("size")).when(F.col("code") == F.col("edge"), F.expr("left * size div tied")).otherwise(F.lit(0))
    return (F.col("copies") * F.col("size") + F.coalesce(more, F.lit(0))).cast("long")


def plan(docs: DataFrame, weights: tuple = WEIGHTS, percent: float = PERCENT, epochs: int = EPOCHS, seed: int = SEED, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, k, size, code), written once, and one row a source: k, n_rows, source_size, target, copies, edge,
    left, tied. Both are tables of the shared folder, so that a lost executor costs no second reading of the texts."""
    rows = staged(docs.select("doc_id", source_key().alias("k"), n_words().alias("size"), code(seed).alias("code")), "mix-rows")
    sources = rows.groupBy("k").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    aimed = targets(sources, weights, percent, epochs)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    aimed = staged(aimed.withColumn("copies", copies).withColumn("words", F.floor(F.col("target") - F.col("copies") * F.col("source_size") + 0.5)), "mix-targets")
    return rows, staged(aimed.drop("words").join(thresholds(rows, aimed.select("k", "words"), bits), "k", "left"), "mix-plan")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, percent: float = PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, size (words), source_size, target, taken, copies (whole
    ones that every document of the source gives).

    A null text has no words; a null source is a source of its own, the last one. A source's taken words are its target,
    rounded; the document on the boundary is taken in part. Rows that repeat doc_id and text alike share a code, hence
    one fate: on the boundary they divide what is left, less than a word lost a row. Rows without doc_id are placed by
    their text. A source without words has the target 0. An empty table gives no rows; other columns are not read.
    """
    rows, known = plan(docs, weights, percent, epochs, seed)
    return with_group(rows, known, "k", "n_rows").select("doc_id", "size", "source_size", "target", taken_words().alias("taken"), "copies")


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, percent: float = PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of `docs`, a row as often as it is taken; a copy that is taken in part holds its
    first words, joined by one space. Odd rows as in `mix`."""
    _, known = plan(docs, weights, percent, epochs, seed)
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(every.alias("_row"), source_key().alias("k"), n_words().alias("size"), code(seed).alias("code"))
    parts = F.col("taken") - F.col("_copy") * F.col("size")  # words that this copy may still give
    out = with_group(rows, known, "k", "n_rows").withColumn("taken", taken_words()).filter("taken > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")) - 1))).withColumn("_words", parts)
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0)), 1, F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") < F.col("size"), first).otherwise(F.col("_row.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '12', doc_id, text)), 1, 15))::BIGINT AS code
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY k),
r AS (SELECT *, ((150 * sum(source_size) OVER ())::DOUBLE / 100 - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE) / sum(w) OVER after_ AS lam,
             row_number() OVER (ORDER BY 2 * source_size / w, k) AS place
      FROM s WINDOW before AS (ORDER BY 2 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    after_ AS (ORDER BY 2 * source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT coalesce(min_by(lam, place) FILTER (WHERE lam * w < 2 * source_size), 0) AS lam FROM r),
t AS (SELECT k, source_size, least(2.0::DOUBLE * source_size, l.lam * w) AS target FROM s, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
c AS (SELECT d.*, source_size, target, copies, floor(target - copies * source_size + 0.5)::BIGINT AS words,
             sum(size) OVER (PARTITION BY d.k ORDER BY code) AS up_to, sum(size) OVER (PARTITION BY d.k, code) AS tied
      FROM d JOIN b ON d.k = b.k)
SELECT doc_id, size, source_size, target, copies,
       (copies * size + CASE WHEN up_to <= words THEN size WHEN up_to - tied < words THEN (words - up_to + tied) * size // tied ELSE 0 END)::BIGINT AS taken
FROM c
"""

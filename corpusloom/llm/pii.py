"""Operator 3: personal data by weak supervision. DataFrame functions only on the data's path.

Base spans come from fixed patterns with checks (see `KINDS`). Beside them there is a pool of looser candidates (phone
numbers without a plus sign, spelled-out mail addresses, card-like numbers, secrets). Three labelers vote on each:
a strict regex, a gazetteer and the words to its left. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, and a logistic span classifier is trained on its soft labels with the votes
and the candidate's shape as features. Candidates it is sure of are added where no base span overlaps them and none of
an earlier kind that it is sure of either (kinds in the order of `POOL`), so that added spans never overlap.

Vote and shape patterns are few by construction (3 votes of 3 values, 3 buckets), so their counts over all documents
are the only thing the driver gets, and the trained classifier goes back as a literal map from pattern to score.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import text_or_empty

#: Base kinds in order, as Java patterns. Possessive quantifiers and look-behinds keep them linear and free of deep
#: recursion on long runs; they match what the plain patterns match.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser candidates of the method.
POOL = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[a-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[a-z0-9-]++)++",
    "card": r"(?<![0-9A-Za-z+.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,5}(?:[ ./-][0-9]{2,5}){1,3}(?![0-9A-Za-z-]|\.[0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}+",
}
ALL_KINDS = ["email", "ip", "card", "phone", "secret"]
#: Characters to a candidate's left that the context labeler reads: its cues stand right before what they announce.
LEFT = 24
SURE = 0.9
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: Gazetteers (mail providers and top-level domains, trunk and service prefixes, card issuers' leading digits, key prefixes) and context words.
GAZETTEER = {
    "email": r"(?i)gmail|yahoo|outlook|hotmail|proton|example|(?:com|org|net|edu|de|fr|es)$",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65)",
    "phone": r"^\(?(?:0|1|8[0-9]{2}|44|49|33|34)",
    "secret": r"^(?:AKIA|ghp_|gho_|sk-|sk_live_|xox[bp]-|eyJ|AIza)",
}
#: What such lists exclude (names of no host, book numbers' prefixes, years, digits and letters in their order).
UNLISTED = {
    "email": r"(?i)\b(?:localhost|invalid|nowhere)$",
    "card": r"^(?:97[89]|0)",
    "phone": r"^(?:19|20)[0-9]{2}[ ./-]",
    "secret": r"(?i)^(?:abcdef|qwerty|0?123456|(?:[a-z]+[_-])+[a-z]+[0-9]{0,2}$)",
}
CONTEXT = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel",
    "card": r"(?i)card|visa|master|amex|karte|carte|tarjeta",
    "phone": r"(?i)tel|phone|call|mobile|fax|llam|rufen|appel",
    "secret": r"(?i)(?:token|key|secret|passw|credential|auth)[a-z_ ]*[\"']? ?[:=] ?[\"']?$",
}
AGAINST = r"(?i)(?:isbn|issn|version|sha1|sha256|md5|commit|checksum|page|order|no\.) ?[:=]? ?[\"']?$"


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, s>> in code points. Their places follow from the
    lengths of matches and of what lies between them; sums go by blocks, so that the work stays far from quadratic."""
    block = 256
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(found, F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length), lambda s, gap: F.struct(s.alias("s"), F.length(s).alias("n"), gap.alias("gap")))
    both = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"] + x["gap"])

    def placed(xs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))
        sums = F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + both(F.slice(xs, b * block + 1, F.lit(block))))))
        return F.transform(F.arrays_zip(F.array(sums.alias("sums")).alias("sums"), F.array(xs).alias("xs")), lambda z: F.transform(z["xs"], lambda x, i: place(z["xs"], z["sums"], x, i)))[0]

    def place(xs: Column, sums: Column, x: Column, i: Column) -> Column:
        b = F.floor(i / block).cast("int")
        start = F.element_at(sums, b + 1) + both(F.slice(xs, b * block + 1, i - b * block)) + x["gap"]
        return F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["s"].alias("s"))

    return F.when(text.rlike(pattern), placed(steps)).otherwise(F.array().cast("array<struct<start:int,end:int,s:string>>"))


def luhn(s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + F.when((F.length(digits) - i) % 2 == 1, F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), digits.substr(i, F.lit(1)).cast("int") + 1)).otherwise(digits.substr(i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def n_digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


def passes(kind: str, s: Column) -> Column:
    return {
        "email": F.lit(True),
        "ip": s.rlike(OCTETS),
        "card": n_digits(s).between(14, 19) & F.when(n_digits(s).between(14, 19), luhn(s)).otherwise(False),
        "phone": n_digits(s).between(10, 15),
    }[kind]


def base_spans(text: Column, kind: str) -> Column:
    return F.transform(F.filter(spans_of(text, KINDS[kind]), lambda x: passes(kind, x["s"])), lambda x: F.struct(x["start"].alias("start"), F.lit(ALL_KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def vote(for_it: Column, against: Column) -> Column:
    return F.when(for_it, "+").when(against, "-").otherwise("0")


def pattern_of(kind: str, s: Column, left: Column) -> Column:
    """Votes of the regex, the gazetteer and the context, then three shape buckets, as a short string."""
    strict, never = {
        "email": (s.rlike(r"(?i)[a-z0-9]{2,} ?[(\[{]at[)\]}].*[a-z]{2,}$"), s.rlike("^[0-9]+$")),
        "card": (n_digits(s).between(14, 19) & luhn(s), ~luhn(s)),
        "phone": (n_digits(s).between(9, 12) & s.rlike(r"^\("), ~n_digits(s).between(8, 13) | s.rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$")),
        "secret": (s.rlike(r"^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"), s.rlike("^[a-z]+[0-9]{1,4}$")),
    }[kind]
    share = n_digits(s) / F.length(s)
    shape = F.concat(
        F.when(F.length(s) < 16, "s").when(F.length(s) < 48, "m").otherwise("l"),
        F.when(share < 0.25, "s").when(share < 0.75, "m").otherwise("l"),
        F.when(left.rlike(r"[\"'(\[:=]$"), "q").otherwise("p"),
    )
    return F.concat(vote(strict, never), vote(s.rlike(GAZETTEER[kind]), s.rlike(UNLISTED[kind])), vote(left.rlike(CONTEXT[kind]), left.rlike(AGAINST)), shape)


def candidates(text: Column, kind: str) -> Column:
    """array<struct<start, kind, end, pattern>>"""
    left = lambda x: text.substr(F.greatest(x["start"] - LEFT, F.lit(0)) + 1, F.least(x["start"], F.lit(LEFT)))
    return F.transform(spans_of(text, POOL[kind]), lambda x: F.struct(x["start"].alias("start"), F.lit(ALL_KINDS.index(kind)).alias("kind"), x["end"].alias("end"), pattern_of(kind, x["s"], left(x)).alias("pattern")))


def reliabilities(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Expectation-maximisation over vote patterns (first three characters): the probability that a candidate is real,
    by vote pattern. Two classes, three labelers that err independently, counts smoothed by one."""
    votes: dict[str, float] = {}
    for p, n in counts.items():
        votes[p[:3]] = votes.get(p[:3], 0) + n
    real = {v: 1 / (1 + math.exp(-2 * (v.count("+") - v.count("-") - 0.5))) for v in votes}
    for _ in range(rounds):
        mass = {c: sum(n * (real[v] if c else 1 - real[v]) for v, n in votes.items()) for c in (0, 1)}
        said = {(c, j, x): 1.0 for c, j, x in product((0, 1), range(3), "+-0")}
        for v, n in votes.items():
            for j, x in enumerate(v):
                said[1, j, x] += n * real[v]
                said[0, j, x] += n * (1 - real[v])
        for v in votes:
            log = [math.log((mass[c] + 1) / (mass[0] + mass[1] + 2)) + sum(math.log(said[c, j, x] / (mass[c] + 3)) for j, x in enumerate(v)) for c in (0, 1)]
            real[v] = 1 / (1 + math.exp(min(60, max(-60, log[0] - log[1]))))
    return real


def span_classifier(counts: dict[str, int], steps: int = 400, l2: float = 1e-2) -> dict[str, float]:
    """Logistic regression over votes and shape, on the soft labels of `reliabilities`: score by pattern."""
    if not counts:
        return {}
    soft, total = reliabilities(counts), sum(counts.values())
    names = sorted({(j, x) for p in counts for j, x in enumerate(p)})
    rows = [(p, [names.index((j, x)) for j, x in enumerate(p)], n / total) for p, n in sorted(counts.items())]
    w = [0.0] * len(names)
    score = lambda at: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in at)))))
    for _ in range(steps):
        g = [l2 * x * 0.1 for x in w]
        for p, at, n in rows:
            e = n * (score(at) - soft[p[:3]])
            for i in at:
                g[i] += e
        w = [x - 2.0 * y for x, y in zip(w, g, strict=True)]
    return {p: score(at) for p, at, _ in rows}


def fit(docs: DataFrame) -> dict[str, dict[str, float]]:
    """Scores of every pattern found in `docs`, by kind. Counts cover all documents."""
    found = docs.select(F.concat(*[candidates(text_or_empty(), k) for k in POOL]).alias("c")).filter(F.size("c") > 0)
    rows = found.select(F.explode("c").alias("c")).groupBy("c.kind", "c.pattern").count().collect()
    return {k: span_classifier({r.pattern: r["count"] for r in rows if ALL_KINDS[r.kind] == k}) for k in POOL}


def trusted(patterns: list[str]):
    return lambda x: x["pattern"].isin(patterns)


def added_spans(text: Column, base: Column, scores: dict[str, dict[str, float]]) -> Column:
    kept = []
    for kind in POOL:
        sure = [p for p, s in sorted(scores[kind].items()) if s >= SURE and "+" in p[:3]]  # one labeler at least speaks for it
        if sure:
            own = F.filter(candidates(text, kind), trusted(sure))
            kept.append(F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    if not kept:
        return F.slice(base, 1, 0)
    order = F.create_map(*[F.lit(v) for i, k in enumerate(POOL) for v in (ALL_KINDS.index(k), i)])
    meets = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    sure_of = F.concat(*kept)
    return F.filter(sure_of, lambda x: ~F.exists(base, lambda b: meets(x, b)) & ~F.exists(sure_of, lambda y: meets(x, y) & (order[y["kind"]] < order[x["kind"]])))


def joined(spans: Column) -> Column:
    names = F.lit(ALL_KINDS)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, scores: dict[str, dict[str, float]]) -> DataFrame:
    """`docs` packed as `row`, with _base and _all: sorted array<struct<start, kind, end>>."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(row, text_or_empty().alias("_t")).withColumn("_base", F.sort_array(F.concat(*[base_spans(F.col("_t"), k) for k in KINDS])))
    return base.withColumn("_all", F.sort_array(F.concat("_base", added_spans(F.col("_t"), F.col("_base"), scores))))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans, n_added.

    Null counts as empty: no spans, the digest of no bytes. Texts are read whole at any length; repeated rows each; an
    empty table gives no rows. Where no candidate is found nothing is trained and nothing is added. Rows without doc_id are
    searched like others. Only doc_id and text are read, whatever other columns are called. Of sure
    candidates that overlap the one of the earlier kind stands, and none stands on a base span. The context labeler reads the
    LEFT characters before a candidate, as cues stand right before what they announce: a cue farther off does not vote.
    """
    found = with_spans(docs.select("doc_id", "text"), fit(docs))
    of = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == ALL_KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "row.doc_id", *[of(k) for k in KINDS], F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"), (F.size("_all") - F.size("_base")).cast("long").alias("n_added")
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first kind in brackets."""
    names = F.transform(F.lit(ALL_KINDS), lambda k: F.concat(F.lit("["), F.upper(k), F.lit("]")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.concat(a["out"], text.substr(a["at"] + 1, x["start"] - a["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], gap).otherwise(a["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """`docs` with its personal data replaced in `text` (and n_chars, if there, brought up to date). Null texts stay null."""
    found = with_spans(docs, fit(docs))
    text = F.when(F.col("row.text").isNotNull(), F.when(F.size("_all") == 0, F.col("_t")).otherwise(masked(F.col("_t"), F.col("_all"))))
    out = found.select("row", text.alias("_new"))
    new = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

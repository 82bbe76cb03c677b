"""Operator 7: removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of `WIDTH` bytes around it also starts in a document with a smaller doc_id. The corpus' suffix
array is never built whole, and suffixes that cannot matter are never moved:

1. Every window of WIDTH bytes has an anchor, its smallest GRAM-gram by hash; equal windows have equal anchors. Anchors
   meet in buckets (packed, eight bytes each), and each document learns which of its own other texts hold too.
2. Runs of windows with the same shared anchor go, with their bytes, to that anchor's bucket. Equal runs are joined
   before they move; within a bucket, too, only distinct runs are sorted. Windows of an anchor that very many texts
   hold go one by one, dealt by their own bytes, so that no bucket gathers the surroundings of a common passage.
3. A bucket's suffixes are sorted a block at a time. Suffixes are sorted by their first PERIOD bytes; longer ties are
   resolved by ranks of the positions in a difference cover, precomputed for the block: for any two suffixes a short
   shift brings both to cover positions, whose ranks settle the order. So memory is that of a block whatever the length
   of repeats. Neighbours in the order that agree on WIDTH bytes are the same window; the smallest doc_id owns it.

Copies of a whole text are set aside before: they are removed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import discard, staged, text_or_empty, with_group
from corpusloom.llm.packets import NAMES as PACKET_NAMES
from corpusloom.llm.packets import PACKET, buckets_of, by_bucket, packed, regrouped

WIDTH = 50
GRAM = 20
PERIOD = 8
SLICE = 2000
DOCS_PER_BUCKET = 2000
RUN = 64
BLOCK = 300_000
#: An anchor of more texts than this is hot: its windows go one by one, to buckets of their own bytes.
HOT_TEXTS = 4096
_HOT = np.uint64(1 << 63)
_AGAIN = 1 << 15  # marks, beside a run's size, that its bytes are those of the run before
#: Where a doc_id has several texts each is named by the range and the rank of its doc_id and, in as many low bits as the
#: doc_id with most texts needs, a number of its own.
RANGES, RANK_BITS = 200, 55
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_ODD = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def difference_cover(period: int) -> list[int]:
    """A small set of residues whose differences are all residues, found greedily."""
    cover, open_ = [0], set(range(1, period))
    while open_:
        best = max(range(period), key=lambda x: (len({(x - c) % period for c in cover} & open_ | {(c - x) % period for c in cover} & open_), -x))
        open_ -= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each string of `gram` bytes, from those of halves."""
    size, h = 1, _BYTES[data]
    with np.errstate(over="ignore"):
        at, out, step = 0, None, 0
        while True:
            if gram & size:
                piece = h[at : len(data) - gram + 1 + at]
                out = piece if out is None else (out * _ODD[step % 5] + piece) ^ (out >> np.uint64(29))
                at += size
                step += 1
            if at == gram:
                break
            h = (h[: len(h) - size] * _ODD[(step + 2) % 5] + h[size:]) ^ (h[size:] >> np.uint64(31))
            size *= 2
        return (out * _ODD[1]) ^ (out * _ODD[1] >> np.uint64(30))


def window_anchors(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """For each window of `width` bytes the smallest hash of its grams, multiplied so that its upper bits, by which buckets
    are told, are spread evenly (smallest hashes are small)."""
    m, span = gram_hashes(data, gram), width - gram + 1
    size = 1
    while size * 2 <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    with np.errstate(over="ignore"):
        return (np.minimum(m[: len(m) - (span - size)], m[span - size :]) if span > size else m) * _ODD[0]


def joined_cells(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[column]])


ANCHORS = "bucket int, docs binary, keys binary, ord binary, top binary, hi binary, lo binary"


def anchor_messages(docs: DataFrame, buckets: int) -> DataFrame:
    """Distinct anchors of each text of a slice, packed by bucket; equal texts of a slice go once."""

    def sliced(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, tuple[int, np.ndarray]] = {}
        for i, t in zip(ids, texts, strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if len(raw) < WIDTH or i is None:
                continue
            key = xxhash.xxh3_128_digest(raw)
            if key in own:
                own[key] = (min(i, own[key][0]), own[key][1])
            else:
                own[key] = (i, np.unique(window_anchors(np.frombuffer(raw, np.uint8))))
        if not own:
            return
        values = np.concatenate([v for _, v in own.values()])
        ord_ = np.repeat(np.arange(len(own), dtype=np.uint16), [len(v) for _, v in own.values()])
        order = by_bucket(values, buckets)
        values, ord_ = values[order], ord_[order]
        bucket = buckets_of(values, buckets)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        names, keys = np.array([i for i, _ in own.values()], "<i8"), np.frombuffer(b"".join(own), "V16")
        for a, b in zip(first.tolist(), np.append(first[1:], len(values)).tolist(), strict=True):
            here, at = np.unique(ord_[a:b], return_inverse=True)
            top, hi, lo = ((values[a:b] >> np.uint64(n)).astype(kind).tobytes() for n, kind in ((48, "<u2"), (32, "<u2"), (0, "<u4")))
            cells = [names[here].tobytes(), keys[here].tobytes(), at.astype("<u2").tobytes(), top, hi, lo]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], names=[c.split()[0] for c in ANCHORS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield from sliced(part.column("doc_id").to_pylist(), part.column("text").to_pylist())

    return docs.mapInArrow(run, ANCHORS)


def shared_anchors(table: pa.Table, homes: int, hot_texts: int = HOT_TEXTS) -> pa.Table:
    """Of one bucket: for the first document of each text, its anchors that other texts hold too, packed by home."""
    names, keys = joined_cells(table, "docs", "<i8"), joined_cells(table, "keys", "<u8").reshape(-1, 2)
    # texts by number; the smallest doc_id of each
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    number = np.empty(len(names), np.int64)
    number[order] = np.cumsum(np.concatenate([[False], (keys[order][1:] != keys[order][:-1]).any(1)]))
    first = np.full(number.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, number, names)
    held = np.array([len(x.as_buffer()) // 8 for x in table["docs"]])
    counts = np.array([len(x.as_buffer()) // 2 for x in table["ord"]])
    text = number[joined_cells(table, "ord", "<u2").astype(np.int64) + np.repeat(np.cumsum(held) - held, counts)]
    top, hi = (joined_cells(table, c, "<u2").astype(np.uint64) for c in ("top", "hi"))
    value = top << np.uint64(48) | hi << np.uint64(32) | joined_cells(table, "lo", "<u4")
    order = np.lexsort((text, value))
    value, text = value[order], text[order]
    fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
    value, text = value[fresh], text[fresh]
    edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    sizes = np.diff(np.append(edge, len(value)))
    many = np.repeat(sizes, sizes)
    keep = many > 1
    value, doc = value[keep] >> np.uint64(1), first[text[keep]]
    value[many[keep] > hot_texts] |= _HOT
    return packed(doc, value.astype("<u8"), homes)


#: One layout for runs on their way to buckets (bucket 0 and up) and for intervals found at once (bucket below 0: -1 - home).
RUNS = "bucket int, docs binary, ord binary, starts binary, sizes binary, anchors binary, data binary"
_RUN_NAMES = [c.split()[0] for c in RUNS.split(", ")]
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])


def spans_table(doc: np.ndarray, start: np.ndarray, end: np.ndarray, homes: int) -> pa.Table:
    found = np.empty(len(doc), SPAN)
    found["start"], found["end"] = start, end
    return packed(doc, found, homes)


def _found(doc: np.ndarray, start: np.ndarray, end: np.ndarray, homes: int) -> pa.RecordBatch:
    """Intervals in the layout of RUNS."""
    t = spans_table(doc, start, end, homes).combine_chunks()
    none = pa.nulls(t.num_rows, pa.binary())
    cell = lambda c: t[c].chunk(0)
    return pa.RecordBatch.from_arrays([pa.array([-1 - h for h in t["home"].to_pylist()], pa.int32()), cell("docs"), none, none, cell("sizes"), none, cell("data")], names=_RUN_NAMES)


def run_messages(docs: DataFrame, buckets: int, bits: int = 0) -> DataFrame:
    """Runs of windows with a shared anchor, packed by bucket with their bytes; of equal runs of a slice only those of
    the smallest document go, and the others are found to be repeats at once."""

    def sliced(ids: list, texts: list, shared: list) -> Iterator[pa.RecordBatch]:
        raws, rows = [], []
        for k, (t, cells) in enumerate(zip(texts, shared, strict=True)):
            raw = (t or "").encode("utf-8", "surrogatepass")
            raws.append(raw)
            if len(raw) < WIDTH:
                continue
            low = window_anchors(np.frombuffer(raw, np.uint8))
            known = np.frombuffer(cells, "<u8")
            hot, known = known[known >= _HOT] & ~_HOT, np.sort(known & ~_HOT)
            first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            stop = np.append(first[1:], len(low))
            value = low[first] >> np.uint64(1)
            at = np.minimum(np.searchsorted(known, value), len(known) - 1)
            for a, b, v, h in zip(first[hit := known[at] == value], stop[hit], value[hit], np.isin(value[hit], hot), strict=True):
                rows += [(k, s, 1, None) for s in range(a, b)] if h else [(k, s, min(RUN, b - s), v) for s in range(a, b, RUN)]
        seen: dict[tuple[int, bytes], list] = {}
        for k, s, n, v in rows:
            raw = raws[k][s : s + n + WIDTH - 1]
            seen.setdefault((name_of(raw) if v is None else int(v), raw), []).append((k, s))
        gone, out = [], []
        for (v, raw), places in seen.items():
            least = min(ids[k] for k, _ in places)
            again = 0  # a run that its document repeats goes with its bytes once
            for k, s in places:
                if ids[k] >> bits > least >> bits:
                    gone.append((ids[k], s, s + len(raw)))
                else:
                    out.append([0, k, s, b"" if again else raw, v, len(raw) | again])
                    again = _AGAIN
        if gone:
            yield _found(*np.array(gone, np.int64).T, buckets)
        for row, b in zip(out, buckets_of(np.array([x[4] for x in out], np.uint64) << np.uint64(1), buckets).tolist(), strict=True):
            row[0] = b
        out.sort(key=lambda x: x[0])
        at = 0
        names = np.array(ids, "<i8")
        while at < len(out):
            end = at
            while end < len(out) and out[end][0] == out[at][0]:
                end += 1
            part = out[at:end]
            here, ord_ = np.unique(np.array([x[1] for x in part]), return_inverse=True)
            cells = [ord_.astype("<u2").tobytes(), np.array([x[2] for x in part], "<u4").tobytes(), np.array([x[5] for x in part], "<u2").tobytes(), np.array([x[4] for x in part], "<u8").tobytes(), b"".join(x[3] for x in part)]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[0][0])], pa.int32()), *(pa.array([c], pa.binary()) for c in [names[here].tobytes(), *cells])], names=_RUN_NAMES)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield from sliced(*(part.column(c).to_pylist() for c in ("doc_id", "text", "shared")))

    return docs.mapInArrow(run, RUNS)


def name_of(window: bytes) -> int:
    return xxhash.xxh3_64_intdigest(window) >> 1


def words(padded: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n 8-byte big-endian words that start at each of `at`."""
    return [(np.lib.stride_tricks.sliding_window_view(padded, 8)[at + 8 * k]).copy().view(">u8").ravel().astype(np.uint64) for k in range(n)]


def dense_ranks(*keys: np.ndarray) -> np.ndarray:
    """Rank of each row of keys (first key leads), equal for equal rows."""
    order = np.lexsort(keys[::-1])
    differs = np.zeros(len(order), bool)
    for k in keys:
        differs[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(differs)
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int, period: int = PERIOD) -> np.ndarray:
    """The order of the suffixes at `starts` by their first `depth` bytes at least (zeros beyond the end)."""
    cover = difference_cover(period)
    padded = np.concatenate([data, np.zeros(depth + 4 * period + 16, np.uint8)])
    total = len(data) + period + 1
    # ranks of cover positions, by doubling: a shift by a multiple of the period leads from cover to cover
    where = np.flatnonzero(np.isin(np.arange(total) % period, cover))
    rank = np.zeros(total + depth + 4 * period, np.int64)
    rank[where] = dense_ranks(*words(padded, where, period // 8 or 1)) + 1
    reach = period
    while reach < depth:
        rank[where] = dense_ranks(rank[where], rank[where + reach]) + 1
        reach *= 2
    head = dense_ranks(*words(padded, starts, period // 8 or 1))
    residue = starts % period
    shift = np.array([[next(d for d in range(period) if (a + d) % period in cover and (b + d) % period in cover) for b in range(period)] for a in range(period)])
    # within each head, a suffix's place is the number of smaller ones in each residue class
    big = np.int64(rank.max() + 2)
    place = np.zeros(len(starts), np.int64)
    classes = [np.flatnonzero(residue == r) for r in range(period)]
    for a in range(period):
        for b in range(period):
            if len(classes[a]) and len(classes[b]):
                d = shift[a, b]
                theirs = np.sort(head[classes[b]] * big + rank[starts[classes[b]] + d])
                place[classes[a]] += np.searchsorted(theirs, head[classes[a]] * big + rank[starts[classes[a]] + d])
    return np.argsort(place, kind="stable")


def repeated_windows(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, width: int = WIDTH, period: int = PERIOD) -> np.ndarray:
    """For each window at `starts`: whether an equal window belongs to a smaller owner."""
    order = suffix_order(data, starts, width, period)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    at = starts[order]
    same = np.ones(len(at), bool)
    same[0] = False
    for k in [*range(0, width - 7, 8), width - 8]:
        w = words(padded, at + k, 1)[0]
        same[1:] &= w[1:] == w[:-1]
    group = np.cumsum(~same) - 1
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner[order])
    out = np.empty(len(at), bool)
    out[order] = least[group] < owner[order]
    return out


def bucket_repeats(table: pa.Table, homes: int, bits: int = 0) -> pa.Table:
    """Of one bucket: removed intervals, packed by home. Intervals that are known already pass through."""
    if table["bucket"][0].as_py() < 0:
        return pa.table([pa.array([-1 - b for b in table["bucket"].to_pylist()], pa.int32()), table["docs"], table["sizes"], table["data"]], names=PACKET_NAMES)
    doc = np.concatenate([np.frombuffer(n.as_buffer(), "<i8")[np.frombuffer(o.as_buffer(), "<u2")] for n, o in zip(table["docs"], table["ord"], strict=True)])
    start, size, anchor = (joined_cells(table, c, k).astype(np.int64 if c != "anchors" else np.uint64) for c, k in (("starts", "<u4"), ("sizes", "<u2"), ("anchors", "<u8")))
    data = joined_cells(table, "data", np.uint8)
    again, size = size & _AGAIN > 0, size & ~np.int64(_AGAIN)
    at = np.cumsum(np.where(again, 0, size)) - size  # a repeat lies where the run before it does
    raw = data.tobytes()
    order = np.lexsort((doc, anchor))
    cuts = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
    ends = np.append(cuts[1:], len(order))
    many = ends - cuts > 1
    gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    block: list[list[int]] = []
    held = 0

    def sort_block() -> None:
        """Sorts the windows of the distinct runs in `block`: lists of equal runs, all of the smallest document."""
        nonlocal block, held
        lead = np.array([b[0] for b in block])
        n = size[lead] - WIDTH + 1
        place = np.cumsum(size[lead]) - size[lead]
        own = np.concatenate([data[at[i] : at[i] + size[i]] for i in lead])
        run = np.repeat(np.arange(len(lead)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(repeated_windows(own, place[run] + offset, doc[lead][run] >> bits))
        times = np.array([len(b) for b in block])
        flat, first = np.concatenate([np.array(b) for b in block]), np.cumsum(times) - times
        r = run[hit]
        which = flat[np.repeat(first[r], times[r]) + np.arange(times[r].sum()) - np.repeat(np.cumsum(times[r]) - times[r], times[r])]
        s = start[which] + np.repeat(offset[hit], times[r])
        gone.append((doc[which], s, s + WIDTH))
        block, held = [], 0

    for a, b in zip(cuts[many], ends[many], strict=True):
        runs: dict[bytes, list[int]] = {}
        for i in order[a:b].tolist():
            runs.setdefault(raw[at[i] : at[i] + size[i]], []).append(i)
        for members in runs.values():  # in order of doc_id
            later = [i for i in members if doc[i] >> bits > doc[members[0]] >> bits]
            if later:
                gone.append((doc[later], start[later], start[later] + size[later]))
        if len(runs) > 1:
            for members in runs.values():
                block.append([i for i in members if doc[i] >> bits == doc[members[0]] >> bits])
                held += len(raw[at[members[0]] : at[members[0]] + size[members[0]]])
            if held > BLOCK:
                sort_block()
    if block:
        sort_block()
    if not gone:
        return spans_table(*(np.zeros(0, np.int64),) * 3, homes)
    return spans_table(*(np.concatenate(x) for x in zip(*gone, strict=True)), homes)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not len(starts):
        return []
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(fresh)
    return list(zip(starts[first].tolist(), ends[np.append(first[1:] - 1, len(ends) - 1)].tolist(), strict=True))


def documents_anchors(own: DataFrame, buckets: int, hot_texts: int = HOT_TEXTS) -> DataFrame:
    met = anchor_messages(own, buckets).groupBy("bucket").applyInArrow(lambda t: shared_anchors(t, buckets, hot_texts), PACKET)
    return regrouped(met, 8).withColumnRenamed("data", "shared")


def found_spans(own: DataFrame, shared: DataFrame, buckets: int, bits: int) -> DataFrame:
    live = own.join(shared.hint("shuffle_hash"), "doc_id")
    return regrouped(run_messages(live, buckets, bits).groupBy("bucket").applyInArrow(lambda t: bucket_repeats(t, buckets, bits), PACKET), SPAN.itemsize)


def text_key() -> Column:
    return F.unhex(F.sha2(text_or_empty().cast("binary"), 256))


def named(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, text, name), texts (name, key) of WIDTH bytes or more, and how many low bits of a name do not count
    in the order of documents. A name is the doc_id itself, unless some doc_id has several texts."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    texts = staged(rows.select("doc_id", F.octet_length(text_or_empty()).alias("n"), text_key().alias("key")).filter(f"n >= {WIDTH} AND doc_id IS NOT NULL").select("doc_id", "key"), "suffix-keys")
    if not texts.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").limit(1).count():
        return rows.withColumn("name", F.col("doc_id")), texts.withColumnRenamed("doc_id", "name"), 0

    apart = texts.distinct()
    bits = (apart.groupBy("doc_id").count().agg(F.max("count")).first()[0] - 1).bit_length()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rank, variant, base = None, 0, 0, TaskContext.get().partitionId() << RANK_BITS
        for batch in batches:
            names = []
            for doc in batch.column("doc_id").to_pylist():
                rank, variant = (rank, variant + 1) if doc == before else (rank + 1, 0)
                before = doc
                if rank >> (RANK_BITS - bits):
                    raise OverflowError(f"a range holds more doc_ids than {RANK_BITS - bits} bits can name")
                names.append(base | rank << bits | variant)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], names=["doc_id", "key", "name"])

    names = staged(apart.repartitionByRange(RANGES, "doc_id").sortWithinPartitions("doc_id", "key").mapInArrow(number, "doc_id long, key binary, name long"), "suffix-names")
    own = rows.withColumn("key", text_key()).join(names, ["doc_id", "key"], "left").select("doc_id", "text", "name")
    named_texts = staged(texts.join(names, ["doc_id", "key"]).select("name", "key"), "suffix-keys")
    discard(texts)
    return own, named_texts, bits


def repeated_spans(own: DataFrame, texts: DataFrame, bits: int, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """name, spans (intervals to be removed, packed as SPAN; they may overlap), whole (all of it goes)."""
    own = own.filter("name IS NOT NULL").select(F.col("name").alias("doc_id"), "text")
    buckets = max(8, texts.count() // DOCS_PER_BUCKET)
    firsts = staged(texts.groupBy("key").agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "suffix-firsts")
    later = F.shiftright("name", bits) > F.shiftright("first", bits)
    copies = staged(with_group(texts, firsts, "key", "c").filter(later).select("name").distinct(), "suffix-copies")
    shared = staged(documents_anchors(own, buckets, hot_texts), "suffix-shared")
    out = staged(found_spans(own, shared, buckets, bits).withColumnRenamed("doc_id", "name"), "suffix-spans")
    discard(shared, firsts)
    return out.join(copies.withColumn("whole", F.lit(True)), "name", "full").select("name", F.col("data").alias("spans"), F.coalesce("whole", F.lit(False)).alias("whole"))


def remove_repeats(docs: DataFrame, with_text: bool = False, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept
    as `kept` if asked for.

    Null counts as empty: no bytes, nothing removed. Texts under WIDTH bytes neither lose nor cost anything. Rows that
    repeat a doc_id are not each other's repeats, whether their texts are equal or not; each loses of its own text what
    smaller doc_ids hold. Rows without doc_id have no place in the order: they are left whole. An empty table gives no
    rows. Texts are read whole at any length. Only doc_id and text are read, whatever other columns are called.
    """
    rows, texts, bits = named(docs)
    own = rows.join(repeated_spans(rows, texts, bits, hot_texts).hint("shuffle_hash"), "name", "left").select("doc_id", "text", "spans", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, whole in zip(batch.column("text"), batch.column("spans"), batch.column("whole"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if whole.as_py():
                    cut = [(0, len(raw))] if len(raw) >= WIDTH else []
                else:
                    found = np.frombuffer(spans.as_buffer(), SPAN) if spans.is_valid else np.zeros(0, SPAN)
                    cut = [(a, min(b, len(raw))) for a, b in merged(found["start"].astype(np.int64), found["end"].astype(np.int64)) if a < len(raw)]
                edges = [0, *(x for span in cut for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())] + [pa.array(columns[4], pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return own.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)

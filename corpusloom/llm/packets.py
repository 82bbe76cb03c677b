"""Records of documents, packed by the home of their document, so that what many buckets found about a document meets
again without a row for each document and bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKET = "home int, docs binary, sizes binary, data binary"
NAMES = ["home", "docs", "sizes", "data"]


def homes_of(doc: np.ndarray, homes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(homes)).astype(np.int64)


def buckets_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 64-bit hashes, by their upper bits, in the order of the hashes."""
    bits = 16 if buckets <= 1 << 16 else 32
    return ((values >> np.uint64(64 - bits)) * np.uint64(buckets) >> np.uint64(bits)).astype(np.int32)


def by_bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """An order in which buckets, and the upper 16 bits within them, ascend."""
    return np.argsort((values >> np.uint64(48)).astype(np.uint16) if buckets <= 1 << 16 else values, kind="stable")


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.append(starts[1:], len(sorted_values))


def packed(doc: np.ndarray, records: np.ndarray, homes: int) -> pa.Table:
    """One row for each home: its documents, how many records each has, and the records."""
    home = homes_of(doc, homes)
    order = np.lexsort((doc, home))
    home, doc, records = home[order], doc[order], records[order]
    rows: list[list] = [[], [], [], []]
    for a, b in zip(*runs(home), strict=True):
        starts, ends = runs(doc[a:b])
        for column, x in zip(rows, (int(home[a]), doc[a:b][starts].astype("<i8").tobytes(), (ends - starts).astype("<u4").tobytes(), records[a:b].tobytes()), strict=True):
            column.append(x)
    return pa.table([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=NAMES)


def by_document(table: pa.Table, kind: np.dtype | str) -> Iterator[tuple[int, np.ndarray]]:
    """Of one home: each document with all its records."""
    whole = [np.concatenate([np.frombuffer(x.as_buffer(), k) for x in table[c]]) for c, k in (("docs", "<i8"), ("sizes", "<u4"), ("data", kind))]
    doc = np.repeat(whole[0], whole[1])
    order = np.argsort(doc, kind="stable")
    doc, data = doc[order], whole[2][order]
    for a, b in zip(*runs(doc), strict=True):
        yield int(doc[a]), data[a:b]


def regrouped(found: DataFrame, width: int) -> DataFrame:
    """doc_id, data: all records (of `width` bytes) of each document."""

    def merge(table: pa.Table) -> pa.Table:
        rows = [(d, x.tobytes()) for d, x in by_document(table, f"V{width}")]
        return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "data": pa.array([x for _, x in rows], pa.binary())})

    return found.groupBy("home").applyInArrow(merge, "doc_id long, data binary")

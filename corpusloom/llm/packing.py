"""Operator 5: packing documents into training sequences by lexical retrieval.

1. The documents are tokenised once and kept as token identifiers.
2. In the same pass each is routed: a bounded sample of documents gives `PIVOTS` pivots, and a document's route is the
   order of the pivots that score best for it by BM25 (its permutation prefix). Sorted by route, wherever they stood in
   the input, documents that say alike stand together, and each run of `SHARD_ROWS` documents (or `SHARD_TOKENS` tokens,
   whichever is reached first) is a shard.
3. Each shard gets a BM25 inverted index, with document frequencies and mean length of the whole corpus. A window's seed
   asks the index with all of its distinct terms, and the best unused neighbours fill the window. The document that
   reaches the window's end is cut there and is the next window's seed. Where no unused document shares a term with the
   seed, the next one in order goes on. Windows run on across the shards of a task, so that only a task's last is short.

A seed meets the documents of its shard, not those of all shards: asking all of them is work that grows with the square
of the corpus. tests/llm/measure_packing.py measures what share of the corpus' best neighbours a seed's shard holds.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm._common import staged

WINDOW = 2048
END = 1
#: Documents of a shard; its tokens, where documents are so long that these end it first.
SHARD_ROWS, SHARD_TOKENS = 2048, 8_000_000
#: Sampled documents (about), pivots among them, pivots of a route.
SAMPLE, PIVOTS, PREFIX = 2048, 64, 4
#: Tasks of the packing at most; beyond that a task packs several shards, one after the other.
TASKS = 20_000
K1, B = 1.5, 0.75
#: Share of a shard's documents from which a term has a dense column; seeds that are scored at once.
DENSE, SCORED = 0.02, 1024
#: Pre-tokens that a worker remembers, twice at most; bytes of text that are tokenised at once; documents routed at once.
CACHE, AT_ONCE, ROUTED = 250_000, 1 << 22, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: The normaliser and pre-tokeniser of the word-level vocabulary, whose pre-tokens are told apart below.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENISER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

# Latin-1 characters by kind: white space, letters, numerals (each a pre-token), anything else.
_SPACE, _LETTER, _NUMERAL, _OTHER = range(4)
_KIND = np.array([_SPACE if chr(c).isspace() and not 0x1C <= c <= 0x1F else _LETTER if chr(c).isalpha() else _NUMERAL if chr(c).isnumeric() else _OTHER for c in range(256)], np.uint8)
_LOWER = bytes(ord(chr(c).lower()) for c in range(256))
#: The byte-level alphabet: printable Latin-1 stands for itself, every other byte for the next character from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLED = dict(zip((b for b in range(256) if b not in _PLAIN), range(256, 512), strict=False))
_BUILT: dict = {}


def pre_tokens(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of Latin-1 text in lower case, and where each begins. They lie one after the other in one buffer,
    so that none of them is a Python object."""
    data = np.frombuffer(raw, np.uint8)
    kind = _KIND[data]
    word = kind != _SPACE
    first = word.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMERAL)
    marks = np.flatnonzero(data == 39)
    marks = marks[(marks == 0) | (kind[marks - 1] != _OTHER)]  # within a run of other characters it is one of them
    after = np.concatenate([data, np.full(3, 32, np.uint8)])
    for ending in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        own = marks[np.all([after[marks + 1 + i] == c for i, c in enumerate(ending)], axis=0)]
        first[own + 1] = False
        behind = own + 1 + len(ending)
        behind = behind[behind < len(data)]
        first[behind] = word[behind]
    starts = np.flatnonzero(first)
    before = np.cumsum(word, dtype=np.int32)
    offsets = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]), starts


class Merges:
    """The model's byte-pair merges, applied to many pre-tokens at once: in each round every pre-token that still has a
    known pair merges the one of lowest rank, the leftmost if there are several."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        self.rank = np.argsort(key, kind="stable")
        self.key, self.merged = key[self.rank], np.array([vocab[a + b] for a, b in pairs], np.int64)[self.rank]
        self.none = len(pairs)
        spelled = [chr(_SPELLED.get(b, b)) for b in range(256)]
        self.inner, self.last = (np.array([vocab.get(c + x, -1) for c in spelled], np.int64) for x in ("", suffix))

    def _pairs(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place of each pair; pairs that do not merge, or reach into the next pre-token, rank last."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.key, key), self.none - 1)
        return np.where(same & (self.key[at] == key), self.rank[at], self.none), at

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all of `words` (UTF-8, none empty), one after the other, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - 1
        ids, word = self.inner[data], np.repeat(np.arange(len(words)), size)
        ids[ends] = self.last[data[ends]]
        after = lambda x: np.append(x[1:], -1)
        rank, at = self._pairs(ids, after(ids), word == after(word))
        done = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            least = np.repeat(least, np.diff(np.append(starts, len(word))))
            open_ = least < self.none
            if not open_.all():
                done.append((word[~open_], ids[~open_]))
                ids, word, rank, at, least = (x[open_] for x in (ids, word, rank, at, least))
            i = np.flatnonzero(rank == least)
            i = i[np.concatenate([np.ones(min(1, len(i)), bool), word[i[1:]] != word[i[:-1]]])]
            ids[i] = self.merged[at[i]]
            stays = np.ones(len(ids), bool)
            stays[i + 1] = False
            ids, word, rank, at = (x[stays] for x in (ids, word, rank, at))
            i -= np.arange(len(i))
            changed = np.concatenate([i, i[i > 0] - 1])
            behind = np.minimum(changed + 1, len(ids) - 1)
            rank[changed], at[changed] = self._pairs(ids[changed], ids[behind], (word[changed] == word[behind]) & (behind > changed))
        word, ids = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class WordIds:
    """Identifiers of texts. Where the file's normaliser and pre-tokeniser are the known ones, pre-tokens are encoded
    apart from each other: those of Latin-1 texts are looked up, and only new ones go to the tokenizer's model. Texts in
    other characters, and all texts under any other file, go to the tokenizer whole."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        self.apart = spec["normalizer"] == NORMALISER and spec["pre_tokenizer"] == PRE_TOKENISER
        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        model = spec["model"]
        plain = model["type"] == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        self.apart = self.apart and plain
        if self.apart:
            self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
            self.apart = min(self.merges.inner.min(), self.merges.last.min()) >= 0  # every byte has an identifier
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE:  # what is not asked for again until the next time is forgotten
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        if None in found:
            new = [i for i, cell in enumerate(found) if cell is None]
            older = list(map(self.older.get, [words[i] for i in new]))
            if None in older:
                apart = [words[i] for i, cell in zip(new, older, strict=True) if cell is None]
                ids, size = self.merges([w if w.isascii() else w.decode("latin-1").encode() for w in apart])
                raw, cuts = ids.astype(self.kind).tobytes(), (np.cumsum(size) * self.kind.itemsize).tolist()
                fresh = map(raw.__getitem__, map(slice, [0, *cuts], cuts))
                older = [next(fresh) if cell is None else cell for cell in older]
            for i, cell in zip(new, older, strict=True):
                found[i] = cell
            self.known.update(zip([words[i] for i in new], older, strict=True))
        return found

    def _latin(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b" ".join(texts)
        arr, starts = pre_tokens(raw)
        coded = arr.dictionary_encode()
        cells = self._look_up(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, cells), np.int32, len(cells)) // np.int32(self.kind.itemsize)
        pool, at = np.frombuffer(b"".join(cells), self.kind), np.cumsum(size, dtype=np.int32) - size
        index = coded.indices.to_numpy()
        n = size[index]
        ends = np.cumsum(n, dtype=np.int32)
        place = np.repeat(at[index] - (ends - n), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = pool[place]
        text_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return ids, np.diff(np.append(0, ends)[np.searchsorted(starts, text_starts)]).astype(np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The identifiers of all texts, one after the other, and how many each text has."""
        latin: dict[int, list[bytes]] = {}
        if self.apart:
            for i, text in enumerate(texts):
                try:
                    latin[i] = apart(text.encode("latin-1").translate(_LOWER), AT_ONCE)
                except UnicodeEncodeError:
                    pass
        if len(latin) == len(texts) and all(len(x) == 1 for x in latin.values()) and sum(len(x[0]) for x in latin.values()) <= 2 * AT_ONCE:
            return self._latin([x[0] for x in latin.values()])
        pieces, owners, parts, sizes = [], [], [], np.zeros(len(texts), np.int64)
        for i, many in latin.items():
            pieces += many
            owners += [i] * len(many)
        coded: dict[int, list[np.ndarray]] = {}
        at = 0
        while at < len(pieces):
            end, held = at, 0
            while end < len(pieces) and (end == at or held + len(pieces[end]) <= AT_ONCE):
                held += len(pieces[end])
                end += 1
            ids, n = self._latin(pieces[at:end])
            cuts = np.cumsum(n)
            for owner, a, b in zip(owners[at:end], (cuts - n).tolist(), cuts.tolist(), strict=True):
                coded.setdefault(owner, []).append(ids[a:b])
            at = end
        for i, text in enumerate(texts):
            own = coded[i] if i in latin else [np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)]
            parts += own
            sizes[i] = sum(map(len, own))
        return np.concatenate([np.zeros(0, self.kind), *parts]), sizes


def apart(raw: bytes, most: int) -> list[bytes]:
    """A text in parts of about `most` bytes, cut at white space; longer where there is none."""
    out = []
    while len(raw) > most:
        cut = raw.find(b" ", most)
        if cut < 0:
            break
        out.append(raw[:cut])
        raw = raw[cut:]
    return [*out, raw]


def counted(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of each document's distinct terms, in this order."""
    shift = np.uint64(32)
    narrow = ids.dtype.itemsize == 2 and len(sizes) <= 1 << 16
    key = np.repeat(np.arange(len(sizes), dtype=np.uint32 if narrow else np.uint64), sizes)
    key = (key << np.uint32(16)) | ids if narrow else (key << shift) | ids.astype(np.uint64)
    key.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint32(16), key & np.uint32(0xFFFF), count) if narrow else ((key >> shift).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), count)


def weights(term: np.ndarray, tf: np.ndarray, length: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    return (idf[term] * tf / (tf + K1 * (1 - B + B * length / mean))).astype(np.float32)


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Routes:
    """Pivots, as a matrix of BM25 weights by term."""

    def __init__(self, pivots: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, mean: float):
        self.columns = len(pivots)
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *(t.astype(np.int64) for t, _, _ in pivots)]))
        self.row = np.zeros(len(idf), np.int32)  # row 0: terms that no pivot has
        self.row[used] = np.arange(1, len(used) + 1)
        self.weight = np.zeros((len(used) + 1, self.columns), np.float32)
        for p, (term, tf, length) in enumerate(pivots):
            self.weight[self.row[term], p] = weights(term, tf, length, idf, mean)

    def __call__(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Routes of `n` documents, as numbers that sort as their routes do. `doc`: sorted."""
        route = np.zeros(n, np.int64)
        if not self.columns:
            return route
        row = self.row[term]
        for lo in range(0, n, ROUTED):
            some = slice(*np.searchsorted(doc, [lo, lo + ROUTED]))
            asks = np.zeros((min(ROUTED, n - lo), len(self.weight)), np.float32)
            asks[doc[some] - lo, row[some]] = 1
            for best in np.argsort(-(asks @ self.weight), axis=1, kind="stable")[:, :PREFIX].T:
                route[lo : lo + ROUTED] = route[lo : lo + ROUTED] * self.columns + best
        return route


def word_ids(data: bytes) -> WordIds:
    if "ids" not in _BUILT:
        _BUILT["ids"] = WordIds(data)
    return _BUILT["ids"]


def in_parts(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches of at most about `most` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(sizes), np.array(end, ids.dtype)), sizes + 1


def fitted(docs: DataFrame, n: int, data, end: int = END, vocabulary: int = 1 << 16) -> Routes:
    """Routes, from a sample of about `SAMPLE` documents picked by a hash of doc_id. Its document frequencies are used for
    nothing else. Where the sample is empty all documents have one route."""
    every = max(1, n // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.xxhash64("doc_id").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            ids, sizes = with_end(*word_ids(data.value)([t or "" for t in batch.column("text").to_pylist()]), end)
            doc, term, count = counted(ids, sizes)
            cuts = np.searchsorted(doc, np.arange(len(sizes) + 1))
            cells = [pa.array([x[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cells, pa.array(sizes, pa.int64())], names=["doc_id", "terms", "counts", "length"])

    told = staged(sample.mapInArrow(run, "doc_id long, terms binary, counts binary, length long"), "packing-sample")
    df, total, seen = np.zeros(vocabulary), 0, 0

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for cell in batch.column("terms"):
                own[np.frombuffer(cell.as_buffer(), "<u4")] += 1
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["term", "n"])

    rows = told.select("terms").mapInArrow(spread, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    seen, total = told.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    chosen = told.orderBy("doc_id", "length", "terms").limit(PIVOTS).toArrow().to_pylist()  # a vocabulary's size each at most
    pivots = [(np.frombuffer(r["terms"], "<u4"), np.frombuffer(r["counts"], "<u4"), r["length"]) for r in chosen]
    return Routes(pivots, inverse_frequency(df, seen), max(total / max(seen, 1), 1.0))


def tokenised(docs: DataFrame, data, routes, end: int = END, vocabulary: int = 1 << 16) -> DataFrame:
    """doc_id; ids: little-endian identifiers with `end` last; route; row: a number of the document. Rows whose `df` is
    set are not documents: one a partition, `df` counts its documents by token identifier, n and total its documents and
    their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, df, n, total = word_ids(data.value), np.zeros(vocabulary, "<u4"), 0, 0
        base = TaskContext.get().partitionId() << 40
        for batch in in_parts(batches):
            ids, sizes = with_end(*to_ids([t or "" for t in batch.column("text").to_pylist()]), end)
            doc, term, _ = counted(ids, sizes)
            df += np.bincount(term, minlength=vocabulary).astype("<u4")
            k, width = len(sizes), ids.dtype.itemsize
            offsets = np.append(0, np.cumsum(sizes) * width).astype(np.int32)
            cells = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
            none = pa.nulls(k, pa.int64())
            route, row = routes.value(doc, term, k), np.arange(base + n, base + n + k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), cells, pa.array(route), pa.array(row), pa.nulls(k, pa.binary()), none, none], names=names)
            n, total = n + k, total + len(ids)
        if n:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.binary()), none, none, pa.array([df.tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=names)

    schema = "doc_id long, ids binary, route long, row long, df binary, n long, total long"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def frequencies(tokens: DataFrame, vocabulary: int = 1 << 16) -> tuple[np.ndarray, int, int]:
    """Documents by token identifier, documents, tokens; over all of `tokens`. Partitions' counts are added up by
    identifier, so the driver gets a vector as long as the vocabulary whatever their number."""
    parts = tokens.filter("df IS NOT NULL")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for cell in batch.column("df"):
                df += np.frombuffer(cell.as_buffer(), "<u4")
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "n"])

    rows = parts.select("df").mapInArrow(spread, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(vocabulary)
    df[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    n, total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return df, n, total


class Index:
    """BM25 inverted index of a shard. Terms that many of its documents hold have a dense column, others a posting list."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(ids)
        lengths = np.array([len(x) for x in ids], np.int64)
        doc, term, tf = counted(np.concatenate(ids), lengths)
        weight = weights(term, tf, lengths[doc], idf, mean)
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, self.n)))
        held = np.bincount(term, minlength=len(idf))
        common = np.flatnonzero(held > DENSE * self.n)
        self.column = np.full(len(idf), -1)
        self.column[common] = np.arange(len(common))
        at = self.column[term]
        self.dense = np.zeros((len(common), self.n), np.float32)
        self.dense[at[at >= 0], doc[at >= 0]] = weight[at >= 0]
        term, doc, weight = term[at < 0], doc[at < 0], weight[at < 0]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.scored: dict[int, np.ndarray] = {}

    def scores(self, seeds: list[np.ndarray]) -> np.ndarray:
        """Score of every document for each seed's distinct terms, all of them."""
        term, who = np.concatenate(seeds), np.repeat(np.arange(len(seeds)), [len(t) for t in seeds])
        at = self.column[term]
        query = np.zeros((len(seeds), len(self.dense)), np.float32)
        query[who[at >= 0], at[at >= 0]] = 1
        score = query @ self.dense
        term, who = term[at < 0], who[at < 0]
        order = np.argsort(term, kind="stable")
        term, who = term[order], who[order]
        asked, first = np.unique(term, return_index=True)
        for t, lo, hi in zip(asked.tolist(), first.tolist(), np.append(first, len(term))[1:].tolist(), strict=True):
            s = slice(self.starts[t], self.starts[t + 1])
            if s.stop - s.start > 1:  # a term of the seed alone finds nobody else
                score[who[lo:hi, None], self.doc[s]] += self.weight[s]
        return score

    def of(self, seed: int) -> np.ndarray:
        """Scores for one of the shard's documents. Seeds are scored in blocks."""
        block = seed // SCORED
        if block not in self.scored:
            self.scored[block] = self.scores(self.terms[block * SCORED : (block + 1) * SCORED])
        return self.scored[block][seed % SCORED]

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first (ties: in order)."""
        score = np.where(unused, self.of(seed), -1)
        score[seed] = -1
        while score[best := int(score.argmax())] > 0:
            yield best
            score[best] = -1


class Windows:
    """The windows of a task, filled one after the other."""

    def __init__(self, window: int, first: int):
        self.window, self.number, self.offset, self.rows = window, first, 0, []

    def place(self, name: int | None, ids: np.ndarray) -> bool:
        """Puts a document into the current window and those after it; whether it reached the window's end."""
        wide, at, ended = ids.astype("<u4").tobytes(), 0, False
        while at < len(ids):
            k = min(self.window - self.offset, len(ids) - at)
            self.rows.append((name, at, k, zlib.crc32(wide[4 * at : 4 * (at + k)]), len(ids), self.number, self.offset))
            at, self.offset = at + k, self.offset + k
            if self.offset == self.window:
                self.number, self.offset, ended = self.number + 1, 0, True
        return ended

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])


def fill(names: list[int | None], ids: list[np.ndarray], index: Index, windows: Windows) -> None:
    """Packs all documents of a shard."""
    unused, left, following, neighbours = np.ones(len(ids), bool), len(ids), 0, iter(())
    while left:
        best, fresh = next(neighbours, None), False
        if best is None:  # nobody is left who shares a term with the seed
            while not unused[following]:
                following += 1
            best, fresh = following, True
        unused[best], left = False, left - 1
        if windows.place(names[best], ids[best]) or fresh:
            neighbours = index.neighbours(best, unused)


def shards(batches: Iterator[pa.RecordBatch], rows: int, kind: str) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    names, ids, held = [], [], 0
    for batch in batches:
        for name, cell in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            own = np.frombuffer(cell, kind)
            if names and (len(names) == rows or held + len(own) > SHARD_TOKENS):
                yield names, ids
                names, ids, held = [], [], 0
            names.append(name), ids.append(own)
            held += len(own)
    if names:
        yield names, ids


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: see `PIECES`. `docs`: doc_id, text; other columns are not read.

    A null or empty text is a document of its end identifier alone. A long document fills windows of its own and its
    rest is a seed like any other; it is read whole. Repeated rows are packed each, and rows without doc_id too. An empty
    table gives no rows. Documents that share nothing with a seed follow in the order of their routes. Shards end after
    `shard_rows` documents or `SHARD_TOKENS` tokens.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        raw = f.read()
    own = WordIds(raw)
    vocabulary = max(1 << 16, own.tokenizer.get_vocab_size(), end + 1)
    kind, n = str(own.kind.str), docs.count()
    if not n:
        return spark.createDataFrame([], PIECES)
    data = spark.sparkContext.broadcast(raw)  # a fixed file
    routes = spark.sparkContext.broadcast(fitted(docs, n, data, end, vocabulary))
    tokens = staged(tokenised(docs, data, routes, end, vocabulary), "packing-tokens")
    df, n, total = frequencies(tokens, vocabulary)
    corpus = spark.sparkContext.broadcast((inverse_frequency(df, n), max(total / n, 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window, TaskContext.get().partitionId() << 40)
        for names, ids in shards(batches, shard_rows, kind):
            fill(names, ids, Index(ids, *corpus.value), windows)
            yield windows.batch()

    routed = tokens.filter("df IS NULL").repartitionByRange(max(1, min(TASKS, -(-n // shard_rows))), "route", "row").sortWithinPartitions("route", "row")
    return routed.select("doc_id", "ids").mapInArrow(run, PIECES)

"""python tests/llm/measure_packing.py DOCUMENTS.parquet: of the documents whose number is divisible by 100, what share of
their best neighbours in the whole table (BM25 over all terms, brute force) stands in their own shard, and how the best
score within the shard compares with the best of all."""

import sys
from pathlib import Path

import numpy as np
import pyarrow.dataset as ds

sys.path.insert(0, str(Path(__file__).parent.parent.parent))
import public_tokenizers  # noqa: E402

from corpusloom.llm import packing  # noqa: E402


def main(path: str) -> None:
    own = packing.WordIds(Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes())
    ids = []
    for batch in packing.in_parts(ds.dataset(path).to_batches(columns=["text"])):
        ids += np.split(*(lambda i, n: (i, np.cumsum(n)[:-1]))(*packing.with_end(*own([t or "" for t in batch.column("text").to_pylist()]), packing.END)))
    n, sizes = len(ids), np.array([len(x) for x in ids])
    df = sum(np.bincount(np.unique(x), minlength=1 << 16) for x in ids)
    idf, mean = packing.inverse_frequency(df, n), float(sizes.mean())
    picked = np.random.default_rng(0).permutation(n)[: packing.PIVOTS]
    routes = packing.Routes([(*np.unique(ids[i], return_counts=True), len(ids[i])) for i in picked], idf, mean)
    route = []
    for lo in range(0, n, 4096):
        part = ids[lo : lo + 4096]
        doc, term, _ = packing.counted(np.concatenate(part), sizes[lo : lo + 4096])
        route.append(routes(doc, term, len(part)))
    place = np.empty(n, np.int64)
    place[np.lexsort((np.arange(n), np.concatenate(route)))] = np.arange(n)
    asked = np.arange(0, n, 100)
    terms, score = [np.unique(ids[i]) for i in asked], np.zeros((len(asked), n), np.float32)
    for lo in range(0, n, 2048):
        score[:, lo : lo + 2048] = packing.Index(ids[lo : lo + 2048], idf, mean).scores(terms)
    score[np.arange(len(asked)), asked] = -1
    best = score.max(1)
    for rows in (packing.SHARD_ROWS, 2 * packing.SHARD_ROWS):
        shard = place // rows
        here = np.where(shard == shard[asked][:, None], score, -1).max(1)
        same = [(shard[np.argpartition(-score, k - 1)[:, :k]] == shard[asked][:, None]).mean() for k in (1, 10)]
        print(f"{n} documents, shards of {rows}: best neighbour {same[0]:.3f}, ten best {same[1]:.3f}, score of the best {np.mean(here[best > 0] / best[best > 0]):.3f}")


main(sys.argv[1])

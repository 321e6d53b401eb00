"""Benchmark decontamination: SimHash windows of item size, multi-index
Hamming blocks, exact weighted-shingle verification.

The benchmark is the stated query set: it is read in blocks of items, each of
a fixed size, and every block is compared with all documents in one pass that
shuffles nothing. Per task, the words and shingles of a batch are hashed with
numpy. A window of an item's size that shares no shingle with the item has
similarity 0, so only windows around shared shingles are fingerprinted (this
loses nothing). Window fingerprints meet the item fingerprints through
multi-index blocks: of ``len(blocks)`` blocks of 8 bits, two fingerprints
within ``radius`` agree in one up to radius // blocks bits, so every pair
within the radius is found. Candidates are verified exactly: the weight of the
item's shingles found in the window, divided by the item's weight.

Shingles are five words (an item of fewer words is one shingle of all of
them); a shingle weighs ln(1 + items / items that hold it). The items of the
whole benchmark are counted, so results don't depend on the size of a block.

Defined results
* Null or wordless texts and items match nothing; empty tables give no rows.
* Repeated documents give repeated rows, repeated items a row for each item_id.
* Ties: the window of highest similarity, then the first one, is reported.
* Input columns other than ids and texts do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm import wordhash as wh
from innsight.llm.columns import small_batches

SHINGLE = 5
BITS = 64
BLOCK_BITS = 8
HITS = "doc_id long, item_id long, first_word long, n_window long, hamming int, similarity double"


def _fingerprint(bits_sum: np.ndarray) -> np.ndarray:
    """Rows of 64 signed sums to 64-bit fingerprints."""
    return np.packbits(bits_sum > 0, axis=-1).view(">u8").reshape(-1).astype(np.uint64)


def _signed_bits(h: np.ndarray) -> np.ndarray:
    as_bytes = wh.mix(h + np.uint64(0x5851F42D4C957F2D)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(as_bytes, axis=1).astype(np.int64) * 2 - 1


def _votes(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted bits of shingles, in whole numbers: sums are exact in any order."""
    return _signed_bits(g) * np.rint(w * 4096).astype(np.int64)[:, None]


class Items:
    """The items of a block of the benchmark, with their shingles, weights and fingerprints."""

    def __init__(self, rows: list[tuple[int, bytes]], weight_of, radius: int, shingle: int):
        self.radius, self.shingle = radius, shingle
        self.ids, self.words, self.n, self.grams, self.weights, self.prints = [], [], [], [], [], []
        for item_id, text in rows:
            words = wh.hash_words([text], wh.ALNUM).h
            if not len(words):
                continue
            n = min(shingle, len(words))
            g = wh.ngrams(words, n)
            w = weight_of(g)
            self.ids.append(item_id)
            self.words.append(len(words))
            self.n.append(n)
            self.grams.append(g)
            self.weights.append(w)
            self.prints.append(int(_fingerprint(_votes(g, w).sum(0)[None])[0]))
        self.by_n = {}
        for n in sorted(set(self.n)):
            of = [(int(h), t, o) for t in range(len(self.ids)) if self.n[t] == n
                  for o, h in enumerate(self.grams[t])]
            h = np.array([x[0] for x in of], dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 22, dtype=bool)
            seen[(h >> np.uint64(42)).astype(np.int64)] = True
            self.by_n[n] = (h[order], np.array([x[1] for x in of])[order], seen)
        # multi-index: for each block of bits, every value within the block's share of the radius
        self.fp = np.array(self.prints, dtype=np.uint64)
        n_blocks = BITS // BLOCK_BITS
        near = np.array([v for v in range(1 << BLOCK_BITS)
                         if bin(v).count("1") <= radius // n_blocks], dtype=np.int64)
        self.index = []
        for b in range(n_blocks):
            own = ((self.fp >> np.uint64(b * BLOCK_BITS)) & np.uint64(255)).astype(np.int64)
            slots = [[] for _ in range(1 << BLOCK_BITS)]
            for t, v in enumerate(own):
                for d in near:
                    slots[v ^ int(d)].append(t)
            self.index.append([np.array(s, dtype=np.int64) for s in slots])

    def within_radius(self, print_: int) -> np.ndarray:
        """Items whose fingerprint is within the radius."""
        found = np.unique(np.concatenate([
            self.index[b][(print_ >> (b * BLOCK_BITS)) & 255] for b in range(len(self.index))]))
        if not len(found):
            return found
        return found[np.bitwise_count(self.fp[found] ^ np.uint64(print_)) <= self.radius]

    def anchors(self, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, items) where a shingle of the text is one of an item."""
        h, item, seen = self.by_n[n]
        at = np.flatnonzero(seen[(g >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(h, g[at], "left"), np.searchsorted(h, g[at], "right")
        many = hi - lo
        place = np.repeat(at, many)
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        return place, item[which]


def _windows(words: np.ndarray, items: Items, shared: dict[int, list[int]], weight_of,
             threshold: float) -> list[tuple]:
    """Best verified window of each item in one text. shared: item -> places of shared shingles."""
    best: dict[int, tuple] = {}
    done: set[tuple[int, int, int]] = set()
    for t, places in shared.items():
        size, n = items.words[t], items.n[t]
        last = max(0, len(words) - size)
        starts = np.unique(np.concatenate([
            np.arange(max(0, p - size + n), min(p, last) + 1) for p in places] + [[]])).astype(np.int64)
        # prints of runs of neighbouring windows from prefix sums over the run's shingles
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            if not len(run) or (int(run[0]), int(run[-1]), size) in done:
                continue
            done.add((int(run[0]), int(run[-1]), size))
            g = wh.ngrams(words[run[0]:run[-1] + size], n)
            if not len(g):
                continue
            sums = np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(_votes(g, weight_of(g)), 0)])
            span = max(1, min(size, len(words)) - n + 1)
            lo = run - run[0]
            prints = _fingerprint(sums[np.minimum(lo + span, len(g))] - sums[lo])
            for s, p in zip(run.tolist(), prints.tolist(), strict=True):
                for c in items.within_radius(p).tolist():
                    if items.words[c] != size:
                        continue
                    sim = _similarity(words[s:s + size], items, c)
                    if sim >= threshold and (c not in best or sim > best[c][0]
                                             or sim == best[c][0] and s < best[c][1]):
                        ham = bin(p ^ int(items.fp[c])).count("1")
                        best[c] = (sim, s, ham, min(size, len(words)))
    return [(c, *v) for c, v in sorted(best.items())]


def _similarity(window: np.ndarray, items: Items, t: int) -> float:
    """Weight of the item's shingles that the window holds, by the item's weight."""
    own, first, count = np.unique(items.grams[t], return_index=True, return_counts=True)
    w = items.weights[t][first]
    have, times = np.unique(wh.ngrams(window, items.n[t]), return_counts=True)
    at = np.searchsorted(have, own)
    at[at == len(have)] = 0
    found = np.where(len(have) and have[at] == own, times[at], 0) if len(have) else np.zeros(len(own))
    return float((w * np.minimum(count, found)).sum() / (w * count).sum())


def _item_shingles(text: bytes, shingle: int) -> np.ndarray:
    """Distinct shingles of an item."""
    words = wh.hash_words([text], wh.ALNUM).h
    return np.unique(wh.ngrams(words, min(shingle, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _weight_of(h: np.ndarray, n: np.ndarray, n_items: int):
    """ln(1 + items / items with the shingle); one that is not in h (sorted) counts as held by one item."""
    weight = np.log1p(n_items / n)
    rare = float(np.log1p(n_items))

    def of(g: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.full(len(g), rare)
        at = np.minimum(np.searchsorted(h, g), len(h) - 1)
        return np.where(h[at] == g, weight[at], rare)
    return of


def _weights(rows: list[tuple[int, bytes]], n_items: int, shingle: int):
    """Weights from the rows of a whole benchmark that is at hand."""
    h, n = np.unique(np.concatenate([*(_item_shingles(t, shingle) for _, t in rows), np.zeros(0, np.uint64)]),
                     return_counts=True)
    return _weight_of(h, n, n_items)


def item_frequencies(items: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that two items or more of the benchmark hold, sorted; numbers of those items).

    Counted by Spark; 16 bytes a shared shingle come back, less than the items
    themselves, which are broadcast too. All others weigh as held by one item.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wh.slices(batches):
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [
                _item_shingles(t, shingle) for t in wh.text_bytes(batch.column(0))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])
    shared = items.select("t").mapInArrow(run, "h long, n long").groupBy("h").agg(
        F.sum("n").alias("n")).filter("n > 1").toPandas()
    h, n = shared["h"].to_numpy(dtype=np.int64).view(np.uint64), shared["n"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 23,
                  shingle: int = SHINGLE, block_items: int = 5000, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it (HITS columns).

    ``block_items`` bounds what is broadcast at once; a larger benchmark takes
    one pass over the documents per block. Weights are those of the whole
    benchmark: the shingles that items share are broadcast once for all blocks.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"),
                             F.lower(F.coalesce(F.col(item_text), F.lit(""))).alias("t"))
    n_items = items.count()
    parts = max(1, -(-n_items // block_items))
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    left = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    frequencies = spark.sparkContext.broadcast((*item_frequencies(items, shingle), n_items))
    out = None
    for b in range(parts):
        rows = [(r[0], r[1].encode()) for r in items.filter(F.col("b") == b).collect()]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        shared = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weight_of = _weight_of(*frequencies.value)
            known = Items(shared.value, weight_of, radius, shingle)
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()),
                                ("first_word", pa.int64()), ("n_window", pa.int64()),
                                ("hamming", pa.int32()), ("similarity", pa.float64())])
            for batch in wh.slices(batches):
                ids, texts = batch.column(0).to_pylist(), wh.text_bytes(batch.column(1))
                found = []
                for lo, hi in wh.blocks(texts):
                    words = wh.hash_words(texts[lo:hi], wh.ALNUM)
                    places: dict[int, dict[int, list[int]]] = {}
                    for n in known.by_n:
                        g = wh.ngrams(words.h, n)
                        place, item = known.anchors(g, n)
                        ok = wh.inside_text(words, n)[place]
                        doc = np.searchsorted(words.off, place[ok], "right") - 1
                        for d, p, t in zip(doc.tolist(), place[ok].tolist(), item[ok].tolist(), strict=True):
                            places.setdefault(d, {}).setdefault(t, []).append(p - int(words.off[d]))
                    for d, of in places.items():
                        w = words.h[words.off[d]:words.off[d + 1]]
                        found += [(ids[lo + d], known.ids[t], s, size, ham, sim) for t, sim, s, ham, size
                                  in _windows(w, known, of, weight_of, threshold)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)],
                        schema=schema)
        hits = left.mapInArrow(scan, HITS)
        out = hits if out is None else out.unionByName(hits)
    return out

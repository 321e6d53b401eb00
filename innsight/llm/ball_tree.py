"""Ranked lexical search: exact inner products over sparse ball trees.

A document is a sparse vector over the terms of the queries: entry t is
``w(t) * impact(tf, length)``, an integer; a query is the 0/1 vector of its terms,
so a score is an inner product. Scores never leave 64-bit integers.

1. One pass turns whole texts into (length, terms, counts) over the terms that
   any query holds, written to the shared folder; the counts over all documents
   (documents, terms, documents with a term) come from that table.
2. The documents of a task are taken in blocks. Each block becomes a balanced
   ball tree: a node is split at the median of the projection on two far
   members, and holds its centroid c and radius for every query. No document of
   a node can score more than q.c + |q| r with the Euclidean radius r, nor more
   than q.(c + u), where u is the radius of each coordinate by itself (how far a
   member lies above the centroid in that term). The smaller one counts; it is
   rounded up by far more than doubles can err. With some 100 query terms a
   document the first prunes only topics that share no words, the second most
   of the rest.
3. Every query descends best bound first and scores leaves exactly, until the
   best bound left is below its k-th best score so far; that score is carried
   from block to block. A bound equal to it is still opened (ties by doc_id).
4. Each task hands on k documents a query; these are ranked in two steps (by
   buckets of documents, then all), so no task sees the lists of all tasks.

Queries are taken in blocks of bounded size (``block_items``, chosen by the hash
of their id), documents never meet each other, and nothing is capped.

Defined results
* Terms are maximal runs of ASCII letters, digits and characters beyond ASCII,
  A-Z lower-cased; null and empty texts have none and don't count in N. Texts
  of any length are cut at separators into pieces that are counted together.
* A query term counts once. Queries without terms, or whose terms no document
  holds, have no rows. Queries with one id are one query with all their terms;
  a null id is an id like others.
* Equal scores: ascending doc_id, rows without a doc_id last. Repeated rows
  are documents of their own and get ranks of their own.
* Empty tables give no rows. Other columns are not used.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm import wordhash as wh
from innsight.llm.columns import quoted, small_batches, written

BLOCK_DOCS, BLOCK_ENTRIES, LEAF_DOCS = 8192, 2_000_000, 16
BLOCK_ITEMS = 2000
PIECE = 1 << 20
BUCKETS = 256
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if wh.ALNUM[b] else 32 for b in range(256))
NO_ID = np.iinfo(np.int64).max


def term_counts(text: bytes) -> Counter:
    """Occurrences of every term of a text."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and wh.ALNUM[text[end]]:    # a piece ends at a separator
            end += 1
        counts.update(text[at:end].translate(_FOLD).split())
        at = end
    return counts


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def entries(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """w * ((10**9 tf) div (1000 tf + 8 m)) with m = 10 + (90 length N) div L, in integers."""
    m = np.array([10 + 90 * int(n) * n_docs // max(n_terms, 1) for n in length.tolist()], dtype=np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class BallTree:
    """A balanced ball tree over the rows of a sparse integer matrix, for fixed 0/1 queries.

    ids, off, term, value: rows in CSR form, every row with an entry or more.
    items: a sorted array of terms for each query.
    """

    def __init__(self, ids: np.ndarray, off: np.ndarray, term: np.ndarray, value: np.ndarray,
                 items: list[np.ndarray], n_terms: int, leaf: int = LEAF_DOCS):
        self.items, self.n_terms = items, n_terms
        self._flat = np.concatenate(items)
        self._starts = np.concatenate([[0], np.cumsum([len(i) for i in items])[:-1]])
        self._length = np.sqrt(np.array([len(i) for i in items], dtype=np.float64))
        self.child: list[tuple[int, int] | None] = []
        self.range: list[tuple[int, int]] = []
        bounds = []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            rows = order[lo:hi]
            at, size = _ranges(off, rows)
            t, v = term[at], value[at].astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            centre = np.bincount(t, weights=v, minlength=n_terms) / len(rows)
            dots = np.add.reduceat(v * centre[t], starts)
            norms = np.add.reduceat(v * v, starts)
            c2 = float(centre @ centre)
            # the subtraction loses digits: what it may lose is added to the radius
            far = norms - 2 * dots + c2 + 1e-9 * (norms + c2)
            radius = math.sqrt(max(float(far.max()), 0.0))
            me = len(self.child)
            self.child.append(None)
            self.range.append((lo, hi))
            if parent >= 0:
                left, right = self.child[parent]
                self.child[parent] = (me, right) if side == 0 else (left, me)
            above = np.zeros(n_terms)
            np.maximum.at(above, t, v - centre[t])
            ball = np.add.reduceat(centre[self._flat], self._starts) + self._length * radius
            box = np.add.reduceat((centre + above)[self._flat], self._starts)
            bounds.append(np.minimum(ball, box) * (1 + 1e-9) + 1)
            if hi - lo > leaf:
                a = int(far.argmax())
                pivot = np.zeros(n_terms)
                pivot[t[starts[a]:starts[a] + size[a]]] = v[starts[a]:starts[a] + size[a]]
                b = int((norms - 2 * np.add.reduceat(v * pivot[t], starts)).argmax())
                pivot[t[starts[b]:starts[b] + size[b]]] -= v[starts[b]:starts[b] + size[b]]
                side_of = np.argsort(np.add.reduceat(v * pivot[t], starts), kind="stable")
                order[lo:hi] = rows[side_of]
                mid = (lo + hi) // 2
                self.child[me] = (-1, -1)
                todo += [(lo, mid, me, 0), (mid, hi, me, 1)]
        self.bounds = np.stack(bounds)              # [nodes, queries]
        at, size = _ranges(off, order)
        self.ids, self.term, self.value = ids[order], term[at], value[at]
        self.off = np.concatenate([[0], np.cumsum(size)])
        self.opened = 0                             # leaves scored, for tests and tuning

    def search(self, q: int, best: list[tuple[int, int]], k: int) -> None:
        """Put documents of positive score into ``best``, a heap of the k largest (score, -doc_id)."""
        wanted = np.zeros(self.n_terms, dtype=bool)
        wanted[self.items[q]] = True
        bound = self.bounds[:, q]
        queue = [(-bound[0], 0)]
        while queue:
            reach, node = heapq.heappop(queue)
            if len(best) == k and -reach < best[0][0]:
                return                              # nothing left can enter
            if self.child[node] is not None:
                for c in self.child[node]:
                    heapq.heappush(queue, (max(reach, -bound[c]), c))
                continue
            self.opened += 1
            lo, hi = self.range[node]
            first, last = self.off[lo], self.off[hi]
            hit = np.where(wanted[self.term[first:last]], self.value[first:last], 0)
            score = np.add.reduceat(hit, self.off[lo:hi] - first)
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(score >= max(least, 1)):
                entry = (int(score[i]), -int(self.ids[lo + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _ranges(off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the entries of ``rows`` one after the other, entries of each row)."""
    size = off[rows + 1] - off[rows]
    ends = np.cumsum(size)
    return np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(off[rows], size), size


def _vectors(docs: DataFrame, terms: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(id, n, term, tf): length and counts of the wanted terms of every document that has terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())),
                        ("tf", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in wh.slices(batches):
            rows, n, term, tf = [], [], [], []
            for i, t in enumerate(wh.text_bytes(batch.column(1))):
                counts = term_counts(t)
                if counts:
                    rows.append(i)
                    n.append(counts.total())
                    both = [(known[w], c) for w, c in counts.items() if w in known]
                    term.append([x for x, _ in both])
                    tf.append([c for _, c in both])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()),
                pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], schema=schema)
    rows = small_batches(docs).select(quoted(doc_id).cast("long"), quoted(text).cast("string"))
    return rows.mapInArrow(run, "id long, n long, term array<int>, tf array<long>")


def _searcher(items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int,
              block_docs: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]

        def search(parts: list[tuple]) -> None:
            ids, n, size, term, tf = (np.concatenate(x) for x in zip(*parts))
            off = np.concatenate([[0], np.cumsum(size)])
            value = entries(weight[term], tf, np.repeat(n, size), n_docs, n_terms)
            tree = BallTree(ids, off, term, value, items, len(weight), leaf)
            for q in range(len(items)):
                tree.search(q, best[q], k)

        parts, rows, held = [], 0, 0
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            # documents without a query term score 0
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                s = size[lo:lo + 256].astype(np.int64)
                use = s > 0
                if not use.any():
                    continue
                parts.append((part.column(0).fill_null(NO_ID).to_numpy()[use], part.column(1).to_numpy()[use],
                              s[use], part.column(2).flatten().to_numpy().astype(np.int64),
                              part.column(3).flatten().to_numpy()))
                rows, held = rows + int(use.sum()), held + int(s.sum())
                if rows >= block_docs or held >= BLOCK_ENTRIES:
                    search(parts)
                    parts, rows, held = [], 0, 0
        if parts:
            search(parts)
        found = [(q, None if d == -NO_ID else -d, s) for q, heap in enumerate(best) for s, d in heap]
        q, d, s = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], names=["q", "doc_id", "score"])
    return run


def _search_block(docs: DataFrame, items: list[tuple], k: int, doc_id: str, text: str,
                  block_docs: int, leaf: int) -> DataFrame | None:
    """Ranked documents of a bounded list of (item id, terms)."""
    terms = {t: i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    if not terms:
        return None
    spark = docs.sparkSession
    vectors = written(_vectors(docs, terms, doc_id, text), "term-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row for each query term at most
    df = dict(vectors.select(F.explode("term").alias("t")).groupBy("t").count().toArrow().to_pandas()
              .itertuples(index=False, name=None))
    weight = np.array([term_weight(n_docs, df.get(i, 0)) for i in range(len(terms))], dtype=np.int64)
    asked = [np.array(sorted(terms[t] for t in ts), dtype=np.int64) for _, ts in items]
    found = vectors.mapInArrow(_searcher(asked, weight, n_docs, n_terms, k, block_docs, leaf),
                               "q int, doc_id long, score long")
    first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("q", "bucket").orderBy(*first)
    ranked = (found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "score"), F.lit(BUCKETS)))
              .withColumn("r", F.row_number().over(some)).filter(F.col("r") <= k)
              .withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*first)))
              .filter(F.col("rank") <= k))
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], "q int, item_id long")
    return ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", query: str = "text", block_items: int = BLOCK_ITEMS,
           block_docs: int = BLOCK_DOCS, leaf: int = LEAF_DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of each query with the highest scores above 0."""
    asked = queries.select(quoted(item_id).cast("long").alias("item_id"),
                           F.coalesce(quoted(query).cast("string"), F.lit("")).alias("text"))
    n_blocks = max(1, -(-asked.count() // block_items))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(n_blocks):
        items: dict = {}
        for i, t in asked.filter(F.col("block") == b).select("item_id", "text").toLocalIterator():
            items.setdefault(i, set()).update(term_counts(t.encode()))
        rows = [(i, ts) for i, ts in sorted(items.items(), key=lambda x: (x[0] is None, x[0])) if ts]
        found = _search_block(docs, rows, k, doc_id, text, block_docs, leaf) if rows else None
        if found is not None:
            out = out.unionByName(written(found, "ranked"))
    return out

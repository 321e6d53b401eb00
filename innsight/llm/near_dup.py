"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF
shingles, banded, verified by weighted Jaccard similarity.

1. Documents with the same text are collapsed to one, which keeps their number.
2. Shingles of five words are hashed; a shingle's document frequency is
   counted exactly over all documents that have words (every row counts) and
   its weight is tf * ln(1 + documents / documents with the shingle). The texts
   are dealt to chunks by their hash. A chunk sends its distinct hashes, sorted
   and as differences, to the task of their range of hashes, which answers with
   the places of those found in two documents or more, and their numbers. So
   most shingles (those of one document) are shuffled once, in some five bytes,
   and no table of frequencies is collected, broadcast or joined.
3. Each document gets ``bands * rows`` consistent weighted samples; a band is
   the hash of ``rows`` samples. Two documents of weighted Jaccard J share a
   band with probability 1 - (1 - J**rows)**bands: 0.99998 at J = 0.8.
4. In each bucket (documents of equal band hash) every pair of documents that
   are not already in one class is verified by exact weighted Jaccard, on the
   shingles that other documents have too and the weight of all; the links found
   join classes. A pair within a class needs no check, which makes
   dense groups linear. Buckets run in two rounds: the first bands alone, in
   blocks of bounded size, settle most groups; then all bands, buckets whose
   documents are in one class already left out, buckets of the same documents
   taken once, oversized buckets as pairs of blocks. No bucket, block or pair
   is capped or dropped.
5. Classes are connected components of the links.

``edits``: in a large group of copies the common shingles weigh little, and a changed word
makes ``SHINGLE`` shingles that weigh most, so weights alone part copies that differ by a
word. With ``edits`` two documents are linked as well if their Jaccard similarity by number
is at least the threshold and so is the weighted one in which a run of shingles that are
rare for their text weighs as much as the words changed in it (a run of five is one word). Texts
that are mostly a common passage, with an own part beside it, stay apart. Buckets are the same.

Defined results
* A text of fewer than five words is one shingle of all its words; a text
  without words is alike to nothing. Null text is empty text.
* Rows with one doc_id are one document as far as classes go. A row without a
  doc_id is in a class of its own with null class_id, and is kept.
* Ties: the smallest doc_id of a class represents it. Repeated rows repeat.
* Empty tables give empty results. Input columns stay, except those with the
  name of a result column.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm import hash_exchange as hx
from innsight.llm import wordhash as wh
from innsight.llm.columns import other_columns, quoted, small_batches, written
from innsight.llm.components import connected_components
from innsight.llm.rows_by_id import BROADCAST_IDS, HEAVY_GROUPS, join_groups, split_by_ids

SHINGLE = 5
BANDS, ROWS = 16, 3
CHUNK_BYTES, LEAST_CHUNKS = 2 << 20, 64
SKETCH_SHINGLES = 1 << 16
BLOCK_DOCS, BLOCK_CHARS = 1000, 8 << 20
FIRST_BANDS = 2
HAS_WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]"
RESULTS = ["class_id", "kept"]


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, wh.Words]:
    """(shingle hashes, their text, words) of a block; short texts are one shingle."""
    words = wh.hash_words(texts, wh.ALNUM)
    g = wh.ngrams(words.h, SHINGLE)
    ok = wh.inside_text(words, SHINGLE)
    doc = words.doc[:len(g)][ok]
    g = g[ok]
    count = np.diff(words.off)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        own = np.concatenate([wh.ngrams(words.h[words.off[d]:words.off[d + 1]], int(count[d]))
                              for d in short])
        g, doc = np.concatenate([g, own]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc, words


def _counted(g: np.ndarray, doc: np.ndarray, placed: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct (hash, document) with the number of times, sorted by document and hash, and if ``placed`` the place of
    every shingle among them."""
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    at, place = np.flatnonzero(new), np.zeros(0, dtype=np.int64)
    if placed:
        place = np.empty(len(g), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
    return g[at], doc[at], np.diff(np.append(at, len(g))), place


def _rare(df: np.ndarray, doc: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Which shingles (by document) only the text's copies have, or an eighth at most of the documents that half of its
    shingles have: an edit, and one that was copied on."""
    order = np.lexsort((df, doc))
    first = np.searchsorted(doc, np.arange(len(copies) + 1))
    middle = np.zeros(len(copies), dtype=np.int64)
    full = np.flatnonzero(np.diff(first))
    middle[full] = df[order][(first[full] + first[full + 1]) // 2]
    return df <= np.maximum(copies, middle // 8)[doc]


def _changed(own: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """What each text's weight is less by if a run of own shingles weighs as much as the words changed in it; rows
    are the shingles of the texts in their order."""
    at = np.flatnonzero(own)
    if not len(at):
        return np.zeros(n_docs)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    first = np.union1d(first, np.flatnonzero(np.diff(doc[at], prepend=-1) != 0))
    size = np.diff(np.append(first, len(at)))
    share = 1 - np.maximum(1, size - SHINGLE + 1) / size
    return np.bincount(doc[at[first]], weights=np.add.reduceat(weight[at], first) * share, minlength=n_docs)


# ---- document frequencies: chunks of texts ask, ranges of hashes answer ----

class Chunk:
    """The distinct texts of a chunk: their shingles, and the chunk's distinct hashes in order (all). ``placed``: also
    the shingles in the order of the texts."""

    def __init__(self, group: pa.Table, placed: bool = False):
        rows = group.combine_chunks().sort_by([("t1", "ascending"), ("t2", "ascending")])
        self.ids, self.copies = rows["id"], rows["n"].to_numpy()
        texts = wh.text_bytes(rows["text"])
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        parts, n = [], 0
        for lo, hi in wh.blocks(texts):
            g, doc, words = _shingles(texts[lo:hi])
            g, doc, tf, place = _counted(g, doc + lo, placed)
            parts.append((g, doc, tf, place + n, np.diff(words.off)))
            n += len(g)
        self.g, self.doc, self.tf, self.order, self.words = (np.concatenate(p) for p in zip(*parts))
        self.all, self.place = np.unique(self.g, return_inverse=True)


def _ask(n_ranges: int):
    """A chunk's distinct hashes, with the documents that hold them, to the ranges of the hashes."""
    def run(group: pa.Table) -> pa.Table:
        chunk = Chunk(group)
        held = np.bincount(chunk.place, weights=chunk.copies[chunk.doc], minlength=len(chunk.all))
        return hx.questions(group["chunk"][0].as_py(), chunk.all, held, n_ranges)
    return run


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), by 16 bits: its distribution is 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        x = (lo + hi) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        lo, hi = np.where(under, x, lo), np.where(under, hi, x)
    x = (lo + hi) / 2
    return x.astype(np.float32), np.log(x).astype(np.float32)


def icws_samples(g: np.ndarray, weight: np.ndarray, off: np.ndarray, n_samples: int) -> np.ndarray:
    """Consistent weighted samples, [n_samples, texts]: the hash of (shingle, level) of each sample.

    For every shingle and sample three numbers come from bits of one hash:
    r and c of Gamma(2, 1) and b of [0, 1). With t = floor(ln w / r + b) the
    shingle of least ln c - r (t - b) - r is the sample.
    """
    gamma, log_gamma = _tables()
    n_texts = len(off) - 1
    out = np.zeros((n_samples, n_texts), dtype=np.uint64)
    full = np.flatnonzero(np.diff(off) > 0)
    if not len(full):
        return out
    starts = off[full]
    log_w = np.log(weight).astype(np.float32)
    low = np.uint64(0xFFFF)
    size = np.diff(np.append(starts, off[-1]))
    for k in range(n_samples):
        seed = wh.mix(np.array([k + 1], dtype=np.uint64))[0]
        h = (g ^ seed) * (seed | np.uint64(1))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        r = gamma[(h >> np.uint64(48)).astype(np.int32)]
        c = log_gamma[((h >> np.uint64(32)) & low).astype(np.int32)]
        b = ((h >> np.uint64(16)) & low).astype(np.float32) * np.float32(2.0 ** -16)
        t = np.floor(log_w / r + b)
        value = c - r * (t - b + np.float32(1))
        least = np.repeat(np.minimum.reduceat(value, starts), size)
        hit = np.flatnonzero(value == least)
        of = np.searchsorted(starts, hit, "right") - 1
        first = np.ones(len(hit), dtype=bool)
        first[1:] = of[1:] != of[:-1]          # equal values: the smaller hash, as rows are sorted
        at = hit[first]
        out[k, full] = wh.mix(g[at] * np.uint64(0x9E3779B97F4A7C15) + t[at].astype(np.int64).astype(np.uint64))
    return out


_SKETCH = ("id long, size long, bands array<long>, total double, h array<long>, w array<double>")
_EDITS = ", changed double, n array<int>, number long"


def _sketch(n_docs: int, n_ranges: int, bands: int, rows: int, edits: bool):
    """Band keys of every text of a chunk, the weight of all its shingles, and those that others have too. For ``edits``
    also their numbers, and the weight (changed) if runs of rare shingles weigh as the words changed in them."""
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(texts, edits)
        df = hx.totals(chunk.all, answers, n_ranges)[chunk.place]
        weight = chunk.tf * np.log1p(n_docs / df)
        n = len(chunk.size)
        off = np.searchsorted(chunk.doc, np.arange(n + 1))
        keys = np.zeros((bands, n), dtype=np.uint64)
        lo = 0
        while lo < n:                        # some texts at once
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SKETCH_SHINGLES, "right")) - 1)
            part = slice(off[lo], off[hi])
            samples = icws_samples(chunk.g[part], weight[part], off[lo:hi + 1] - off[lo], bands * rows)
            for b in range(bands):
                key = np.full(hi - lo, np.uint64(b + 1))
                for s in samples[b * rows:(b + 1) * rows]:
                    key = wh.mix(key * np.uint64(0xD6E8FEB86659FD93) + s)
                keys[b, lo:hi] = key
            lo = hi
        total = np.bincount(chunk.doc, weights=weight, minlength=n)
        shared = df > 1
        kept = np.searchsorted(chunk.doc[shared], np.arange(n + 1))
        ok = pa.array((chunk.words > 0) & chunk.ids.is_valid().to_numpy())   # rows without an id are in no class
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        more = {}
        if edits:
            own = _rare(df, chunk.doc, chunk.copies)[chunk.order]
            less = _changed(own, (weight / chunk.tf)[chunk.order], chunk.doc[chunk.order], n)
            more = {"changed": total - less, "n": lists(kept, pa.array(chunk.tf[shared], pa.int32())),
                    "number": np.bincount(chunk.doc, weights=chunk.tf, minlength=n).astype(np.int64)}
        return pa.table({
            "id": chunk.ids.combine_chunks(), "size": chunk.size,
            "bands": lists(np.arange(n + 1) * bands, pa.array(keys.T.reshape(-1).view(np.int64))),
            "total": total, "h": lists(kept, pa.array(chunk.g[shared].view(np.int64))),
            "w": lists(kept, pa.array(weight[shared])), **more}).filter(ok)
    return run


def weighted_jaccard_one_to_all(q: int, off: np.ndarray, g: np.ndarray, w: np.ndarray,
                                totals: np.ndarray, by_hash) -> np.ndarray:
    """Exact weighted Jaccard of text q with all texts of a block, through the block's postings."""
    hashes, weights, texts = by_hash
    mine, own = g[off[q]:off[q + 1]], w[off[q]:off[q + 1]]
    lo, hi = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
    many = hi - lo
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    least = np.minimum(weights[at], np.repeat(own, many))
    shared = np.bincount(texts[at], weights=least, minlength=len(totals))
    return shared / np.maximum(totals + totals[q] - shared, 1e-300)


def few_edits_one_to_all(q: int, off: np.ndarray, g: np.ndarray, w: np.ndarray, by_hash, edits: tuple,
                         threshold: float) -> np.ndarray:
    """Whether text q differs from each text of a block by a few words only (``edits`` of the module)."""
    changed, n, number, n_by_hash = edits
    by_number = weighted_jaccard_one_to_all(q, off, g, n, number, (by_hash[0], n_by_hash, by_hash[2]))
    return (by_number >= threshold) & (weighted_jaccard_one_to_all(q, off, g, w, changed, by_hash) >= threshold)


def link_block(ids: np.ndarray, comp: np.ndarray, off: np.ndarray, g: np.ndarray, w: np.ndarray,
               totals: np.ndarray, threshold: float, edits: tuple | None = None) -> list[tuple[int, int]]:
    """Links that join the classes of a block: every pair of different classes is compared.

    off, g, w: hashes and weights of each text (those that no other text has may be missing);
    totals: the weight of all. comp: the class known so far. edits: the weight of all with own runs weighing as their
    words, the numbers of g and the number of all, if a few edits link. The most central text is tried first, so a
    dense group is joined after a few queries, and the rest is skipped once
    all texts that are left are in one class.
    """
    n = len(ids)
    doc = np.repeat(np.arange(n), np.diff(off))
    order = np.argsort(g, kind="stable")
    by_hash = g[order], w[order], doc[order]
    edits = edits and (*edits, edits[1][order])
    lo = np.searchsorted(by_hash[0], g, "left")
    shared = np.searchsorted(by_hash[0], g, "right") - lo
    central = np.bincount(doc, weights=w * (shared - 1), minlength=n) / np.maximum(totals, 1e-300)
    _, root = np.unique(comp, return_inverse=True)
    root = root.astype(np.int64)
    links = []
    for q in np.argsort(-central, kind="stable"):
        if (root == root[0]).all():
            break                            # one class: nothing is left to join
        if central[q] <= 0:
            continue                         # shares no shingle with any other text
        sim = weighted_jaccard_one_to_all(int(q), off, g, w, totals, by_hash)
        near = sim >= threshold
        if edits and (~near & (root != root[q]) & (sim > 0)).any():
            near |= few_edits_one_to_all(int(q), off, g, w, by_hash, edits, threshold)
        for m in np.flatnonzero(near & (root != root[q])):
            if root[m] != root[q]:
                links.append((int(ids[q]), int(ids[m])))
                root[root == root[m]] = root[q]
    return links


def _linked(members: DataFrame, vectors: DataFrame, threshold: float, edits: bool) -> DataFrame:
    """members (bucket, block, id, comp) -> verified links (a, b)."""
    mine, _ = split_by_ids(vectors, members.select("id").distinct(), ["id"])
    more = ["changed", "n", "number"] if edits else []
    rows = members.join(mine, "id").select("bucket", "block", "id", "comp", "total", "h", "w", *more)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        h, w = (group[c].combine_chunks() for c in ("h", "w"))
        off = np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy())])
        links = link_block(group["id"].to_numpy(), group["comp"].to_numpy(), off,
                           h.flatten().to_numpy().view(np.uint64), w.flatten().to_numpy(),
                           group["total"].to_numpy(), threshold, (
                               group["changed"].to_numpy(), group["n"].combine_chunks().flatten().to_numpy(),
                               group["number"].to_numpy()) if edits else None)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return rows.groupBy("bucket", "block").applyInArrow(run, "a long, b long")


def _first_of_copies(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of every text; n is the number of rows that have it.

    groups (t1, t2, rep, n, k): texts of n > 1 rows, k of them with the id that
    stands for all. They are counted first; beyond BROADCAST_IDS only the at most
    HEAVY_GROUPS hot ones are broadcast, whose copies are gone before the rest is shuffled.
    """
    on = ["t1", "t2"]

    def without_copies(rows: DataFrame, some: DataFrame) -> DataFrame:
        named = some.withColumnsRenamed({"rep": "rep_", "n": "n_", "k": "k_"})
        return rows.join(named, on, "left").filter("n_ IS NULL OR id <=> rep_").withColumns(
            {"n": F.coalesce("n", "n_"), "k": F.coalesce("k", "k_")}).drop("rep_", "n_", "k_")
    rows = texts.withColumns({c: F.lit(None).cast("long") for c in ("n", "k")})
    if groups.count() <= BROADCAST_IDS:
        rows = without_copies(rows, F.broadcast(groups))
    else:
        hot = F.col("n") * HEAVY_GROUPS > (groups.agg(F.sum("n")).first()[0] or 0)
        rows = without_copies(without_copies(rows, F.broadcast(groups.filter(hot))), groups.filter(~hot))
    rows = rows.withColumn("n", F.coalesce("n", F.lit(1)))
    if not groups.filter("k > 1").isEmpty():      # rows that repeat an id and its text
        rows = rows.filter("k IS NULL OR k = 1").unionByName(rows.filter("k > 1").dropDuplicates(on))
    return rows.drop("k")


def document_sketches(texts: DataFrame, bands: int = BANDS, rows: int = ROWS,
                      chunk_bytes: int = CHUNK_BYTES, edits: bool = False) -> tuple[DataFrame, DataFrame]:
    """texts (id, text) -> (sketch of one document of each text, copies (id, rep) of the others)."""
    # wordless texts are alike to nothing
    texts = texts.filter(F.col("text").rlike(HAS_WORDS)).withColumns(
        {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    light = written(texts.groupBy("t1", "t2", "id").agg(
        F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("size")), "text-keys")
    size, n_docs = light.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)),
                             F.coalesce(F.sum("n"), F.lit(0))).first()
    first = F.min(F.struct(F.col("id").isNull(), "id", "n"))
    groups = written(light.groupBy("t1", "t2").agg(first.alias("lo"), F.sum("n").alias("n")).filter("n > 1").select(
        "t1", "t2", F.col("lo.id").alias("rep"), "n", F.col("lo.n").alias("k")), "copy-groups")
    copies = join_groups(light.select("id", "t1", "t2"), groups, ["t1", "t2"]).filter("id != rep").select("id", "rep")
    n_chunks = max(LEAST_CHUNKS, -(-size // chunk_bytes))
    work = _first_of_copies(texts, groups).withColumn("chunk", F.pmod("t1", F.lit(n_chunks)))
    answers = hx.answers(work.groupBy("chunk").applyInArrow(_ask(n_chunks), hx.MESSAGE))
    sketches = work.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _sketch(n_docs, n_chunks, bands, rows, edits), _SKETCH + _EDITS * edits)
    return written(sketches, "sketches"), copies


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS,
                           rows: int = ROWS, doc_id: str = "doc_id", text: str = "text",
                           block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS,
                           chunk_bytes: int = CHUNK_BYTES, edits: bool = False) -> DataFrame:
    """(id, class_id) of every document that is in a class of two or more doc_ids. edits: a few changed words
    link too, however large the group of copies."""
    texts = small_batches(docs).select(F.col(doc_id).cast("long").alias("id"),
                        F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    sketches, copies = document_sketches(texts, bands, rows, chunk_bytes, edits)
    copies = written(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")), "copies")
    vectors = sketches.drop("size", "bands")
    banded = sketches.select("id", "size", F.posexplode("bands").alias("band", "key")).select(
        "id", "size", "band", F.xxhash64("band", "key").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).filter("n > 1")
    members = written(banded.join(buckets, "bucket").distinct(), "band-members")

    links = copies
    for last in (False, True):
        if last:
            known = members.join(connected_components(links), "id", "left").withColumn(
                "comp", F.coalesce("component", "id"))
        else:     # the members are representatives of copies: no two are linked yet
            known = members.filter(F.col("band") < FIRST_BANDS).withColumn("comp", F.col("id"))
        # buckets with something to join; of those with the same documents (in several bands), one
        open_ = known.groupBy("bucket").agg(
            F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m"),
            F.bit_xor(F.xxhash64("id", "size")).alias("x1"),
            F.bit_xor(F.xxhash64(F.lit(1), "id", "size")).alias("x2")).filter(
            "c0 != c1").groupBy("m", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket")
        known = known.join(open_, "bucket").withColumn("blocks", F.greatest(
            F.ceil(F.col("n") / block_docs), F.ceil(F.col("chars") / block_chars)).cast("int"))
        mine = F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int")
        known = known.withColumn("mine", mine)
        if last:   # oversized buckets: every pair of blocks, each a task of its own
            known = known.withColumn("block", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
                F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (
                    F.least(o, F.col("mine")).cast("long") * F.col("blocks") + F.greatest(o, F.col("mine")))))))
            split = known.filter("blocks > 1").groupBy("bucket", "block").agg(
                F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 = c1").select("bucket", "block")
            known = known.join(split, ["bucket", "block"], "left_anti")
        else:
            known = known.withColumn("block", F.col("mine").cast("long"))
        found = written(_linked(known.select("bucket", "block", "id", "comp"), vectors, threshold, edits), "links")
        links = written(links.unionByName(found).distinct(), "all-links")
    return connected_components(links).withColumnRenamed("component", "class_id")


def mark_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents with class_id (smallest doc_id of the class) and kept (does it represent the class)."""
    classes = near_duplicate_classes(docs, doc_id=doc_id, text=text, **kw)
    rest = other_columns(docs, RESULTS)
    left = docs.select(*[quoted(c) for c in rest], F.col(doc_id).cast("long").alias("__id"))
    joined = left.join(classes.withColumnRenamed("class_id", "__class"),
                       left["__id"] == classes["id"], "left")
    return joined.select(*[quoted(c) for c in rest],
                         F.coalesce("__class", "__id").alias("class_id"),
                         (F.col("__class").isNull() | (F.col("__class") == F.col("__id"))).alias("kept"))

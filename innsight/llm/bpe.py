"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of up to ``chunk`` characters is one piece. A longer one is cut into
chunks that overlap by ``overlap`` characters and are dealt over the cluster:

1. every chunk is pre-tokenised on its own, from its first character on, which
   may be in the middle of a pre-token;
2. two neighbours are stitched at the first place in their overlap where both
   begin a pre-token: matches depend on the text to their right only, so from
   there on both agree;
3. each chunk encodes what lies between its two stitches, and the ids of a
   text's chunks are put together in order.

If an overlap has no common boundary (a pre-token longer than the overlap), the
chunks from there on are joined and encoded as one piece. The result is exact for
patterns whose matches depend on at most ``MARGIN`` characters beyond their end, as
those of PATTERN do; a pattern that looks further ahead (such as ``\\s*[\\r\\n]+``, which
scans any run of spaces for a line end) needs texts of one chunk. Pre-tokens are merged by rank (lowest first, leftmost on
ties); the merges of a pre-token are cached. Decoding concatenates the raw
bytes of the ids.

Defined results
* Null text is empty text: no ids, no bytes. There are no special tokens.
* Repeated rows give repeated results; input columns other than the text go
  along, except those with the name of a result column.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm import wordhash as wh
from innsight.llm.columns import other_columns, quoted, small_batches, written

CHUNK, OVERLAP = 1 << 15, 512
MARGIN = 8            # a match that ends this close to a chunk's end may go on beyond it
CACHE = 120_000       # pre-tokens of a generation; a worker remembers two
LONG_PART = 64
if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as the machine's own unsigned 32-bit integers, little-endian")
RESULTS = ["n_tokens", "ids"]


def read_ranks(path: str) -> bytes:
    """A rank file, as it is: a line is the base64 of a token and its rank."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _ranks(raw: bytes) -> tuple[dict[bytes, int], list[bytes]]:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return ranks, tokens


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG_PART:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for pre-tokens of any length."""
    n = len(piece)
    end = list(range(1, n + 1))                 # part i is piece[i:end[i]]
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def push(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(piece[i:end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, j, end[j]))
    for i in range(n):
        push(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not alive[i] or not alive[j] or end[i] != j or end[j] != e:
            continue
        alive[j] = False
        end[i] = e
        if e < n:
            before[e] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes pieces to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks, self.tokens = _ranks(raw)
        self.pattern = regex.compile(pattern)
        # the present generation and the one before: what is used again stays, the rest goes
        self.cache: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        pre = self.pattern.findall(text)
        out = list(map(self.cache.get, pre))
        if None in out:
            if len(self.cache) > CACHE:
                self.cache, self.former = {}, self.cache
            fresh = {}
            for p, ids in zip(pre, out, strict=True):
                if ids is None and p not in fresh:
                    fresh[p] = self.former.get(p) or array("I", merge(p.encode(), self.ranks)).tobytes()
            self.cache.update((p, b) for p, b in fresh.items() if len(p) <= LONG_PART)
            out = [fresh[p] if ids is None else ids for p, ids in zip(pre, out, strict=True)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=1)
def _encoder(raw: bytes, pattern: str) -> Encoder:
    wh.drop_tables()
    return Encoder(raw, pattern)


def boundaries(text: str, pattern: str, whole: bool) -> list[int]:
    """Starts of pre-tokens that don't depend on what follows the text (all of them if it is whole)."""
    out, end = [], len(text) if whole else len(text) - MARGIN
    for m in regex.finditer(pattern, text):
        out.append(m.start())
        if m.end() > end:
            break
    return out


def _chunks(chunk: int, overlap: int):
    """Rows of (id, text) to (id, chunk number, whether it is the last, first character, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wh.slices(batches):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(0, n, 64):
                    ks = range(k, min(n, k + 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(ks), pa.int64()), pa.array(ks, pa.int32()),
                         pa.array([i == n - 1 for i in ks]), pa.array([i * chunk for i in ks], pa.int64()),
                         pa.array([text[i * chunk:] if i == n - 1 else text[i * chunk:(i + 1) * chunk + overlap]
                                   for i in ks], pa.string())],
                        names=["row", "k", "last", "start", "text"])
    return run


def _edges(pattern: str, chunk: int, overlap: int):
    """Boundaries of each chunk in its overlap with the chunk before (head) and after (tail)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wh.slices(batches):
            heads, tails = [], []
            for last, start, text in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                at = boundaries(text, pattern, last)
                heads.append([start + b for b in at if b < overlap])
                tails.append([] if last else [start + b for b in at if b >= chunk])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(4)), pa.array(heads, pa.list_(pa.int64())),
                 pa.array(tails, pa.list_(pa.int64()))],
                names=["row", "k", "last", "start", "head", "tail"])
    return run


def _encode_batches(shipped, pattern: str, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shipped.value, pattern)
        for batch in wh.slices(batches):
            ids = [enc.encode(t or "") for t in batch.column(text).to_pylist()]
            cols = [c for i, c in enumerate(batch.columns) if i != text]
            names = [c for i, c in enumerate(batch.schema.names) if i != text]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=[*names, *RESULTS])
    return run


def _stitched(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Pieces (row, run, text) of long texts, each from stitch to stitch."""
    edges = chunks.mapInArrow(_edges(pattern, chunk, overlap),
                              "row long, k int, last boolean, start long, head array<long>, tail array<long>")
    w = Window.partitionBy("row").orderBy("k")         # a few numbers per chunk, no text
    stitch = F.array_min(F.array_intersect(F.lag("tail").over(w), "head"))
    marks = edges.select("row", "k", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(stitch).alias("lo"))
    marks = marks.select("row", "k", "lo", F.lead("lo").over(w).alias("hi"),
                         F.min(F.when(F.col("lo").isNull(), F.col("k"))).over(Window.partitionBy("row")).alias("lost"))
    # from the chunk before the first one that found no stitch, all is one piece
    pieces = chunks.join(marks, ["row", "k"]).withColumn(
        "run", F.when(F.col("lost").isNull(), F.col("k")).otherwise(F.least("k", F.col("lost") - 1)))
    alone = F.col("lost").isNull() | (F.col("k") < F.col("lost") - 1)
    single = pieces.filter(alone).select("row", "run", F.substring(
        "text", (F.col("lo") - F.col("start") + 1).cast("int"),
        F.when(F.col("hi").isNull(), F.lit(2**31 - 1)).otherwise(F.col("hi") - F.col("lo")).cast("int")).alias("text"))
    own = F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, chunk))
    own = F.when(F.col("k") == F.col("run"), F.substring(
        own, (F.col("lo") - F.col("start") + 1).cast("int"), F.lit(2**31 - 1))).otherwise(own)
    joined = pieces.filter(~alone).groupBy("row", "run").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("k", own.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return single.unionByName(joined)


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """The documents with n_tokens and ids (binary: little-endian unsigned 32-bit)."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)    # a vocabulary, not data
    rest = other_columns(docs, RESULTS)
    source = small_batches(docs).select(*[quoted(c) for c in rest], F.col(text).alias("__text"))
    is_long = F.coalesce(F.length("__text"), F.lit(0)) > chunk + overlap
    schema = source.drop("__text").schema.add("n_tokens", "long").add("ids", "binary")
    short = source.filter(~is_long).mapInArrow(_encode_batches(shipped, pattern, len(rest)), schema)

    # long texts get a number in a written table, so that it stays the same from here on
    long_ = written(source.filter(is_long).withColumn("__row", F.monotonically_increasing_id()), "long-texts")
    chunks = written(long_.select("__row", "__text").mapInArrow(
        _chunks(chunk, overlap), "row long, k int, last boolean, start long, text string"
    ).repartition("row", "k"), "chunks")
    ids = _stitched(chunks, pattern, chunk, overlap).repartition("row", "run").mapInArrow(
        _encode_batches(shipped, pattern, 2), "row long, run int, n_tokens long, ids binary")
    whole = ids.groupBy("row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
            "run", F.hex("ids").alias("x")))), lambda p: p["x"]), "")).alias("ids"))
    joined = long_.drop("__text").join(whole, F.col("__row") == F.col("row"))
    return short.unionByName(joined.select(*[quoted(c) for c in rest], "n_tokens", "ids"))


def decode(encoded: DataFrame, ranks: bytes, ids: str = "ids", after_encoding: bool = False) -> DataFrame:
    """The rows with ``decoded`` (binary): the bytes of the ids, one after the other.

    ``after_encoding``: the ids were written before, so no worker of this application encodes beside
    this step, and reused workers let go of their encoders."""
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)
    rest = other_columns(encoded, ["decoded"])
    source = encoded.select(*[quoted(c) for c in rest], F.col(ids).alias("__ids"))
    schema = source.drop("__ids").schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if after_encoding:
            _encoder.cache_clear()
        _, tokens = _ranks(shipped.value)
        get = tokens.__getitem__
        for batch in wh.slices(batches):
            out = [b"".join(map(get, np.frombuffer(b or b"", dtype="<u4").tolist()))
                   for b in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())],
                                             names=[*batch.schema.names[:-1], "decoded"])
    return source.mapInArrow(run, schema)

"""Substring dedup by level-wise doubling of repeated word windows.

Level 1 takes windows of ``window / 2`` words. Two equal windows of full
length have the same smallest half-length hash, so only such witnesses (about
two in twelve places) are counted; those found once can't belong to a repeat
and end here. Level 2 extends the windows of the repeated witnesses, and only
those, to twice that length, which is ``window``: a window that repeats there is
removed at every place but its first. The levels go on, 40, 80, 160 ... words,
until no candidates survive: a candidate is a place where a window repeated at one
length is followed, within its document, by another one right behind it; its
hash comes from theirs, without the text. Each level is written to the shared
folder; which of its hashes repeat is asked of ranges of hashes
(``hash_exchange``). Longer repeats are unions of windows of the second level, so
these levels tell how long the repeats are (``longest_repeat``).

Defined results
* Words are runs of anything but ASCII white space, unchanged; null text has none.
* "Earlier" is a smaller doc_id, or an earlier start in the same document; a
  null doc_id comes last; different texts under one doc_id are ordered by
  their hash; equal rows (id and text) are one document and get equal results.
* Texts of fewer than ``window`` words lose nothing. Empty tables give empty results.
* Whole copies of a text are found by the text's hash: every window of theirs
  starts earlier, so they lose all words and take no part in the levels.
* longest_repeat is the largest of window, 2 window, 4 window ... of which some
  window of the text is found at another place too, in any document; 0 if
  none, or if the text is a copy of an earlier one (its first copy tells).
* Very long texts take part whole; a level more for each doubling of the longest repeat.
* Window hashes have 64 bits: with w windows in the corpus some w * w / 2**65 are
  taken for repeats by chance.
* Input columns stay, except those with the name of a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm import hash_exchange as hx
from innsight.llm import wordhash as wh
from innsight.llm.columns import other_columns, quoted, small_batches, written
from innsight.llm.rows_by_id import join_groups, split_by_ids

RESULTS = ["n_words", "n_removed", "kept_text", "longest_repeat"]
CHUNK_WINDOWS, LEAST_CHUNKS = 1 << 18, 64
KEY = ["__od", "__tid"]
LAST_ID = (1 << 63) - 1


def _sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    run, width = g, 1
    while width * 2 <= n:
        run = np.minimum(run[:-width], run[width:])
        width *= 2
    rest = n - width
    return np.minimum(run[:len(run) - rest], run[rest:]) if rest else run


def _windows(words: wh.Words, half: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the full windows inside one text, half-length hashes, smallest of each window)."""
    g = wh.ngrams(words.h, half)
    if len(words.h) < window:
        return np.zeros(0, np.int64), g, np.zeros(0, np.uint64)
    least = _sliding_min(g, window - half + 1)
    at = np.flatnonzero(wh.inside_text(words, window))
    return at, g, least[at]


def _witnesses(window: int):
    half = window // 2
    schema = pa.schema([("h", pa.int64()), ("__od", pa.int64()), ("__tid", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            od, tid = (batch.column(i).to_numpy() for i in (0, 1))
            texts = wh.text_bytes(batch.column(2))
            for lo, hi in wh.blocks(texts):
                words = wh.hash_words(texts[lo:hi], wh.NONSPACE)
                at, g, least = _windows(words, half, window)
                if not len(at):
                    continue
                marked = np.zeros(len(g), dtype=bool)
                for j in range(window - half + 1):
                    marked[at[g[at + j] == least] + j] = True
                place = np.flatnonzero(marked)
                doc = np.searchsorted(words.off, place, "right") - 1
                h = g[place]
                order = np.lexsort((h, doc))       # one row per document and hash, with its count
                h, doc = h[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(h))).astype(np.int32)
                doc = doc[first] + lo
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[first].view(np.int64)), pa.array(od[doc]), pa.array(tid[doc]),
                    pa.array(n)], schema=schema)
    return run


STATE = "__od long, __tid long, pos array<int>, h array<long>"


def _extend(window: int):
    """Full windows whose witness is repeated: one row per document, with all their places and hashes."""
    half = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            od, tid = (batch.column(i).to_numpy() for i in (0, 1))
            texts = wh.text_bytes(batch.column(2))
            alive = batch.column(3)
            ends, values = alive.offsets.to_numpy(), alive.values.to_numpy().view(np.uint64)
            for lo, hi in wh.blocks(texts):
                words = wh.hash_words(texts[lo:hi], wh.NONSPACE)
                at, _, least = _windows(words, half, window)
                full = wh.ngrams(words.h, window)[at] if len(at) else least
                doc = np.searchsorted(words.off, at, "right") - 1
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                of, pos, h = [], [], []
                for d in range(hi - lo):
                    own = slice(cut[d], cut[d + 1])
                    live = np.flatnonzero(np.isin(least[own], values[ends[lo + d]:ends[lo + d + 1]]))
                    if len(live):
                        of.append(lo + d)
                        pos.append(at[own][live] - words.off[d])
                        h.append(full[own][live])
                if of:
                    yield _state_rows(od[of], tid[of], pos, h)
    return run


def _state_rows(od: np.ndarray, tid: np.ndarray, pos: list[np.ndarray], h: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0] + [len(p) for p in pos]), pa.int32())
    join = lambda parts: np.concatenate([*parts, np.zeros(0, parts[0].dtype)]) if parts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(od), pa.array(tid), pa.ListArray.from_arrays(ends, pa.array(join(pos).astype(np.int32))),
        pa.ListArray.from_arrays(ends, pa.array(join(h).view(np.int64)))], names=["__od", "__tid", "pos", "h"])


def _candidates(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """(row, place, hash) of the windows of a chunk, and its rows in order."""
    rows = group.combine_chunks().sort_by([("__od", "ascending"), ("__tid", "ascending")])
    pos, h = (rows[c].combine_chunks() for c in ("pos", "h"))
    row = np.repeat(np.arange(rows.num_rows), pos.value_lengths().to_numpy())
    return row, pos.flatten().to_numpy().astype(np.int64), h.flatten().to_numpy().view(np.uint64), rows


def _ask_windows(n_ranges: int):
    def run(group: pa.Table) -> pa.Table:
        _, _, h, _ = _candidates(group)
        own, held = np.unique(h, return_counts=True)
        return hx.questions(group["chunk"][0].as_py(), own, held, n_ranges)
    return run


def _double(length: int, n_ranges: int):
    """The windows of ``length`` words that repeat, extended to twice that length where another follows."""
    def run(group: pa.Table, answered: pa.Table) -> pa.Table:
        row, pos, h, rows = _candidates(group)
        own, place = np.unique(h, return_inverse=True)
        again = hx.totals(own, answered, n_ranges)[place] > 1
        row, pos, h = row[again], pos[again], h[again]
        key = row << 32 | pos                        # ascending, as rows and places are
        after = np.searchsorted(key, key + length)
        after[after == len(key)] = 0
        ok = np.flatnonzero(key[after] == key + length) if len(key) else after
        longer = wh.mix(h[ok] * np.uint64(0x9E3779B97F4A7C15) + h[after[ok]])
        n = rows.num_rows
        ends = pa.array(np.searchsorted(row[ok], np.arange(n + 1)), pa.int32())
        return pa.table({
            "__od": rows["__od"], "__tid": rows["__tid"],
            "pos": pa.ListArray.from_arrays(ends, pa.array(pos[ok].astype(np.int32))),
            "h": pa.ListArray.from_arrays(ends, pa.array(longer.view(np.int64))),
            "repeated": pa.array(np.bincount(row, minlength=n), pa.int64())}).filter(
                pa.array(np.bincount(row, minlength=n) > 0))
    return run


def repeat_lengths(state: DataFrame, window: int) -> DataFrame:
    """state: windows of ``window`` words that may repeat -> (od, tid, longest), documents with a repeat alone."""
    found, length = None, window
    keys = state.select(*KEY)
    if keys.count() != keys.distinct().count():          # equal rows are one document
        state = state.dropDuplicates(KEY)
    while True:
        n = state.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
        if not n:
            break
        n_chunks = max(LEAST_CHUNKS, -(-n // CHUNK_WINDOWS))
        dealt = state.withColumn("chunk", F.pmod(F.xxhash64(*KEY), F.lit(n_chunks)))
        answered = hx.answers(dealt.groupBy("chunk").applyInArrow(_ask_windows(n_chunks), hx.MESSAGE))
        level = written(dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
            _double(length, n_chunks), STATE + ", repeated long"), f"level-{2 * length}")
        hits = level.select(*KEY, F.lit(length).cast("long").alias("longest"))
        found = hits if found is None else found.unionByName(hits)
        state = level.filter(F.size("h") > 0).drop("repeated")
        length *= 2
    if found is None:
        return state.select(*KEY, F.lit(0).cast("long").alias("longest")).limit(0)
    return found.groupBy(*KEY).agg(F.max("longest").alias("longest"))


def _kept(text: bytes, gone: np.ndarray | None, window: int, copy: bool, local: bool) -> tuple[int, int, bytes]:
    """(words, removed words, kept text). gone: starts of windows that other documents have first."""
    words = text.split()   # on bytes: ASCII white space, as wordhash.NONSPACE
    n = len(words)
    if n < window:
        return n, 0, b" ".join(words)
    if copy:
        return n, n, b""
    starts = np.zeros(0, np.int64) if gone is None else gone.astype(np.int64)
    if local:
        h = wh.ngrams(wh.hash_words([text], wh.NONSPACE).h, window)
        _, first = np.unique(h, return_index=True)
        again = np.ones(len(h), dtype=bool)
        again[first] = False
        starts = np.concatenate([starts, np.flatnonzero(again)])
    if not len(starts):
        return n, 0, b" ".join(words)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    covered = np.cumsum(edge[:n]) > 0
    return n, int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])


def _rebuild(window: int, text: int, gone: int | None, copy: bool):
    """Batches with their n_words, n_removed and kept_text, in place of the text column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = wh.text_bytes(batch.column(text))
            lists = batch.column(gone) if gone is not None else None
            out = []
            for i, t in enumerate(texts):
                g = None
                if lists is not None and lists[i].is_valid:
                    g = np.asarray(lists[i].values)
                out.append(_kept(t, g, window, copy, gone is not None))
            n, r, k = zip(*out, strict=True) if out else ((), (), ())
            last = batch.num_columns - 1              # longest_repeat
            keep = [c for c in range(last) if c != gone]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.binary()).cast(pa.string()),
                   batch.column(last)],
                names=[batch.schema.names[c] for c in keep] + RESULTS)
    return run


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Order key od and tid; tid only tells texts apart where ids are shared, else it is 0."""
    od = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))
    shared = docs.select(od.alias("id"), F.xxhash64(F.col(text)).alias("t")).groupBy("id").agg(
        F.min("t").alias("a"), F.max("t").alias("b")).filter("a != b").limit(1).count()
    tid = F.xxhash64(F.col(text)) if shared else F.lit(0).cast("long")
    return docs.select("*", od.alias(KEY[0]), tid.alias(KEY[1]))


def _copies(keyed: DataFrame, text: str) -> DataFrame:
    """Keys of documents whose whole text an earlier document has."""
    ids = keyed.select(*KEY, F.xxhash64(F.col(text)).alias("t1"),
                       F.xxhash64(F.lit(1), F.col(text)).alias("t2"))
    first = written(ids.groupBy("t1", "t2").agg(
        F.min("__od").alias("first"), F.max("__od").alias("last"), F.count("*").alias("n")).filter(
        "first != last").select("t1", "t2", "first", "n"), "copy-groups")
    return join_groups(ids, first, ["t1", "t2"]).filter("__od != first").select(*KEY).distinct()


def _survivors(texts: DataFrame, window: int) -> DataFrame:
    """Level 1: (od, tid, alive), the repeated half-length witnesses of each document."""
    seen = texts.mapInArrow(_witnesses(window), "h long, __od long, __tid long, n int")
    repeated = seen.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    return seen.select("h", *KEY).join(repeated, "h").groupBy(*KEY).agg(
        F.collect_set("h").alias("alive"))


def repeated_windows(texts: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (od, tid, text) -> (documents with candidates, removed windows (od, tid, pos), lengths of repeats)."""
    alive = written(_survivors(texts, window), "level-half")
    hit, _ = split_by_ids(texts, alive.select(*KEY), KEY)
    state = written(hit.join(alive, KEY).select(*KEY, "text", "alive").mapInArrow(_extend(window), STATE), "level-full")
    full = state.select(*KEY, F.explode(F.arrays_zip("pos", "h")).alias("x")).select(*KEY, "x.pos", "x.h")
    first = full.groupBy("h").agg(F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last"),
                                  F.count("*").alias("n")).filter("first != last").select(
        "h", F.col("first.__od").alias("od0"), F.col("first.__tid").alias("tid0"), "n")
    # a passage that a third of all documents hold is a hot key: such hashes are broadcast
    gone = join_groups(full, written(first, "first-places"), ["h"]).filter(
        "__od != od0 OR __tid != tid0").select(*KEY, "pos")
    return alive.select(*KEY), gone, repeat_lengths(state, window)


def dedup_substrings(docs: DataFrame, window: int = 20, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """The documents with n_words, n_removed, kept_text and longest_repeat."""
    rest = other_columns(docs, RESULTS)
    keyed = _identified(small_batches(docs), doc_id, text)
    copies = written(_copies(keyed, text), "copies")
    whole, own = split_by_ids(keyed, copies, KEY)
    texts = own.select(*KEY, F.coalesce(F.col(text), F.lit("")).alias("text"))
    candidates, gone, lengths = repeated_windows(texts, window)
    hit, clean = split_by_ids(own, candidates, KEY)
    hit = hit.join(gone.groupBy(*KEY).agg(F.collect_set("pos").alias("__gone")), KEY, "left").join(
        lengths.withColumnRenamed("longest", "__longest"), KEY, "left")

    def rebuilt(df: DataFrame, with_gone: bool, copy: bool) -> DataFrame:
        cols = [quoted(c) for c in rest]
        longest = F.coalesce("__longest", F.lit(0)) if with_gone else F.lit(0)
        df = df.select(*cols, F.col(text).alias("__text"), *(["__gone"] if with_gone else []),
                       longest.cast("long").alias("longest_repeat"))
        schema = df.drop("__gone", "longest_repeat").schema
        for name, kind in zip(RESULTS, ("long", "long", "string", "long"), strict=True):
            schema = schema.add(name, kind)
        return df.mapInArrow(_rebuild(window, len(rest), len(rest) + 1 if with_gone else None, copy),
                             schema).drop("__text")
    return rebuilt(hit, True, False).unionByName(rebuilt(clean, False, False)).unionByName(
        rebuilt(whole, False, True))

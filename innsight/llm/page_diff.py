"""Main text of web pages by nearest-URL page differencing.

1. Every page becomes a list of text blocks (``html_text``), each a line for
   the alignment; markup tells which blocks are page furniture (menus,
   headers, footers, side bars, notices, adverts, forms, reader comments).
2. Pages of one host are put in order of their URL path; a page is paired with
   the two before and the two after it, whose paths are the nearest. The places
   in that order come from prefix sums over range partitions, and pages are
   dealt out in blocks of 64 neighbours, so a host of any size is spread
   over all tasks.
3. The lines of a pair are aligned by a longest common subsequence, and lines
   that both hold are shared. A pair that shares more than half of the text
   of its longer page (page furniture aside) holds a copied article, not a
   template, and has no say.
4. Shared lines are deleted: outside an article element if half of the partners
   (one at least) share the line, where the page has an article, one is enough;
   within the article element only if all partners, three at least, share it.

Line hashes alone are shuffled; the pages stay where they are. Pages with
shared lines are few next to those whose furniture the markup tells; their
line numbers are broadcast up to ``rows_by_id.BROADCAST_IDS`` rows, beyond that
joined by shuffle.

Defined results
* Null and empty html: empty text. A page without markup is one block.
* Null url, or a host with one page: nothing to pair with, the markup decides.
* Very long pages are processed whole. The alignment needs memory in
  proportion to the lines (a divide-and-conquer over bit vectors).
* Rows that are equal in page_id, url and html take part once and get equal
  results. Ties in the order of paths: by the hash of the row.
* Empty tables give empty results. Input columns stay, except those with the
  name of a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm import html_text as ht
from innsight.llm import wordhash as wh
from innsight.llm.columns import other_columns, quoted, small_batches, written
from innsight.llm.rows_by_id import BROADCAST_IDS
from innsight.operators.ranks import prefix_sums

BLOCK_PAGES, REACH = 64, 2
COPY_SHARE = 0.5
RESULTS = ["text", "n_chars", "n_shared"]


def _matched(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, by Hirschberg's division over bit vectors."""
    out: list[tuple[int, int]] = []

    def lengths(x: list[int], y: list[int]) -> np.ndarray:
        """Length of the common subsequence of x with every prefix of y."""
        places: dict[int, int] = {}
        for j, v in enumerate(y):
            places[v] = places.get(v, 0) | 1 << j
        full = row = (1 << len(y)) - 1
        for v in x:
            hit = row & places.get(v, 0)
            row = (row + hit | row - hit) & full
        bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")
        return np.concatenate([[0], np.cumsum(1 - bits[:len(y)].astype(np.int64))])

    def divide(lo: int, hi: int, left: int, right: int) -> None:
        while lo < hi and left < right and a[lo] == b[left]:
            out.append((lo, left))
            lo, left = lo + 1, left + 1
        if lo >= hi or left >= right:
            return
        if hi - lo == 1:
            if a[lo] in b[left:right]:
                out.append((lo, b.index(a[lo], left, right)))
            return
        mid = (lo + hi) // 2
        head = lengths(a[lo:mid], b[left:right])
        tail = lengths(a[mid:hi][::-1], b[left:right][::-1])
        cut = left + int((head + tail[::-1]).argmax())
        divide(lo, mid, left, cut)
        divide(mid, hi, cut, right)

    divide(0, len(a), 0, len(b))
    return out


def shared_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines; lines that only one side has are left out first."""
    both = set(a) & set(b)
    i = [k for k, v in enumerate(a) if v in both]
    j = [k for k, v in enumerate(b) if v in both]
    return [(i[x], j[y]) for x, y in _matched([a[k] for k in i], [b[k] for k in j])]


def deleted_lines(page: tuple, partners: list[tuple], aligned: list[list[int]]) -> list[int]:
    """Lines of a page that go. page: (lines, sizes, states); aligned: shared lines with each partner."""
    lines, sizes, states = page
    mine = sum(s for s, st in zip(sizes, states) if st != ht.FURNITURE)
    votes: dict[int, int] = {}
    voters = 0
    for (_, their_sizes, their_states), shared in zip(partners, aligned):
        common = sum(sizes[i] for i in shared if states[i] != ht.FURNITURE)
        theirs = sum(s for s, st in zip(their_sizes, their_states) if st != ht.FURNITURE)
        if common > COPY_SHARE * max(mine, theirs):
            continue                                   # a copied article
        voters += 1
        for i in shared:
            votes[i] = votes.get(i, 0) + 1
    has_article = ht.ARTICLE in states
    half = 1 if has_article else max(1, -(-voters // 2))
    return sorted(i for i, n in votes.items() if states[i] == ht.OUTSIDE and n >= half
                  or states[i] == ht.ARTICLE and n == voters >= 3)


_LINES = "k1 long, k2 long, host string, path string, lines array<long>, sizes array<int>, states array<int>"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]+)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in wh.slices(batches, 128):
        keep, lines, sizes, states = [], [], [], []
        for r, page in enumerate(batch.column(4).to_pylist()):
            found = list(ht.blocks(page or ""))
            if found:
                keep.append(r)
                lines.append(_line_hashes([t for t, _ in found]))
                sizes.append([len(t) for t, _ in found])
                states.append([s for _, s in found])
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(i).take(at) for i in range(4)] + [
                pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())),
                pa.array(states, pa.list_(pa.int32()))],
            names=["k1", "k2", "host", "path", "lines", "sizes", "states"])


def _line_hashes(lines: list[str]) -> list[int]:
    from xxhash import xxh3_64_intdigest
    return [xxh3_64_intdigest(t) - (1 << 63) for t in lines]


def _decide(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["pos"])
    of_host = {r["pos"]: r for r in rows}
    pair: dict[tuple[int, int], list[tuple[int, int]]] = {}
    out = []
    for r in rows:
        if r["pos"] // BLOCK_PAGES != r["block"]:
            continue
        partners, aligned = [], []
        for step in range(-REACH, REACH + 1):
            other = of_host.get(r["pos"] + step)
            if step == 0 or other is None or other["host"] != r["host"]:
                continue
            lo, hi = sorted((r["pos"], other["pos"]))
            if (lo, hi) not in pair:
                pair[lo, hi] = shared_lines(of_host[lo]["lines"], of_host[hi]["lines"])
            partners.append((other["lines"], other["sizes"], other["states"]))
            aligned.append([p[0 if r["pos"] == lo else 1] for p in pair[lo, hi]])
        gone = deleted_lines((r["lines"], r["sizes"], r["states"]), partners, aligned)
        if gone:
            out.append((r["k1"], r["k2"], gone))
    k1, k2, gone = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()),
                     "gone": pa.array(gone, pa.list_(pa.int32()))})


def shared_line_numbers(keyed: DataFrame, url: str, html: str) -> DataFrame:
    """(k1, k2, gone): pages with lines that are shared with their nearest pages."""
    rows = keyed.select("k1", "k2", F.lower(F.regexp_extract(quoted(url), _HOST, 1)).alias("host"),
                        F.regexp_replace(F.regexp_extract(quoted(url), _PATH, 1), r"(\.[A-Za-z]{3,5})?/*$", "")
                        .alias("path"), quoted(html).cast("string").alias("html"))
    lines = rows.filter("host <> ''").mapInArrow(_line_rows, _LINES).dropDuplicates(["k1", "k2"])
    placed = prefix_sums(lines.withColumn("one", F.lit(1).cast("long")), ["host", "path", "k1", "k2"], ["one"])
    placed = placed.withColumnRenamed("one_before", "pos").drop("one", "path")
    block = lambda shift: F.floor((F.col("pos") + shift) / BLOCK_PAGES)
    placed = placed.withColumn("block", F.explode(F.array_distinct(F.array(block(-REACH), block(0), block(REACH)))))
    return placed.groupBy("block").applyInArrow(_decide, "k1 long, k2 long, gone array<int>")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in wh.slices(batches, 128):
        texts, shared = [], []
        names = batch.schema.names
        gone_of = batch.column(names.index("__gone")).to_pylist()
        for page, gone in zip(batch.column(names.index("__html")).to_pylist(), gone_of):
            dropped = set(gone or ())
            found = list(ht.blocks(page or ""))
            texts.append("\n\n".join(t for i, (t, s) in enumerate(found) if s != ht.FURNITURE and i not in dropped))
            shared.append(len(dropped))
        rest = [i for i, n in enumerate(names) if n not in ("__html", "__gone")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in rest] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                                               pa.array(shared, pa.int64())],
            names=[names[i] for i in rest] + RESULTS)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                      limit: int = BROADCAST_IDS) -> DataFrame:
    """The pages with text (blocks joined by an empty line), n_chars, and n_shared (lines deleted as shared)."""
    row = [quoted(c).cast("string") for c in (page_id, url, html)]
    key = F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), F.length(c).cast("string"), F.lit(":"), c))
                     for c in row])
    keyed = small_batches(pages).withColumns({"k1": F.xxhash64(key), "k2": F.xxhash64(F.lit(1), key)})
    gone = written(shared_line_numbers(keyed, url, html), "shared-lines")
    if gone.count() <= limit:
        gone = F.broadcast(gone)
    rest = other_columns(pages, RESULTS)
    own = pages.select(*[quoted(c) for c in rest], quoted(html).cast("string").alias("__html"),
                       F.xxhash64(key).alias("__k1"), F.xxhash64(F.lit(1), key).alias("__k2"))
    gone = gone.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("gone").alias("__gone"))
    joined = own.join(gone, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    schema = ", ".join([f"`{c.replace('`', '``')}` {t}" for c, t in joined.dtypes if c not in ("__html", "__gone")]
                       + ["text string, n_chars long, n_shared long"])
    return joined.mapInArrow(_texts, schema)

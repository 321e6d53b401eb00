"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is
parsed greedily into the longest phrases that occur in a language's text; the
fewer phrases, the closer the language. The language with the fewest
normalised phrases, phrases * log2(training length) / length, wins.

The training text is a bounded sample: of each language about
``sample_docs`` documents chosen by the hash of their id, in the order of that
hash, until ``train_chars`` characters are reached (the documented bound of the
fit; what reaches the driver is at most that and one document for each distinct
value of lang). Everything else covers whole texts.

Every letter of the training text is a symbol of its own. An automaton is a
table state x symbol. A missing transition holds the state after restarting at
the root, with a flag that counts a phrase, so a parse step is one table
look-up. Alphabets of more than ``MAX_DENSE`` symbols (Chinese, Japanese,
Korean) take a table that holds the transitions alone, rows shifted into each
other's gaps, and three look-ups.

Texts are parsed side by side in lanes of ``LANE`` symbols, one numpy step for all
lanes of a block. At first every lane starts at the root. Then lanes are parsed
again from the state in which the lane before ends, until they meet the state of
the former parse, from where on both are the same; a lane that never meets it
passes its new end state on. What is counted are the phrases of the
whole text: lanes don't cut a match.

Defined results
* Letters are lower-cased; every run of other characters is one separator.
* Null text, and text without a letter, is ``und`` with score 0; so is
  everything when no labelled text was given.
* Ties: the language that sorts first. Score: 1 - best / second best.
* Repeated rows get equal results; a table without rows gives none. Very long
  texts are parsed whole. Input columns stay, except those with the name of a
  result column.
* Letters never seen in training have no transitions: they are phrases of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm import wordhash as wh
from innsight.llm.columns import other_columns, quoted, small_batches

LANE = 256
BLOCK = 1 << 20
UND = "und"
FLAG = np.uint32(1 << 31)
RESULTS = ["lang_pred", "score", "entropy"]
MAX_DENSE = 250


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``symbols``; 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def parse_table(symbols: list[int], n_symbols: int) -> np.ndarray:
    """Flat look-up table; the last column is padding, which changes nothing."""
    nxt = suffix_automaton(symbols)
    root = np.array([nxt[0].get(c, 0) for c in range(n_symbols)], dtype=np.uint32) | FLAG
    table = np.empty((len(nxt), n_symbols + 1), dtype=np.uint32)
    table[:, :n_symbols] = root
    table[:, n_symbols] = np.arange(len(nxt))
    for s, to in enumerate(nxt):
        for c, t in to.items():
            table[s, c] = t
    return table.reshape(-1)


class SparseTable:
    """The transitions of parse_table() without the missing ones, for large alphabets.

    The edge of state s by symbol c is at base[s] + c, where owner tells whose
    edge is there; ``miss`` is the row of missing transitions.
    """

    def __init__(self, symbols: list[int], n_symbols: int):
        nxt = suffix_automaton(symbols)
        self.base = np.zeros(len(nxt), dtype=np.int64)
        used, top = np.zeros(2 * n_symbols + 2, dtype=bool), 0    # no slot from top on is used
        single = []
        for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):
            if len(nxt[s]) == 1:
                single.append(s)
            elif nxt[s]:
                cs = np.array(sorted(nxt[s]))
                fits = np.ones(top + 1, dtype=bool)               # at top everything fits
                for c in cs.tolist():
                    fits &= ~used[c:c + top + 1]
                self.base[s] = b = int(np.argmax(fits))
                used[b + cs] = True
                top = max(top, b + int(cs[-1]) + 1)
                if top + n_symbols + 2 > len(used):
                    used = np.concatenate([used, np.zeros(len(used) + n_symbols, dtype=bool)])
        used = np.concatenate([used, np.zeros(len(single) + n_symbols, dtype=bool)])
        free = np.flatnonzero(~used[n_symbols:])[:len(single)] + n_symbols
        for s, slot in zip(single, free.tolist(), strict=True):
            self.base[s] = slot - next(iter(nxt[s]))
        size = int(self.base.max()) + n_symbols + 1
        self.owner = np.full(size, -1, dtype=np.int64)
        self.target = np.zeros(size, dtype=np.uint32)
        for s, to in enumerate(nxt):
            for c, t in to.items():
                self.owner[self.base[s] + c], self.target[self.base[s] + c] = s, t
        self.miss = np.zeros(n_symbols + 1, dtype=np.uint32)      # the last one is padding, at ends only
        self.miss[:n_symbols] = np.array([nxt[0].get(c, 0) for c in range(n_symbols)], dtype=np.uint32) | FLAG

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = self.base.take(state) + symbol
        return np.where(self.owner.take(at) == state, self.target.take(at), self.miss.take(symbol))


def _folded(c: str) -> str:
    """Lower case of a letter, as one letter."""
    return c.lower()[0]


class Model:
    """Training text by language, small enough to ship; tables are built once per worker."""

    def __init__(self, texts: dict[str, str]):
        self.texts = {k: v for k, v in sorted(texts.items()) if any(c.isalpha() for c in v)}

    def key(self) -> tuple:
        return tuple(self.texts.items())


@lru_cache(maxsize=1)
def _compiled(key: tuple):
    known = sorted({_folded(c) for _, text in key for c in set(text) if c.isalpha()})
    unknown = len(known) + 1                 # never in a training text, so it has no transitions
    of = {c: i + 1 for i, c in enumerate(known)}
    symbol = np.zeros(0x110000, dtype=np.min_scalar_type(unknown + 1))
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            symbol[cp] = of.get(_folded(c), unknown)
    tables, bits = [], []
    for _, text in key:
        s = _symbols(text.encode(), symbol)
        table = parse_table if unknown + 1 <= MAX_DENSE else SparseTable
        tables.append(table(s.tolist(), unknown + 1))
        bits.append(np.log2(max(2, len(s))))
    return symbol, unknown + 1, tables, np.array(bits)


def _symbols(text: bytes, symbol: np.ndarray) -> np.ndarray:
    s = symbol[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def phrases(texts: list[bytes], key: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases [languages, texts], symbols of each text, letters of each text)."""
    symbol, n_symbols, tables, _ = _compiled(key)
    parts = [_symbols(t, symbol) for t in texts]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    letters = np.array([np.count_nonzero(p) for p in parts], dtype=np.int64)
    lanes = -(-size // LANE)
    first = np.cumsum(lanes) - lanes
    grid = np.full(int(lanes.sum()) * LANE, n_symbols, dtype=symbol.dtype)
    for p, f in zip(parts, first.tolist(), strict=True):
        grid[f * LANE:f * LANE + len(p)] = p
    steps = np.ascontiguousarray(grid.reshape(-1, LANE).T).astype(np.uint32)
    lane_text = np.repeat(np.arange(len(texts)), lanes)
    follows = np.zeros(len(lane_text), dtype=bool)           # lanes that go on with the text of the lane before
    follows[1:] = lane_text[1:] == lane_text[:-1]
    out = np.zeros((len(tables), len(texts)), dtype=np.int64)
    for i, table in enumerate(tables):
        starts = _phrase_starts(table, steps, follows, np.uint32(n_symbols + 1))
        # the phrase that a text begins with, and those that start later
        out[i] = (size > 0) + np.bincount(lane_text, weights=starts, minlength=len(texts)).astype(np.int64)
    return out, size, letters


def _phrase_starts(table, steps: np.ndarray, follows: np.ndarray, width: np.uint32) -> np.ndarray:
    """Phrases that start in each lane (not counting the first of a text)."""
    def step(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return table.step(state, symbol) if isinstance(table, SparseTable) else table.take(state * width + symbol)

    n = len(follows)
    after = np.empty(steps.shape, dtype=np.uint32)           # state after each symbol, with the flag of a new phrase
    state = np.zeros(n, dtype=np.uint32)
    for t, symbol in enumerate(steps):
        after[t] = state = step(state, symbol)
        state = state & ~FLAG
    entered = np.zeros(n, dtype=np.uint32)                   # the state in which each lane was entered
    while True:
        end = after[-1] & ~FLAG
        want = np.zeros(n, dtype=np.uint32)
        want[1:] = np.where(follows[1:], end[:-1], 0)
        lanes = np.flatnonzero(want != entered)
        if not len(lanes):
            return (after >> np.uint32(31)).sum(axis=0)
        entered[lanes] = state = want[lanes]
        for t, symbol in enumerate(steps):
            now = step(state, symbol[lanes])
            met = (now & ~FLAG) == (after[t, lanes] & ~FLAG)
            after[t, lanes] = now
            lanes, state = lanes[~met], (now & ~FLAG)[~met]
            if not len(lanes):
                break


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(labelled: DataFrame, sample_docs: int = 256, train_chars: int = 16384,
          doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a bounded sample: at most train_chars of each language reach the driver's model."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.xxhash64(F.col(doc_id), F.lit("train")).alias("h"))
    counts = rows.groupBy("lang").count()
    u = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(counts), "lang").filter(u * F.col("count") < sample_docs).select(
        "lang", "h", "text").distinct()
    # about sample_docs rows a language: those before train_chars characters are full
    before = Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1)
    picked = sample.withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).filter(
        F.col("before") < train_chars).select("lang", "h", F.substring("text", 1, train_chars).alias("text")).collect()
    texts: dict[str, str] = {}
    seen = set()
    for r in sorted(picked, key=lambda r: (r["lang"], r["h"], r["text"])):
        if r["text"] not in seen:
            seen.add(r["text"])
            have = texts.get(r["lang"], "")
            texts[r["lang"]] = (have + " " + r["text"])[:train_chars] if have else r["text"][:train_chars]
    return Model(texts)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with lang_pred, score and entropy (bits a symbol under the predicted language)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.key())
    rest = other_columns(docs, RESULTS)
    left = small_batches(docs).select(*[quoted(c) for c in rest], F.col(text).alias("__text"))
    schema = left.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("entropy", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shipped.value
        names = np.array([k for k, _ in key], dtype=object)
        for batch in wh.slices(batches):
            texts = wh.text_bytes(batch.column(len(rest)))
            pred = np.full(len(texts), UND, dtype=object)
            score, entropy = np.zeros(len(texts)), np.zeros(len(texts))
            for lo, hi in wh.blocks(texts, BLOCK) if key else ():
                n, size, letters = phrases(texts[lo:hi], key)
                bits = n * _compiled(key)[3][:, None] / np.maximum(size, 1)
                order = np.argsort(bits, axis=0, kind="stable")
                best = np.take_along_axis(bits, order[:1], 0)[0]
                second = np.take_along_axis(bits, order[1:2], 0)[0] if len(key) > 1 else np.full(hi - lo, np.inf)
                ok = letters > 0
                pred[lo:hi] = np.where(ok, names[order[0]], UND)
                score[lo:hi] = np.where(ok, 1 - best / second, 0)
                entropy[lo:hi] = np.where(ok, best, 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(entropy)],
                names=[*batch.schema.names[:-1], *RESULTS])
    return left.mapInArrow(run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **kw) -> DataFrame:
    """Train on the documents that are not held out, predict all of them."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return predict(docs, train(own.filter(~held_out(F.col("doc_id"))), **kw), text=text)

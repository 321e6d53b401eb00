"""Word and n-gram hashes of many texts at once, with numpy inside a task.

A block of UTF-8 texts is one byte array: a table marks the bytes of words, a
polynomial prefix hash modulo 2**64 gives each word's hash from two prefixes,
and n-gram hashes are sums of shifted word hashes. Words split at ASCII
separators only, so cutting at bytes never cuts a character.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        p = np.ones(n, dtype=np.uint64)
        done, step = 1, base % 2**64
        while done < n:                      # doubling: p[done:2*done] = p[:done] * base**done
            k = min(done, n - done)
            p[done:done + k] = p[:k] * _U(step)
            step = step * step % 2**64
            done += k
        return p
    return run(_BASE), run(pow(_BASE, -1, 2**64))


#: tables that a Python worker keeps between tasks: module, function with an lru_cache
WORKER_TABLES = [("innsight.llm.wordhash", "_powers"), ("innsight.llm.language", "_compiled"),
                 ("innsight.llm.near_dup", "_tables")]


def drop_tables() -> None:
    """Spark reuses Python workers: a stage with large tables of its own lets go of those of the stages before."""
    for module, name in WORKER_TABLES:
        if module in sys.modules:
            getattr(sys.modules[module], name).cache_clear()


def _byte_set(pattern: bytes) -> np.ndarray:
    return np.array([re.match(pattern, bytes([i])) is not None for i in range(256)])


#: bytes of words: letters, digits and all beyond ASCII (near-duplicate operators)
ALNUM = _byte_set(rb"[0-9A-Za-z\x80-\xff]")
#: bytes of words: anything but ASCII white space (substring dedup)
NONSPACE = _byte_set(rb"[^\x20\x09-\x0D]")


@dataclass
class Words:
    """h: word hashes of a block; off[d]:off[d + 1] are the words of text d."""
    h: np.ndarray
    off: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def hash_words(texts: list[bytes], is_word: np.ndarray) -> Words:
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, dtype=np.uint8)
    size = 1 << max(19, (len(buf) - 1).bit_length())
    power, inverse = _powers(size)
    inside = is_word[buf].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    value = buf.astype(np.uint64)
    value += _U(1)
    value *= power[:len(buf)]
    np.cumsum(value, out=value)
    before = np.where(start > 0, value[np.maximum(start, 1) - 1], _U(0))
    h = mix((value[end - 1] - before) * inverse[start]) if len(start) else np.zeros(0, np.uint64)
    length = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts)) + 1
    first_byte = np.concatenate([[0], np.cumsum(length)])
    return Words(h, np.searchsorted(start, first_byte))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes; the last n - 1 places have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    # sums over power-of-two runs, by doubling, put together along the bits of n
    out, at, run, width = None, 0, h, 1
    factor = _STEP
    while True:
        if n & width:
            part = run[at:at + size]
            out = part.copy() if out is None else out * _U(factor) + part
            at += width
        if width * 2 > n:
            break
        run = run[:-width] * _U(factor) + run[width:]
        factor = (factor * factor + 2) % 2**64
        width *= 2
    return mix(out + _U(n))


def inside_text(words: Words, n: int) -> np.ndarray:
    """For the places of ngrams(): does the n-gram lie within one text?"""
    size = max(0, len(words.h) - n + 1)
    last = np.repeat(words.off[1:], np.diff(words.off))[:size]
    return np.arange(size) + n <= last


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return col.cast(pa.large_binary()).fill_null(b"").to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that a worker holds Python objects of a few hundred rows only."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a block of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)

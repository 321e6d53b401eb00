"""Which hashes of a chunk do other chunks have too: asked of ranges of hashes, answered by place.

A chunk sends its distinct hashes, sorted and as differences, with the number
of times it holds each, to the task of their range of the 64-bit numbers. The
range adds up what all chunks hold and answers each chunk with the places, in the
chunk's own sorted list, of the hashes held twice or more, and their totals. A
hash costs some five bytes on the way there, and one found once nothing back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MESSAGE = "chunk long, range long, data binary"


def packed(*columns: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, so that the zeros of small numbers lie together."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + len(planes).to_bytes(8, "little") + pa.compress(
        planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, *types: type) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(
        data[16:], int.from_bytes(data[8:16], "little"), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(np.ascontiguousarray(planes[at:at + size].reshape(-1, n).T).reshape(-1).view(t))
        at += size
    return out


def _starts(n_ranges: int) -> np.ndarray:
    """First hash of every range: the ranges share the 64-bit numbers out evenly."""
    return np.array([-(-i * 2**64 // n_ranges) for i in range(n_ranges)], dtype=np.uint64)


def questions(chunk: int, hashes: np.ndarray, held: np.ndarray, n_ranges: int) -> pa.Table:
    """MESSAGE rows of a chunk: its distinct hashes (sorted) and how often it holds each."""
    edge = np.append(np.searchsorted(hashes, _starts(n_ranges)), len(hashes))
    use = np.flatnonzero(np.diff(edge))
    data = [packed(np.diff(hashes[edge[r]:edge[r + 1]], prepend=np.uint64(0)), held[edge[r]:edge[r + 1]].astype(np.uint64))
            for r in use]
    return pa.table({"chunk": pa.array(np.full(len(use), chunk), pa.int64()), "range": pa.array(use, pa.int64()),
                     "data": pa.array(data, pa.binary())})


def _answer(group: pa.Table) -> pa.Table:
    parts = [unpacked(d, np.uint64, np.uint64) for d in group["data"].to_pylist()]
    h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    _, place = np.unique(h, return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.uint64)[place]
    out, at = [], 0
    for chunk, p in zip(group["chunk"].to_pylist(), parts):
        n = total[at:at + len(p[0])]
        at += len(p[0])
        shared = np.flatnonzero(n > 1)
        if len(shared):
            out.append((chunk, packed(np.diff(shared, prepend=0).astype(np.uint32), n[shared])))
    chunk, data = zip(*out) if out else ((), ())
    return pa.table({"chunk": pa.array(chunk, pa.int64()),
                     "range": pa.array([group["range"][0].as_py()] * len(out), pa.int64()),
                     "data": pa.array(data, pa.binary())})


def answers(asked: DataFrame) -> DataFrame:
    """MESSAGE rows to the chunks."""
    return asked.groupBy("range").applyInArrow(_answer, MESSAGE)


def totals(hashes: np.ndarray, answered: pa.Table, n_ranges: int) -> np.ndarray:
    """How often all chunks hold each of the chunk's distinct hashes (sorted); 1 where nothing was answered."""
    n = np.ones(len(hashes), dtype=np.int64)
    first = np.searchsorted(hashes, _starts(n_ranges))
    for r, data in zip(answered["range"].to_pylist(), answered["data"].to_pylist()):
        step, count = unpacked(data, np.uint32, np.uint64)
        n[first[r] + np.cumsum(step, dtype=np.int64)] = count
    return n

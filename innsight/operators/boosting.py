"""Second-order boosted trees on Spark: gradient and hessian histograms.

Features are binned once to one byte (edges from Spark's mergeable quantile
summary). Features of few bins share a byte (``Packing``): a histogram over the
codes of a byte holds the histograms of all its features. A node's larger child is
the node less its smaller child. Two plans:

* A table of at most ``node_rows`` rows is one task, which grows the whole fit; its
  memory is bounded by that number. Many such fits run side by side (``Fold``). The
  task packs the features anew by the combinations that its rows have (``bundled``):
  one-hot and derived features need few.
* Rows of a larger table live in blocks of an RDD, as many for each core; a block knows its
  rows' scores from the trees so far, so a job ships the new trees only. Scores, and the
  nodes of the tree that is grown, are cached in the Python workers, and led on by the
  levels and trees since; scores are written with ``checkpoint()`` every ``refresh`` trees: a lost
  executor costs the trees since then, never the fit. A level of a tree is one job:
  every partition sums up its histograms and the driver adds them, which is bounded by
  nodes x codes. From level ``HISTOGRAM_LEVELS`` on, the rows of a node within
  ``node_rows`` go to one task, which grows the rest of that subtree with the same
  split rule; all such nodes of a tree are one job.

Leaf value: -T(G) / (H + l2), T the soft threshold at l1. A split's gain is the
loss it takes away, T(GL)^2/(HL + l2) + T(GR)^2/(HR + l2) - T(G)^2/(H + l2); it is
made if the gain exceeds ``minSplitGain`` and both children have a hessian of
``minChildWeight``. Columns are drawn once a tree. Ties: the first feature, then
the lowest edge. Missing values are the last bin.
"""

from __future__ import annotations

import base64
import io
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.schema import SEED
from innsight.session import ensure_checkpoint_dir

BLOCK_ROWS, NODE_ROWS = 16_384, 1_000_000
REFRESH, SHIPPED = 100, 20
CACHED_BLOCKS = 1024
CODES = 256
HISTOGRAM_LEVELS = 8
DRIVER_SUMS = 32
MAX_DEPTH = 12
EPSILON = 1e-6
CHUNK, SCORED = 16_384, 16_384
COUNTED = ACCURACY = 10_000


def _param(name: str, doc: str, kind):
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _BoostedParams(Params):
    featuresCol = _param("featuresCol", "vector column", TypeConverters.toString)
    labelCol = _param("labelCol", "label column", TypeConverters.toString)
    weightCol = _param("weightCol", "row weights (none: 1)", TypeConverters.toString)
    objective = _param("objective", "logistic or squared", TypeConverters.toString)
    maxIter = _param("maxIter", "trees", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = _param("stepSize", "learning rate", TypeConverters.toFloat)
    subsamplingRate = _param("subsamplingRate", "share of the rows of a tree", TypeConverters.toFloat)
    columnRate = _param("columnRate", "share of the columns of a tree", TypeConverters.toFloat)
    minSplitGain = _param("minSplitGain", "least gain of a split", TypeConverters.toFloat)
    minChildWeight = _param("minChildWeight", "least hessian of a child", TypeConverters.toFloat)
    l1 = _param("l1", "soft threshold of gradients", TypeConverters.toFloat)
    l2 = _param("l2", "added to hessians", TypeConverters.toFloat)
    maxBins = _param("maxBins", "bins of a feature, 255 at most", TypeConverters.toInt)
    seed = _param("seed", "seed of row and column draws", TypeConverters.toInt)
    nodeRows = _param("nodeRows", "rows that one task may grow trees from", TypeConverters.toInt)

    DEFAULTS = dict(featuresCol="features", labelCol="label", objective="logistic", maxIter=100, maxDepth=6,
                    stepSize=0.3, subsamplingRate=1.0, columnRate=1.0, minSplitGain=0.0, minChildWeight=1.0,
                    l1=0.0, l2=1.0, maxBins=64, seed=SEED, nodeRows=NODE_ROWS)

    def _values(self) -> dict:
        return {n: self.getOrDefault(n) for n in self.DEFAULTS}


# ---------------------------------------------------------------------------
# one tree: splits from histograms (numpy, the same code in tasks and on the driver)
# ---------------------------------------------------------------------------

class Tree:
    """A binary tree in heap order: children of node i are 2i + 1 and 2i + 2; feature -1 is a leaf."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature = np.full(size, -1, dtype=np.int16)
        self.edge = np.zeros(size, dtype=np.uint8)
        self.value = np.zeros(size)
        self.gain = np.zeros(size)


def leaves(feature: np.ndarray, edge: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Node at which each row ends; bins [features, rows]."""
    out = np.zeros(bins.shape[1], dtype=np.int64)
    steps = Steps(feature, edge)
    for lo in range(0, len(out), CHUNK):
        held = np.ascontiguousarray(bins[:, lo:lo + CHUNK])
        out[lo:lo + CHUNK] = steps.ends(held, *steps.room(held.shape[1]))
    return out


class Steps:
    """A grown tree as look-ups: the feature, the edge and the left child of each node; a leaf's rows stay."""

    def __init__(self, feature: np.ndarray, edge: np.ndarray):
        inner, here = feature >= 0, np.arange(len(feature))
        self.feature = np.where(inner, feature, 0).astype(np.int64)
        self.left = np.where(inner, 2 * here + 1, here)
        self.edge = np.where(inner, edge, CODES - 1).astype(np.uint8)      # no bin is above CODES - 2
        self.levels = int(np.flatnonzero(inner).max(initial=-1) + 1).bit_length()

    @staticmethod
    def room(n: int) -> tuple:
        """Arrays that a walk of n rows writes to."""
        return np.arange(n), *(np.empty(n, dtype=t) for t in (np.int64, np.int64, np.uint8, np.uint8, np.bool_))

    def ends(self, bins: np.ndarray, rows, at, node, bin_, edge, right) -> np.ndarray:
        """``leaves`` of rows whose number ``room`` was given; written over by the next call."""
        flat, start = bins.reshape(-1), self.feature * bins.shape[1]
        node[:] = 0
        for _ in range(self.levels):
            start.take(node, out=at, mode="clip")
            at += rows
            flat.take(at, out=bin_, mode="clip")
            self.edge.take(node, out=edge, mode="clip")
            np.greater(bin_, edge, out=right)
            self.left.take(node, out=at, mode="clip")
            np.add(at, right, out=node)
        return node


class Packing:
    """Features share the codes of a byte while the product of their bins is within it: bin b of a feature stands at
    the codes with (code // stride) % size = b."""

    def __init__(self, edges: list[np.ndarray]):
        self.size = np.array([len(e) + 1 for e in edges], dtype=np.int64)
        self.code, self.stride = np.zeros(len(edges), dtype=np.int64), np.ones(len(edges), dtype=np.int64)
        self.used: list[int] = []
        for f in np.argsort(-self.size, kind="stable"):
            at = next((i for i, u in enumerate(self.used) if u * self.size[f] <= CODES), len(self.used))
            if at == len(self.used):
                self.used.append(1)
            self.code[f], self.stride[f] = at, self.used[at]
            self.used[at] *= int(self.size[f])
        self.bin = (np.arange(CODES) // self.stride[:, None]) % self.size[:, None]     # [feature, code]

    def bundled(self, codes: np.ndarray) -> tuple["Packing", np.ndarray]:
        """Features packed by the combinations of bins that the rows have, and the rows' codes: a feature joins the
        byte whose combinations it multiplies least, while they are within CODES."""
        out = Packing([])
        out.size, out.code = self.size, np.zeros(len(self.size), dtype=np.int64)
        out.bin, out.used, kept = np.zeros((len(self.size), CODES), dtype=np.int64), [], []
        members: list[list[int]] = []
        for f in np.argsort(-self.size, kind="stable"):
            own, size, best = self.bin[f].astype(np.uint8)[codes[self.code[f]]], int(self.size[f]), None
            for at, used in enumerate(out.used):
                seen = np.zeros(used * size, dtype=bool)
                for lo in range(0, len(own), CHUNK):
                    seen[kept[at][lo:lo + CHUNK] * np.intp(size) + own[lo:lo + CHUNK]] = True
                n = int(seen.sum())
                if n <= CODES and (best is None or n * out.used[best[0]] < best[1] * used):
                    best = at, n, seen
            if best is None:
                best = len(out.used), 0, np.zeros(size, dtype=bool)
                best[2][np.unique(own)] = True
                out.used.append(1)
                members.append([])
                kept.append(np.zeros(len(own), dtype=np.uint8))
            at, _, seen = best
            found = np.flatnonzero(seen)
            new = (np.cumsum(seen) - 1).astype(np.uint8)
            for lo in range(0, len(own), CHUNK):
                kept[at][lo:lo + CHUNK] = new[kept[at][lo:lo + CHUNK] * np.intp(size) + own[lo:lo + CHUNK]]
            for i in members[at]:
                out.bin[i, :len(found)] = out.bin[i, found // size]
            members[at].append(f)
            out.code[f], out.bin[f, :len(found)], out.used[at] = at, found % size, len(found)
        return out, np.stack(kept) if kept else np.zeros((0, codes.shape[1]), dtype=np.uint8)

    def codes(self, bins: np.ndarray) -> np.ndarray:
        """[codes, rows] of bins [rows, features]."""
        out = np.zeros((len(self.used), len(bins)), dtype=np.uint8)
        for f in range(bins.shape[1]):
            out[self.code[f]] += bins[:, f] * np.uint8(self.stride[f] % CODES)
        return out

    def histograms(self, codes: np.ndarray, columns: np.ndarray, place: np.ndarray, nodes: int, weights) -> np.ndarray:
        """Sums [weight, node, code, value] of the rows; ``place`` is a row's node times CODES, weight None counts."""
        out = np.zeros((len(weights), nodes, len(self.used), CODES))
        for c in np.unique(self.code[columns]):
            at = place + codes[c]
            for i, w in enumerate(weights):
                out[i, :, c] = np.bincount(at, weights=w, minlength=nodes * CODES).reshape(nodes, CODES)
        return out

    def sums(self, codes: np.ndarray, columns: np.ndarray, gh: np.ndarray, rows: np.ndarray | None,
             words: np.ndarray | None = None) -> np.ndarray:
        """Sums [gradient or hessian, code, value] of a node's rows (None: all); ``gh`` holds the gradient and i times the
        hessian, so that one pass adds both. ``words`` are the rows' codes side by side (``wide``)."""
        out, used = np.zeros((len(self.used), CODES), dtype=np.complex128), np.unique(self.code[columns])
        words = wide(codes) if words is None else words
        for lo in range(0, len(gh) if rows is None else len(rows), CHUNK):
            at = slice(lo, lo + CHUNK) if rows is None else rows[lo:lo + CHUNK]
            values = gh[at] if rows is None else gh.take(at, mode="clip")
            # eight codes are one look-up
            held = [(w[at] if rows is None else w.take(at, mode="clip")).view(np.uint8).reshape(-1, 8) for w in words]
            for c in used:
                np.add.at(out[c], held[c // 8][:, c % 8].astype(np.intp), values)
        return np.stack([out.real, out.imag])

    def by_feature(self, hist: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """[weight, node, column, bin] of histograms over codes."""
        out = np.zeros((*hist.shape[:2], len(columns), max(2, int(self.size.max()))))
        for c in np.unique(self.code[columns]):
            mine, used = np.flatnonzero(self.code[columns] == c), self.used[c]
            first = np.concatenate([[0], self.size[columns[mine]].cumsum()])
            share = np.zeros((used, first[-1]))
            for lo, f in zip(first, columns[mine]):
                share[np.arange(used), lo + self.bin[f, :used]] = 1.0
            part = hist[:, :, c, :used] @ share
            for i, lo, hi in zip(mine, first, first[1:]):
                out[:, :, i, :hi - lo] = part[:, :, lo:hi]
        return out

    def right(self, feature: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """[node, code]: whether a row with that code goes to the right child."""
        return self.bin[feature] > edge[:, None]

    def parted(self, codes: np.ndarray, rows: np.ndarray, feature: int, edge: int, out: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray]:
        """The rows that go to the left child and to the right one, each in their order; written to ``out``, where the
        caller holds memory for them."""
        code, right = codes[self.code[feature]], self.bin[feature] > edge
        out, goes = np.empty_like(rows) if out is None else out, np.empty(len(rows), dtype=np.bool_)
        for lo in range(0, len(rows), CHUNK):
            goes[lo:lo + CHUNK] = right.take(code.take(rows[lo:lo + CHUNK], mode="clip"), mode="clip")
        left = len(rows) - np.count_nonzero(goes)
        for side, first in ((~goes, 0), (goes, left)):
            for lo in range(0, len(rows), CHUNK):
                mine = np.flatnonzero(side[lo:lo + CHUNK])
                rows[lo:lo + CHUNK].take(mine, out=out[first:first + len(mine)], mode="clip")
                first += len(mine)
        return out[:left], out[left:len(rows)]

    def landed(self, score: np.ndarray, codes: np.ndarray, rows: np.ndarray, feature: int, edge: int, value) -> None:
        """Add the value of its child, the left or the right one, to the score of each of the rows."""
        code, of_code = codes[self.code[feature]], np.where(self.bin[feature] > edge, value[1], value[0])
        for lo in range(0, len(rows), CHUNK):
            at = rows[lo:lo + CHUNK]
            score[at] += of_code.take(code.take(at, mode="clip"), mode="clip")

    def route(self, tree: Tree, codes: np.ndarray) -> np.ndarray:
        """Node of the tree, as far as it is grown, at which each row ends."""
        walk, out = Walk(self, tree), np.zeros(codes.shape[1], dtype=np.int64)
        for lo in range(0, len(out), CHUNK):
            walk.on(np.ascontiguousarray(codes[:, lo:lo + CHUNK]), out[lo:lo + CHUNK])
        return out


class Walk:
    """A tree, as far as it is grown, as look-ups on codes: a node's left child, and whether a code goes to the right."""

    def __init__(self, packing: Packing, tree: Tree):
        inner, here = tree.feature >= 0, np.arange(len(tree.feature))
        feature = np.where(inner, tree.feature, 0)
        self.code, self.left = packing.code[feature], np.where(inner, 2 * here + 1, here)
        self.right = (packing.right(feature, tree.edge) & inner[:, None]).reshape(-1)
        self.levels = int(np.flatnonzero(inner).max(initial=-1) + 1).bit_length()

    def on(self, codes: np.ndarray, node: np.ndarray, done: int = 0) -> None:
        """Lead the rows on from their nodes, which are ``done`` levels down (or leaves), as far as the tree is grown."""
        flat, start, rows = codes.reshape(-1), self.code * codes.shape[1], np.arange(codes.shape[1])
        for _ in range(done, self.levels):
            at = start.take(node, mode="clip")
            at += rows
            code = flat.take(at, mode="clip")
            np.multiply(node, CODES, out=at)
            at += code
            node[:] = self.left.take(node, mode="clip")
            node += self.right.take(at, mode="clip")


def wide(codes: np.ndarray) -> np.ndarray:
    """[word, row]: eight codes of a row in one number."""
    words = -(-len(codes) // 8)
    out = np.zeros((words, codes.shape[1], 8), dtype=np.uint8)
    for c, code in enumerate(codes):
        out[c // 8, :, c % 8] = code
    return out.view(np.uint64).reshape(words, codes.shape[1])


class Candidates:
    """The splits (feature, edge) that the drawn columns allow, by feature and edge, and per byte of codes a matrix
    whose product with the code's histogram is the left child's sum for each of them."""

    def __init__(self, packing: Packing, columns: np.ndarray):
        self.feature = np.repeat(columns, packing.size[columns] - 1)
        first = np.cumsum(packing.size[columns] - 1) - (packing.size[columns] - 1)
        self.edge = np.arange(len(self.feature)) - np.repeat(first, packing.size[columns] - 1)
        self.parts = []
        for c in np.unique(packing.code[columns]):
            mine, used = np.flatnonzero(packing.code[self.feature] == c), packing.used[c]
            left = packing.bin[self.feature[mine], :used] <= self.edge[mine][:, None]
            self.parts.append((c, used, mine, np.ascontiguousarray(left.T, dtype=np.float64)))

    def best(self, hist: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """``best_splits`` from histograms over codes."""
        sums = np.zeros((*hist.shape[:2], len(self.feature)))
        for c, used, mine, left in self.parts:
            sums[:, :, mine] = hist[:, :, c, :used] @ left
        c, used = self.parts[0][:2]
        gain, at, sides = best_of(*sums, *hist[:, :, c, :used].sum(axis=2, keepdims=True), p)
        return gain, self.feature[at], self.edge[at], sides


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(g, h, p: dict):
    return -soft(g, p["l1"]) / (h + p["l2"]) * p["stepSize"]


def best_splits(g: np.ndarray, h: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Best (gain, feature, edge) of each node from histograms [nodes, features, bins], and both children's sums."""
    gl, hl = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    flat, width = lambda x: x.reshape(len(g), -1), gl.shape[2]
    gain, at, sides = best_of(flat(gl), flat(hl), g[:, :1].sum(axis=2), h[:, :1].sum(axis=2), p)
    return gain, at // width, at % width, sides


def best_of(gl: np.ndarray, hl: np.ndarray, total_g: np.ndarray, total_h: np.ndarray, p: dict
            ) -> tuple[np.ndarray, np.ndarray, dict]:
    """(gain, place, both children's sums) of each node's best split, from the left children's sums [nodes, splits] and
    the nodes' [nodes, 1]."""
    gr, hr = total_g - gl, total_h - hl
    l1, l2 = p["l1"], p["l2"]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = lambda a, b: np.where(b + l2 > 0, soft(a, l1) ** 2 / (b + l2), 0.0)
        gain = score(gl, hl) + score(gr, hr) - score(total_g, total_h)
    least = max(p["minChildWeight"], EPSILON)
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
    # differences below rounding are ties: the first feature, then the lowest edge
    top = gain.max(axis=1, keepdims=True)
    at = (gain >= np.where(np.isfinite(top), top - EPSILON * (1 + np.abs(top)), np.inf)).argmax(axis=1)
    rows = np.arange(len(gl))
    pick = lambda x: x[rows, at]
    return gain[rows, at], at, {"gl": pick(gl), "hl": pick(hl), "gr": pick(gr), "hr": pick(hr)}


def grow(tree: Tree, root: int, packing: Packing, codes: np.ndarray, words: np.ndarray, gh: np.ndarray, rows: np.ndarray,
         depth: int, columns: np.ndarray, p: dict, score: np.ndarray | None = None, alone: bool = False,
         room: tuple | None = None) -> None:
    """Grow the subtree at ``root`` from its rows' codes, level by level, and add its leaves to the rows' ``score``.
    ``alone``: ``gh`` is 0 for every other row. ``room``: two arrays as long as ``rows``, for the rows by node of a level
    and of the next one."""
    room = (np.empty_like(rows), np.empty_like(rows)) if room is None else room
    total = (gh if alone else gh.take(rows)).sum()
    tree.value[root] = leaf_value(total.real, total.imag, p)
    nodes, members = np.array([root]), [rows]
    allowed = Candidates(packing, columns)
    hist = packing.sums(codes, columns, gh, None if alone else rows, words)[:, None]
    for level in range(depth if len(allowed.feature) else 0):
        gain, feature, edge, sides = allowed.best(hist, p)
        more = gain > max(p["minSplitGain"], EPSILON)
        split = np.flatnonzero(more)
        if score is not None:
            for i in np.flatnonzero(~more):
                score[members[i]] += tree.value[nodes[i]]
        feature, edge = feature[split], edge[split]
        tree.feature[nodes[split]], tree.edge[nodes[split]], tree.gain[nodes[split]] = feature, edge, gain[split]
        nodes = np.stack([2 * nodes[split] + 1, 2 * nodes[split] + 2], axis=1).ravel()
        pair = lambda a, b: np.stack([sides[a][split], sides[b][split]], axis=1).ravel()  # noqa: E731,B023
        tree.value[nodes] = leaf_value(pair("gl", "gr"), pair("hl", "hr"), p)
        if level + 1 == depth:
            if score is not None:
                for i, f, e, value in zip(split, feature, edge, tree.value[nodes].reshape(-1, 2)):
                    packing.landed(score, codes, members[i], f, e, value)
            return
        if not len(split):
            return
        first = np.cumsum([0] + [len(members[i]) for i in split])
        members = [m for i, f, e, lo, hi in zip(split, feature, edge, first, first[1:])
                   for m in packing.parted(codes, members[i], f, e, room[level % 2][lo:hi])]
        both = np.empty((2, len(nodes), *hist.shape[2:]))
        for i, parent in enumerate(split):
            small = 2 * i + (len(members[2 * i + 1]) < len(members[2 * i]))
            both[:, small] = packing.sums(codes, columns, gh, members[small], words)
            both[:, small ^ 1] = hist[:, parent] - both[:, small]
        hist = both
    if score is not None:
        for node, mine in zip(nodes, members):
            score[mine] += tree.value[node]


# ---------------------------------------------------------------------------
# blocks of rows in the tasks
# ---------------------------------------------------------------------------

#: what this worker has seen of blocks: (fit, block) -> [trees applied, scores, levels of the next tree, nodes of the rows]
_SCORES: OrderedDict = OrderedDict()


class Block:
    """Rows of a partition: codes [codes, n], label, weight, and their scores after ``applied`` trees (one, where all
    rows have it)."""

    def __init__(self, number: tuple, codes, y, w, score, applied: int = 0):
        self.number, self.codes, self.y, self.w, self.score, self.applied = number, codes, y, w, score, applied

    def reached(self, fit: str, trees: list[Tree], walk, tree: Tree | None = None, by_level: bool = True
                ) -> tuple[np.ndarray, np.ndarray]:
        """(scores after the trees, nodes in the ``tree`` that is being grown); ``walk`` gives the look-ups of a tree. What
        this worker knows of the block from former jobs is led on; nodes only if trees grow ``by_level`` alone."""
        key = (fit, self.number)
        done, score, level, node = _SCORES.get(key, (-1, None, 0, None))
        if done < self.applied or done > len(trees):
            done, score, level, node = self.applied, np.broadcast_to(self.score, len(self.y)).copy(), 0, None
        node = np.zeros(len(self.y), dtype=np.int64) if node is None else node.astype(np.int64)
        for t in trees[done:]:
            walk(t).on(self.codes, node, level)
            score += t.value.take(node, mode="clip")
            node[:], level = 0, 0
        if tree is not None and walk(tree).levels < level:
            node[:], level = 0, 0            # a level that is asked for once more
        if tree is not None:
            walk(tree).on(self.codes, node, level)
            level = walk(tree).levels
        _SCORES[key] = (len(trees), score, level, node.astype(np.int16)) if by_level else (len(trees), score, 0, None)
        _SCORES.move_to_end(key)
        while len(_SCORES) > CACHED_BLOCKS:
            _SCORES.popitem(last=False)
        return score, node

    def sampled(self, seed: int, tree: int, rate: float) -> np.ndarray:
        """Whether each row is in the tree's sample: the same in every job of the tree, on any executor."""
        return np.random.Generator(np.random.Philox(
            key=[seed & 0xFFFFFFFF, tree], counter=[*self.number, 0, 0])).random(len(self.y)) < rate


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in a byte each, if all are whole and small."""
    with np.errstate(invalid="ignore"):
        small = a.astype(np.uint8)
    return small if (small == a).all() else a


def slim(block: Block) -> Block:
    """A block that no tree was applied to, in fewer bytes: every level of a tree reads it."""
    return Block(block.number, block.codes, narrow(block.y), narrow(block.w), block.score[:1])


def paired(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Gradients and hessians as the parts of complex numbers."""
    out = np.empty(len(g), dtype=np.complex128)
    out.real, out.imag = g, h
    return out


def gradients(objective: str, score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "logistic":
        prob = np.negative(score)
        np.exp(prob, out=prob)
        prob += 1.0
        np.divide(1.0, prob, out=prob)
        h = 1.0 - prob
        h *= prob
        np.maximum(h, 1e-16, out=h)
        h *= w
        prob -= y
        prob *= w
        return prob, h
    return (score - y) * w, w


class _Job:
    """What a job of a tree does with its blocks. Pickled with the new trees; older ones are broadcast."""

    def __init__(self, fit: str, p: dict, packing: Packing, shipped: list, fresh: list, number: int, tree: Tree, columns,
                 counted: bool):
        self.fit, self.p, self.packing, self.shipped, self.fresh = fit, p, packing, shipped, fresh
        self.number, self.tree, self.columns, self.counted = number, tree, columns, counted

    def opened(self) -> "_Job":
        """The job in a task: its trees, whose look-ups are made once."""
        self.trees, self.walks = [t for b in self.shipped for t in b.value] + self.fresh, {}
        return self

    def walk(self, tree: Tree) -> Walk:
        if id(tree) not in self.walks:
            self.walks[id(tree)] = Walk(self.packing, tree)
        return self.walks[id(tree)]

    def rows(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(gradients, hessians as the imaginary part; node) of a block's rows; rows that aren't in the sample have node -1."""
        score, node = block.reached(self.fit, self.trees, self.walk, self.tree, not self.counted)
        gh = paired(*gradients(self.p["objective"], score, block.y, block.w))
        if self.p["subsamplingRate"] < 1:
            node[~block.sampled(self.p["seed"], self.number, self.p["subsamplingRate"])] = -1
        return gh, node

    def histograms(self, nodes: list[int]):
        """A function of a partition's blocks: sums of gradient and hessian, and rows if they are ``counted``, by
        [node, code, value]."""
        place = np.full(len(self.tree.feature) + 1, -1)          # the last one is that of node -1
        place[nodes] = np.arange(len(nodes))

        def run(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
            job, used, size = self.opened(), np.unique(self.packing.code[self.columns]), len(nodes) * CODES
            total, count = np.zeros((len(self.packing.used), size), dtype=np.complex128), []
            for block in blocks:
                gh, node = job.rows(block)
                at = place.take(node, mode="wrap")
                live = np.flatnonzero(at >= 0)
                if not len(live):
                    continue
                few = len(live) < len(at)
                first, gh = (at.take(live) * CODES, gh.take(live)) if few else (at * CODES, gh)
                codes = block.codes.take(live, axis=1) if few else block.codes
                for c in used:
                    np.add.at(total[c], first + codes[c], gh)
                if job.counted:
                    more = job.packing.histograms(codes, job.columns, first, len(nodes), (None,))[0]
                    count = [more + count[0] if count else more]
            parts = np.stack([total.real, total.imag]).reshape(2, len(total), len(nodes), CODES).swapaxes(1, 2)
            if job.counted:
                parts = np.concatenate([parts, np.stack(count) if count else np.zeros((1, *parts.shape[1:]))])
            yield parts
        return run

    def small_rows(self, nodes: list[int]):
        """A function of a partition's blocks: (node, rows) of the nodes that one task finishes."""
        def run(blocks: Iterator[Block]) -> Iterator[tuple]:
            job = self.opened()
            for block in blocks:
                gh, node = job.rows(block)
                for s in nodes:
                    mine = np.flatnonzero(node == s)
                    if len(mine):
                        yield s, (block.number, block.codes[:, mine], gh[mine])
        return run

    def subtree(self, item: tuple) -> tuple:
        """(nodes, features, edges, values, gains) of a small node's subtree."""
        root, parts = item
        parts = sorted(parts, key=lambda x: x[0])
        codes, gh = (np.concatenate(x, axis=-1) for x in list(zip(*parts))[1:])
        depth = self.p["maxDepth"] - int(np.log2(root + 1))
        tree = Tree(self.p["maxDepth"])
        grow(tree, root, self.packing, codes, wide(codes), gh, np.arange(len(gh)), depth, self.columns, self.p, alone=True)
        at = np.flatnonzero((tree.feature >= 0) | (tree.value != 0))
        return at, tree.feature[at], tree.edge[at], tree.value[at], tree.gain[at]


def counts_of(values: np.ndarray, limit: int) -> tuple | None:
    """Distinct values and how often each stands; None beyond ``limit`` values."""
    found = np.unique(values, return_counts=True)
    return found if len(found[0]) <= limit else None


def added_counts(a: tuple | None, b: tuple | None, limit: int) -> tuple | None:
    if a is None or b is None:
        return None
    values, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    if len(values) > limit:
        return None
    n = np.zeros(len(values), dtype=np.int64)
    np.add.at(n, place, np.concatenate([a[1], b[1]]))
    return values, n


def sure_edges(values: np.ndarray, n: np.ndarray, probs: np.ndarray) -> np.ndarray | None:
    """The quantiles that a summary of relative error 1 / ACCURACY gives, from counts; None where its error (three times
    the bound, for merges) lets it choose a value that isn't among them anyhow."""
    under = n.cumsum()
    rank, slack = np.ceil(probs * under[-1]), 3 * int(under[-1]) // ACCURACY
    low = np.searchsorted(under, np.maximum(rank - slack, 1))
    high = np.searchsorted(under, np.minimum(rank + slack, under[-1]))
    sure = np.unique(low[low == high])
    for a, b in zip(low, high):
        if a < b and not np.isin(np.arange(a, b + 1), sure).all():
            return None
    return values[sure]


def _counted(values: DataFrame, n_features: int, limit: int) -> list:
    """``counts_of`` every feature: each task counts its rows, the tasks' counts are added in a tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_features)
                total = [counts_of(x[:, j], limit) if total is None else
                         total[j] and added_counts(total[j], counts_of(x[:, j], limit), limit) for j in range(n_features)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"counts": pa.array([pickle.dumps(total, protocol=5)], pa.binary())})
    return (values.mapInArrow(run, "counts binary").rdd.map(lambda r: pickle.loads(r[0]))
            .treeReduce(lambda a, b: [added_counts(i, j, limit) for i, j in zip(a, b)]))


def bin_edges(data: DataFrame, features: str, n_features: int, max_bins: int) -> list[np.ndarray]:
    """At most ``max_bins`` - 1 edges a feature: quantiles from a mergeable summary; a value belongs to the bin of the
    first edge that is not below it. Where the counts of a feature's values leave the summary no choice
    (``sure_edges``), they give the same edges and no summary is built."""
    values = data.select(vector_to_array(F.col(features)).alias("x"))
    probs = [i / max_bins for i in range(1, max_bins)]
    found = {}
    for i, counts in enumerate(_counted(values, n_features, COUNTED)):
        sure = None if counts is None else sure_edges(*counts, np.array(probs))
        if sure is not None:
            found[i] = sure
    many = [i for i in range(n_features) if i not in found]
    for lo in range(0, len(many), 100):          # columns of one aggregate
        part = many[lo:lo + 100]
        row = values.agg(*[F.percentile_approx(F.col("x")[i], probs, ACCURACY).alias(f"q{i}") for i in part]).first()
        found |= dict(zip(part, row))
    return [np.unique(np.array([v for v in (found[i] if found[i] is not None else []) if v == v], dtype=np.float64))
            for i in range(n_features)]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


def _blocks(data: DataFrame, p: dict, weight: str | None, edges: list[np.ndarray], packing: Packing, prior: float):
    """An RDD of blocks; rows are binned on Arrow batches, blocks are numbered by partition and place."""
    cols = [vector_to_array(F.col(p["featuresCol"])).alias("x"), F.col(p["labelCol"]).cast("double").alias("y"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            rows = [np.concatenate(x, axis=-1) for x in zip(*held)]
            return pa.RecordBatch.from_pydict({"rows": pa.array([pickle.dumps(rows, protocol=5)], pa.binary())})
        held, n = [], 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            now = (packing.codes(to_bins(x, edges)),
                   *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)))
            while n + now[0].shape[1] >= BLOCK_ROWS:
                cut = BLOCK_ROWS - n
                yield out([*held, tuple(a[..., :cut] for a in now)])
                held, n, now = [], 0, tuple(a[..., cut:] for a in now)
            if now[0].shape[1]:
                held, n = [*held, now], n + now[0].shape[1]
        if held:
            yield out(held)

    def numbered(index: int, rows: Iterator) -> Iterator[Block]:
        for number, r in enumerate(rows):
            codes, y, w = pickle.loads(r[0])
            yield Block((index, number), codes, y, w, np.full(len(y), prior))
    return data.select(*cols).mapInArrow(binned, "rows binary").rdd.mapPartitionsWithIndex(numbered)


def train(data: DataFrame, p: dict, weight: str | None) -> tuple[list[np.ndarray], float, list[Tree], int]:
    """(edges, prior score, trees, features) of a boosted fit."""
    if not 0 < p["maxDepth"] <= MAX_DEPTH or not 2 <= p["maxBins"] <= 255:
        raise ValueError(f"maxDepth is 1 to {MAX_DEPTH}, maxBins 2 to 255")
    w, y = (F.col(weight) if weight else F.lit(1.0)), F.col(p["labelCol"]).cast("double")
    first = data.select(p["featuresCol"]).first()
    if first is None:
        raise ValueError("no rows to fit")
    n_features = len(first[0])
    n, mean = data.agg(F.count(F.lit(1)), F.sum(w * y) / F.sum(w)).first()
    if p["objective"] == "logistic":
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        prior = float(np.log(mean / (1 - mean)))
    else:
        prior = float(mean)
    edges = bin_edges(data, p["featuresCol"], n_features, p["maxBins"])
    packing = Packing(edges)
    rows = _blocks(data, p, weight, edges, packing, prior)
    if n <= p["nodeRows"]:
        def whole(blocks: Iterator[Block]) -> Iterator[list[Tree]]:
            yield grown_in_task(sorted(blocks, key=lambda b: b.number), p, packing, n_features)[0]
        # the binned rows first, by all tasks; then one task grows the trees
        rows = rows.persist()
        try:
            rows.count()
            return edges, prior, rows.coalesce(1).mapPartitions(whole).first(), n_features
        finally:
            rows.unpersist()
    return edges, prior, _train_distributed(rows, p, packing, n_features), n_features


def _sums(parts, partitions: int) -> np.ndarray:
    """The partitions' histograms, added on the driver while they are few, else in a tree."""
    return parts.reduce(np.add) if partitions <= DRIVER_SUMS else parts.treeReduce(np.add)


def _train_distributed(rows, p: dict, packing: Packing, n_features: int) -> list[Tree]:
    """Trees whose every level is one job over the blocks."""
    sc = rows.context
    ensure_checkpoint_dir(SparkSession.active())
    fit = uuid.uuid4().hex
    # as many blocks for each core: a level takes as long as its largest partition
    rows = rows.map(slim).keyBy(lambda b: b.number).repartitionAndSortWithinPartitions(sc.defaultParallelism, sum).values().persist()
    rows.checkpoint()
    rows.count()
    partitions = rows.getNumPartitions()
    rng = np.random.default_rng(p["seed"])
    trees, shipped, fresh = [], [], []
    counted = p["maxDepth"] > HISTOGRAM_LEVELS
    try:
        for number in range(p["maxIter"]):
            k = max(1, int(round(p["columnRate"] * n_features)))
            columns = np.sort(rng.choice(n_features, k, replace=False))
            tree = Tree(p["maxDepth"])
            job = _Job(fit, p, packing, shipped, fresh, number, tree, columns, counted)
            allowed = Candidates(packing, columns)
            build, derive, small, above = [0], [], [], {}
            for level in range(p["maxDepth"]):
                if not build:
                    break
                got = _sums(rows.mapPartitions(job.histograms(build)), partitions)
                hist = {node: got[:, i] for i, node in enumerate(build)}
                hist |= {node: above[(node - 1) // 2] - hist[other] for node, other in derive}
                nodes = sorted(hist)
                stacked = np.stack([hist[i] for i in nodes], axis=1)
                if level == 0:
                    g, h = stacked[:2, 0, packing.code[columns[0]]].sum(axis=1)
                    tree.value[0] = leaf_value(g, h, p)
                gain, feature, edge, sides = allowed.best(stacked[:2], p)
                build, derive, above = [], [], hist
                for i in np.flatnonzero(gain > max(p["minSplitGain"], EPSILON)):
                    node = nodes[i]
                    tree.feature[node], tree.edge[node], tree.gain[node] = feature[i], edge[i], gain[i]
                    left, right = 2 * node + 1, 2 * node + 2
                    tree.value[left] = leaf_value(sides["gl"][i], sides["hl"][i], p)
                    tree.value[right] = leaf_value(sides["gr"][i], sides["hr"][i], p)
                    if level + 1 == p["maxDepth"]:
                        continue
                    size = {left: sides["hl"][i], right: sides["hr"][i]}      # the hessians do where rows aren't counted
                    if counted:
                        code, goes = packing.code[feature[i]], packing.right(feature[i:i + 1], edge[i:i + 1])[0]
                        n = stacked[2, i, code]
                        size = {left: n[~goes].sum(), right: n[goes].sum()}
                    done = [c for c in size if level + 1 >= HISTOGRAM_LEVELS and size[c] <= p["nodeRows"]]
                    small += done
                    order = sorted((c for c in size if c not in done), key=lambda c: size[c])
                    build += order[:1]
                    derive += [(order[1], order[0])] if len(order) == 2 else []
            if small:
                tasks = min(len(small), sc.defaultParallelism)
                found = rows.mapPartitions(job.small_rows(small)).groupByKey(tasks).map(job.subtree).collect()
                for at, f, e, v, gain in found:
                    tree.feature[at], tree.edge[at], tree.value[at], tree.gain[at] = f, e, v, gain
            trees.append(tree)
            fresh = fresh + [tree]
            if len(fresh) == SHIPPED:
                shipped, fresh = shipped + [sc.broadcast(fresh)], []
            if (number + 1) % REFRESH == 0 and number + 1 < p["maxIter"]:
                done, sent, late = len(trees), list(shipped), list(fresh)

                def scored(block: Block, done=done, sent=sent, late=late) -> Block:
                    score, _ = block.reached(fit, [t for b in sent for t in b.value] + late, lambda t: Walk(packing, t))
                    return Block(block.number, block.codes, block.y, block.w, score, done)
                newer = rows.map(scored).persist()
                newer.checkpoint()
                newer.count()
                rows.unpersist()
                rows = newer
    finally:
        rows.unpersist()
        for b in shipped:
            b.unpersist()
    return trees


# ---------------------------------------------------------------------------
# many fits side by side
# ---------------------------------------------------------------------------

def grown_in_task(blocks: list[Block], p: dict, packing: Packing, n_features: int) -> tuple[list[Tree], np.ndarray]:
    """(trees, scores of the rows) of a fit whose rows are all here."""
    codes, y, w, score = (np.concatenate([getattr(b, a) for b in blocks], axis=-1) for a in ("codes", "y", "w", "score"))
    bundles, codes = packing.bundled(codes)
    words = wide(codes)
    first = np.cumsum([0] + [len(b.y) for b in blocks])
    gh, every = np.empty(len(y), dtype=np.complex128), np.arange(len(y))
    room = np.empty_like(every), np.empty_like(every)      # memory that all trees share
    rng = np.random.default_rng(p["seed"])
    k = max(1, int(round(p["columnRate"] * n_features)))
    trees = []
    for number in range(p["maxIter"]):
        columns = np.sort(rng.choice(n_features, k, replace=False))
        for lo, hi in zip(first, first[1:]):
            gh.real[lo:hi], gh.imag[lo:hi] = gradients(p["objective"], score[lo:hi], y[lo:hi], w[lo:hi])
        use, rest = every, every[:0]
        if p["subsamplingRate"] < 1:
            drawn = np.concatenate([b.sampled(p["seed"], number, p["subsamplingRate"]) for b in blocks])
            use, rest = np.flatnonzero(drawn), np.flatnonzero(~drawn)
        # where most rows are drawn, the root's sums are a pass over all, the others being 0
        alone = len(rest) < len(use)
        if alone:
            gh[rest] = 0.0
        tree = Tree(p["maxDepth"])
        grow(tree, 0, bundles, codes, words, gh, use, p["maxDepth"], columns, p, score, alone, room)
        if len(rest):
            score[rest] += tree.value[bundles.route(tree, codes.take(rest, axis=1))]
        trees.append(tree)
    return trees, score


def area_under_roc(score: np.ndarray, label: np.ndarray) -> float:
    """Share of (positive, negative) pairs in order, ties a half."""
    _, place, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - n + (n + 1) / 2)[place]
    pos = label == 1
    if not pos.any() or pos.all():
        return 0.5
    return float((rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()))


def held_out_value(blocks: list[Block], held: list[Block], p: dict, packing: Packing, n_features: int) -> float:
    """ROC AUC (logistic) or RMSE (squared) on the held-out rows of a fit that is grown in this task."""
    trees, _ = grown_in_task(blocks, p, packing, n_features)
    codes, y, score = (np.concatenate([getattr(b, a) for b in held], axis=-1) for a in ("codes", "y", "score"))
    for t in trees:
        score = score + t.value[packing.route(t, codes)]
    if p["objective"] == "logistic":
        return area_under_roc(1.0 / (1.0 + np.exp(-score)), y)
    return float(np.sqrt(np.mean((score - y) ** 2)))


class Fold:
    """Fitting and held-out rows of a fold, binned once for all draws that share the number of bins."""

    def __init__(self, fit: DataFrame, held: DataFrame, p: dict, weight: str | None):
        w, y = (F.col(weight) if weight else F.lit(1.0)), F.col(p["labelCol"]).cast("double")
        mean = fit.agg(F.sum(w * y) / F.sum(w)).first()[0]
        if p["objective"] == "logistic":
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            mean = float(np.log(mean / (1 - mean)))
        self.n_features = len(fit.select(p["featuresCol"]).first()[0])
        edges = bin_edges(fit, p["featuresCol"], self.n_features, p["maxBins"])
        self.packing = Packing(edges)
        one = lambda d, tag: _blocks(d, p, weight, edges, self.packing, mean).map(lambda b: (tag, b))
        # binned by all tasks, then one partition that every draw reads
        parts = fit.sparkSession.sparkContext.union([one(fit, 0), one(held, 1)]).persist()
        parts.count()
        self.rows = parts.coalesce(1).persist()
        self.rows.count()
        parts.unpersist()

    def values(self, draws: dict[int, dict], number: int):
        """An RDD of (draw, fold, value): one task for each draw."""
        n, packing = self.n_features, self.packing

        def run(p: dict, draw: int):
            def one(tagged: Iterator) -> Iterator[tuple]:
                tagged = sorted(tagged, key=lambda x: (x[0], x[1].number))
                yield draw, number, held_out_value([b for t, b in tagged if t == 0], [b for t, b in tagged if t == 1], p,
                                                    packing, n)
            return one
        return [self.rows.mapPartitions(run(p, d)) for d, p in draws.items()]

    def unpersist(self) -> None:
        self.rows.unpersist()


# ---------------------------------------------------------------------------
# Spark ML stages
# ---------------------------------------------------------------------------

class BoostedTrees(Estimator, _BoostedParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees with row weights; ``objective`` logistic (a 0/1 label) or squared."""

    @keyword_only
    def __init__(self, featuresCol=None, labelCol=None, weightCol=None, objective=None, maxIter=None, maxDepth=None,
                 stepSize=None, subsamplingRate=None, columnRate=None, minSplitGain=None, minChildWeight=None,
                 l1=None, l2=None, maxBins=None, seed=None, nodeRows=None):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        p = self._values()
        weight = self.getOrDefault("weightCol") if self.isDefined("weightCol") else None
        edges, prior, trees, n = train(dataset, p, weight)
        return BoostedTreesModel(featuresCol=p["featuresCol"], objective=p["objective"], numFeatures=n,
                                 ensemble=_encode(edges, prior, trees))


def _encode(edges: list[np.ndarray], prior: float, trees: list[Tree]) -> str:
    out = io.BytesIO()
    stack = lambda name: np.stack([getattr(t, name) for t in trees]) if trees else np.zeros((0, 1))
    np.savez_compressed(out, prior=prior, edges=np.concatenate([*edges, np.zeros(0)]),
                        sizes=np.array([len(e) for e in edges]),
                        **{a: stack(a) for a in ("feature", "edge", "value", "gain")})
    return base64.b64encode(out.getvalue()).decode()


class Ensemble:
    """The fitted trees, ready to score rows of raw feature values."""

    def __init__(self, text: str):
        z = np.load(io.BytesIO(base64.b64decode(text)))
        self.prior = float(z["prior"])
        self.edges = np.split(z["edges"], np.cumsum(z["sizes"])[:-1]) if len(z["sizes"]) else []
        self.feature, self.edge, self.value, self.gain = (z[a] for a in ("feature", "edge", "value", "gain"))
        self.steps = [Steps(f, e) for f, e in zip(self.feature, self.edge)]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for lo in range(0, len(x), SCORED):
            bins = np.ascontiguousarray(to_bins(x[lo:lo + SCORED], self.edges).T)
            room, part = Steps.room(bins.shape[1]), out[lo:lo + SCORED]
            for steps, value in zip(self.steps, self.value):
                part += value.take(steps.ends(bins, *room), mode="clip")
        return out


_ENSEMBLES: OrderedDict = OrderedDict()


def _ensemble(text: str) -> Ensemble:
    """Decoded once a worker."""
    if text not in _ENSEMBLES:
        _ENSEMBLES[text] = Ensemble(text)
        while len(_ENSEMBLES) > 4:
            _ENSEMBLES.popitem(last=False)
    return _ENSEMBLES[text]


class BoostedTreesModel(Model, _BoostedParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (a vector, as Spark's classifiers do) or ``prediction``; scoring runs on Arrow batches."""

    ensemble = _param("ensemble", "edges and trees (npz, base64)", TypeConverters.toString)
    numFeatures = _param("numFeatures", "features of a row", TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol=None, objective=None, numFeatures=None, ensemble=None):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.getOrDefault("ensemble"))

        def score(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype="float64")
            return pd.Series(_ensemble(shared.value).score(np.stack(rows.to_numpy())))
        raw = F.pandas_udf(score, "double")(vector_to_array(F.col(self.getOrDefault("featuresCol"))))
        if self.getOrDefault("objective") == "logistic":
            prob = 1.0 / (1.0 + F.exp(-F.col("_raw")))
            return (dataset.withColumn("_raw", raw).withColumn("_prob", prob)
                    .withColumn("probability", array_to_vector(F.array(1.0 - F.col("_prob"), F.col("_prob"))))
                    .drop("_raw", "_prob"))
        return dataset.withColumn("prediction", raw)

    @property
    def featureImportances(self):
        """Total gain of every feature's splits, averaged over them, as shares of their sum."""
        from pyspark.ml.linalg import Vectors
        e = _ensemble(self.getOrDefault("ensemble"))
        n = self.getOrDefault("numFeatures")
        used = e.feature >= 0
        count = np.bincount(e.feature[used], minlength=n)
        gain = np.bincount(e.feature[used], weights=e.gain[used], minlength=n) / np.maximum(count, 1)
        return Vectors.dense(gain / max(gain.sum(), 1e-300))

    @property
    def getNumTrees(self) -> int:
        return len(_ensemble(self.getOrDefault("ensemble")).feature)

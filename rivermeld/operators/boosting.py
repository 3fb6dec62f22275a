"""Gradient boosting for any number of classes: per round one regression tree per class on softmax gradients.

Trees grow level by level from histograms of gradient and hessian sums over binned features; a leaf's value is the Newton
step of its sums. One pass over the rows serves a level of the trees of all classes and all folds at once, so
cross-validation reads the rows no more often than a single fit. A pass returns sums of the size of the model (folds x
classes x nodes x features x bins), added up in a tree of tasks; rows never leave their partition.

The passes are hundreds of short jobs of plain array work per partition with a state (the margins) that changes every
round. That is the one place here where an RDD of array blocks is used instead of a DataFrame. Blocks come from a written table, and
margins are checkpointed every few rounds, so a lost executor costs its own blocks and a few rounds.

Rows outside every fold, without label or of a class that a fold's training rows lack are no problem: the class has no
tree there and the probability zero. A fold whose training rows have one class predicts it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.session import spread, written
from rivermeld.settings import TREES

ROWS_PER_TASK = 25_000
#: Values that a task keeps of a feature to find bins.
SUMMARY = 2048
#: Up to so many bytes of binned rows a fold is fitted by one task; beyond, rows stay dealt out and every level is a pass.
ROWS_HELD_BYTES = 16 << 20
#: Rows summed at once, so that the cells of a pass stay in the cache.
CHUNK = 1 << 17
ROUNDS_PER_CHECKPOINT = 10
#: Margin of a class that a fold has no rows of.
ABSENT = -1e3


@dataclass(frozen=True)
class Boosting:
    """Published settings; `ridge` and `min_hessian` are the usual regularisation of Newton boosting."""

    maxIter: int = TREES
    maxDepth: int = 6
    stepSize: float = 0.1
    maxBins: int = 32
    ridge: float = 1.0
    min_hessian: float = 1.0


# ---- rows as blocks of arrays --------------------------------------------------------------------
def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper bounds of all bins but the last: every value of a feature that has few, else values at even quantiles.

    A task returns per feature its distinct values with their counts, or `SUMMARY` values at even steps of its rows.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0), np.zeros(0))] * len(features)
        for batch in batches:
            for i in range(len(features)):
                found[i] = _thinned(*_joined([found[i], (batch.column(i).to_numpy(zero_copy_only=False), None)]))
        for i, (values, counts) in enumerate(found):
            yield pa.RecordBatch.from_pydict({"feature": pa.array([i], pa.int32()), "found": [values], "counts": [counts]})

    parts: list[list] = [[] for _ in features]
    numbers = rows.select(*[F.col(f"`{f}`").cast("double") for f in features])
    # Per task and feature at most `SUMMARY` values.
    for r in numbers.mapInArrow(summary, "feature int, found array<double>, counts array<double>").collect():
        parts[r["feature"]].append((np.array(r["found"], dtype=float), np.array(r["counts"], dtype=float)))
    edges = []
    for found in parts:
        values, counts = _joined(found)
        if not len(values):
            values, counts = np.zeros(1), np.ones(1)
        if len(values) >= bins:
            ranks = counts.cumsum()
            values = values[np.unique(np.searchsorted(ranks, ranks[-1] * np.arange(1, bins) / bins))]
        edges.append(values)
    return edges


def _joined(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their counts; values that are no number are left out."""
    values = np.concatenate([v for v, _ in parts]) if parts else np.zeros(0)
    counts = np.concatenate([np.ones(len(v)) if n is None else n for v, n in parts]) if parts else np.zeros(0)
    known = ~np.isnan(values)
    distinct, place = np.unique(values[known], return_inverse=True)
    return distinct, np.bincount(place, weights=counts[known], minlength=len(distinct)).astype(float)


def _thinned(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most `SUMMARY` of the values, at even steps of their counts; each stands for the rows up to it."""
    if len(values) <= SUMMARY:
        return values, counts
    ranks = counts.cumsum()
    at = np.unique(np.searchsorted(ranks, ranks[-1] * np.arange(1, SUMMARY + 1) / SUMMARY).clip(max=len(values) - 1))
    return values[at], np.diff(ranks[at], prepend=0.0)


def binned_rows(rows: DataFrame, features: list[str], edges: list[np.ndarray]) -> DataFrame:
    """One row per batch of rows: its number, n and the bytes of their bins, labels and folds."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            x = np.empty((batch.num_rows, len(features)), dtype=np.uint8)
            for i, cut in enumerate(edges):
                x[:, i] = np.searchsorted(cut, batch.column(i).to_numpy(zero_copy_only=False), side="left")
            y, fold = (batch.column(len(features) + k).to_numpy(zero_copy_only=False).astype(np.int32) for k in (0, 1))
            yield pa.RecordBatch.from_pydict({"block": pa.array([first + number], pa.int64()), "n": pa.array([batch.num_rows], pa.int32()),
                                              "x": [x.tobytes()], "y": [y.tobytes()], "fold": [fold.tobytes()]})

    narrow = rows.select(*[F.col(f"`{f}`").cast("double") for f in features], F.col("label").cast("int").alias("label_"), F.col("fold_").cast("int"))
    return written(spread(narrow, ROWS_PER_TASK).mapInArrow(binned, "block bigint, n int, x binary, y binary, fold binary"), "binned")


def training_counts(rows: DataFrame, left_out: list[int], classes: int, balance: bool) -> tuple[np.ndarray, np.ndarray]:
    """Training rows per fold left out and class, and class weights: n / (k * n_c) over the k classes a training slice has, or one."""
    # One row per fold and class.
    counts = {(r["fold_"], int(r["label"])): r["n"] for r in rows.groupBy("fold_", "label").agg(F.count("*").alias("n")).collect()}
    sizes, weights = np.zeros((len(left_out), classes)), np.zeros((len(left_out), classes))
    for m, out in enumerate(left_out):
        sizes[m] = [sum(n for (f, label), n in counts.items() if label == k and f != out) for k in range(classes)]
        has = sizes[m] > 0
        weights[m, has] = sizes[m].sum() / (has.sum() * sizes[m, has]) if balance else 1.0
    return sizes, weights


# ---- trees ---------------------------------------------------------------------------------------
# A tree is three arrays over heap places (children of i at 2i + 1 and 2i + 2): feature (-1: leaf), bin and value.
def _places(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Heap place of every row after at most `depth` steps down one tree."""
    at = np.zeros(len(x), dtype=np.int64)
    every = np.arange(len(x))
    for _ in range(depth):
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            break
        step = 2 * at + 1 + (x[every, np.maximum(f, 0)] > cut[at])
        at = np.where(inner, step, at)
    return at


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _histograms(block, trees, depth: int, weights: np.ndarray, folds: list[int], bins: int) -> np.ndarray:
    """Sums of gradient and hessian: [model, class, node of this level, feature, bin, 2]."""
    x, y, fold, margins = block
    n_features, (models, classes) = x.shape[1], weights.shape
    nodes, first = 1 << depth, (1 << depth) - 1
    out = np.zeros((models, classes, nodes * n_features * bins, 2))
    columns = np.arange(n_features) * bins + x
    for m in range(models):
        use = np.flatnonzero(fold != folds[m])
        if not len(use):
            continue
        p = _softmax(margins[use, m])
        w = weights[m][y[use]]
        for k in range(classes):
            if weights[m, k] == 0:
                continue
            at = _places(x[use], trees[0][m, k], trees[1][m, k], depth) - first
            alive = at >= 0
            g = (w * (p[:, k] - (y[use] == k)))[alive]
            h = (w * 2 * p[:, k] * (1 - p[:, k]))[alive]
            cells = (at[alive, None] * (n_features * bins) + columns[use][alive]).ravel()
            for j, v in enumerate((g, h)):
                out[m, k, :, j] += np.bincount(cells, weights=np.repeat(v, n_features), minlength=out.shape[2])
    return out.reshape(models, classes, nodes, n_features, bins, 2)


def _grow(sums: np.ndarray, trees, totals: np.ndarray, gains: np.ndarray, depth: int, s: Boosting) -> None:
    """Split the nodes of one level where that gains, and set the values and sums of their children."""
    feature, cut, value, cover = trees
    first = (1 << depth) - 1
    left = np.cumsum(sums, axis=4)[..., :-1, :]
    whole = sums.sum(axis=4)[:, :, :, :1, None, :]
    right = whole - left

    def quality(part):
        return part[..., 0] ** 2 / (part[..., 1] + s.ridge)

    gain = quality(left) + quality(right) - quality(whole)
    gain[(left[..., 1] < s.min_hessian) | (right[..., 1] < s.min_hessian)] = 0.0
    models, classes, nodes = gain.shape[:3]
    flat = gain.reshape(models, classes, nodes, -1)
    best = flat.argmax(axis=3)
    for m in range(models):
        for k in range(classes):
            if depth == 0:
                g, h = totals[m, k] = whole[m, k, 0, 0, 0]
                cover[m, k, 0] = h
                value[m, k, 0] = -g / (h + s.ridge) * s.stepSize
            for node in range(nodes):
                top = flat[m, k, node, best[m, k, node]]
                if top <= 1e-9:
                    continue
                f, b = divmod(int(best[m, k, node]), gain.shape[4])
                at = first + node
                feature[m, k, at], cut[m, k, at] = f, b
                gains[m, f] += top
                for child, part in ((2 * at + 1, left), (2 * at + 2, right)):
                    g, h = part[m, k, node, f, b]
                    cover[m, k, child] = h
                    value[m, k, child] = -g / (h + s.ridge) * s.stepSize


def _boost(blocks: DataFrame, n_features: int, folds: list[int], weights: np.ndarray, start: np.ndarray, s: Boosting):
    """(rounds of trees, gain per model and feature) for all models at once."""
    context = blocks.sparkSession.sparkContext
    models, classes = weights.shape
    size = (2 << s.maxDepth) - 1

    def opened(r):
        x = np.frombuffer(bytes(r.x), dtype=np.uint8).reshape(r.n, -1)
        y, fold = (np.frombuffer(bytes(v), dtype=np.int32) for v in (r.y, r.fold))
        return x, y, fold, np.broadcast_to(start, (r.n, models, classes)).copy()

    state = blocks.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    older = None
    rounds, gains = [], np.zeros((models, n_features))
    empty = (models, classes, 1, n_features, s.maxBins, 2)
    try:
        for number in range(s.maxIter):
            trees = (np.full((models, classes, size), -1, dtype=np.int16), np.zeros((models, classes, size), dtype=np.uint8),
                     np.zeros((models, classes, size)), np.zeros((models, classes, size)))
            totals = np.zeros((models, classes, 2))
            for depth in range(s.maxDepth):
                shared = context.broadcast(trees[:2])

                def summed(part, depth=depth, shared=shared):
                    total = None
                    for block in part:
                        h = _histograms(block, shared.value, depth, weights, folds, s.maxBins)
                        total = h if total is None else np.add(total, h, out=total)
                    if total is not None:
                        yield total

                passes = state.mapPartitions(summed)
                sums = passes.treeReduce(np.add) if passes.getNumPartitions() > 1 else passes.collect()
                sums = (sums[0] if sums else np.zeros(empty)) if isinstance(sums, list) else sums
                shared.unpersist()
                if older is not None:  # its successor has been computed by this pass
                    older.unpersist()
                    older = None
                _grow(sums, trees, totals, gains, depth, s)
                if not (trees[0][:, :, (1 << depth) - 1:] >= 0).any():
                    break
            rounds.append(trees)
            if not (trees[2] != 0).any():
                break

            def moved(block, trees=trees[:3]):
                x, y, fold, margins = block
                for m in range(models):
                    for k in range(classes):
                        margins[:, m, k] += trees[2][m, k][_places(x, trees[0][m, k], trees[1][m, k], s.maxDepth)]
                return x, y, fold, margins

            older, state = state, state.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % ROUNDS_PER_CHECKPOINT == 0:
                state.checkpoint()
    finally:
        for held in (state, older):
            if held is not None:
                held.unpersist()
    return rounds, gains


def _boost_together(blocks: DataFrame, held: dict[int, int], folds: list[int], weights: np.ndarray, start: np.ndarray,
                    edges: list[np.ndarray], s: Boosting) -> list[tuple[str, np.ndarray]]:
    """(trees as JSON, gain per feature) of every fold, from passes over rows that stay dealt out."""
    rounds, gains = _boost(blocks, len(edges), folds, weights, start, s)
    classes = range(weights.shape[1])
    return [(json.dumps([[_listed(one, m, k, edges) for k in classes] for one in rounds]), gains[m]) for m in range(len(folds))]


# ---- few rows: one task per fold -----------------------------------------------------------------
class _Pairs:
    """Rows of one training slice, ready for sums per node and bin: two features at a time share one pass."""

    def __init__(self, x: np.ndarray, bins: int):
        self.x, self.bins, self.n_features = x, bins, x.shape[1]
        even = np.concatenate([x, np.zeros((len(x), x.shape[1] % 2), dtype=np.uint8)], axis=1)
        self.pairs = [even[:, j].astype(np.uint16) * bins + even[:, j + 1] for j in range(0, even.shape[1], 2)]

    def sums(self, rows: np.ndarray, node: np.ndarray, nodes: int, values: list[np.ndarray]) -> np.ndarray:
        """Sums of the values over the rows: [node, feature, bin, value]."""
        b = self.bins
        out = np.zeros((nodes, 2 * len(self.pairs), b, len(values)))
        for start in range(0, len(rows), CHUNK):
            some = rows[start:start + CHUNK]
            first = node[start:start + CHUNK].astype(np.int64) * (b * b)
            picked = [v.take(some) for v in values]
            for j, pair in enumerate(self.pairs):
                cells = first + pair.take(some)
                for i, v in enumerate(picked):
                    table = np.bincount(cells, weights=v, minlength=nodes * b * b).reshape(nodes, b, b)
                    out[:, 2 * j, :, i] += table.sum(axis=2)
                    out[:, 2 * j + 1, :, i] += table.sum(axis=1)
        return out[:, :self.n_features]


def _one_tree(data: _Pairs, g: np.ndarray, h: np.ndarray, s: Boosting, gains: np.ndarray) -> tuple[tuple, np.ndarray]:
    """One regression tree and the heap place at which every row ends; of two siblings the one with fewer rows is summed."""
    size, n = (2 << s.maxDepth) - 1, len(g)
    trees = (np.full((1, 1, size), -1, dtype=np.int16), np.zeros((1, 1, size), dtype=np.uint8), np.zeros((1, 1, size)), np.zeros((1, 1, size)))
    feature, cut = trees[0][0, 0], trees[1][0, 0]
    flat, width = data.x.reshape(-1), data.n_features
    ends, rows, node = np.zeros(n, dtype=np.int64), np.arange(n), np.zeros(n, dtype=np.int64)
    totals, sums = np.zeros((1, 1, 2)), None
    for depth in range(s.maxDepth):
        if sums is None:
            sums = data.sums(rows, node, 1, [g, h])
        else:
            sizes = np.bincount(node, minlength=1 << depth).reshape(-1, 2)
            less = sizes.argmin(axis=1)  # the sibling to sum, per parent
            summed = (node & 1) == less[node >> 1]
            less_sums = data.sums(rows[summed], node[summed] >> 1, len(less), [g, h])
            rest = np.where((sizes.sum(axis=1) > 0)[:, None, None, None], sums - less_sums, 0.0)
            sums = np.empty((1 << depth, *sums.shape[1:]))
            every = np.arange(len(less))
            sums[2 * every + less], sums[2 * every + 1 - less] = less_sums, rest
        _grow(sums[None, None], trees, totals, gains[None], depth, s)
        at = node + (1 << depth) - 1
        f = feature.take(at).astype(np.int64)
        inner = f >= 0
        if not inner.all():
            rows, node, f, at = rows[inner], node[inner], f[inner], at[inner]
        if not len(rows):
            break
        right = flat.take(rows * width + f) > cut.take(at)
        node = 2 * node + right
        ends[rows] = node + (2 << depth) - 1
    return trees, ends


def _boosted(x: np.ndarray, y: np.ndarray, weights: np.ndarray, start: np.ndarray, edges: list[np.ndarray], s: Boosting) -> tuple[str, np.ndarray]:
    """All rounds of one training slice whose rows are all here."""
    data, classes = _Pairs(x, s.maxBins), len(weights)
    margins, gains, listed = np.tile(start, (len(x), 1)), np.zeros(x.shape[1]), []
    w = weights[y]
    for _ in range(s.maxIter):
        p = _softmax(margins)
        one, moved = [], False
        for k in range(classes):
            if weights[k] == 0:
                size = (2 << s.maxDepth) - 1
                trees = tuple(np.full((1, 1, size), v) for v in (-1, 0, 0.0, 0.0))
            else:
                trees, ends = _one_tree(data, w * (p[:, k] - (y == k)), w * 2 * p[:, k] * (1 - p[:, k]), s, gains)
                margins[:, k] += trees[2][0, 0].take(ends)
                moved |= bool((trees[2] != 0).any())
            one.append(_listed(trees, 0, 0, edges))
        listed.append(one)
        if not moved:
            break
    return json.dumps(listed), gains


def _boost_in_tasks(blocks: DataFrame, held: dict[int, int], folds: list[int], weights: np.ndarray, start: np.ndarray,
                    edges: list[np.ndarray], s: Boosting) -> list[tuple[str, np.ndarray]]:
    """As `_boost_together`, where all rows fit into one task: each fold's rounds follow each other in one task."""

    def boosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, mine = {}, set()
        for batch in batches:
            for block, x, y, fold, m in zip(*(batch.column(k) for k in ("block", "x", "y", "fold", "model"))):
                mine.add(m.as_py())
                if block.as_py() not in parts:
                    label, f = (np.frombuffer(v.as_py(), dtype=np.int32) for v in (y, fold))
                    parts[block.as_py()] = np.frombuffer(x.as_py(), dtype=np.uint8).reshape(len(label), -1), label, f
        if not mine:
            return
        x, y, fold = (np.concatenate(column) for column in zip(*(parts[b] for b in sorted(parts))))
        for m in sorted(mine):
            use = fold != folds[m]
            trees, gains = _boosted(x[use], y[use], weights[m], start[m], edges, s)
            yield pa.RecordBatch.from_pydict({"model": pa.array([m], pa.int32()), "trees": [trees], "gains": [list(gains)]})

    copies = blocks.select("block", "x", "y", "fold", F.explode(F.sequence(F.lit(0), F.lit(len(folds) - 1))).alias("model"))
    fitted = written(copies.repartitionById(len(folds), "model").mapInArrow(boosted, "model int, trees string, gains array<double>"), "boosted")
    # One row per fold.
    found = {r["model"]: (r["trees"], np.array(r["gains"])) for r in fitted.collect()}
    return [found[m] for m in range(len(folds))]


# ---- the fitted model ----------------------------------------------------------------------------
class BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees of one fit. `trees` holds them as JSON: per round and class the nodes from the root down, as
    (place, feature, upper bound of the left side, value, cover); a leaf has the feature -1."""

    trees = Param(Params._dummy(), "trees", "rounds of trees, one per class", typeConverter=TypeConverters.toString)
    start = Param(Params._dummy(), "start", "margin of each class before the first round", typeConverter=TypeConverters.toListFloat)
    gains = Param(Params._dummy(), "gains", "share of each feature in the gain of all splits", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, trees: str = "[]", start: list[float] | None = None, gains: list[float] | None = None):
        super().__init__()
        self._set(trees=trees, start=start or [], gains=gains or [])

    @property
    def featureImportances(self) -> list[float]:
        return self.getOrDefault(self.gains)

    @property
    def numClasses(self) -> int:
        return len(self.getOrDefault(self.start))

    def rounds(self) -> list[list[list[list[float]]]]:
        return json.loads(self.getOrDefault(self.trees))

    def base_margin(self, at: int) -> float:
        return float(self.getOrDefault(self.start)[at])

    def node_table(self, at: int) -> pd.DataFrame:
        """Nodes of the trees of one class in the shape that explanations read."""
        rows = []
        for number, one in enumerate(self.rounds()):
            for place, feature, bound, value, cover in one[at]:
                inner = feature >= 0
                rows.append({"treeID": number, "id": int(place), "leftChild": int(2 * place + 1) if inner else -1,
                             "rightChild": int(2 * place + 2) if inner else -1, "prediction": value, "cover": cover,
                             "split": {"featureIndex": int(feature), "leftCategoriesOrThreshold": [bound]}})
        return pd.DataFrame(rows, columns=["treeID", "id", "leftChild", "rightChild", "prediction", "cover", "split"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        start = np.array(self.getOrDefault(self.start))
        packed = [[_packed(nodes) for nodes in one] for one in self.rounds()]
        shared = dataset.sparkSession.sparkContext.broadcast(packed)  # bounded by rounds x classes x 2^(depth + 1)

        @F.pandas_udf("array<double>")
        def chances(values: pd.Series) -> pd.Series:
            x = np.stack(values.to_numpy()) if len(values) else np.zeros((0, 1))
            margins = np.tile(start, (len(x), 1))
            every = np.arange(len(x))
            for one in shared.value:
                for k, (feature, bound, value, left) in enumerate(one):
                    at = np.zeros(len(x), dtype=np.int64)
                    while (inner := feature[at] >= 0).any():
                        side = x[every, np.maximum(feature[at], 0)] > bound[at]
                        at = np.where(inner, left[at] + side, at)
                    margins[:, k] += value[at]
            return pd.Series(list(_softmax(margins)))

        out = dataset.withColumn("probability", array_to_vector(chances(vector_to_array("features"))))
        array = vector_to_array("probability")
        return out.withColumn("prediction", (F.array_position(array, F.array_max(array)) - 1).cast("double"))


def _packed(nodes):
    """Arrays over the listed nodes: feature, bound, value and the index of the left child (the right one is next)."""
    index = {int(n[0]): i for i, n in enumerate(nodes)}
    table = np.array(nodes, dtype=float).reshape(-1, 5)
    left = np.array([index.get(2 * int(p) + 1, 0) for p in table[:, 0]], dtype=np.int64)
    return table[:, 1].astype(np.int64), table[:, 2], table[:, 3], left


def _listed(trees, m: int, k: int, edges: list[np.ndarray]) -> list[list[float]]:
    """Nodes of one tree in heap order, so that siblings follow each other."""
    feature, cut, value, cover = (t[m, k] for t in trees)
    nodes, level = [], [0]
    while level:
        for at in level:
            f = int(feature[at])
            if f >= 0 and cut[at] >= len(edges[f]):
                raise ValueError("a split needs a value on either side")
            nodes.append([at, f, float(edges[f][cut[at]]) if f >= 0 else 0.0, float(value[at]), float(cover[at])])
        level = [c for at in level if feature[at] >= 0 for c in (2 * at + 1, 2 * at + 2)]
    return nodes


def fit_folds(rows: DataFrame, features: list[str], labels: list[str], folds: list[int] | None = None, balance: bool = True,
              **changes) -> dict[int | None, PipelineModel]:
    """A scoring model per fold, fitted on all rows outside it; without folds one model, on all rows, under the key None.

    `rows` has the features filled, `label` (index in `labels`) and, for folds, `fold`. Balanced weights are n / (k * n_c)
    over the k classes that a training slice has, which for two classes is the ratio of the published positive weight.
    """
    known = {name: v for name, v in changes.items() if name != "seed"}  # nothing here is drawn at random
    s = Boosting(**known)
    left_out = folds if folds is not None else [-1]
    rows = rows.withColumn("fold_", F.col("fold") if folds is not None else F.lit(0))
    edges = bin_edges(rows, features, s.maxBins)
    sizes, weights = training_counts(rows, left_out, len(labels), balance)
    start = np.full(weights.shape, ABSENT)
    for m in range(len(left_out)):
        has, share = sizes[m] > 0, weights[m] * sizes[m]
        start[m, has] = np.log(share[has] / share.sum())
    blocks = binned_rows(rows, features, edges)
    # One row per block of some thousand rows.
    held = {r["block"]: r["n"] for r in blocks.select("block", "n").collect()}
    boost = _boost_in_tasks if sum(held.values()) * len(features) <= ROWS_HELD_BYTES else _boost_together
    found = boost(blocks, held, left_out, weights, start, edges, s)
    made = {}
    for m, out in enumerate(left_out):
        trees, gains = found[m]
        model = BoostedModel(trees=trees, start=[float(v) for v in start[m]], gains=[float(v) for v in gains / (gains.sum() or 1.0)])
        made[out if folds is not None else None] = PipelineModel([
            VectorAssembler(inputCols=features, outputCol="features"), model,
            IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)])
    return made

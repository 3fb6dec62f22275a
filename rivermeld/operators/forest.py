"""Random forests of all folds at once, from binned rows; a fitted model is Spark's own forest model.

A tree grows level by level from counts of its sampled rows by open node, drawn feature, bin and class; gini gain decides. Spark's
trainer sends such counts of every node from every partition to the reducers, which for 200 trees of depth 10 costs the same
seconds however few the rows are. Here binned rows (one byte a value) go to the tasks that own trees, and counts stay where
they are made. Rows beyond `ROWS_HELD_BYTES` of bytes stay dealt out: each task counts its own rows for all trees, and one job per
level adds the counts up.

Samples and drawn features follow from (seed, fold, tree, block or level), so both ways give the same trees.
"""

from __future__ import annotations

import json
import pickle
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.operators.boosting import bin_edges, binned_rows, training_counts
from rivermeld.session import new_folder, written

#: Bytes of binned rows that one task holds when it grows whole trees, and when it counts for all of them.
ROWS_HELD_BYTES = 128 << 20
PART_BYTES = 32 << 20
#: Rows counted at once, so that the cells of a pass stay in the cache.
CHUNK = 1 << 17
#: Sample counts by a 16-bit draw: Poisson with mean one.
_CHANCES = np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320], dtype=float)
SAMPLED = np.searchsorted(np.cumsum(_CHANCES), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    least: int
    bins: int
    seed: int
    drawn: int


HONOURED = {"numTrees", "maxDepth", "minInstancesPerNode", "maxBins", "seed", "featureSubsetStrategy", "maxMemoryInMB"}


def _settings(template: RandomForestClassifier, features: int, changes: dict) -> Settings:
    if unknown := set(changes) - HONOURED:
        raise ValueError(f"settings that forests do not honour: {sorted(unknown)}")
    strategy = template.getFeatureSubsetStrategy()
    drawn = {"sqrt": np.ceil(np.sqrt(features)), "auto": np.ceil(np.sqrt(features)), "all": features,
             "log2": max(np.ceil(np.log2(features)), 1), "onethird": np.ceil(features / 3)}
    if strategy not in drawn or template.getMaxBins() > 256:
        raise ValueError(f"featureSubsetStrategy {strategy} or maxBins {template.getMaxBins()} is not known here")
    return Settings(template.getNumTrees(), template.getMaxDepth(), template.getMinInstancesPerNode(), template.getMaxBins(),
                    template.getSeed(), min(int(drawn[strategy]), features))


# ---- rows of one task ----------------------------------------------------------------------------
class Rows:
    """Cells (bin times classes plus class) of rows in the order of their blocks, and their folds."""

    def __init__(self, sizes: dict[int, int], features: int, classes: int, bins: int):
        self.places, at = {}, 0
        for block in sorted(sizes):
            self.places[block] = slice(at, at + sizes[block])
            at += sizes[block]
        self.features, self.classes, self.cells = features, classes, bins * classes
        self.x = np.empty((at, features), dtype=np.uint8 if self.cells <= 256 else np.uint16)
        self.fold = np.empty(at, dtype=np.int32)
        self.filled: set[int] = set()

    def put(self, block: int, x: bytes, y: bytes, fold: bytes) -> None:
        if block in self.filled:
            return
        at = self.places[block]
        label = np.frombuffer(y, dtype=np.int32)
        self.fold[at] = np.frombuffer(fold, dtype=np.int32)
        self.x[at] = np.frombuffer(x, dtype=np.uint8).reshape(-1, self.features)
        self.x[at] *= self.x.dtype.type(self.classes)
        self.x[at] += label[:, None].astype(self.x.dtype)
        self.filled.add(block)


class Sample:
    """The rows that one tree draws and that still stand in an open node, with that node's number among the open ones."""

    def __init__(self, rows: Rows, seed: int, fold: int, tree: int):
        times = np.empty(len(rows.fold), dtype=np.uint8)
        for block, at in rows.places.items():
            draws = np.random.default_rng((seed % (1 << 63), fold + 1, tree, block)).integers(0, 1 << 16, at.stop - at.start, dtype=np.uint16)
            times[at] = SAMPLED[draws]
        times[rows.fold == fold] = 0
        at = np.flatnonzero(times)
        self.rows, self.flat, self.times = rows, rows.x.reshape(-1), times[at]
        self.base = at * rows.features
        self.node = np.zeros(len(at), dtype=np.int32)

    def counts(self, drawn: np.ndarray) -> np.ndarray:
        """Sampled rows by open node, drawn feature, bin and class."""
        open_nodes, width = drawn.shape
        cells = self.rows.cells
        out = np.zeros((width, open_nodes * cells))
        columns = [np.ascontiguousarray(drawn[:, j], dtype=np.int64) for j in range(width)]
        for start in range(0, len(self.base), CHUNK):
            node = self.node[start:start + CHUNK].astype(np.int64)
            base, times = self.base[start:start + CHUNK], self.times[start:start + CHUNK].astype(float)
            first = node * cells
            for j, column in enumerate(columns):
                at = column.take(node)
                at += base
                at = first + self.flat.take(at)
                out[j] += np.bincount(at, weights=times, minlength=out.shape[1])
        return out.reshape(width, open_nodes, -1, self.rows.classes).transpose(1, 0, 2, 3)

    def move(self, route) -> None:
        """Down one level; rows in nodes that are no longer open go."""
        feature, cut, following = route
        bound = (cut.astype(np.int64) + 1) * self.rows.classes
        node = np.empty_like(self.node)
        feature = feature.astype(np.int64)
        for start in range(0, len(self.base), CHUNK):
            at = self.node[start:start + CHUNK].astype(np.int64)
            right = self.flat.take(self.base[start:start + CHUNK] + feature.take(at)) >= bound.take(at)
            node[start:start + CHUNK] = following.take(2 * at + right)
        stay = node >= 0
        if stay.all():
            self.node = node
        else:
            self.base, self.times, self.node = self.base[stay], self.times[stay], node[stay]


# ---- trees ---------------------------------------------------------------------------------------
def drawn_features(s: Settings, features: int, fold: int, tree: int, depth: int, open_nodes: int) -> np.ndarray:
    rng = np.random.default_rng((s.seed % (1 << 63), fold + 1, tree, depth, 7))
    return np.sort(np.argsort(rng.random((open_nodes, features)), axis=1)[:, :s.drawn], axis=1)


def best_splits(counts: np.ndarray, drawn: np.ndarray, weights: np.ndarray, least: int):
    """Per open node: feature, cut, gain, and the sampled rows by class of the node and of its left side."""
    found = []
    for start in range(0, len(counts), 64):
        part = counts[start:start + 64].astype(float)
        every = np.arange(len(part))
        whole = part[:, 0].sum(axis=1)
        left = part.cumsum(axis=2)[:, :, :-1]
        right = whole[:, None, None] - left

        def purity(n):
            w = n * weights
            total = w.sum(axis=-1)
            return (w * w).sum(axis=-1) / np.where(total > 0, total, 1.0), total

        (p, total), (p_left, _), (p_right, _) = purity(whole), purity(left), purity(right)
        gain = (p_left + p_right - p[:, None, None]) / np.where(total > 0, total, 1.0)[:, None, None]
        gain[(left.sum(axis=-1) < least) | (right.sum(axis=-1) < least)] = 0.0
        flat = gain.reshape(len(part), -1)
        best = flat.argmax(axis=1)
        j, cut = np.divmod(best, gain.shape[2])
        found.append((drawn[start:start + 64][every, j].astype(np.int16), cut.astype(np.uint8), flat[every, best], whole, left[every, j, cut]))
    return tuple(np.concatenate(column) for column in zip(*found))


class Tree:
    """Nodes from the root down, children after their parents; routes lead rows through the levels."""

    def __init__(self, classes: int):
        self.feature, self.cut = np.full(1, -1, dtype=np.int16), np.zeros(1, dtype=np.uint8)
        self.left, self.gain = np.full(1, -1, dtype=np.int32), np.full(1, -1.0)
        self.counts = np.zeros((1, classes))
        self.open, self.routes = np.zeros(1, dtype=np.int64), []

    def split(self, best, s: Settings) -> None:
        feature, cut, gain, whole, left = best
        if not self.routes:
            self.counts[0] = whole[0]
        wins = (gain > 1e-12) & (len(self.routes) < s.depth)
        chosen, n = self.open[wins], len(self.feature)
        children = 2 * int(wins.sum())
        self.feature[chosen], self.cut[chosen], self.gain[chosen] = feature[wins], cut[wins], gain[wins]
        self.left[chosen] = n + np.arange(0, children, 2)
        counts = np.stack([left[wins], whole[wins] - left[wins]], axis=1).reshape(children, self.counts.shape[1])
        self.feature = np.append(self.feature, np.full(children, -1, dtype=np.int16))
        self.cut = np.append(self.cut, np.zeros(children, dtype=np.uint8))
        self.left = np.append(self.left, np.full(children, -1, dtype=np.int32))
        self.gain = np.append(self.gain, np.full(children, -1.0))
        self.counts = np.concatenate([self.counts, counts])
        goes_on = (counts.sum(axis=1) >= 2 * s.least) & ((counts > 0).sum(axis=1) > 1) & (len(self.routes) + 1 < s.depth)
        number = np.full(children, -1, dtype=np.int32)
        number[goes_on] = np.arange(goes_on.sum())
        following = np.full((len(wins), 2), -1, dtype=np.int32)
        following[wins] = number.reshape(-1, 2)
        self.open = n + np.flatnonzero(goes_on)
        self.routes.append((feature, cut, following.reshape(-1)))


def grown(rows: Rows, s: Settings, weights: np.ndarray, fold: int, number: int) -> Tree:
    """One whole tree from rows that are all here."""
    tree, sample = Tree(rows.classes), Sample(rows, s.seed, fold, number)
    while len(tree.open):
        drawn = drawn_features(s, rows.features, fold, number, len(tree.routes), len(tree.open))
        tree.split(best_splits(sample.counts(drawn), drawn, weights, s.least), s)
        if len(tree.open):
            sample.move(tree.routes[-1])
    return tree


TREES = "model int, treeID int, tree binary"
NODES = ("treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
         "leftChild int, rightChild int, feature int, bound double")


def tree_row(model: int, number: int, tree: Tree) -> pa.RecordBatch:
    packed = pickle.dumps((tree.feature, tree.cut, tree.left, tree.gain, tree.counts))
    return pa.RecordBatch.from_pydict({"model": pa.array([model], pa.int32()), "treeID": pa.array([number], pa.int32()), "tree": [packed]})


def node_rows(number: int, packed: bytes, weights: np.ndarray, edges: list[np.ndarray]) -> pa.RecordBatch:
    """Nodes as Spark keeps them: stats are weighted, a split goes left up to its bound."""
    feature, cut, left, gain, counts = pickle.loads(packed)
    n, inner, stats = len(feature), feature >= 0, counts * weights
    return pa.RecordBatch.from_pydict({
        "treeID": pa.array(np.full(n, number, dtype=np.int32)), "id": pa.array(np.arange(n, dtype=np.int32)),
        "prediction": pa.array(stats.argmax(axis=1).astype(float)), "impurity": pa.array(np.where(stats.any(axis=1), 1 - (_shares(stats) ** 2).sum(axis=1), 0.0)),
        "impurityStats": pa.array(list(stats), pa.list_(pa.float64())), "rawCount": pa.array(counts.sum(axis=1).astype(np.int64)),
        "gain": pa.array(gain), "leftChild": pa.array(left), "rightChild": pa.array(np.where(inner, left + 1, -1).astype(np.int32)),
        "feature": pa.array(feature.astype(np.int32)), "bound": pa.array(_bounds(feature, cut, edges, 0.0))})


def _bounds(feature: np.ndarray, cut: np.ndarray, edges: list[np.ndarray], leaf: float) -> np.ndarray:
    return np.array([edges[f][c] if f >= 0 else leaf for f, c in zip(feature, cut)], dtype=float)


def _shares(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(axis=1, keepdims=True)
    return stats / np.where(total > 0, total, 1.0)


class Votes:
    """The trees of one model as arrays: class chances of rows, and importances as Spark defines them."""

    def __init__(self, trees: list[bytes], weights: np.ndarray, edges: list[np.ndarray], depth: int):
        parts, first, self.roots, self.depth = [], 0, [], depth
        self.importances = np.zeros(len(edges))
        for packed in trees:
            feature, cut, left, gain, counts = pickle.loads(packed)
            stats, inner = counts * weights, feature >= 0
            places = np.arange(first, first + len(feature))
            # A leaf leads to itself: no value is above its bound.
            parts.append((np.where(inner, feature, 0).astype(np.int64), _bounds(feature, cut, edges, np.inf), np.where(inner, left + first, places), _shares(stats)))
            own = np.bincount(feature[inner], weights=(gain * stats.sum(axis=1))[inner], minlength=len(edges))
            self.importances += own / (own.sum() or 1.0)
            self.roots.append(first)
            first += len(feature)
        self.importances /= self.importances.sum() or 1.0
        self.feature, self.bound, self.left, self.share = (np.concatenate(column) for column in zip(*parts))

    def chances(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.share.shape[1]))
        flat = np.where(np.isnan(x), np.inf, x).reshape(-1)
        base = np.arange(len(x)) * x.shape[1]
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = self.left.take(at) + (flat.take(base + self.feature.take(at)) > self.bound.take(at))
            out += self.share.take(at, axis=0)
        return _shares(out)


# ---- jobs ----------------------------------------------------------------------------------------
@dataclass
class Job:
    """What all tasks know: block sizes, folds left out, class weights per fold, settings and bin edges."""

    sizes: dict[int, int]
    folds: list[int]
    weights: np.ndarray
    settings: Settings
    edges: list[np.ndarray]

    def rows(self, sizes: dict[int, int]) -> Rows:
        return Rows(sizes, len(self.edges), self.weights.shape[1], self.settings.bins)

    def trees(self) -> list[tuple[int, int]]:
        return [(m, t) for m in range(len(self.folds)) for t in range(self.settings.trees)]


def _whole_trees(blocks: DataFrame, job: Job) -> DataFrame:
    """Every task gets all rows and grows its share of the trees."""
    trees = job.trees()
    groups = min(len(trees), 3 * blocks.sparkSession.sparkContext.defaultParallelism)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, mine = job.rows(job.sizes), set()
        for batch in batches:
            for block, x, y, fold, group in zip(*(batch.column(k) for k in ("block", "x", "y", "fold", "group"))):
                rows.put(block.as_py(), x.as_buffer(), y.as_buffer(), fold.as_buffer())
                mine.add(group.as_py())
        for m, t in (tree for group in sorted(mine) for tree in trees[group::groups]):
            yield tree_row(m, t, grown(rows, job.settings, job.weights[m], job.folds[m], t))

    copies = blocks.select("block", "x", "y", "fold", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    return copies.repartitionById(groups, "group").mapInArrow(grow, TREES)


def _level_by_level(blocks: DataFrame, job: Job) -> DataFrame:
    """Rows stay dealt out; one job per level counts in all tasks, adds up per tree and finds the splits."""
    spark, s = blocks.sparkSession, job.settings
    context = spark.sparkContext
    bytes_held = sum(job.sizes.values()) * len(job.edges)
    parts = -(-bytes_held // PART_BYTES)
    part_of, filled = {}, [0] * parts
    for block in sorted(job.sizes):  # dealt evenly: each block to the part with the fewest rows
        part = filled.index(min(filled))
        part_of[block], filled[part] = part, filled[part] + job.sizes[block]
    listed = spark.createDataFrame(list(part_of.items()), "block bigint, part int")
    dealt = blocks.join(F.broadcast(listed), "block").repartitionById(parts, "part")
    forest = {key: Tree(job.weights.shape[1]) for key in job.trees()}
    reducers = min(len(forest), 3 * context.defaultParallelism)
    while still := {key: (tree.routes, len(tree.open)) for key, tree in forest.items() if len(tree.open)}:
        shared = context.broadcast(still)

        def drawn(m, t, shared=shared):
            routes, open_nodes = shared.value[m, t]
            return drawn_features(s, len(job.edges), job.folds[m], t, len(routes), open_nodes)

        def count(batches, shared=shared, drawn=drawn):
            held = {}
            for batch in batches:
                for block, x, y, fold in zip(*(batch.column(k) for k in ("block", "x", "y", "fold"))):
                    held[block.as_py()] = x.as_py(), y.as_py(), fold.as_py()
            if not held:
                return
            rows = job.rows({block: job.sizes[block] for block in held})
            for block in list(held):
                rows.put(block, *held.pop(block))
            for (m, t), (routes, _) in shared.value.items():
                sample = Sample(rows, s.seed, job.folds[m], t)
                for route in routes:
                    sample.move(route)
                counts = sample.counts(drawn(m, t)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"model": pa.array([m], pa.int32()), "tree": pa.array([t], pa.int32()), "counts": [counts.tobytes()]})

        def split(batches, drawn=drawn):
            sums = {}
            for batch in batches:
                for m, t, counts in zip(*(batch.column(k) for k in ("model", "tree", "counts"))):
                    key, part = (m.as_py(), t.as_py()), np.frombuffer(counts.as_buffer(), dtype=np.int32)
                    if key in sums:
                        sums[key] += part
                    else:
                        sums[key] = part.astype(np.int64)
            for (m, t), total in sums.items():
                features = drawn(m, t)
                total = total.reshape(*features.shape, s.bins, -1)
                best = best_splits(total, features, job.weights[m], s.least)
                yield pa.RecordBatch.from_pydict({"model": pa.array([m], pa.int32()), "tree": pa.array([t], pa.int32()), "best": [pickle.dumps(best)]})

        counted = dealt.mapInArrow(count, "model int, tree int, counts binary")
        owner = F.pmod(F.col("model") * s.trees + F.col("tree"), F.lit(reducers)).cast("int")
        found = counted.repartitionById(reducers, owner).mapInArrow(split, "model int, tree int, best binary")
        # Per tree one split for each open node: bounded by the model.
        for r in found.collect():
            forest[r["model"], r["tree"]].split(pickle.loads(r["best"]), s)
        shared.unpersist()
    shared = context.broadcast(forest)

    def listed_trees(batches):
        for batch in batches:
            for at in batch.column("id").to_pylist():
                m, t = divmod(at, s.trees)
                yield tree_row(m, t, shared.value[m, t])

    return spark.range(len(forest)).mapInArrow(listed_trees, TREES)


def _metadata(template: RandomForestClassifier, features: int, classes: int) -> tuple[str, str]:
    """What Spark 4.1 writes beside the nodes, for the forest and for each of its trees."""

    def described(kind: str, uid: str, names: set[str] | None, **more) -> str:
        maps = ({p.name: v for p, v in found.items() if names is None or p.name in names} for found in (template._paramMap, template._defaultParamMap))
        return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__,
                           "uid": uid, "paramMap": next(maps), "defaultParamMap": next(maps), **more})

    own = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInfoGain",
           "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "probabilityCol", "rawPredictionCol", "seed", "weightCol"}
    return (described("RandomForestClassificationModel", template.uid, None, numFeatures=features, numClasses=classes, numTrees=template.getNumTrees()),
            described("DecisionTreeClassificationModel", f"{template.uid}_tree", own))


def _grown_trees(rows: DataFrame, features: list[str], classes: int, template: RandomForestClassifier, folds: list[int], balance: bool,
                 changes: dict) -> tuple[DataFrame, Job]:
    """One row per tree of the forest of each fold; `rows` has `fold_`, and a forest sees the rows of the other folds."""
    s = _settings(template, len(features), changes)
    edges = bin_edges(rows, features, s.bins)
    _, weights = training_counts(rows, folds, classes, balance)
    blocks = binned_rows(rows, features, edges)
    # One row per block of some thousand rows.
    sizes = {r["block"]: r["n"] for r in blocks.select("block", "n").collect()}
    if not sizes:
        raise ValueError("there are no rows to fit on")
    job = Job(sizes, folds, weights, s, edges)
    grow = _whole_trees if sum(sizes.values()) * len(features) <= ROWS_HELD_BYTES else _level_by_level
    return written(grow(blocks, job), "forest"), job


def fit(rows: DataFrame, features: list[str], labels: list[str], template: RandomForestClassifier, balance: bool = True, **changes) -> PipelineModel:
    """A scoring model of all rows, with Spark's own forest model.

    `rows` has the features filled and `label` (index in `labels`); `template` has the settings, of which `changes` differ from the
    published ones.
    """
    spark = rows.sparkSession
    trees, job = _grown_trees(rows.withColumn("fold_", F.lit(0)), features, len(labels), template, [-1], balance, changes)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed in zip(batch.column("treeID").to_pylist(), batch.column("tree")):
                yield node_rows(number, packed.as_py(), job.weights[0], job.edges)

    nodes = trees.mapInArrow(listed, NODES)
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") >= 0, F.array("bound")).otherwise(
        F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split.alias("split"))
    metadata, tree_metadata = _metadata(template, len(features), len(labels))
    path = new_folder(spark, "forest-model")
    nodes.select("treeID", data.alias("nodeData")).write.parquet(f"{path}/data")
    spark.createDataFrame([(metadata,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.range(job.settings.trees).coalesce(1).select(
        F.col("id").cast("int").alias("_1"), F.lit(tree_metadata).alias("_2"), F.lit(1.0).alias("_3")).write.parquet(f"{path}/treesMetadata")
    return PipelineModel([
        VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassificationModel.load(path),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)])


def cross_validated(rows: DataFrame, features: list[str], labels: list[str], template: RandomForestClassifier, folds: list[int],
                    **changes) -> tuple[DataFrame, list[tuple[int, str, float]]]:
    """Out-of-fold predictions of a forest per fold, and the importances of its features.

    Every row is read once, by the model that did not see its fold; models are arrays of some megabytes, bounded by trees and depth.
    """
    spark = rows.sparkSession
    trees, job = _grown_trees(rows.withColumn("fold_", F.col("fold")), features, len(labels), template, folds, True, changes)
    packed: dict[int, list] = {m: [] for m in range(len(folds))}
    for r in trees.orderBy("model", "treeID").collect():
        packed[r["model"]].append(bytes(r["tree"]))
    models = {fold: Votes(packed[m], job.weights[m], job.edges, job.settings.depth) for m, fold in enumerate(folds)}
    shared = spark.sparkContext.broadcast(models)
    kept = ["fww_id", "fold", "wfd_status"]

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1)
            fold = batch.column("fold").to_numpy()
            chances = np.zeros((len(x), len(labels)))
            for one in np.unique(fold):
                chances[fold == one] = shared.value[one].chances(x[fold == one])
            predicted = pa.array([labels[k] for k in chances.argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], predicted, pa.array(list(chances), pa.list_(pa.float64()))],
                                             names=[*kept, "predicted", "probability"])

    types = dict(rows.dtypes)
    scored = rows.mapInArrow(tested, ", ".join(f"{c} {types[c]}" for c in kept) + ", predicted string, probability array<double>")
    ranked = [(int(fold), f, float(v)) for fold, model in models.items() for f, v in zip(features, model.importances)]
    return written(scored, "out-of-fold"), ranked

"""Multi-class gradient boosting with the softmax objective (H4), second order,
on distributed histograms.

* Features are cut into at most ``MAX_BINS`` bins at quantiles (one scan); a row
  becomes a byte per feature. Rows are held in blocks (one record per block: bins,
  labels, folds, margins), which stay in executor memory for all rounds. They are
  dealt out evenly, however few files the table has, so that all cores have work.
* A round grows one tree per class on the same gradients: p = softmax(margin),
  g = p - y, h = 2 p (1 - p). A tree level is one job for all classes: every task
  adds up (node, feature, bin) -> (g, h, n) of its blocks, the partial histograms
  meet by node, and the task that has a node's sum picks its best split, so only one
  record per node reaches the driver. Leaves are -eta G / (H + lambda).
* When all nodes that may still split have at most ``LOCAL_ROWS`` rows (in large tables only
  if they are fewer bytes than the histograms that their subtrees would take), each is
  finished by one task: its rows (bins and one number, from which g and h follow) meet there and
  the same splits are made in memory, all in one job. There only the smaller child of a split is
  added up, the other is its parent less that; a whole tree's root is added up by the tasks that
  hold the rows. Large tables take histogram levels first, small ones a job per round.
* After a round, margins get the new trees' values, in the first job of the next one. Where a
  round is one job, they are only kept every ``KEEP`` rounds; the jobs between add the values of
  the rounds since, which is cheaper than to move all margins out of the workers and back. Every
  ``CUT_LINEAGE`` rounds they are checkpointed to the shared folder, so a lost executor costs
  at most that many updates of its blocks. Blocks are RDD records (numpy arrays), so that no
  job of a round is planned as a query.
* Cross-validation fits all folds in the same jobs: a block carries a margin per fold
  model, and model m adds up only the rows outside fold m.

Sums are added in the order of the partial histograms' tasks, so a fit on the same
partitions gives the same trees. Ties (to ``TIE``) go to the smaller feature, then the smaller
cut. A missing value lies above every cut."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# the functions below run in tasks on executors that needn't have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BINS = 256
LAMBDA = 1.0
MIN_CHILD = 1.0
MIN_GAIN = 1e-6
TIE = 1e-9
KEEP, CUT_LINEAGE = 5, 10
LOCAL_ROWS = 1 << 20
#: What the rows of a round may move at most where histograms would move less, and how many
#: times smaller than its sums a compressed histogram is, about.
LOCAL_BYTES, SPARSE = 1 << 28, 8
#: Partial histograms that a task which adds them up is to hold at most.
REDUCER_BYTES = 1 << 26
#: Rows of a block, and of a partition of blocks at least and at most.
BLOCK_ROWS, FEW_ROWS, MANY_ROWS = 50_000, 5_000, 500_000
#: Values of a feature that a summary for the cut points holds at most, and how many summaries meet in one task.
SUMMARY, MEET = 1 << 17, 16
NODE_DDL = "model int, round int, class int, node int, depth int, feature string, threshold double, gain double, cover double, n long, left int, right int, value double"


def _thinned(parts: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values ascending, rows of each) of several such summaries together; if there are more
    than ``most`` values, ``most`` of them at equal steps of rank, each with the rows since the one before."""
    values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([c for _, c in parts]), len(values)).astype(np.int64)
    if len(values) <= most:
        return values, counts
    upto = np.cumsum(counts)
    keep = np.unique(np.searchsorted(upto, -(-np.arange(1, most + 1) * int(upto[-1]) // most)))
    return values[keep], np.diff(upto[keep], prepend=0)


def _value_counts(n_features: int, most: int):
    """Per feature a summary of a task's values. Chunks of equal weight meet, so each row is
    thinned a logarithmic number of times and the memory doesn't follow the task's rows."""

    def run(batches):
        held: list[list] = [[] for _ in range(n_features)]  # (level, summary), levels falling
        waiting: list[list] = [[] for _ in range(n_features)]
        rows = 0

        def meet():
            for own, chunk in zip(held, waiting, strict=True):
                values = np.concatenate(chunk)
                own.append((0, _thinned([np.unique(values[~np.isnan(values)], return_counts=True)], most)))
                chunk.clear()
                while len(own) > 1 and own[-1][0] == own[-2][0]:
                    (level, a), (_, b) = own[-2:]
                    own[-2:] = [(level + 1, _thinned([a, b], most))]

        for b in batches:
            for j, chunk in enumerate(waiting):
                chunk.append(b.column(j).to_numpy(zero_copy_only=False))
            rows += b.num_rows
            if rows >= 2 * most:
                meet()
                rows = 0
        if rows:
            meet()
        found = [_thinned([x for _, x in own], most) for own in held if own]
        names = ["feature", "counted", "vals"]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([c.tobytes() for _, c in found], pa.binary()), pa.array([v.tobytes() for v, _ in found], pa.binary())], names=names)

    return run


def _met(most: int):
    def run(key_parts):
        key, parts = key_parts
        parts = sorted(parts, key=lambda x: x[0])
        return key[0], (key[1], *_thinned([x[1:] for x in parts], most))

    return run


def quantile_cuts(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Per feature the values at which a bin begins (all but the smallest, at most
    ``max_bins`` - 1): a row is left of a cut if its value is smaller. The quantiles are
    exact for features of at most ``SUMMARY`` values; for others every thinning (a few,
    one more with each ``MEET``-fold number of tasks) leaves a rank off by 1 / ``SUMMARY`` of the rows at most."""
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(features)]
    rows = df.select(*columns).mapInArrow(_value_counts(len(features), SUMMARY), "feature int, counted binary, vals binary").rdd
    as_arrays = lambda task, own: ((r[0], (task, np.frombuffer(r[2]), np.frombuffer(r[1], np.int64))) for r in own)
    parts, tasks = rows.mapPartitionsWithIndex(as_arrays), rows.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    while True:  # a few summaries of a feature meet in a task at a time
        tasks = max(1, -(-tasks // MEET))
        grouped = parts.map(lambda x: ((x[0], x[1][0] // MEET), x[1])).groupByKey(max(1, min(len(features) * tasks, 4 * cores)))
        parts = grouped.map(_met(SUMMARY))
        if tasks == 1:
            break
    found = dict(parts.mapValues(lambda x: _at_ranks(x[1], x[2], max_bins)).collect()) if features else {}
    return [found.get(j, np.zeros(0)) for j in range(len(features))]


def _at_ranks(values: np.ndarray, counts: np.ndarray, max_bins: int) -> np.ndarray:
    """The values at equal steps of rank, without the smallest."""
    if not len(values):
        return values
    upto = np.cumsum(counts)
    ranks = np.ceil(np.array([i / (max_bins - 1) for i in range(max_bins)]) * int(upto[-1]))
    return np.unique(values[np.searchsorted(upto, np.maximum(ranks, 1))])[1:]


@dataclass
class Tree:
    """A tree in heap order: node i has the children 2i + 1 and 2i + 2. Where a tree ends
    early every row goes left and the value is that of all places below."""

    feature: np.ndarray  # of inner places, -1 where no split
    cut: np.ndarray  # bin of the split: left if bin <= cut
    threshold: np.ndarray  # left if value < threshold
    gain: np.ndarray
    sums: np.ndarray  # (places, 3): g, h, n
    value: np.ndarray  # of the places of the last level

    @staticmethod
    def empty(depth: int) -> Tree:
        inner = 2**depth - 1
        return Tree(np.full(inner, -1, np.int16), np.full(inner, 32767, np.int16), np.full(inner, np.inf), np.zeros(inner), np.zeros((2 * inner + 1, 3)), np.zeros(inner + 1))

    def for_rows(self) -> Tree:
        """What it takes to give rows their values."""
        return Tree(self.feature, self.cut, None, None, None, self.value)

    def end(self, node: int, depth: int, eta: float, reg: float) -> None:
        """Make ``node`` a leaf."""
        level, g, h = (node + 1).bit_length() - 1, self.sums[node, 0], self.sums[node, 1]
        width = 2 ** (depth - level)
        first = (node + 1) * width - 2**depth
        self.value[first : first + width] = -eta * g / (h + reg)


def places(tree: Tree, bins: np.ndarray, depth: int) -> np.ndarray:
    """Where the rows of a block (features x rows) are after ``depth`` levels."""
    node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    flat, start = bins.reshape(-1), tree.feature.astype(np.int64) * bins.shape[1]
    for _ in range(depth):
        node = 2 * node + 1 + (flat[start[node] + rows] > tree.cut[node])  # feature -1 reads the last, cut 32767 keeps left
    return node


def leaf_values(tree: Tree, bins: np.ndarray, depth: int) -> np.ndarray:
    """What the tree gives the rows of a block; below its last split there is nothing to look up."""
    inner = np.flatnonzero(tree.feature >= 0)
    level = (int(inner[-1]) + 1).bit_length() if inner.size else 0
    return tree.value[(places(tree, bins, level) + 1) * 2 ** (depth - level) - 2**depth]


def probabilities(margin: np.ndarray) -> np.ndarray:
    """Softmax over the first axis."""
    e = np.exp(margin - margin.max(0, keepdims=True))
    return e / e.sum(0, keepdims=True)


def histogram(slot: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, n_bins: int) -> np.ndarray:
    """Sums (g, h, n) by (slot, feature, bin) of rows, one feature after the other."""
    out, base = np.empty((3, slots, len(bins), n_bins)), slot.astype(np.int64) * n_bins  # bincount counts in this type
    for j in range(len(bins)):
        cell = base + bins[j]
        for i, weights in enumerate((g, h, None)):
            out[i, :, j] = np.bincount(cell, weights, slots * n_bins).reshape(slots, n_bins)
    return out


def _to_blocks(cuts, models: int, classes: int):
    names = ["bins", "label", "fold"]

    def block(held):
        arrays = (np.concatenate([x[i] for x in held], axis=-1) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=names)

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            bins = np.stack([np.searchsorted(c, b.column(j).to_numpy(zero_copy_only=False), side="right").astype(np.uint8) for j, c in enumerate(cuts)])
            label, fold = (b.column(len(cuts) + i).to_numpy(zero_copy_only=False).astype(np.uint8) for i in (0, 1))
            held.append((bins, label, fold))
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    return run


def _arrays(n_features: int, models: int, classes: int):
    """A block as arrays, with margins of nought."""

    def run(row):
        bins, label, fold = (np.frombuffer(x, np.uint8) for x in row)
        return bins.reshape(n_features, -1), label, fold, np.zeros((models, classes, len(label)))

    return run


def _advance(since: list[list[list[Tree]]], depth: int):
    """Margins with the values of the trees of the rounds ``since`` added, round by round."""

    def run(block):
        bins, label, fold, margin = block
        if since:
            margin = margin.copy()
        for trees in since:
            for m, own in enumerate(trees):
                for k, tree in enumerate(own):
                    margin[m, k] += leaf_values(tree, bins, depth)
        return bins, label, fold, margin

    return run


def _marked(p: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A row's probability of a class, negative (-0.0 too) if the row is of that class."""
    return np.where(own, -p, p)


def _gradients(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """g and h of rows."""
    p = np.abs(marked)
    return p - np.signbit(marked), np.maximum(2.0 * p * (1.0 - p), 1e-16)


def _histograms(trees, slots, level: int, n_bins: int, classes: int, advance):
    """Partial sums (g, h, n) by (feature, bin) of the open nodes: one record per node and task.
    ``slots[m][k]`` numbers the open nodes of a tree by their place."""
    first = np.cumsum([0, *(int(x.max()) + 1 if x.size else 0 for own in slots for x in own)])

    def run(task, blocks):
        total = {}
        for bins, label, fold, margin in map(advance, blocks):
            for m, own in enumerate(trees):
                p = probabilities(margin[m])
                used = fold != m
                for k, tree in enumerate(own):
                    if not slots[m][k].size:
                        continue
                    g, h = _gradients(_marked(p[k], label == k))
                    slot = slots[m][k][places(tree, bins, level) - (2**level - 1)]
                    rows, own_bins = used & (slot >= 0), bins
                    if not rows.all():
                        rows = np.flatnonzero(rows)
                        slot, own_bins, g, h = slot[rows], bins.take(rows, 1), g[rows], h[rows]
                    sums = histogram(slot, own_bins, g, h, int(slots[m][k].max()) + 1, n_bins)
                    at = int(first[m * classes + k])
                    if at in total:
                        total[at] += sums
                    else:
                        total[at] = sums
        for at, sums in total.items():
            for node in range(sums.shape[1]):
                yield at + node, (task, np.ascontiguousarray(sums[:, node]))

    return run


def best_split(sums: np.ndarray, reg: float = LAMBDA, min_child: float = MIN_CHILD) -> tuple:
    """(gain, feature, bin, left sums, node sums) of (3, features, bins); gain 0 if no split is better than none."""
    whole = sums[:, 0].sum(-1)
    left = np.cumsum(sums, -1)[:, :, :-1]
    right = whole[:, None, None] - left
    score = lambda s: s[0] ** 2 / (s[1] + reg)
    gain = score(left) + score(right) - score(whole)
    gain[(left[1] < min_child) | (right[1] < min_child) | (left[2] < 1) | (right[2] < 1)] = 0
    if not gain.size or gain.max() <= MIN_GAIN:
        return 0.0, -1, -1, whole, whole
    # gains that only rounding parts are equal, so the choice doesn't hang on the order of sums
    first = int((gain >= gain.max() - TIE * max(float(gain.max()), 1.0)).argmax())
    feature, at = np.unravel_index(first, gain.shape)
    return float(gain[feature, at]), int(feature), int(at), left[:, feature, at], whole


def _splits(reg: float, min_child: float):
    """The best split of every node, from its partial sums in the order of their tasks."""

    def run(parts):
        by_node: dict[int, list] = {}
        for node, part in parts:
            by_node.setdefault(node, []).append(part)
        for node, own in sorted(by_node.items()):
            own.sort(key=lambda x: x[0])
            total = own[0][1].copy()
            for _, sums in own[1:]:
                total += sums
            yield node, *best_split(total, reg, min_child)

    return run


def fit(df: DataFrame, features: list[str], label: str, classes: int = 3, rounds: int = 100, depth: int = 6, eta: float = 0.1,
        reg: float = LAMBDA, min_child: float = MIN_CHILD, max_bins: int = MAX_BINS, fold: str | None = None, folds: int = 1, local_rows: int = LOCAL_ROWS) -> tuple[list[list[list[Tree]]], list[tuple[int, int]]]:
    """(models, held-out results). ``models[m][round][class]``: one model on all rows, or
    one for each of ``folds`` values of the column ``fold``, without that fold's rows.
    The results are (rows, rightly predicted) of each model's fold."""
    spark = df.sparkSession
    if not 2 <= max_bins <= 256 or not 0 < depth <= 12 or folds > 255:
        raise ValueError("2 to 256 bins, a depth of 1 to 12, at most 255 folds")
    cuts = quantile_cuts(df, features, max_bins)
    n_features, n_bins = len(features), max((len(c) for c in cuts), default=0) + 1
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]
    rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(numbers)], F.col(label).cast("int").alias("y"), (F.col(fold).cast("int") if fold else F.lit(255)).alias("f"))
    counts = dict(rows.groupBy("f").count().collect())
    tasks = block_tasks(sum(counts.values()), spark.sparkContext.defaultParallelism)
    if tasks > 1:
        rows = rows.repartition(tasks)
    ensure_checkpoint_dir(spark)
    blocks = rows.mapInArrow(_to_blocks(cuts, folds, classes), "bins binary, label binary, fold binary").rdd
    state = blocks.map(_arrays(n_features, folds, classes)).persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()
    files, before = state, None  # the last state with files; the one before the current
    since: list = []  # the rounds whose trees the state's margins lack
    size = [sum(n for f, n in counts.items() if f != m) for m in range(folds)]
    reducers, histogram_bytes = spark.sparkContext.defaultParallelism, tasks * 24 * n_features * n_bins  # of a node, from every task
    models: list[list[list[Tree]]] = [[] for _ in range(folds)]
    try:
        for r in range(rounds):
            trees = [[Tree.empty(depth) for _ in range(classes)] for _ in range(folds)]
            open_, local = {(m, k): [0] for m in range(folds) for k in range(classes)}, []  # places of the level that may split
            for level in range(depth):
                most = local_rows
                if sum(size) * classes * (n_features + 8) > LOCAL_BYTES:  # a row moves its bins and a number; a node and all below it three sums by feature and bin from every task
                    most = min(most, histogram_bytes * (2 ** (depth - level) - 1) // (SPARSE * (n_features + 8)))
                todo = [(m, k, x) for (m, k), nodes in open_.items() for x in nodes]
                if not todo:
                    break
                if all((size[m] if not x else trees[m][k].sums[x, 2]) <= most for m, k, x in todo):
                    local = [(m, k, x, level) for m, k, x in todo]  # one job instead of one for every level
                    break
                if since:  # several jobs of this round would add these values
                    before, state, since = state, state.map(_advance(since, depth)).persist(StorageLevel.MEMORY_AND_DISK), []
                slots = [[_numbered(open_[m, k], level) for k in range(classes)] for m in range(folds)]
                parts = state.mapPartitionsWithIndex(_histograms(trees, slots, level, n_bins, classes, _advance(since, depth))).partitionBy(histogram_reducers(len(todo), histogram_bytes, reducers), int)
                open_ = _grow(trees, todo, parts.mapPartitions(_splits(reg, min_child)).collect(), level, depth, cuts, classes, eta, reg)
            if local:
                parts = state.mapPartitionsWithIndex(_rows_of(trees, local, classes, n_bins, _advance(since, depth))).partitionBy(min(len(local), 4 * reducers), int)
                _graft(trees, parts.mapPartitions(_finished(local, n_bins, depth, reg, min_child)).collect(), local, depth, cuts, eta, reg)
            for m in range(folds):
                models[m].append(trees[m])
            if before is not None:  # the new margins are in place
                before.unpersist()
            if state is not files and state.isCheckpointed():
                _drop_files(spark, files)
                files = state
            before = None
            since.append([[tree.for_rows() for tree in own] for own in trees])
            if r + 1 < rounds and (len(since) == KEEP or (r + 1) % CUT_LINEAGE == 0):
                before, state, since = state, state.map(_advance(since, depth)).persist(StorageLevel.MEMORY_AND_DISK), []
                if (r + 1) % CUT_LINEAGE == 0:
                    state.checkpoint()
        held = state.map(_advance(since, depth)).mapPartitions(_held_out(folds)).reduceByKey(lambda a, b: a + b, 1).collect() if fold else []
    finally:
        for x in {state, before} - {None}:
            x.unpersist()
        for x in {state, files}:
            _drop_files(spark, x)
    results = {m: tuple(x.tolist()) for m, x in held}
    return models, [results.get(m, (0, 0)) for m in range(folds)]


def _drop_files(spark: SparkSession, state) -> None:
    """Delete the checkpoint files of a state, if it has some."""
    if name := state.getCheckpointFile():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def block_tasks(rows: int, cores: int) -> int:
    """Partitions of the blocks: a multiple of the cores, none of more than ``MANY_ROWS``
    rows; fewer for a small table."""
    return max(1, min(cores * -(-rows // (cores * MANY_ROWS)), rows // FEW_ROWS))


def histogram_reducers(nodes: int, node_bytes: int, cores: int) -> int:
    """Tasks that add up the histograms of nodes: one for a core, or as many as keep each to
    ``REDUCER_BYTES`` (a node at least)."""
    return min(nodes, max(cores, -(-nodes * node_bytes // REDUCER_BYTES)))


def _numbered(nodes: list[int], level: int) -> np.ndarray:
    """By place of the level the number of an open node, -1 elsewhere; empty without open nodes."""
    if not nodes:
        return np.zeros(0, np.int32)
    out = np.full(2**level, -1, np.int32)
    out[np.array(nodes) - (2**level - 1)] = np.arange(len(nodes))
    return out


def grow_in_memory(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, n_bins: int, reg: float = LAMBDA, min_child: float = MIN_CHILD, root: np.ndarray | None = None) -> Tree:
    """The tree of some rows (bins: features x rows); thresholds and leaf values are left open.
    Only the smaller child of a node is added up, the other is what that leaves of its parent;
    ``root`` has the sums of all rows if they are known."""
    tree = Tree.empty(depth)
    added_up = lambda bins, g, h: histogram(np.zeros(len(g), np.int64), bins, g, h, 1, n_bins)[:, 0]
    open_ = {0: (None, added_up(bins, g, h) if root is None else root)}  # by place the numbers of the rows (None: all) and their sums
    while open_:
        node, (rows, sums) = open_.popitem()
        gain, feature, at, left, whole = best_split(sums, reg, min_child)
        tree.sums[node] = whole
        if feature < 0:
            continue
        tree.feature[node], tree.cut[node], tree.gain[node] = feature, at, gain
        tree.sums[2 * node + 1], tree.sums[2 * node + 2] = left, whole - left
        if 2 * node + 1 >= len(tree.feature):
            continue
        right = (bins[feature] if rows is None else bins[feature].take(rows)) > at
        numbers = [np.flatnonzero(x) if rows is None else rows[x] for x in (~right, right)]
        small = int(len(numbers[1]) < len(numbers[0]))
        own = numbers[small]
        part = added_up(bins.take(own, 1), g[own], h[own])
        for side, of_side in ((small, part), (1 - small, sums - part)):
            open_[2 * node + 1 + side] = numbers[side], of_side
    return tree


def _rows_of(trees, local: list[tuple], classes: int, n_bins: int, advance):
    """The rows of the nodes in ``local`` (model, class, node, level), numbered by their
    place in it: bins and marked probabilities by node and block; and the sums of whole trees'
    rows, one record per tree and task."""
    by_tree: dict[tuple, dict[int, np.ndarray]] = {}  # by level the numbers of its places, -1 elsewhere
    for key, (m, k, node, level) in enumerate(local):
        by_tree.setdefault((m, k), {}).setdefault(level, np.full(2**level, -1))[node - (2**level - 1)] = key

    def run(task, blocks):
        roots: dict[int, np.ndarray] = {}
        for block, (bins, label, fold, margin) in enumerate(map(advance, blocks)):
            for m in range(len(trees)):
                p, used = probabilities(margin[m]), fold != m
                for k in range(classes):
                    if (m, k) not in by_tree:
                        continue
                    marked = _marked(p[k], label == k)
                    if 0 in by_tree[m, k]:  # all the model's rows
                        key, rows = int(by_tree[m, k][0][0]), slice(None) if used.all() else np.flatnonzero(used)
                        own_bins, marked = bins[:, rows], marked[rows]
                        sums = histogram(np.zeros(len(marked), np.int64), own_bins, *_gradients(marked), 1, n_bins)[:, 0]
                        roots[key] = roots[key] + sums if key in roots else sums
                        yield key, (task, block, own_bins, marked)
                        continue
                    key_of = np.full(len(label), -1)  # a row is in one local node at most
                    for level, numbers in by_tree[m, k].items():
                        key_of = np.maximum(key_of, numbers[places(trees[m][k], bins, level) - (2**level - 1)])
                    key_of[~used] = -1
                    order = np.argsort(key_of, kind="stable")
                    keys, first = np.unique(key_of[order], return_index=True)
                    for key, rows in zip(keys.tolist(), np.split(order, first[1:]), strict=True):
                        if key >= 0:
                            yield key, (task, block, bins.take(rows, 1), marked[rows])
        for key, sums in roots.items():
            yield key, (task, -1, sums)

    return run


def _finished(local: list[tuple], n_bins: int, depth: int, reg: float, min_child: float):
    """The subtrees of local nodes from their rows in the order of tasks and blocks: key, place, gain, feature, bin, sums."""

    def run(parts):
        held: dict[int, list] = {}
        for key, part in parts:
            held.setdefault(key, []).append(part)
        for key in sorted(held):
            own = sorted(held.pop(key), key=lambda x: x[:2])
            added_up = [x[2] for x in own if x[1] < 0]
            bins, marked = (np.concatenate([x[i] for x in own if x[1] >= 0], axis=-1) for i in (2, 3))
            tree = grow_in_memory(bins, *_gradients(marked), depth - local[key][3], n_bins, reg, min_child, sum(added_up[1:], added_up[0]) if added_up else None)
            todo = [0]
            while todo:
                node = todo.pop()
                inner = node < len(tree.feature) and tree.feature[node] >= 0
                yield (key, node, float(tree.gain[node]), int(tree.feature[node]), int(tree.cut[node]), tree.sums[node]) if inner else (key, node, 0.0, -1, -1, tree.sums[node])
                todo += [2 * node + 1, 2 * node + 2] if inner else []

    return run


def _graft(trees, found, local: list[tuple], depth: int, cuts, eta: float, reg: float) -> None:
    """Enter the subtrees of local nodes."""
    for key, place, gain, feature, at, sums in found:
        m, k, root, level = local[key]
        below = (place + 1).bit_length() - 1
        node = (root + 1) * 2**below - 1 + place - (2**below - 1)
        tree = trees[m][k]
        tree.sums[node] = sums
        if feature < 0:
            tree.end(node, depth, eta, reg)
        else:
            tree.feature[node], tree.cut[node], tree.gain[node] = feature, at, gain
            tree.threshold[node] = cuts[feature][at]


def _grow(trees, todo: list[tuple], found, level: int, depth: int, cuts, classes: int, eta: float, reg: float) -> dict:
    """Enter the splits of a level's nodes ``todo`` (model, class, node); the nodes that the next level may split."""
    open_ = {(m, k): [] for m in range(len(trees)) for k in range(classes)}
    for number, gain, feature, at, left, whole in sorted(found, key=lambda x: x[0]):
        m, k, node = todo[number]
        tree = trees[m][k]
        tree.sums[node] = whole
        if feature < 0:
            tree.end(node, depth, eta, reg)
            continue
        tree.feature[node], tree.cut[node], tree.gain[node] = feature, at, gain
        tree.threshold[node] = cuts[feature][at]
        tree.sums[2 * node + 1], tree.sums[2 * node + 2] = left, whole - left
        if level + 1 < depth:
            open_[m, k] += [2 * node + 1, 2 * node + 2]
        else:
            tree.end(2 * node + 1, depth, eta, reg)
            tree.end(2 * node + 2, depth, eta, reg)
    return open_


def _held_out(folds: int):
    """(rows, rightly predicted) of each model's fold."""

    def run(blocks):
        total = np.zeros((folds, 2), np.int64)
        for _, label, fold, margin in blocks:
            for m in range(folds):
                out = fold == m
                total[m] += out.sum(), (margin[m][:, out].argmax(0) == label[out]).sum()
        yield from enumerate(total)

    return run


# ------------------------------------------------------------------ model ----


def node_rows(rounds: list[list[Tree]], features: list[str], model: int = 0) -> list[tuple]:
    """The node relation of a model: a row per split and per leaf."""
    out = []
    for r, own in enumerate(rounds):
        for k, tree in enumerate(own):
            depth = (len(tree.value)).bit_length() - 1
            todo = [(0, 0)]
            while todo:
                node, level = todo.pop()
                g, h, n = tree.sums[node].tolist()
                if level < depth and tree.feature[node] >= 0:
                    out.append((model, r, k, node, level, features[tree.feature[node]], float(tree.threshold[node]), float(tree.gain[node]), h, int(n), 2 * node + 1, 2 * node + 2, None))
                    todo += [(2 * node + 2, level + 1), (2 * node + 1, level + 1)]
                else:
                    first = (node + 1) * 2 ** (depth - level) - 2**depth
                    out.append((model, r, k, node, level, None, None, None, h, int(n), None, None, float(tree.value[first])))
    return out


class BoostedTrees(Model, MLReadable, MLWritable):
    """Fitted trees as a pipeline stage: adds ``rawPrediction`` (margins), ``probability``
    (their softmax) and ``prediction`` to rows that hold the feature columns. Saved as
    its node relation (Parquet), which SQL can read."""

    def __init__(self, nodes: list[tuple] | None = None, features: list[str] | None = None, classes: int = 3):
        super().__init__()
        self.nodes, self.features, self.classes = nodes or [], features or [], classes

    def node_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_DDL)

    def trees(self) -> tuple[list[np.ndarray], list[Tree]]:
        """By feature the thresholds that occur, ascending; by (round, class) the trees, their
        cuts counted in these."""
        depth = max((n[4] for n in self.nodes), default=0)
        rounds = max((n[1] for n in self.nodes), default=-1) + 1
        cuts = [np.array(sorted({n[6] for n in self.nodes if n[5] == f})) for f in self.features]
        number = {f: i for i, f in enumerate(self.features)}
        trees = [Tree.empty(depth) for _ in range(rounds * self.classes)]
        for _, r, k, node, level, f, t, *_, v in self.nodes:
            tree = trees[r * self.classes + k]
            if f is not None:
                tree.feature[node], tree.cut[node] = number[f], np.searchsorted(cuts[number[f]], t)
            else:
                width = 2 ** (depth - level)
                first = (node + 1) * width - 2**depth
                tree.value[first : first + width] = v
        return cuts, [tree.for_rows() for tree in trees]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own_cuts, own_trees = self.trees()
        # bounded by rounds, classes and depth; arrays alone, as a broadcast is pickled by reference to this module
        shared = dataset.sparkSession.sparkContext.broadcast((own_cuts, [(t.feature, t.cut, t.value) for t in own_trees]))
        classes = self.classes

        def margins(*columns: pd.Series) -> pd.Series:
            cuts, trees = shared.value
            # left if value < threshold, so if no more than the thresholds before it are reached; missing values go right
            bins = np.stack([np.searchsorted(c, x.to_numpy(float), side="right").astype(np.int16) for c, x in zip(cuts, columns, strict=True)])
            total = np.zeros((classes, bins.shape[1]))
            for t, (feature, cut, value) in enumerate(trees):
                tree = Tree(feature, cut, None, None, None, value)
                total[t % classes] += leaf_values(tree, bins, len(tree.value).bit_length() - 1)
            return pd.Series(list(total.T))

        margin = F.pandas_udf(margins, "array<double>")(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features])
        out = dataset.withColumn("_margin", margin)
        top = F.array_max("_margin")
        e = F.transform("_margin", lambda x: F.exp(x - top))
        out = out.withColumn("_e", e)
        total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
        return out.withColumns({
            "rawPrediction": array_to_vector("_margin"), "probability": array_to_vector(F.transform("_e", lambda x: x / total)),
            "prediction": (F.array_position("_margin", top) - 1).cast("double"),
        }).drop("_margin", "_e")

    def importances(self) -> list[tuple[str, float]]:
        """Mean gain of a feature's splits, as a share of all features' means, largest first."""
        gains: dict[str, list[float]] = {f: [] for f in self.features}
        for n in self.nodes:
            if n[5] is not None:
                gains[n[5]].append(n[7])
        mean = {f: sum(g) / len(g) if g else 0.0 for f, g in gains.items()}
        total = sum(mean.values()) or 1.0
        return sorted(((f, v / total) for f, v in mean.items()), key=lambda x: (-x[1], x[0]))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: BoostedTrees):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        own = self.instance
        DefaultParamsWriter.saveMetadata(own, path, self.sparkSession, extraMetadata={"features": own.features, "classes": own.classes})
        own.node_frame(self.sparkSession).coalesce(1).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path: str) -> BoostedTrees:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{BoostedTrees.__module__}.{BoostedTrees.__name__}")
        nodes = self.sparkSession.read.parquet(f"{path}/nodes").orderBy("round", "class", "node").collect()  # bounded by the model
        stage = BoostedTrees([tuple(r) for r in nodes], meta["features"], meta["classes"])
        stage._resetUid(meta["uid"])
        return stage

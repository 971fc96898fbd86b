"""Regression trees on binned rows, for boosting loops that fit many small trees on one table.

A feature's values become bins once: between at most `BINS` - 1 edges, found in a sample as
Spark's own trees do, or one bin per category. Features whose joint bins fit a byte share one
code, so flags ride along with a feature of many bins. The rows then stay in the executors as
blocks of codes with the score they have so far. Growing a tree takes one pass per level: every
block adds up gradient, hessian and rows per leaf and code, a task parts the codes into the bins
of their features, and the tasks' sums are added up. Of two
sibling leaves only the smaller one is summed, the other is what is left of their parent. The
driver holds these sums, whose size does not depend on the rows, and chooses the splits.

A grown tree becomes an ordinary Spark model, so scoring, saving and importances are Spark's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 64
CODES = 256
SAMPLE_ROWS = 10_000  # as many as Spark's trees take for the edges
LEAF = -1
# sums of up to so many tasks meet on the driver, those of more in the executors first
DIRECT_TASKS = 64

# codes (bundles x rows), label, score so far, and how many rows are learnt from, which come first
Block = tuple[np.ndarray, np.ndarray, np.ndarray, int]


@dataclass
class Binning:
    """Edges of a numeric feature's bins, or the number of categories of another one."""

    edges: list[np.ndarray]
    categories: list[int]  # 0: numeric

    @cached_property
    def sizes(self) -> list[int]:
        """Bins of each feature."""
        return [c or len(e) + 1 for e, c in zip(self.edges, self.categories, strict=True)]

    @cached_property
    def bundles(self) -> list[list[int]]:
        """Features that share a code, whose last feature counts in ones."""
        found: list[list[int]] = []
        many: list[int] = []
        for f in sorted(range(len(self.sizes)), key=lambda f: -self.sizes[f]):
            free = (i for i, m in enumerate(many) if m * self.sizes[f] <= CODES)
            if (i := next(free, None)) is None:
                found.append([f])
                many.append(self.sizes[f])
            else:
                found[i].append(f)
                many[i] *= self.sizes[f]
        return found

    @cached_property
    def places(self) -> list[tuple[int, int]]:
        """Of each feature its bundle and how many codes one of its bins counts for."""
        out = [(0, 0)] * len(self.sizes)
        for i, bundle in enumerate(self.bundles):
            step = 1
            for f in reversed(bundle):
                out[f] = i, step
                step *= self.sizes[f]
        return out

    def parted(self, sums: np.ndarray) -> np.ndarray:
        """Sums of codes, bundles x slots x `CODES`, as slots x bins, those of all features in a row."""
        out: list = [None] * len(self.sizes)
        for cells, bundle in zip(sums, self.bundles, strict=True):
            shape = [self.sizes[f] for f in bundle]
            cells = cells[:, : int(np.prod(shape))].reshape(-1, *shape)
            for j, f in enumerate(bundle):
                out[f] = cells.sum(axis=tuple(1 + k for k in range(len(shape)) if k != j))
        return np.concatenate(out, axis=1)

    def apart(self, sums: np.ndarray) -> np.ndarray:
        """Sums of bins in a row, 3 x slots x bins, as 3 x slots x features x `BINS`."""
        place = np.concatenate([f * BINS + np.arange(many) for f, many in enumerate(self.sizes)])
        out = np.zeros((*sums.shape[:2], len(self.sizes) * BINS))
        out[:, :, place] = sums
        return out.reshape(*sums.shape[:2], len(self.sizes), BINS)

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Codes, bundles x rows, of values, rows x features; a value on an edge lies below it."""
        out = np.zeros((len(self.bundles), len(values)), np.uint8)
        for f, (edges, many) in enumerate(zip(self.edges, self.categories, strict=True)):
            bins = values[:, f] if many else np.searchsorted(edges, values[:, f], "left")
            bundle, step = self.places[f]
            out[bundle] += (bins * step).astype(np.uint8)
        return out


def _edges(values: np.ndarray) -> np.ndarray:
    """Halfway between all values if they are few, else between those next to equal shares of the rows."""
    distinct, n = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) < BINS:
        return between
    share, reached = len(values) / BINS, np.cumsum(n)[:-1]
    near = np.abs(reached[None, :] - share * np.arange(1, BINS)[:, None]).argmin(axis=1)
    return between[np.unique(near)]


def binning(rows: DataFrame, inputs: PipelineModel) -> Binning:
    """Bins of the ``features`` that ``inputs`` makes; rows that are not learnt from should be left out."""
    known = inputs.transform(rows).schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    many = {a["idx"]: len(a["vals"]) for a in known}
    n = rows.count()
    if not n:
        raise ValueError("no rows to learn from")
    some = rows if n <= SAMPLE_ROWS else rows.sample(SAMPLE_ROWS / n, 42)
    values = np.array([r[0] for r in inputs.transform(some).select(vector_to_array("features")).collect()])
    categories = [many.get(f, 0) for f in range(values.shape[1])]
    if max(categories, default=0) > BINS:
        raise ValueError(f"a category has more than {BINS} values")
    return Binning([np.zeros(0) if c else _edges(values[:, f]) for f, c in enumerate(categories)], categories)


def binned(rows: DataFrame, inputs: PipelineModel, binning: Binning) -> DataFrame:
    """Blocks of rows from the features, ``label`` and the flag ``learnt``: codes and labels as bytes, those learnt from first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                learnt = b.column("learnt").to_numpy(zero_copy_only=False)
                order = np.concatenate([np.flatnonzero(learnt), np.flatnonzero(~learnt)])
                values = b.column("values").flatten().to_numpy().reshape(b.num_rows, -1)[order]
                label = b.column("label").to_numpy(zero_copy_only=False)[order]
                parts = [pa.array([x.tobytes()], pa.binary()) for x in (binning.codes(values), label)]
                counts = [pa.array([int(n)], pa.int64()) for n in (b.num_rows, learnt.sum())]
                yield pa.RecordBatch.from_arrays([*parts, *counts], ["codes", "label", "n", "n_learnt"])

    # the columns themselves: a vector would be packed and unpacked for every row
    names = inputs.stages[-1].getInputCols()
    values = F.array(*[F.col(c).cast("double") for c in names]).alias("values")
    indexed = PipelineModel(inputs.stages[:-1]).transform(rows).select(values, F.col("label").cast("float"), "learnt")
    return indexed.mapInArrow(cut, "codes binary, label binary, n bigint, n_learnt bigint")


def blocks(staged: DataFrame, tasks: int) -> RDD:
    """The staged blocks with a score of 0, dealt evenly over as many tasks."""

    def read(r) -> Block:
        codes = np.frombuffer(r.codes, np.uint8).reshape(-1, r.n)
        return codes, np.frombuffer(r.label, np.float32), np.zeros(r.n), r.n_learnt

    return staged.repartition(tasks).rdd.map(read)


class Tree:
    """Nodes of a tree: those below node i are 2 i + 1, where bins marked in ``below`` go, and 2 i + 2."""

    def __init__(self, depth: int) -> None:
        nodes = (2 << depth) - 1
        self.depth = depth
        self.feature = np.full(nodes, LEAF)
        self.below = np.zeros((nodes, BINS), bool)
        self.gain = np.zeros(nodes)
        self.sums = np.zeros((nodes, 3))  # gradient, hessian, rows
        # the split once more, by codes: the bundle of the feature, and the codes that go below
        self.bundle = np.zeros(nodes, np.int64)
        self.codes_below = np.zeros((nodes, CODES), bool)

    def split(self, node: int, feature: int, below: np.ndarray, binning: Binning) -> None:
        self.feature[node], self.below[node] = feature, below
        self.bundle[node], step = binning.places[feature]
        self.codes_below[node] = below[np.arange(CODES) // step % binning.sizes[feature]]

    def values(self) -> np.ndarray:
        """Newton step of each node."""
        return -self.sums[:, 0] / np.maximum(self.sums[:, 1], 1e-300)

    def leaves(self) -> list[int]:
        """The nodes that are not split and that rows can reach."""
        met, found = [0], []
        while met:
            node = met.pop()
            if self.feature[node] == LEAF:
                found.append(node)
            else:
                met += [2 * node + 1, 2 * node + 2]
        return found

    def reached(self, codes: np.ndarray, rows: np.ndarray, wanted: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The wanted nodes, none of which is below another one, and those of the rows that reach them."""
        wanted, ahead = set(wanted), set()
        for node in wanted:
            while node:
                node = (node - 1) // 2
                ahead.add(node)
        met = [(0, rows)]
        while met:
            node, rows = met.pop()
            if node in wanted:
                yield node, rows
                continue
            below = self.codes_below[node][codes[self.bundle[node]][rows]]
            first, second = 2 * node + 1, 2 * node + 2
            if first in wanted or first in ahead:
                met.append((first, rows[below]))
            if second in wanted or second in ahead:
                met.append((second, rows[~below]))


def _sums(part: Iterator[Block], terms: Callable, binning: Binning, tree: Tree | None, asked: Sequence[int]) -> np.ndarray | int:
    """Gradient, hessian and rows per node asked for and bin of the rows learnt from; 0 without rows."""
    shape = len(binning.bundles), len(asked) * CODES
    total, many = None, None
    for codes, label, raw, learnt in part:
        if total is None:
            total, many = np.zeros(shape, complex), np.zeros(shape, np.int64)
        if tree:
            slots = {node: i for i, node in enumerate(asked)}
            found = [(slots[node], rows) for node, rows in tree.reached(codes, np.arange(learnt), asked)]
            at = np.concatenate([rows for _, rows in found])
            first = np.repeat([i * CODES for i, _ in found], [len(rows) for _, rows in found])
        else:
            at, first = slice(learnt), 0
        grad, hess = terms(label[at], raw[at])
        both = grad + 1j * hess  # added up in one go
        for i, bundle in enumerate(codes):
            place = first + bundle[at].astype(np.int64)
            np.add.at(total[i], place, both)
            many[i] += np.bincount(place, None, shape[1])
    if total is None:
        return 0
    return np.stack([binning.parted(x.reshape(shape[0], -1, CODES)) for x in (total.real, total.imag, many)])


def _added(tree: Tree, rate: float) -> Callable[[Block], Block]:
    steps, leaves = rate * tree.values(), tree.leaves()

    def add(block: Block) -> Block:
        codes, label, raw, learnt = block
        raw = raw.copy()
        for leaf, rows in tree.reached(codes, np.arange(len(raw)), leaves):
            raw[rows] += steps[leaf]
        return codes, label, raw, learnt

    return add


def add_tree(rows: RDD, tree: Tree, rate: float) -> RDD:
    """The blocks with the tree's answers added to their scores."""
    return rows.map(_added(tree, rate))


def _together(parts: RDD, add: Callable):
    """What the tasks say, added up; a shuffle would leave its files behind in every pass."""
    return reduce(add, parts.collect()) if parts.getNumPartitions() <= DIRECT_TASKS else parts.treeReduce(add)


def first_sums(rows: RDD, binning: Binning, terms: Callable, loss: Callable) -> tuple[np.ndarray, float, int]:
    """Sums of the root, and the loss of the rows not learnt from with their number, in one pass."""

    def both(part: Iterator[Block]) -> Iterator[tuple[np.ndarray | int, float, int]]:
        held = [0.0, 0]

        def seen() -> Iterator[Block]:
            for block in part:
                _, label, raw, learnt = block
                losses = loss(label[learnt:], raw[learnt:])
                held[0] += float(losses.sum())
                held[1] += len(losses)
                yield block

        yield _sums(seen(), terms, binning, None, [0]), *held

    root, lost, n = _together(rows.mapPartitions(both), lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
    return binning.apart(root), lost, n


def _splits(sums: np.ndarray, categories: Sequence[int], leaf_rows: int) -> list[tuple | None]:
    """Best split of each slot (sums: 3 x slots x features x bins): gain, feature, bins below, sums below."""
    grad, hess, n = sums
    # categories in the order of their means, those without rows last; numbers in their own
    order, named = np.broadcast_to(np.arange(BINS), n.shape).copy(), np.flatnonzero(categories)
    mean = np.where(n > 0, -grad / np.maximum(hess, 1e-300), np.inf)[:, named]
    order[:, named] = np.argsort(mean, axis=2, kind="stable")
    below = np.cumsum(np.take_along_axis(sums, order[None], axis=3), axis=3)
    whole = below[..., -1:]
    above = whole - below
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = below[0] ** 2 / below[1] + above[0] ** 2 / above[1]
        gain = parts - whole[0] ** 2 / whole[1]
    allowed = (np.rint(below[2]) >= leaf_rows) & (np.rint(above[2]) >= leaf_rows) & (below[2] > 0) & (above[2] > 0)
    gain = np.where(allowed & (gain > 0), gain, -np.inf).reshape(len(n), -1)
    found = []
    for slot, best in enumerate(gain.argmax(axis=1)):
        feature, cut = divmod(int(best), BINS)
        if gain[slot, best] == -np.inf:
            found.append(None)
            continue
        mask = np.zeros(BINS, bool)
        mask[order[slot, feature, : cut + 1]] = True
        found.append((gain[slot, best], feature, mask, below[:, slot, feature, cut]))
    return found


def grow(rows: RDD, root: np.ndarray, binning: Binning, terms: Callable, depth: int, leaf_rows: int) -> Tree:
    """A tree on the rows learnt from, from the sums of its root; one pass for each further level."""
    tree = Tree(depth)
    held = {0: root}
    tree.sums[0] = root[:, 0, 0].sum(axis=1)
    for level in range(depth):
        nodes = list(held)
        found = _splits(np.concatenate([held[i] for i in nodes], axis=1), binning.categories, leaf_rows) if nodes else []
        smaller = []
        for node, split in zip(nodes, found, strict=True):
            if split is None:
                continue
            tree.gain[node], feature, mask, first = split
            tree.split(node, feature, mask, binning)
            tree.sums[2 * node + 1], tree.sums[2 * node + 2] = first, tree.sums[node] - first
            smaller.append(2 * node + 1 + int(first[2] * 2 > tree.sums[node][2]))
        if not smaller or level == depth - 1:
            break
        part = binning.apart(_together(rows.mapPartitions(lambda blocks, t=tree, s=smaller: [_sums(blocks, terms, binning, t, s)]), np.add))
        below = {}
        for i, node in enumerate(smaller):
            parent = (node - 1) // 2
            below[node] = part[:, i : i + 1]
            below[4 * parent + 3 - node] = held[parent] - part[:, i : i + 1]
        held = dict(sorted(below.items()))
    return tree


def spark_tree(spark: SparkSession, tree: Tree, binning: Binning) -> DecisionTreeRegressionModel:
    """The tree as a Spark model on the values of the features."""
    jvm = spark.sparkContext._jvm
    nodes = jvm.org.apache.spark.ml.tree
    # looked up once: every name is a call to the JVM
    leaf, inner, by_category, by_value = nodes.LeafNode, nodes.InternalNode, nodes.CategoricalSplit, nodes.ContinuousSplit
    calculator, parse = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.org.apache.spark.mllib.linalg.Vectors.parse
    values = tree.values().tolist()

    def doubles(*numbers: float):
        return parse(f"[{','.join(repr(float(x)) for x in numbers)}]").toArray()

    def node(i: int):
        grad, hess, n = tree.sums[i].tolist()
        # the spread within the node is not summed up: the stats hold weight, weighted sum and the least sum of squares
        stats = calculator(doubles(hess, -grad, grad * grad / max(hess, 1e-300)), round(n))
        feature = int(tree.feature[i])
        if feature == LEAF:
            return leaf(values[i], 0.0, stats)
        many = binning.categories[feature]
        if many:
            split = by_category(feature, doubles(*np.flatnonzero(tree.below[i][:many])), many)
        else:
            split = by_value(feature, float(binning.edges[feature][int(tree.below[i].sum()) - 1]))
        return inner(values[i], 0.0, float(tree.gain[i] / hess), node(2 * i + 1), node(2 * i + 2), split, stats)

    made = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", node(0), len(binning.categories))
    return DecisionTreeRegressionModel(made)

"""Random forests of spark.ml, grown where their rows are.

The settings, the cuts tried for a feature, the draws of each tree and the rules by
which a node is split are those of ``RandomForestRegressor``, and so are the trees.
Growing differs: spark.ml passes over all rows for every few nodes and sends statistics
of each node, of which a deep forest has millions.  Here the rows are packed once.  Nodes
of many rows are split by statistics, a level of all trees a pass; the rows of a node that
a task can hold travel to one task, which grows all that is below it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column

from ...storage import stored

# Draws of a node whose rows one task holds: some 30 MB.
TASK_DRAWS = 1 << 20
# Trees whose draws are stored and travel together, and bytes up to which more of them do.
TOGETHER = 5
TRAVEL_BYTES = 1 << 28
# Rows and nodes whose statistics are taken at once.
STEP_ROWS, STEP_NODES = 1 << 14, 256
# Rows of a node from which the statistics of its larger child are a difference.
LARGE = 1 << 15
# Impurity that spark.ml takes for none.
NO_IMPURITY = 2.0**-52


@dataclass
class Tree:
    """Nodes of a tree from its root on; ``left`` is 0 for a leaf, the right child is the next one.

    A row goes right where the bin of ``feature`` is above ``bin``.
    """

    left: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray


@dataclass
class _Growing:
    """A tree whose nodes of many rows are being split; ``below`` has the draws of those that tasks grow on."""

    left: list = field(default_factory=lambda: [0])
    feature: list = field(default_factory=lambda: [0])
    bin: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    below: dict = field(default_factory=dict)

    def table(self) -> Tree:
        kinds = (np.int32, np.int8, np.uint8, float)
        return Tree(*[np.array(x, dtype=k) for x, k in zip((self.left, self.feature, self.bin, self.value), kinds, strict=True)])


class Forest:
    """The forest of ``forest.fit(rows)``, and ``rows`` packed with their ``keys``.

    Rows, statistics and subtrees are tables in ``folder``, to be discarded after use.
    """

    def __init__(self, forest: RandomForestRegressor, rows: DataFrame, keys: list[str]):
        self.folder = f"isobar-forest-{uuid.uuid4().hex}"
        made, self.cuts = drawn(forest, rows, keys)
        self.trees = forest.getNumTrees()
        self.rows = stored(packed(made, self.trees), f"{self.folder}/rows", compression="zstd")
        self._depth, self._leaf_rows = forest.getMaxDepth(), forest.getMinInstancesPerNode()
        # spark.ml may find a cut or two more than it asks for.
        self._bins = max(len(known) for known in self.cuts) + 1
        self._node_bytes = forest.getMaxMemoryInMB() << 20
        self._count = self.rows.agg(F.sum("n")).first()[0]
        self._top = [_Growing() for _ in range(self.trees)]
        self._split_large()
        self._below = self._grow_below()

    def read(self, first: int, last: int) -> list[Tree]:
        """Trees ``first`` up to, not including, ``last``."""
        parts: dict = {t: {} for t in range(first, last)}
        for held, table in self._below:
            if held.stop <= first or last <= held.start:
                continue
            for r in table.where(F.col("tree").between(first, last - 1)).collect():
                parts[r.tree][r.node] = Tree(
                    np.frombuffer(r.left, np.int32), np.frombuffer(r.feature, np.int8),
                    np.frombuffer(r.bin, np.uint8), np.frombuffer(r.value, float),
                )
        return [_joined(self._top[t].table(), parts[t]) for t in range(first, last)]

    def _columns(self, trees) -> list[str]:
        return sorted({_group(t) for t in trees})

    def _split_large(self) -> None:
        """Split nodes of more than TASK_DRAWS draws, a level of all trees a pass."""
        if self._count <= TASK_DRAWS:
            for tree in self._top:
                tree.below[0] = self._count
            return
        # Root: no statistics of a parent. Else the child with fewer draws, and its sibling.
        wanted = [(t, 0, 0, -1) for t in range(self.trees)]
        parents: list[DataFrame] = []
        for level in range(self._depth):
            most = max(1, self._node_bytes // (len(self.cuts) * self._bins * 16))
            parts = [self._statistics(wanted[i : i + most], level, parents) for i in range(0, len(wanted), most)]
            parents, wanted = parts, []
            for r in (r for part in parts for r in part.drop("sums").collect()):
                tree = self._top[r.tree]
                if r.gain <= 0:
                    continue
                at = len(tree.left)
                tree.left[r.node], tree.feature[r.node], tree.bin[r.node] = at, r.feature, r.bin
                for count, total in ((r.left_count, r.left_sum), (r.right_count, r.right_sum)):
                    for of, first in ((tree.left, 0), (tree.feature, 0), (tree.bin, 0), (tree.value, total / count)):
                        of.append(first)
                last = level + 1 == self._depth
                tree.below |= {at + i: n for i, n in enumerate((r.left_count, r.right_count)) if n <= TASK_DRAWS and not last}
                if max(r.left_count, r.right_count) > TASK_DRAWS and not last:
                    fewer = int(r.right_count < r.left_count)
                    wanted.append((r.tree, r.node, at + fewer, at + 1 - fewer))
            if not wanted:
                return

    def _statistics(self, wanted: list[tuple], level: int, parents: list[DataFrame]) -> DataFrame:
        """The best split of each wanted node and its sibling, and their ``sums`` for the next level."""
        features, bins, leaf_rows = len(self.cuts), self._bins, self._leaf_rows
        slots: dict = {}
        for tree, parent, node, sibling in wanted:
            slots.setdefault(tree, []).append((node, parent, sibling))
        tops = {t: self._top[t].table() for t in slots}

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {t: np.zeros((2, features, len(of) * bins)) for t, of in slots.items()}
            place = {}
            for t, of in slots.items():
                place[t] = np.full(len(tops[t].left), -1)
                place[t][[node for node, _, _ in of]] = np.arange(len(of))
            part = TaskContext.get().partitionId()
            for _, label, binned, draws in _chunks(batches, features):
                for t in slots:
                    at, node = _descended(tops[t], binned, draws(t), level)
                    slot = place[t][node]
                    at, slot = at[slot >= 0], slot[slot >= 0] * bins
                    weight = draws(t)[at].astype(float)
                    weighted = weight * label[at]
                    for f in range(features):
                        cell = slot + binned[f][at]
                        for s, of in enumerate((weight, weighted)):
                            sums[t][s, f] += np.bincount(cell, of, sums[t].shape[2])
            for t, of in slots.items():
                cells = sums[t].reshape(2, features, len(of), bins).transpose(2, 0, 1, 3)
                yield _batch(
                    tree=pa.array([t] * len(of), pa.int32()), node=pa.array([p for _, p, _ in of], pa.int32()),
                    part=pa.array([part] * len(of), pa.int32()), sums=pa.array([x.tobytes() for x in cells], pa.binary()),
                )

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs_of = {(t, p): (n, s) for t, of in slots.items() for n, p, s in of}
            for (t, parent), some in _groups(batches, ("tree", "node")):
                if (t, parent) not in pairs_of:
                    continue
                node, sibling = pairs_of[t, parent]
                whole, one = None, np.zeros((2, features, bins))
                for r in some:
                    found = np.frombuffer(r["sums"]).reshape(2, features, bins)
                    if r["part"] < 0:
                        whole = found
                    else:
                        one = one + found
                pairs = [(node, one)] if whole is None else [(node, one), (sibling, whole - one)]
                yield _batch_of([{"tree": t, "node": n, **_best_split(x, leaf_rows), "sums": x.tobytes()} for n, x in pairs], result)

        shape = "tree int, node int, part int, sums binary"
        result = "tree int, node int, feature int, bin int, gain double, left_count double, left_sum double, right_count double, right_sum double, sums binary"
        source = self.rows.select("n", "label", "bins", *self._columns(slots))
        sums = source.mapInArrow(taken, shape)
        for held in parents:
            sums = sums.unionByName(held.select("tree", "node", F.lit(-1).alias("part"), "sums"))
        dealt = sums.repartition(len(wanted) // 16 + 1, "tree", "node").sortWithinPartitions("tree", "node", "part")
        return stored(dealt.mapInArrow(best, result), f"{self.folder}/nodes")

    def _grow_below(self) -> list[tuple[range, DataFrame]]:
        """The subtrees of all nodes that tasks grow on, some trees at a time."""
        one = self._count * 0.64 * (len(self.cuts) + 9) * TOGETHER
        step = TOGETHER * max(1, int(TRAVEL_BYTES // max(one, 1)))
        together = [range(t, min(t + step, self.trees)) for t in range(0, self.trees, step)]
        return [(trees, self._subtrees(trees)) for trees in together]

    def _subtrees(self, trees: range) -> DataFrame:
        features, bins, depth, leaf_rows = len(self.cuts), self._bins, self._depth, self._leaf_rows
        tops = {t: self._top[t].table() for t in trees}
        below: dict = {t: {} for t in trees}
        before = 0
        for t, node, draws in ((t, node, draws) for t in trees for node, draws in self._top[t].below.items()):
            # Small nodes share a task, which grows one after the other.
            below[t][node] = int(before // (TASK_DRAWS // 2))
            before += draws

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for place, label, binned, draws in _chunks(batches, features):
                for t in trees:
                    at, node = _descended(tops[t], binned, draws(t), depth)
                    found = []
                    for n, task in below[t].items():
                        some = at[node == n] if len(tops[t].left) > 1 else at
                        found.append({
                            "task": task, "tree": t, "node": n, "part": place[0], "chunk": place[1], "label": label[some].tobytes(),
                            "bins": binned[:, some].tobytes(), "weight": draws(t)[some].tobytes(),
                        })
                    yield _batch_of([r for r in found if r["weight"]], moved)

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (t, node), some in _groups(batches, ("tree", "node")):
                label, weight, binned = [], [], []
                for r in some:
                    label.append(np.frombuffer(r["label"]))
                    weight.append(np.frombuffer(r["weight"], np.uint8))
                    binned.append(np.frombuffer(r["bins"], np.uint8).reshape(features, -1))
                levels = depth - _level(tops[t], node)
                tree = grow_tree(np.concatenate(label), np.concatenate(weight), np.concatenate(binned, axis=1), levels, leaf_rows, bins)
                arrays = {name: getattr(tree, name).tobytes() for name in ("left", "feature", "bin", "value")}
                yield _batch_of([{"tree": t, "node": node, **arrays}], result)

        moved = "task int, tree int, node int, part int, chunk int, label binary, bins binary, weight binary"
        result = "tree int, node int, left binary, feature binary, bin binary, value binary"
        source = self.rows.select("part", "chunk", "n", "label", "bins", *self._columns(trees))
        dealt = source.mapInArrow(sent, moved).repartitionById(int(before // (TASK_DRAWS // 2)) + 1, F.col("task"))
        return stored(dealt.sortWithinPartitions("tree", "node", "part", "chunk").mapInArrow(grow, result), f"{self.folder}/trees")


def packed(made: DataFrame, trees: int) -> DataFrame:
    """A row for each few thousand rows of :func:`drawn`: bins by feature, draws by tree, a byte each."""
    names = sorted({_group(t) for t in range(trees)})
    shape = T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("part", "chunk", "n")]
        + [T.StructField("keys", T.ArrayType(made.schema["keys"].dataType))]
        + [T.StructField(n, T.BinaryType()) for n in ("label", "bins", *names)]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for chunk, batch in enumerate(batches):
            n = batch.num_rows
            if not n:
                continue
            bins, draws = (batch.column(c).flatten().to_numpy().reshape(n, -1).T.astype(np.uint8) for c in ("bins", "draws"))
            numbers = {name: pa.array([x], pa.int32()) for name, x in (("part", part), ("chunk", chunk), ("n", n))}
            keys = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("keys"))
            label = batch.column("label").to_numpy(zero_copy_only=False).tobytes()
            of = {name: pa.array([draws[i * TOGETHER : (i + 1) * TOGETHER].tobytes()], pa.binary()) for i, name in enumerate(names)}
            yield _batch(**numbers, keys=keys, label=pa.array([label], pa.binary()), bins=pa.array([bins.tobytes()], pa.binary()), **of)

    return made.mapInArrow(pack, shape)


def _group(tree: int) -> str:
    """The column of a tree's draws."""
    return f"draws_{tree // TOGETHER:05d}"


def _chunks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple]:
    """Place, labels, bins by feature and a function that gives a tree's draws, of each packed row."""
    for batch in batches:
        for r in batch.drop_columns([c for c in batch.schema.names if c == "keys"]).to_pylist():
            n = r["n"]
            held = {name: np.frombuffer(x, np.uint8).reshape(-1, n) for name, x in r.items() if name.startswith("draws_")}
            yield (
                (r.get("part"), r.get("chunk")), np.frombuffer(r["label"]), np.frombuffer(r["bins"], np.uint8).reshape(features, n),
                lambda t, held=held: held[_group(t)][t % TOGETHER],
            )


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_KINDS = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def _batch_of(rows: list[dict], shape: str) -> pa.RecordBatch:
    named = [part.split() for part in shape.split(", ")]
    return _batch(**{name: pa.array([r[name] for r in rows], _KINDS[kind]) for name, kind in named})


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple]:
    """Neighbouring rows that agree in ``by``."""
    key, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if key != (now := tuple(r[c] for c in by)):
                if held:
                    yield key, held
                key, held = now, []
            held.append(r)
    if held:
        yield key, held


def _descended(tree: Tree, binned: np.ndarray, draws: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that a tree has drawn, and the node of each after so many levels."""
    at = np.flatnonzero(draws)
    node = np.zeros(len(at), dtype=np.intp)
    for _ in range(levels if len(tree.left) > 1 else 0):
        below = tree.left[node]
        if not below.any():
            break
        right = binned[tree.feature[node], at] > tree.bin[node]
        node = np.where(below > 0, below + right, node)
    return at, node


def _level(tree: Tree, node: int) -> int:
    levels = 0
    while node:
        (parent,) = np.flatnonzero((tree.left > 0) & ((tree.left == node) | (tree.left + 1 == node)))
        node, levels = int(parent), levels + 1
    return levels


def _best_split(sums: np.ndarray, leaf_rows: int) -> dict:
    """The best split by a node's counts and sums of labels; its gain is 0 if there is none."""
    up = sums.cumsum(axis=2)
    (count, total), (left, left_sum) = up[:, 0, -1], up[:, :, :-1]
    right, right_sum = count - left, total - left_sum
    fits = (left >= leaf_rows) & (right >= leaf_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left_sum**2 / left + right_sum**2 / right - total**2 / count, 0.0)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    names = ("gain", "left_count", "left_sum", "right_count", "right_sum")
    return {"feature": int(f), "bin": int(b), **{n: float(x[f, b]) for n, x in zip(names, (gain, left, left_sum, right, right_sum), strict=True)}}


def _joined(top: Tree, parts: dict[int, Tree]) -> Tree:
    """A tree and what has grown from some of its leaves."""
    pieces = [top.left.copy(), top.feature.copy(), top.bin.copy(), top.value.copy()]
    joined = [[x] for x in pieces]
    size = len(top.left)
    for node, part in parts.items():
        # The root takes the leaf's place, the other nodes follow the last one.
        moved = np.where(part.left > 0, part.left + (size - 1), 0).astype(np.int32)
        for of, piece, x in zip(joined, pieces, (moved, part.feature, part.bin, part.value), strict=True):
            piece[node] = x[0]
            of.append(x[1:])
        size += len(part.left) - 1
    return Tree(*[np.concatenate(x) for x in joined])


def _variance(count, total, squares):
    """Variance, as spark.ml computes it."""
    return (squares - (total * total) / count) / count


def grow_tree(label: np.ndarray, weight: np.ndarray, binned: np.ndarray, levels: int, leaf_rows: int, bins: int) -> Tree:
    """A regression tree of rows that one task holds, level by level.

    Sums are added up in the order of rows and of bins, as spark.ml does with rows of one
    partition: where two splits part a node alike, rounding decides between them.
    """
    weight = weight.astype(float)
    weighted = weight * label
    rows = _Rows((weight, weighted, weighted * label), binned, leaf_rows, bins)
    order, sizes, place = np.arange(len(label)), np.array([len(label)]), np.zeros(1, dtype=np.intp)
    stats = np.array([[x.sum()] for x in rows.shares])
    value, made, size = [stats[1] / stats[0]], [], 1
    wholes: dict[int, np.ndarray] = {}
    for level in range(levels):
        grows = (stats[0] >= 2 * leaf_rows) & ((np.abs(_variance(*stats)) >= NO_IMPURITY) | (level == 0))
        known = rows.known(order, sizes, grows, wholes)
        order, sizes, stats, place = order[np.repeat(grows, sizes)], sizes[grows], stats[:, grows], place[grows]
        wholes, found, pairs, start = {}, [], 0, 0
        for first, last in _steps(sizes, known):
            some = order[start : start + sizes[first:last].sum()]
            start += len(some)
            sums = known.pop(first) if first in known else rows.sums(some, sizes[first:last])
            split, *step = rows.split(some, sizes[first:last], stats[:, first:last], sums)
            found.append((place[first:last][split], *step))
            if len(split) and len(some) >= LARGE:
                wholes[pairs] = sums
            pairs += len(split)
        if not pairs:
            break
        nodes, feature, cut, order, sizes, stats = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
        place = size + np.arange(2 * pairs)
        made.append((nodes, place[::2], feature, cut))
        value.append(stats[1] / stats[0])
        size += 2 * pairs
    tree = Tree(np.zeros(size, np.int32), np.zeros(size, np.int8), np.zeros(size, np.uint8), np.concatenate(value))
    for nodes, *of in made:
        for array, x in zip((tree.left, tree.feature, tree.bin), of, strict=True):
            array[nodes] = x
    return tree


def _steps(sizes: np.ndarray, alone: dict) -> Iterator[tuple[int, int]]:
    """Runs of nodes of some STEP_ROWS rows together; those ``alone`` are runs of their own."""
    ends, first, single = np.cumsum(sizes), 0, sorted(alone)
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = min(first + STEP_NODES, max(first + 1, int(np.searchsorted(ends, before + STEP_ROWS, "right"))))
        if single and single[0] < last:
            last = max(first + (single[0] == first), single[0])
            single = single[single[0] < last :]
        yield first, last
        first = last


@dataclass
class _Rows:
    """Rows of a tree: draws, draws times label and times its square; bins by feature."""

    shares: tuple[np.ndarray, ...]
    binned: np.ndarray
    leaf_rows: int
    bins: int

    def sums(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of the shares by feature, node and bin, of ``rows`` that are ordered by node."""
        if len(sizes) == 1 and len(rows) > LARGE:
            return sum(self.sums(rows[i : i + LARGE], np.array([len(rows[i : i + LARGE])])) for i in range(0, len(rows), LARGE))
        cells = len(sizes) * self.bins
        base = np.repeat(np.arange(0, cells, self.bins), sizes)
        parts = [x[rows] for x in self.shares]
        out = np.empty((len(parts), len(self.binned), cells))
        for f, column in enumerate(self.binned):
            cell = base + column[rows]
            for s, part in enumerate(parts):
                out[s, f] = np.bincount(cell, part, cells)
        return out.reshape(len(parts), len(self.binned), len(sizes), self.bins)

    def known(self, order: np.ndarray, sizes: np.ndarray, grows: np.ndarray, wholes: dict) -> dict[int, np.ndarray]:
        """By place among the nodes that grow: the sums of children of ``wholes``, of the larger by difference."""
        starts, found, place = np.append(0, np.cumsum(sizes)), {}, np.cumsum(grows) - 1
        for pair, whole in wholes.items():
            fewer = 2 * pair + int(sizes[2 * pair + 1] < sizes[2 * pair])
            more = 4 * pair + 1 - fewer
            if grows[more] and sizes[more] >= LARGE // 2:
                one = self.sums(order[starts[fewer] : starts[fewer + 1]], sizes[[fewer]])
                found[int(place[more])] = whole - one
                if grows[fewer]:
                    found[int(place[fewer])] = one
        return found

    def split(self, rows: np.ndarray, sizes: np.ndarray, stats: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which nodes are split, by which feature and bin; rows, sizes and stats of their children."""
        up = sums.cumsum(axis=-1)
        whole = up[..., -1:]
        # A split after an empty bin is the split before it.
        fits = (up[0] >= self.leaf_rows) & (whole[0] - up[0] >= self.leaf_rows) & (sums[0] > 0)
        feature, node, cut = np.nonzero(fits)
        left = up[:, feature, node, cut]
        right = whole[:, feature, node, 0] - left
        count = left[0] + right[0]
        gain = np.full((len(sizes), len(self.binned) * self.bins), -np.inf)
        gain[node, feature * self.bins + cut] = (
            _variance(*stats)[node] - left[0] / count * _variance(*left) - right[0] / count * _variance(*right)
        )
        best = gain.argmax(axis=1)
        splits = np.flatnonzero(gain[np.arange(len(sizes)), best] > 0)
        feature, cut = np.divmod(best[splits], self.bins)
        left = up[:, feature, splits, cut]
        children = np.stack([left, whole[:, feature, splits, 0] - left], axis=-1).reshape(len(left), -1)
        if len(sizes) == 1:
            if not len(splits):
                return splits, feature, cut, rows[:0], sizes[:0], children
            right = self.binned[feature[0]][rows] > cut[0]
            return splits, feature, cut, np.append(rows[~right], rows[right]), np.array([(~right).sum(), right.sum()]), children
        rank = np.full(len(sizes), -1)
        rank[splits] = np.arange(len(splits))
        at = np.repeat(rank, sizes)
        rows, at = rows[at >= 0], at[at >= 0]
        child = (2 * at + (self.binned[feature[at], rows] > cut[at])).astype(np.uint16)
        return splits, feature, cut, rows[child.argsort(kind="stable")], np.bincount(child, minlength=2 * len(splits)), children


def drawn(forest: RandomForestRegressor, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows with ``keys``, ``label``, ``bins`` and the ``draws`` of each tree; the cuts of each feature.

    These are spark.ml's own steps before it grows a tree; it draws rows by partition and
    position.  Every feature has numbers, none has categories.
    """
    spark = rows.sparkSession
    jvm = spark._jvm
    forest._transfer_params_to_java()
    settings = forest._java_obj
    impl, encoders = jvm.org.apache.spark.ml.tree.impl, "org.apache.spark.sql.catalyst.encoders"
    plain = jvm.org.apache.spark.sql.catalyst.encoders.AgnosticEncoders
    number = _module(jvm, f"{encoders}.AgnosticEncoders$PrimitiveDoubleEncoder")
    integers = plain.ArrayEncoder(_module(jvm, f"{encoders}.AgnosticEncoders$PrimitiveIntEncoder"), False)

    checks = _module(jvm, "org.apache.spark.ml.util.DatasetUtils")
    checked = rows.select(
        Column(checks.checkRegressionLabels(forest.getLabelCol())).alias("label"),
        Column(checks.checkNonNegativeWeights(settings.get(settings.weightCol()))).alias("weight"),
        Column(checks.checkNonNanVectors(forest.getFeaturesCol())).alias("features"),
    )
    kind = jvm.org.apache.spark.ml.linalg.VectorUDT()
    vector = plain.UDTEncoder(kind, kind.getClass())
    instance = _product(jvm, "org.apache.spark.ml.feature.Instance", label=number, weight=number, features=vector)
    points = getattr(checked._jdf, "as")(instance).rdd()

    trees, seed = forest.getNumTrees(), forest.getSeed()
    regression = _module(jvm, "org.apache.spark.mllib.tree.configuration.Algo").Regression()
    no_categories = _module(jvm, "scala.collection.immutable.Map").empty()
    strategy = settings.getOldStrategy(no_categories, 0, regression, settings.getOldImpurity())
    facts = impl.DecisionTreeMetadata.buildMetadata(points, strategy, trees, forest.getFeatureSubsetStrategy())
    splits = _module(jvm, "org.apache.spark.ml.tree.impl.RandomForest").findSplits(points, facts, seed)
    binned = impl.TreePoint.convertToTreeRDD(points, splits, facts)
    bags = _module(jvm, "org.apache.spark.ml.tree.impl.BaggedPoint")
    same = getattr(bags, "convertToBaggedRDD$default$5")()
    bagged = bags.convertToBaggedRDD(binned, forest.getSubsamplingRate(), trees, forest.getBootstrap(), same, seed)

    named = rows.select(*keys)
    tree_point = _product(jvm, "org.apache.spark.ml.tree.impl.TreePoint", label=number, binnedFeatures=integers)
    bag = _product(jvm, "org.apache.spark.ml.tree.impl.BaggedPoint", datum=tree_point, subsampleCounts=integers)
    row = _module(jvm, f"{encoders}.RowEncoder").encoderFor(named._jdf.schema())
    beside = bagged.toJavaRDD().zip(named._jdf.toJavaRDD()).rdd()
    both = spark._jsparkSession.createDataset(beside, _product(jvm, "scala.Tuple2", _1=bag, _2=row)).toDF()
    made = DataFrame(both, spark).select(
        F.col("_2").alias("keys"),
        F.col("_1.datum.label").alias("label"),
        F.col("_1.datum.binnedFeatures").alias("bins"),
        F.col("_1.subsampleCounts").alias("draws"),
    )
    return made, [np.array([split.threshold() for split in feature], dtype=float) for feature in splits]


def _class(jvm, name: str):
    return jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(name)


def _module(jvm, name: str):
    """A Scala object."""
    return getattr(_class(jvm, f"{name}$").getField("MODULE$"), "get")(None)


def _product(jvm, name: str, **fields):
    """Encoder of a class by its members."""
    sql, none = jvm.org.apache.spark.sql, jvm.scala.Option.apply(None)
    field = jvm.org.apache.spark.sql.catalyst.encoders.AgnosticEncoders.EncoderField
    listed = [field(n, kind, False, sql.types.Metadata.empty(), none, none) for n, kind in fields.items()]
    members = jvm.scala.jdk.javaapi.CollectionConverters.asScala(listed).toSeq()
    tag = _module(jvm, "scala.reflect.ClassTag").apply(_class(jvm, name))
    return sql.catalyst.encoders.AgnosticEncoders.ProductEncoder(tag, members, none)

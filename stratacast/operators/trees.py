"""Regression trees grown leaf by leaf on binned features.

Features are cut into bins once; a row's bins are a short binary value, so the state
of a boosting run is a narrow table.  A node sends a set of bins of one feature to the left: a prefix of the
bins' order for numbers, and of the bins ordered by their Newton step for categories.

Growth is best first: the leaf whose split gains most is split next, until the number of leaves is reached.
Sums of gradients by leaf, feature and bin are made in tasks and added up in Spark, for all leaves that the queue may split next at
once (``Forest``), so a tree takes about as many jobs as it is deep.  Of two children the smaller is counted
and the other is the difference.  Several independent trees, one for each fold, grow in the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins that fit a byte; the first is for missing values.
MOST_BINS = 256
#: Added to a category's sum of hessians where categories are ordered.
SMOOTH = 10.0


@dataclass
class Binner:
    """Cuts of each numeric feature, or the codes of each categorical one; bin 0 is for missing and other values."""

    cuts: list[np.ndarray]
    categorical: list[bool]

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of features (missing: NaN)."""
        out = np.zeros(x.shape, dtype=np.uint8)
        for j, (cuts, by_code) in enumerate(zip(self.cuts, self.categorical, strict=True)):
            column, known = x[:, j], ~np.isnan(x[:, j])
            if not len(cuts):
                out[:, j] = known
            elif by_code:
                at = np.minimum(np.searchsorted(cuts, column[known]), len(cuts) - 1)
                out[known, j] = np.where(cuts[at] == column[known], at + 1, 0)
            else:
                out[known, j] = np.minimum(np.searchsorted(cuts, column[known]) + 1, len(cuts) + 1)
        return out


def fit_binner(rows: DataFrame, features: list[str], categories: tuple[str, ...], bins: int) -> Binner:
    """Cuts at quantiles of ``rows``; a category's codes are its ``bins - 2`` most frequent values."""
    bins = min(bins, MOST_BINS)
    numbers = [f for f in features if f not in categories]
    cast = rows.select(*[F.col(f).cast("double").alias(f) for f in features])
    found = dict(zip(numbers, cast.approxQuantile(numbers, [i / (bins - 1) for i in range(1, bins - 1)], 0.001), strict=True)) if numbers else {}
    cuts = []
    for f in features:
        if f in categories:
            top = cast.where(F.col(f).isNotNull()).groupBy(f).count().orderBy(F.desc("count"), f).limit(bins - 2).collect()
            cuts.append(np.array(sorted(r[0] for r in top)))
        else:
            cuts.append(np.unique(np.array([v for v in found[f] if v is not None and not np.isnan(v)])))
    return Binner(cuts, [f in categories for f in features])


def binned(rows: DataFrame, features: list[str], binner: Binner, keep: list[str], name: str = "bins") -> DataFrame:
    """The columns ``keep`` and the bins of ``features``, a byte each, as one binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((batch.num_rows, len(features)))
            for j in range(len(features)):
                x[:, j] = batch.column(len(keep) + j).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            flat = pa.Array.from_buffers(pa.binary(len(features)), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(binner.bins(x)).tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], flat.cast(pa.binary())], names=[*keep, name])

    ready = rows.select(*keep, *[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)])
    kinds = ", ".join(f"`{k}` {ready.schema[k].dataType.simpleString()}" for k in keep)
    return ready.mapInArrow(run, f"{kinds}, {name} binary")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of bins of a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


@dataclass
class Tree:
    """Nodes of a tree, the root first; ``feature`` is -1 at leaves, and the bins that ``left_bins`` (nodes by bins) holds go left."""

    feature: np.ndarray
    left_bins: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), dtype=np.int64)
        while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
            here = at[inner]
            goes_left = self.left_bins[here, bins[inner, self.feature[here]]]
            at[inner] = np.where(goes_left, self.left[here], self.right[here])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass
class Growth:
    """A tree that grows: nodes, their sums by feature and bin (count, gradient, hessian), and the best split of each."""

    nodes: list[list] = field(default_factory=lambda: [[-1, np.zeros(MOST_BINS, dtype=bool), 0, 0]])
    sums: dict[int, np.ndarray] = field(default_factory=dict)
    splits: dict[int, tuple[float, int, np.ndarray]] = field(default_factory=dict)
    totals: dict[int, np.ndarray] = field(default_factory=dict)
    depth: dict[int, int] = field(default_factory=lambda: {0: 0})

    def tree(self, values: dict[int, float]) -> Tree:
        feature, masks, left, right = zip(*self.nodes, strict=True)
        value = np.array([values.get(i, 0.0) for i in range(len(self.nodes))])
        return Tree(np.array(feature), np.array(masks), np.array(left), np.array(right), value)


@dataclass(frozen=True)
class Limits:
    leaves: int
    depth: int
    min_rows: int
    l1: float
    l2: float


def newton_step(g: float, h: float, l1: float = 0.0, l2: float = 0.0) -> float:
    """The regularised minimum of ``g x + h x^2 / 2`` over a leaf's sums."""
    return -float(np.sign(g)) * max(abs(g) - l1, 0.0) / max(h + l2, 1e-12)


def _worth(g: np.ndarray, h: np.ndarray, limits: Limits) -> np.ndarray:
    return np.maximum(np.abs(g) - limits.l1, 0.0) ** 2 / np.maximum(h + limits.l2, 1e-12)


def best_split(sums: np.ndarray, categorical: list[bool], used: list[int], limits: Limits) -> tuple[float, int, np.ndarray] | None:
    """``(gain, feature, bins that go left)`` of a node's sums (features, bins, 3), None where no split gains."""
    best = None
    total = sums[used[0]].sum(axis=0)
    base = _worth(total[1], total[2], limits)
    for j in used:
        order = np.arange(sums.shape[1])
        if categorical[j]:
            held = np.flatnonzero(sums[j, :, 0] > 0)
            order = held[np.argsort(sums[j, held, 1] / (sums[j, held, 2] + SMOOTH), kind="stable")]
        run = sums[j, order].cumsum(axis=0)[:-1]
        rest = total - run
        fits = (run[:, 0] >= max(1, limits.min_rows)) & (rest[:, 0] >= max(1, limits.min_rows))
        if not fits.any():
            continue
        gain = np.where(fits, _worth(run[:, 1], run[:, 2], limits) + _worth(rest[:, 1], rest[:, 2], limits) - base, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > 1e-12 * max(1.0, float(base)) and (best is None or gain[at] > best[0]):
            mask = np.zeros(MOST_BINS, dtype=bool)
            mask[order[: at + 1]] = True
            best = (float(gain[at]), j, mask)
    return best


def node_sums(step: DataFrame, trees: dict[int, Tree], asked: dict[int, list[int]], width: int, n_bins: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums (features, bins, 3) of the nodes ``asked`` of each fold's tree, over ``step`` (fold, bins, grad, hess).

    Each task adds up its own rows; what is shuffled is a row for each task, node and feature.
    """
    plain = {f: (t.feature, t.left_bins, t.left, t.right, t.value) for f, t in trees.items()}  # a broadcast knows no classes of this package
    shared = step.sparkSession.sparkContext.broadcast((plain, asked))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wanted = shared.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy()
            bins, g, h = matrix(batch.column(1), width), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for fold in np.unique(folds):
                rows = np.flatnonzero(folds == fold)
                if int(fold) not in wanted:
                    continue
                at = Tree(*held[int(fold)]).leaves(bins[rows])
                for node in wanted[int(fold)]:
                    own = rows[at == node]
                    if not len(own):
                        continue
                    key = (int(fold), node)
                    if key not in sums:
                        sums[key] = np.zeros((width, n_bins, 3))
                    place = (bins[own].astype(np.int64) + np.arange(width) * n_bins).ravel()
                    for i, values in enumerate((None, np.repeat(g[own], width), np.repeat(h[own], width))):
                        sums[key][:, :, i] += np.bincount(place, values, width * n_bins).reshape(width, n_bins)
        rows = [(fold, node, j, part[j].tobytes()) for (fold, node), part in sums.items() for j in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["fold", "node", "feature", "held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(part)
                sums[tuple(key)] = sums[tuple(key)] + values if tuple(key) in sums else values
        columns = [[k[i] for k in sums] for i in range(3)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["fold", "node", "feature", "held"])

    kinds = "fold int, node int, feature int, held binary"
    parts = step.select("fold", "bins", "grad", "hess").mapInArrow(count, kinds).repartition("fold", "node", "feature").mapInArrow(add, kinds).toArrow()
    shared.destroy()
    out: dict[tuple[int, int], np.ndarray] = {}
    for fold, node, j, held in zip(*(parts[c].to_pylist() for c in ("fold", "node", "feature", "held")), strict=True):
        out.setdefault((fold, node), np.zeros((width, n_bins, 3)))[j] = np.frombuffer(held).reshape(n_bins, 3)
    return out


def grow(step: DataFrame, folds: list[int], categorical: list[bool], used: list[int], limits: Limits, n_bins: int = MOST_BINS) -> dict[int, Tree]:
    """A tree for each fold of ``step`` (fold, bins, grad, hess), best leaves first."""
    width = len(categorical)
    growing = {fold: Growth() for fold in folds}
    for (fold, node), sums in node_sums(step, {f: g.tree({}) for f, g in growing.items()}, {f: [0] for f in folds}, width, n_bins).items():
        _settle(growing[fold], node, sums, categorical, used, limits)
    while True:
        trees, asked, pairs = {}, {}, {}
        for fold, g in growing.items():
            # every split that the queue may still come to is made, and its smaller child asked for, in one job
            for leaf in _open(g, limits):
                pairs.setdefault(fold, []).append(_divide(g, leaf))
            if fold in pairs:
                trees[fold], asked[fold] = g.tree({}), [small for small, _, _ in pairs[fold]]
        if not pairs:
            break
        found = node_sums(step, trees, asked, width, n_bins)
        for fold, made in pairs.items():
            for small, other, parent in made:
                sums = found.get((fold, small), np.zeros((width, n_bins, 3)))
                _settle(growing[fold], small, sums, categorical, used, limits)
                _settle(growing[fold], other, growing[fold].sums[parent] - sums, categorical, used, limits)
                del growing[fold].sums[parent]
    return {fold: _best_first(g, limits) for fold, g in growing.items()}


def _settle(g: Growth, node: int, sums: np.ndarray, categorical: list[bool], used: list[int], limits: Limits) -> None:
    g.sums[node] = sums
    g.totals[node] = sums[used[0]].sum(axis=0)
    if g.depth[node] < limits.depth and (split := best_split(sums, categorical, used, limits)) is not None:
        g.splits[node] = split


def _taken(g: Growth, limits: Limits) -> tuple[list[int], list[int]]:
    """Nodes that best-first growth splits, as far as sums are known, and leaves that it would split next without knowing their children."""
    taken, queue, waiting = [], [0], []
    while queue and len(taken) + len(waiting) < limits.leaves - 1:
        queue.sort(key=lambda n: (-g.splits[n][0] if n in g.splits else np.inf, n))
        node = queue.pop(0)
        if node not in g.splits:
            break
        if g.nodes[node][0] < 0:
            waiting.append(node)
        else:
            taken.append(node)
            queue += g.nodes[node][2:4]
    return taken, waiting


def _open(g: Growth, limits: Limits) -> list[int]:
    return _taken(g, limits)[1]


def _divide(g: Growth, leaf: int) -> tuple[int, int, int]:
    """Give ``leaf`` its two children: ``(the one with fewer rows, the other, leaf)``."""
    _, j, mask = g.splits[leaf]
    left, right = len(g.nodes), len(g.nodes) + 1
    g.nodes[leaf] = [j, mask, left, right]
    g.nodes += [[-1, np.zeros(MOST_BINS, dtype=bool), 0, 0] for _ in range(2)]
    g.depth[left] = g.depth[right] = g.depth[leaf] + 1
    few = 2 * g.sums[leaf][j, mask[: g.sums[leaf].shape[1]], 0].sum() <= g.sums[leaf][j, :, 0].sum()
    return (left, right, leaf) if few else (right, left, leaf)


def _best_first(g: Growth, limits: Limits) -> Tree:
    """The tree of the splits that best-first growth takes; what was made beyond them is left out."""
    taken, _ = _taken(g, limits)
    kept, nodes, values = set(taken), [], {}

    def copy(node: int) -> int:
        at = len(nodes)
        nodes.append([-1, np.zeros(MOST_BINS, dtype=bool), 0, 0])
        if node in kept:
            j, mask, left, right = g.nodes[node]
            nodes[at] = [j, mask, copy(left), copy(right)]
        else:
            _, grad, hess = g.totals[node]
            values[at] = newton_step(grad, hess, limits.l1, limits.l2)
        return at

    copy(0)
    return Growth(nodes=nodes).tree(values)

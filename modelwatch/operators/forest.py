"""A random forest grown on a binned matrix, with a minimum size for a split.

Features are cut at up to ``BINS - 1`` quantiles, and rows are packed into chunks
of one byte a feature.  Rows of the same bins and label lie on the same side of
every cut, so where the bins have no more combinations (cells) than there are rows,
``CELLS`` at most, a single pass adds up how often each tree sees the rows of each
cell and label, and a group per tree grows it from those sums.  The trees are those
that the rows themselves give.

With more cells, every pass over the matrix serves all trees:

* nodes of more than ``LOCAL_ROWS`` rows are split level by level: tasks count
  (node, feature, bin, class), the counts are summed per node, and the best cut of
  each node comes back to the driver;
* the rows of smaller nodes are sent to a group per (tree, node), which grows the
  rest of that subtree.  A group is never larger than ``LOCAL_ROWS``.

Counts are whole numbers and the draws depend on the seed, the tree and the chunk,
so a task that runs again counts the same.  A tree sees each row as often as a
Poisson draw says; classes weigh the same in total; a node looks at the square
root of the number of features, of those that differ in it.  A node of fewer
than ``min_samples_split`` different rows, of one class or at ``max_depth`` is a leaf.

Rows whose label is neither 0 nor 1 take no part.  A missing value counts as the
smallest.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..session import materialise

for _module in (__name__, Settings.__module__):  # executors need no copy of the package
    cloudpickle.register_pickle_by_value(sys.modules[_module])

BINS = 32
#: Rows of a node (drawn ones, repeats counted) that one task grows to the end.
LOCAL_ROWS = 1 << 18
CHUNK_ROWS = 1 << 12
#: Counts that a task of a level pass holds; a level of more nodes takes more passes.
COUNT_BYTES = 128 << 20
#: Rows that a task holds back before it sends them to their nodes.
HELD_BYTES = 64 << 20
TASK_ROWS = 200_000
#: Most cells that rows are added up in, and that a scoring task remembers.
CELLS = BINS**4
#: Rows that a task adds up at a time; all trees send a record for each such block.
BLOCK_ROWS = 1 << 22
#: What one row that is drawn at all adds to a sum of draws, which stays below it.
_SEEN = 1 << 27
_SLICE = 8192
_NODES = "tree int, node long, feature int, threshold double, weight double, share double"


def draws(seed: int, tree: int, chunk: int, n: int) -> np.ndarray:
    """How often a tree sees each row of a chunk."""
    source = np.random.Philox(key=np.array([seed, tree], np.uint64), counter=np.array([0, chunk, 0, 0], np.uint64))
    return np.random.Generator(source).poisson(1.0, n).astype(np.uint8)


def drawer(seed: int, tree: int) -> Callable[[int, int], np.ndarray]:
    """``draws`` of one tree by chunk and number of rows, with one generator for all chunks."""
    source = np.random.Philox(key=np.array([seed, tree], np.uint64))
    generator, state = np.random.Generator(source), source.state

    def draw(chunk: int, n: int) -> np.ndarray:
        state["state"]["counter"][:] = (0, chunk, 0, 0)
        source.state = state
        return generator.poisson(1.0, n).astype(np.uint8)

    return draw


def ranks(seed: int, tree: int, nodes: np.ndarray, n_features: int) -> np.ndarray:
    """An order of the features for each node, by a hash."""
    with np.errstate(over="ignore"):
        x = nodes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(n_features, dtype=np.uint64)
        x += np.uint64((seed * 0xD1B54A32D192ED03 + tree * 0x8CB92BA72F3D8DD7) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        return (x ^ x >> np.uint64(31)) >> np.uint64(1)


def best_cuts(counts: Iterable[np.ndarray], order: np.ndarray, weights: Sequence[float], look_at: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) of the cut with the least Gini impurity for each node; feature
    -1 where all rows are alike.  ``counts`` has (node, bin, class) per feature;
    rows of a bin above the cut go right."""
    gains, bins = [], []
    for count in counts:
        left = np.cumsum(count, axis=1)[:, :-1] * np.asarray(weights, float)
        right = count.sum(axis=1)[:, None] * np.asarray(weights, float) - left
        n_left, n_right = left.sum(axis=2), right.sum(axis=2)
        # from the counts, as a difference of weights may miss zero
        below = np.cumsum(count.sum(axis=2), axis=1)
        possible = (below[:, :-1] > 0) & (below[:, :-1] < below[:, -1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(possible, (left**2).sum(axis=2) / n_left + (right**2).sum(axis=2) / n_right, -np.inf)
        bins.append(gain.argmax(axis=1))
        gains.append(gain.max(axis=1))
    gain, bin_ = np.stack(gains, axis=1), np.stack(bins, axis=1)
    flat = np.isneginf(gain)
    place = np.argsort(np.argsort(np.where(flat, np.uint64(2**64 - 1), order), axis=1, kind="stable"), axis=1, kind="stable")
    gain[place >= look_at] = -np.inf
    feature = gain.argmax(axis=1)
    chosen = bin_[np.arange(len(bin_)), feature]
    return np.where(flat.all(axis=1), -1, feature), chosen


def grow_node(
    bins: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, root: int, settings: Settings, weights: Sequence[float], seen: np.ndarray | None = None
) -> dict:
    """The subtree of a node from its rows: arrays node, feature, bin, n0, n1.  Where
    equal rows are added up, ``seen`` has their number and ``w`` the sum of their draws."""
    seen = np.ones(len(y)) if seen is None else seen
    n_features = len(bins)
    look_at = max(1, int(n_features**0.5))
    slot, heap, depth = np.zeros(len(y), np.int64), np.array([root], np.int64), int(root).bit_length() - 1
    found: dict[str, list] = {"node": [], "feature": [], "bin": [], "n0": [], "n1": []}
    while len(heap):
        k = len(heap)
        by_class = np.bincount(slot * 2 + y, w, 2 * k).reshape(k, 2)
        able = (by_class > 0).all(axis=1) & (np.bincount(slot, seen, k) >= settings.min_samples_split)
        able &= depth < settings.max_depth
        feature, cut = np.full(k, -1), np.zeros(k, np.int64)
        for start in range(0, k, _SLICE):
            nodes = np.flatnonzero(able[start : start + _SLICE]) + start
            if not len(nodes):
                continue
            index = np.full(k, -1)
            index[nodes] = np.arange(len(nodes))
            rows = np.flatnonzero(index[slot] >= 0)
            base, weight, m = index[slot[rows]] * (BINS * 2) + y[rows], w[rows], len(nodes)
            counts = (np.bincount(base + bins[f][rows].astype(np.int64) * 2, weight, m * BINS * 2).reshape(m, BINS, 2) for f in range(n_features))
            feature[nodes], cut[nodes] = best_cuts(counts, ranks(settings.seed, tree, heap[nodes], n_features), weights, look_at)
        for name, values in (("node", heap), ("feature", feature), ("bin", cut), ("n0", by_class[:, 0]), ("n1", by_class[:, 1])):
            found[name].append(values)
        parents = np.flatnonzero(feature >= 0)
        index = np.full(k, -1)
        index[parents] = np.arange(len(parents))
        rows = np.flatnonzero(index[slot] >= 0)
        here = slot[rows]
        bins, y, w, seen = bins[:, rows], y[rows], w[rows], seen[rows]
        right = bins[feature[here], np.arange(len(rows))] > cut[here]
        slot = index[here] * 2 + right
        heap = (heap[parents, None] * 2 + np.array([0, 1])).reshape(-1)
        depth += 1
    return {name: np.concatenate(parts) for name, parts in found.items()}


class _Top:
    """The nodes of a tree above those that are grown by groups."""

    def __init__(self, rows: tuple[int, int]) -> None:
        self.node, self.feature, self.bin, self.left, self.counts = [1], [-1], [0], [0], [rows]

    def split(self, at: int, feature: int, cut: int, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
        self.feature[at], self.bin[at], self.left[at] = feature, cut, len(self.node)
        for side, counts in enumerate((left, right)):
            self.node.append(2 * self.node[at] + side)
            self.counts.append(counts)
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
        return self.left[at], self.left[at] + 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.bin), np.array(self.left)


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The place among a tree's nodes that each row ends at."""
    at = np.zeros(bins.shape[1], np.int64)
    rows = np.arange(bins.shape[1]) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(rows):
        here = at[rows]
        at[rows] = left[here] + (bins[feature[here], rows] > cut[here])
        rows = rows[feature[at[rows]] >= 0]
    return at


def _chunks(batch: pa.RecordBatch, n_features: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for chunk, bins, labels in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        yield chunk, np.frombuffer(bins, np.uint8).reshape(n_features, -1), np.frombuffer(labels, np.uint8).astype(np.int64)


def binned(rows: DataFrame, borders: list[np.ndarray]) -> DataFrame:
    """chunk, bins (feature by feature, a byte a row), labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(start, CHUNK_ROWS)
                values = [c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in part.columns[:-1]]
                bins = [np.where(np.isnan(v), 0, np.searchsorted(b, v)).astype(np.uint8) for v, b in zip(values, borders, strict=True)]
                labels = part.columns[-1].to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [number], "bins": [b"".join(b.tobytes() for b in bins)], "labels": [labels.tobytes()]},
                    pa.schema([("chunk", pa.int64()), ("bins", pa.binary()), ("labels", pa.binary())]),
                )
                number += 1

    return rows.mapInArrow(run, "chunk long, bins binary, labels binary")


def _count_level(matrix: DataFrame, tops: dict[int, tuple], slots: dict[int, np.ndarray], n_features: int, settings: Settings, weights) -> list:
    """Best cuts of the nodes with a slot: tree, slot, feature, bin and the counts on both sides."""
    look_at = max(1, int(n_features**0.5))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {t: np.zeros((int(s.max()) + 1, n_features, BINS * 2), np.int64) for t, s in slots.items()}
        seen = {t: np.zeros(len(counts), np.int64) for t, counts in held.items()}  # different rows
        for batch in batches:
            for chunk, bins, y in _chunks(batch, n_features):
                for t, slot in slots.items():
                    w = draws(settings.seed, t, chunk, len(y))
                    here = slot[walk(bins, *tops[t])]
                    rows = np.flatnonzero((here >= 0) & (w > 0))
                    base, k = here[rows] * (BINS * 2) + y[rows], len(held[t])
                    seen[t] += np.bincount(here[rows], minlength=k)
                    for f in range(n_features):
                        held[t][:, f] += np.bincount(base + bins[f][rows].astype(np.int64) * 2, w[rows], k * BINS * 2).astype(np.int64).reshape(k, -1)
        for t, counts in held.items():
            yield pa.RecordBatch.from_pydict(
                {"tree": pa.array([t] * len(counts), pa.int32()), "slot": pa.array(range(len(counts)), pa.int32()), "counts": [c.tobytes() + n.tobytes() for c, n in zip(counts, seen[t], strict=True)]}
            )

    def decide(key: tuple, rows: pa.Table) -> pa.Table:
        t, slot = key[0].as_py(), key[1].as_py()
        added = sum(np.frombuffer(c, np.int64) for c in rows.column("counts").to_pylist())
        total = added[:-1].reshape(n_features, BINS, 2)
        node = nodes[t][slot : slot + 1]
        feature, cut = (int(x[0]) for x in best_cuts((c[None] for c in total), ranks(settings.seed, t, node, n_features), weights, look_at))
        if added[-1] < settings.min_samples_split:
            feature = -1
        left = total[max(feature, 0), : cut + 1].sum(axis=0)
        right = total[max(feature, 0), cut + 1 :].sum(axis=0)
        values = [t, slot, feature, cut, *left, *right]
        return pa.table({name: pa.array([int(v)], pa.int64()) for name, v in zip(("tree", "slot", "feature", "bin", "l0", "l1", "r0", "r1"), values, strict=True)})

    nodes = {t: tops[t][3][np.flatnonzero(s >= 0)] for t, s in slots.items()}
    tops = {t: arrays[:3] for t, arrays in tops.items()}
    counted = matrix.mapInArrow(count, "tree int, slot int, counts binary").groupBy("tree", "slot")
    return counted.applyInArrow(decide, "tree long, slot long, feature long, bin long, l0 long, l1 long, r0 long, r1 long").collect()


def _grow_small(matrix: DataFrame, tops: dict[int, tuple], small: dict[int, np.ndarray], n_features: int, settings: Settings, weights, borders) -> DataFrame:
    """The subtrees of the nodes marked in ``small``, each in the group of its rows."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = list(held)
            columns = [[b"".join(part[i].tobytes() for part in held[k]) for k in keys] for i in (1, 2)]
            bins = [np.concatenate([part[0] for part in held[k]], axis=1).tobytes() for k in keys]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array(bins, pa.binary()),
                 *[pa.array(c, pa.binary()) for c in columns]],
                ["tree", "node", "bins", "labels", "seen"],
            )

        for batch in batches:
            for chunk, bins, y in _chunks(batch, n_features):
                for t, wanted in small.items():
                    w = draws(settings.seed, t, chunk, len(y))
                    here = np.where(w > 0, wanted[walk(bins, *tops[t])], 0)
                    for node in np.unique(here[here > 0]).tolist():
                        rows = np.flatnonzero(here == node)
                        held.setdefault((t, node), []).append((bins[:, rows], y[rows].astype(np.uint8), w[rows]))
                        size += len(rows) * (n_features + 2)
                if size > HELD_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def grow(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.uint8).reshape(n_features, -1) for b in rows.column("bins").to_pylist()]
        y, w = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8) for c in ("labels", "seen"))
        t = key[0].as_py()
        found = grow_node(np.concatenate(parts, axis=1), y.astype(np.int64), w, t, key[1].as_py(), settings, weights)
        return _node_rows(np.full(len(found["node"]), t), *found.values(), weights, borders)

    groups = sum(len(np.unique(s[s > 0])) for s in small.values())
    tasks = min(groups, max(4 * matrix.sparkSession.sparkContext.defaultParallelism, groups // 16))
    sent = matrix.mapInArrow(send, "tree int, node long, bins binary, labels binary, seen binary").repartition(max(1, tasks), "tree", "node")
    return sent.groupBy("tree", "node").applyInArrow(grow, _NODES)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"u{len(packed) // n}")


def _grow_cells(matrix: DataFrame, n: int, settings: Settings, weights, borders) -> DataFrame:
    """Whole trees, each in a group, from the sums of its draws by cell and label."""
    shape = tuple(len(b) + 1 for b in borders)

    def added(codes: list[np.ndarray], chunks: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        cells, place = np.unique(np.concatenate(codes), return_inverse=True)
        drawn, value = np.empty(len(place), np.uint8), np.arange(256.0) + _SEEN * (np.arange(256) > 0)
        for t in range(settings.num_trees):
            draw, at = drawer(settings.seed, t), 0
            for chunk, size in chunks:
                drawn[at : at + size] = draw(chunk, size)
                at += size
            sums = np.bincount(place, value[drawn], len(cells)).astype(np.int64)
            some = np.flatnonzero(sums)
            if len(some):
                sums = sums[some]
                parts = np.diff(cells[some], prepend=0), sums % _SEEN, sums // _SEEN
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([len(some)], pa.int32()), *(pa.array([_packed(p)], pa.binary()) for p in parts)],
                    ["tree", "n", "steps", "drawn", "seen"],
                )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, chunks, held = [], [], 0
        for batch in batches:
            for chunk, bins, y in _chunks(batch, len(shape)):
                codes.append((np.ravel_multi_index(tuple(bins), shape) * 2 + y).astype(np.int32))
                chunks.append((chunk, len(y)))
                held += len(y)
                if held >= BLOCK_ROWS:
                    yield from added(codes, chunks)
                    codes, chunks, held = [], [], 0
        if held:
            yield from added(codes, chunks)

    def grow(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = key[0].as_py()
        drawn, seen = np.zeros(2 * math.prod(shape)), np.zeros(2 * math.prod(shape))
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("n", "steps", "drawn", "seen"))
            for size, steps, draws_, seen_ in zip(*columns, strict=True):
                cells = np.cumsum(_unpacked(steps, size), dtype=np.int64)
                drawn[cells] += _unpacked(draws_, size)
                seen[cells] += _unpacked(seen_, size)
        cells = np.flatnonzero(drawn)
        bins = np.stack(np.unravel_index(cells >> 1, shape)).astype(np.uint8)
        found = grow_node(bins, cells & 1, drawn[cells], t, 1, settings, weights, seen[cells])
        yield from _node_rows(np.full(len(found["node"]), t), *found.values(), weights, borders).to_batches()

    parallel = matrix.sparkSession.sparkContext.defaultParallelism
    blocks = matrix.repartition(min(max(2 * parallel, -(-n // BLOCK_ROWS)), -(-n // CHUNK_ROWS)), "chunk")
    sums = blocks.mapInArrow(add, "tree int, n int, steps binary, drawn binary, seen binary")
    return sums.repartition(max(1, min(settings.num_trees, 4 * parallel)), "tree").groupBy("tree").applyInArrow(grow, _NODES)


def _node_rows(tree, node, feature, cut, n0, n1, weights, borders) -> pa.Table:
    whole = n0 * weights[0] + n1 * weights[1]
    return pa.table(
        {
            "tree": pa.array(tree, pa.int32()),
            "node": pa.array(node, pa.int64()),
            "feature": pa.array(feature, pa.int32()),
            "threshold": pa.array([borders[f][c] if f >= 0 else None for f, c in zip(feature, cut, strict=True)], pa.float64()),
            "weight": pa.array(whole, pa.float64()),
            "share": pa.array(n1 * weights[1] / np.maximum(whole, 1e-300), pa.float64()),
        }
    )


def grow_forest(df: DataFrame, features: Sequence[str], label: str, settings: Settings | None = None) -> Forest:
    """Train on the rows of ``df``.  The driver holds the borders of the bins and, with
    more cells than are added up, per tree the nodes of more than ``LOCAL_ROWS`` rows
    with their children."""
    settings, features = settings or Settings(), list(features)
    spark, n_features = df.sparkSession, len(features)
    rows = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("int").alias("y")).filter("y IN (0, 1)")
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    first = rows.agg(
        *[F.percentile_approx(F.when(~F.isnan(f"f{i}"), F.col(f"f{i}")), steps, F.lit(10_000)).alias(f"f{i}") for i in range(n_features)],
        *[F.count(F.when(F.col("y") == c, 1)).alias(f"n{c}") for c in (0, 1)],
    ).first()
    by_class = (first["n0"], first["n1"])
    n = sum(by_class)
    if not n:
        raise ValueError("no labelled rows to train on")
    weights = [n / (2 * c) if c else 1.0 for c in by_class]
    borders = [np.unique(np.array(first[f"f{i}"] or [], float)) for i in range(n_features)]
    matrix = materialise(binned(rows, borders), "matrix")
    if math.prod(len(b) + 1 for b in borders) <= min(CELLS, n):
        return Forest(materialise(_grow_cells(matrix, n, settings, weights, borders), "forest"), features)
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    matrix = matrix.repartition(min(tasks, -(-n // CHUNK_ROWS)), "chunk")

    trees = range(settings.num_trees)
    tops = {t: _Top(by_class) for t in trees}
    # what a tree draws of n rows is about n, so the margin keeps groups near the bound
    frontier = {t: [0] for t in trees} if n > LOCAL_ROWS and min(by_class) and settings.max_depth else {}
    small = {t: [0] for t in trees} if not frontier else {t: [] for t in trees}
    while frontier:
        wide = [(t, at) for t, ats in frontier.items() for at in sorted(ats)]
        frontier = {}
        per_pass = max(1, COUNT_BYTES // (n_features * BINS * 16))
        for start in range(0, len(wide), per_pass):
            part: dict[int, list[int]] = {}
            for t, at in wide[start : start + per_pass]:
                part.setdefault(t, []).append(at)
            slots = {}
            for t, ats in part.items():
                slots[t] = np.full(len(tops[t].node), -1)
                slots[t][ats] = np.arange(len(ats))
            arrays = {t: (*tops[t].arrays(), np.array(tops[t].node)) for t in part}
            for cut in _count_level(matrix, arrays, slots, n_features, settings, weights):
                t, at = cut["tree"], part[cut["tree"]][cut["slot"]]
                sides = [(cut["l0"], cut["l1"]), (cut["r0"], cut["r1"])]
                tops[t].counts[at] = tuple(map(sum, zip(*sides, strict=True)))
                if cut["feature"] < 0:
                    continue
                for child, counts in zip(tops[t].split(at, cut["feature"], cut["bin"], *sides), sides, strict=True):
                    if min(counts) == 0 or tops[t].node[child].bit_length() > settings.max_depth:
                        continue  # a leaf
                    (small if sum(counts) <= LOCAL_ROWS else frontier).setdefault(t, []).append(child)

    known = []
    for t, top in tops.items():
        grown = set(small.get(t, ()))
        keep = [i for i in range(len(top.node)) if i not in grown]
        pick = lambda values, keep=keep: np.array([values[i] for i in keep])
        if keep:
            counts = pick(top.counts).astype(float)
            table = _node_rows(np.full(len(keep), t), pick(top.node), pick(top.feature), pick(top.bin), counts[:, 0], counts[:, 1], weights, borders)
            known += [tuple(r.values()) for r in table.to_pylist()]
    nodes = spark.createDataFrame(known, _NODES)
    marks = {}
    for t, ats in small.items():
        if ats:
            marks[t] = np.zeros(len(tops[t].node), np.int64)
            marks[t][ats] = np.array(tops[t].node)[ats]
    if marks:
        arrays = {t: tops[t].arrays() for t in marks}
        nodes = nodes.unionByName(_grow_small(matrix, arrays, marks, n_features, settings, weights, borders))
    return Forest(materialise(nodes, "forest"), features)


class Forest:
    """Nodes as a table: tree, node (children 2n and 2n + 1), feature (-1 in a leaf),
    threshold (values up to it go left), weight, share of class 1."""

    def __init__(self, nodes: DataFrame, features: Sequence[str]) -> None:
        self.nodes, self.features = nodes, list(features)
        self._arrays: tuple[np.ndarray, ...] | None = None

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        names = self.nodes.sparkSession.createDataFrame(list(enumerate(self.features)), "place int, name string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        names = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        return Forest(spark.read.schema(_NODES).parquet(f"{path}/nodes"), [r["name"] for r in names])

    def _compiled(self) -> tuple[np.ndarray, ...]:
        """roots, feature, threshold, left, share; at most 2 ** (max_depth + 1) nodes a tree."""
        if self._arrays is not None:
            return self._arrays
        held = self.nodes.select("tree", "node", "feature", "threshold", "share").toArrow()
        tree, node, feature, threshold, share = (held.column(i).to_numpy() for i in range(5))
        key = tree.astype(np.int64) << 32 | node
        order = np.argsort(key)
        key, node, feature = key[order], node[order], feature[order]
        left = np.searchsorted(key, (key >> 32 << 32) | node * 2)
        self._arrays = np.flatnonzero(node == 1), feature, threshold[order], left.astype(np.int32), share[order]
        return self._arrays

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``predicted_label`` and ``confidence``, the mean share of class 1 in the
        leaves that a row ends at.  Rows between the same thresholds score the same: where
        those leave at most ``CELLS`` cells, a task walks down the trees once for each
        cell that it meets."""
        import pandas as pd

        roots, feature, threshold, left, share = self._compiled()
        borders = [np.unique(threshold[feature == f]) for f in range(len(self.features))]
        n_cells = math.prod(len(b) + 1 for b in borders)
        kept: dict[str, np.ndarray] = {}  # of a task

        def walked(x: np.ndarray) -> np.ndarray:
            total = np.zeros(x.shape[1])
            for root in roots:
                at = np.full(x.shape[1], root)
                rows = np.arange(x.shape[1]) if feature[root] >= 0 else np.zeros(0, np.int64)
                while len(rows):
                    here = at[rows]
                    at[rows] = left[here] + (x[feature[here], rows] > threshold[here])
                    rows = rows[feature[at[rows]] >= 0]
                total += share[at]
            return total / len(roots)

        def confidence(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns])
            if n_cells > CELLS:
                return pd.Series(walked(x))
            if not kept:
                kept["by_cell"] = np.full(n_cells, np.nan)
            by_cell, cell = kept["by_cell"], np.zeros(x.shape[1], np.int64)
            for values, b in zip(x, borders, strict=True):
                cell = cell * (len(b) + 1) + np.where(np.isnan(values), 0, np.searchsorted(b, values))
            new = np.flatnonzero(np.isnan(by_cell[cell]))
            if len(new):
                cells, first = np.unique(cell[new], return_index=True)
                by_cell[cells] = walked(x[:, new[first]])
            return pd.Series(by_cell[cell])

        confidence.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        scored = df.withColumn("confidence", F.pandas_udf(confidence, "double")(*[F.col(f).cast("double") for f in self.features]))
        return scored.withColumn("predicted_label", (F.col("confidence") > 0.5).cast("int"))

    def importance(self) -> DataFrame:
        """(feature, importance): the fall of the weighted impurity by a feature's cuts,
        as shares of a tree's fall, averaged over the trees."""
        impure = F.col("weight") * 2 * F.col("share") * (1 - F.col("share"))
        inner = self.nodes.select("tree", "node", "feature", impure.alias("own")).filter("feature >= 0")
        below = self.nodes.groupBy("tree", F.expr("node div 2").alias("node")).agg(F.sum(impure).alias("rest"))
        falls = inner.join(below, ["tree", "node"]).groupBy("tree", "feature").agg(F.sum(F.col("own") - F.col("rest")).alias("fall"))
        whole = falls.groupBy("tree").agg(F.sum("fall").alias("whole")).filter("whole > 0")
        shares = falls.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("fall") / F.col("whole")).alias("part"), F.count(F.lit(1)).alias("n"))
        used = whole.agg(F.count(F.lit(1)).alias("trees"))
        names = self.nodes.sparkSession.createDataFrame(list(enumerate(self.features)), "feature int, name string")
        found = names.join(shares, "feature", "left").withColumn("_trees", used.scalar())
        return found.select(F.col("name").alias("feature"), F.coalesce(F.col("part") / F.col("_trees"), F.lit(0.0)).alias("importance"))

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from modelwatch.config import load_settings
from modelwatch.operators import forest as G
from modelwatch.operators.training import evaluate, feature_importance, score


def settings(**given):
    return load_settings({"num_trees": 4, "max_depth": 6, **given}, {})


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 6000
    a, b, c = rng.normal(size=n), rng.integers(0, 6, n), rng.normal(size=n)
    y = (a + (b > 3) + rng.normal(0, 0.4, n) > 0.7).astype(int)
    data = [(float(p), float(q), float(r), int(s)) for p, q, r, s in zip(a, b, c, y, strict=True)]
    return spark.createDataFrame(data, "a double, b double, c double, y int").coalesce(1)


def nodes(model):
    return sorted(tuple(r) for r in model.nodes.collect())


def test_level_passes_and_groups_grow_the_same_trees(table, monkeypatch):
    whole = nodes(G.grow_forest(table, ["a", "b", "c"], "y", settings()))
    monkeypatch.setattr(G, "LOCAL_ROWS", 700)
    mixed = nodes(G.grow_forest(table, ["a", "b", "c"], "y", settings()))
    monkeypatch.setattr(G, "LOCAL_ROWS", 3)
    monkeypatch.setattr(G, "COUNT_BYTES", 3 * G.BINS * 16 * 7)  # seven nodes a pass
    levels = nodes(G.grow_forest(table, ["a", "b", "c"], "y", settings(max_depth=4)))
    assert whole == mixed and len({r[0] for r in whole}) == 4
    assert levels == nodes_of_depth(whole, 4)


def test_sums_by_cell_grow_the_trees_of_the_rows(table, monkeypatch):
    """Fewer cells than rows: one pass of sums, and the trees that the level passes give."""
    few = table.select(F.round("a").alias("a"), "b", F.when(F.col("c") > 0, F.round(F.col("c"), 1)).alias("c"), "y").union(table.select("b", "a", F.lit(None), "y"))
    given = settings(num_trees=3, max_depth=9)
    monkeypatch.setattr(G, "LOCAL_ROWS", 700)
    with monkeypatch.context() as rows_only:
        rows_only.setattr(G, "CELLS", 0)
        wanted = nodes(G.grow_forest(few, ["a", "b", "c"], "y", given))

    def passed(*args):
        raise AssertionError("a pass for a level")

    monkeypatch.setattr(G, "_count_level", passed)
    monkeypatch.setattr(G, "_grow_small", passed)
    assert nodes(G.grow_forest(few, ["a", "b", "c"], "y", given)) == wanted
    monkeypatch.setattr(G, "BLOCK_ROWS", 1500)  # several records for a tree
    assert nodes(G.grow_forest(few, ["a", "b", "c"], "y", given)) == wanted and len(wanted) > 100


def test_workers_need_no_copy_of_the_package(tmp_path):
    packed = cloudpickle.dumps((G.grow_node, settings()))
    load = "import sys; from pyspark import cloudpickle; print(cloudpickle.loads(sys.stdin.buffer.read())[1].num_trees)"
    alone = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", load], input=packed, cwd=tmp_path, env=alone, capture_output=True)
    assert done.stdout.split() == [b"4"], done.stderr


def nodes_of_depth(found, depth):
    """The nodes down to a depth, where all are leaves."""
    kept = [list(r) for r in found if r[1].bit_length() <= depth + 1]
    return sorted(tuple([t, i, -1, None, w, p] if i.bit_length() == depth + 1 else [t, i, f, x, w, p]) for t, i, f, x, w, p in kept)


def slow_tree(x, y, w, weights, least, deepest, node=1):
    """One feature, every cut tried; {node: (threshold, weight, share)}."""
    total = [w[y == c].sum() * weights[c] for c in (0, 1)]
    found = {node: (None, sum(total), total[1] / sum(total))}
    if min(total) == 0 or len(y) < least or node.bit_length() > deepest:
        return found

    def impurity(rows):
        part = [w[rows & (y == c)].sum() * weights[c] for c in (0, 1)]
        return sum(part) - sum(p * p for p in part) / sum(part)

    cuts = [(impurity(x <= t) + impurity(x > t), t) for t in np.unique(x)[:-1]]
    if not cuts:
        return found
    best = min(c for c, _ in cuts)
    t = next(t for c, t in cuts if c <= best + 1e-9)
    found[node] = (t, *found[node][1:])
    for side, rows in ((0, x <= t), (1, x > t)):
        found.update(slow_tree(x[rows], y[rows], w[rows], weights, least, deepest, 2 * node + side))
    return found


@pytest.mark.parametrize("least", [2, 5, 40])
def test_against_trying_every_cut(table, least):
    rows = table.limit(900).select("b", "y").coalesce(1)
    x, y = (np.array(c) for c in zip(*rows.collect(), strict=True))
    given = settings(num_trees=2, min_samples_split=least)
    model = G.grow_forest(rows, ["b"], "y", given)
    weights = [len(y) / (2 * (y == c).sum()) for c in (0, 1)]
    for t in range(2):
        w = G.draws(given.seed, t, 0, len(y)).astype(int)
        drawn = w > 0
        wanted = slow_tree(x[drawn], y[drawn], w[drawn], weights, least, given.max_depth)
        got = {r["node"]: r for r in model.nodes.filter(F.col("tree") == t).collect()}
        assert set(got) == set(wanted)
        for node, (threshold, weight, share) in wanted.items():
            assert got[node]["weight"] == pytest.approx(weight) and got[node]["share"] == pytest.approx(share)
            assert (got[node]["threshold"] is None) == (threshold is None)
            if threshold is not None:  # the same rows on both sides
                assert ((x <= got[node]["threshold"]) == (x <= threshold)).all()


def test_no_split_below_the_minimum(table):
    """Rows that reach a node that was split, counted by walking all rows down."""
    model = G.grow_forest(table, ["a", "c"], "y", settings(num_trees=2, max_depth=12, min_samples_split=60))
    x = np.array(table.select("a", "c").collect())
    for t in range(2):
        found = {r["node"]: r for r in model.nodes.filter(F.col("tree") == t).collect()}
        reached, least = {1: np.arange(len(x))}, []
        chunks = [G.draws(42, t, i, min(G.CHUNK_ROWS, len(x) - at)) for i, at in enumerate(range(0, len(x), G.CHUNK_ROWS))]
        drawn = np.concatenate(chunks) > 0
        for node in sorted(found):
            rows, r = reached[node], found[node]
            if r["feature"] >= 0:
                least.append(drawn[rows].sum())
                right = x[rows, r["feature"]] > r["threshold"]
                reached[2 * node], reached[2 * node + 1] = rows[~right], rows[right]
        assert min(least) >= 60 and len(least) > 20


def test_scores_importance_and_storage(spark, table, tmp_path):
    model = G.grow_forest(table.sample(0.8, 1), ["a", "b", "c"], "y", settings(num_trees=20))
    scored = score(model, table)
    assert scored.columns == [*table.columns, "confidence", "predicted_label"]
    assert evaluate(scored, "y").first()["auc_roc"] > 0.93
    part = {r["feature"]: r["importance"] for r in feature_importance(model, ["a", "b", "c"]).collect()}
    assert sum(part.values()) == pytest.approx(1) and part["a"] > part["b"] > part["c"] >= 0
    model.save(str(tmp_path / "m"))
    again = G.Forest.load(spark, str(tmp_path / "m"))
    assert again.features == ["a", "b", "c"] and nodes(again) == nodes(model)
    assert score(again, table).exceptAll(scored).count() == 0


def test_a_cell_is_walked_once(spark, table, monkeypatch):
    """Same scores as from walking every row, with a fraction of the rows walked."""
    model = G.grow_forest(table, ["a", "b", "c"], "y", settings(num_trees=5, max_depth=3))
    odd = spark.createDataFrame([(None, 3.0, float("nan"), 0), (float("inf"), None, float("-inf"), 1), (float("nan"), 9.0, 0.0, 1)], table.schema)
    on_cut = model.nodes.filter("feature = 0").select(F.col("threshold").alias("a"), F.lit(4.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1).alias("y"))
    rows = table.union(odd).union(on_cut).coalesce(1)
    walked = spark.sparkContext.accumulator(0)
    with monkeypatch.context() as all_rows:
        all_rows.setattr(G, "CELLS", 0)
        wanted = [tuple(r)[4:] for r in model.score(rows).collect()]

    class Counted(np.ndarray):
        """Counts the rows that go down a tree."""

        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and len(at):
                walked.add(len(at))
            return np.asarray(self)[at]

    roots, feature, threshold, left, share = model._compiled()
    model._arrays = roots, feature, threshold, left, share.view(Counted)
    assert [tuple(r)[4:] for r in model.score(rows).collect()] == wanted
    assert 0 < walked.value < 5 * rows.count() / 2


def test_odd_rows(spark):
    odd = [(None, 0.0, 0), (float("nan"), 1.0, 1), (1.0, None, 1), (2.0, float("inf"), 0), (2.0, float("-inf"), None), (3.0, 0.0, 7)] * 10
    df = spark.createDataFrame(odd, "a double, b double, y int")
    model = G.grow_forest(df, ["a", "b"], "y", settings(min_samples_split=2))
    scored = score(model, df).collect()
    assert len(scored) == 60 and all(0 <= r["confidence"] <= 1 and r["predicted_label"] in (0, 1) for r in scored)
    with pytest.raises(ValueError, match="no labelled rows"):
        G.grow_forest(df.filter("y = 7"), ["a", "b"], "y", settings())
    for only, confidence in ((0, 0.0), (1, 1.0)):
        one = df.filter(F.col("y") == only)
        model = G.grow_forest(one, ["a", "b"], "y", settings())
        assert {r["confidence"] for r in score(model, one).collect()} == {confidence}
        assert [r["importance"] for r in model.importance().collect()] == [0.0, 0.0]
    empty = df.filter("y IS NULL").filter("a = 99")
    assert score(model, empty).count() == 0


def test_draws_repeat():
    assert (G.draws(1, 2, 3, 50) == G.draws(1, 2, 3, 50)).all()
    assert (G.draws(1, 2, 3, 500) != G.draws(1, 2, 4, 500)).any() and (G.draws(1, 2, 3, 500) != G.draws(1, 3, 3, 500)).any()
    draw = G.drawer(1, 2)
    assert all((draw(chunk, n) == G.draws(1, 2, chunk, n)).all() for chunk, n in ((3, 50), (4, 500), (3, 7), (1 << 40, 9)))

import random
import re

import numpy as np
import pytest

from modelwatch.llm import neardup as N
from modelwatch.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(texts):
    sets, up = [slow_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def family(rng, copies, most):
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(most)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile", [512, 12])
def test_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = family(rng, 60, 9) + family(rng, 2, 3) + [passage + " " + t for t in family(rng, 20, 60)] + [passage.upper(), passage + "\n"] * 5
    texts += ["one two three", "One  two THREE", "one two", None, "", "a b c d e", "a b c d e f"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(3)
    sizes, roots = slow_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs).collect()}
    assert got == {i: (sizes[i], roots[i], roots[i] == i) for i in range(len(texts))}
    assert len({r for r in roots if roots.count(r) > 1}) >= 3


def test_odd_rows(odd, none):
    rows = N.near_duplicates(odd).collect()
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in rows if r.doc_id in (1, 2, 3, 4, 5, 6, 8, 11))
    assert got == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (6, 4, False), (8, 8, True), (11, 3, False)]
    assert sorted((r.component_id or -1, r.kept) for r in rows if r.doc_id is None) == [(-1, True), (4, False)]
    assert N.near_duplicates(none).count() == 0
    kept = N.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 8, 9, 10, 12, 13]
    repeated = odd.filter("doc_id = 5")
    assert N.without_near_duplicates(repeated).count() == 1


def test_bounds_are_posterior_quantiles():
    bounds = N.least_matches([20, 40, 60, 80, 100], 0.85)
    assert bounds == sorted(bounds) and 55 <= bounds[-1] < 85
    rng = np.random.default_rng(1)
    assert (rng.binomial(100, 0.85, 100_000) < bounds[-1]).mean() < 1e-4


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 200), (200, 300), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

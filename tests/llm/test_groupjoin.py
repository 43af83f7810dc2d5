import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.llm import groupjoin as G

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def slow_join(rows, percent=85):
    """doc_id, n, component, links of each (doc_id, text), by all pairs."""
    sets, up, links = [slow_set(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if root(j) == root(i) and d is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id, links[i]))
    return sorted(out, key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + (kind != 0)] = [] if kind == 1 else [f"x{rng.randrange(10**6)}"]
    return words


def corpus(rng):
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for length in (6, 7, 9, 12, 15, 20, 30, 60, 150, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for _ in range(14):
            base = edited(rng, base, rng.randrange(2)) if rng.random() < 0.3 else base
            texts.append(edited(rng, base, rng.randrange(max(2, length // 25))))
    texts += [passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] for _ in range(25)]
    texts += [["a", "b", "c"], ["A", "b", "C"], ["a", "b"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], passage, passage]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(9001, None), (9002, " \t"), (None, rows[0][1]), (None, "nobody else has these words")]


@pytest.mark.parametrize(("members", "sample", "percent"), [(256, 64, 85), (5, 1, 85), (3, 64, 70)])
def test_against_all_pairs(spark, monkeypatch, members, sample, percent):
    """Also where groups are cut, and where keys are known to be frequent."""
    monkeypatch.setattr(G, "MEMBERS", members)
    monkeypatch.setattr(G, "SAMPLE", sample)
    monkeypatch.setattr(G, "FREQUENT", 6 if sample == 1 else 64)
    rows = corpus(random.Random(members))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = slow_join(rows, percent)
    assert sorted((tuple(r) for r in G.jaccard_join(docs, percent).collect()), key=str) == wanted
    assert len({r[2] for r in wanted if r[3]}) > 8


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for percent in (60, 80, 85, 95):
        keys = G.PartKeys(percent)
        for _ in range(1500):
            n = int(rng.integers(1, 120))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            b = a.copy()
            for _ in range(int(rng.integers(0, 1 + n * (100 - percent) // 100))):
                if rng.random() < 0.5 and len(b) > 1:
                    b = np.delete(b, rng.integers(len(b)))
                else:
                    b = np.unique(np.append(b, rng.integers(0, 1 << 63, dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert set(keys.of(a).tolist()) & set(keys.of(b).tolist()), (percent, len(a), len(b), both)


def test_linked_sets_share_the_keys_they_need():
    rng = np.random.default_rng(5)
    for percent in (60, 85, 95):
        keys, beyond_one = G.PartKeys(percent), 0
        for _ in range(600):
            n = int(rng.integers(1, 700))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            edits = 1 + n * (100 - percent) // 200
            less = np.delete(a, rng.integers(0, len(a), rng.integers(edits)))
            b = np.unique(np.append(less, rng.integers(0, 1 << 63, rng.integers(edits), dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            shared = [k & G.INTERVAL for k in set(keys.of(a).tolist()) & set(keys.of(b).tolist())]
            needs = [{x & G.INTERVAL: x >> 8 for x in keys.needs(s)} for s in (a, b)]
            smaller = G.bisect_left(keys.ends, min(len(a), len(b))) & G.INTERVAL
            need = max(x[smaller] for x in needs)
            assert shared.count(smaller) >= need, (percent, len(a), len(b), both)
            beyond_one += need > 1
        assert beyond_one > 20 or percent == 60  # where two sets may differ in most parts, one key is all they need


def test_sets_that_share_phrases_only_are_not_stored(spark, monkeypatch):
    """Texts of which any two have common phrases by chance, and so a key here and there."""
    rng = random.Random(8)
    phrases = [[f"p{i}x{j}" for j in range(4)] for i in range(40)]
    rows = []
    for i in range(60):
        words = []
        for p in rng.sample(phrases, 25):
            words += [*p, *[f"u{rng.randrange(10**9)}" for _ in range(8)]]
        rows.append((i, " ".join(words)))
    rows.append((99, rows[0][1].replace(" u", " v", 1)))
    stored, build_groups = [], G.build_groups

    def seen(signed, members, percent):
        stored.extend(r.row for r in members.select("row").collect())
        return build_groups(signed, members, percent)

    monkeypatch.setattr(G, "build_groups", seen)
    found = sorted((tuple(r) for r in G.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == slow_join(rows) and [r[0] for r in found if r[3]] == [0, 99]
    assert len(stored) == 2


def test_texts_are_filtered_before_they_are_exchanged(spark):
    rows = spark.range(5000).select(F.col("id").alias("row"), F.lit(b"x").alias("packed"))
    some = rows.filter("row % 50 = 7").select("row")
    passed = {r.row for r in G.passing(rows, G.row_filter(some)).collect()}
    assert passed >= {r.row for r in some.collect()} and len(passed) < 110
    assert not G.row_filter(some.limit(0)).any()


def test_sets_in_few_parts_keep_their_empty_keys():
    keys = G.PartKeys(85)
    near = np.arange(1, 60, dtype=np.uint64)  # all tokens in one part
    assert set(keys.of(near).tolist()) & set(keys.of(near[:-3]).tolist())


def test_closed_groups(monkeypatch):
    """A group whose union does not cover a set enough is not opened."""
    a = G.Group([1], [1], [10], np.arange(10, dtype=np.uint64).tobytes(), np.arange(10, dtype=np.uint32).tobytes())
    b = G.Group([2], [1], [10], np.arange(5, 15, dtype=np.uint64).tobytes(), np.arange(10, dtype=np.uint32).tobytes())
    monkeypatch.setattr(G, "overlaps", None)
    assert G.compare(a, b, 85) is None


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in G.jaccard_join(odd).collect()), key=str) == slow_join(rows)
    assert G.jaccard_join(none).collect() == []

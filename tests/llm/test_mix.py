import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.llm import mix as M
from modelwatch.llm.common import word_count


def slow_targets(sizes):
    """Sharing out, taking back what is above, sharing that out again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while rest > 1e-9 and free:
        share = rest / sum(weight[s] for s in free)
        rest = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        n = int(rng.integers(1, 120)) if i % 50 else 700
        rows.append((i, " ".join(f"{i}_{j}" for j in range(n)), source, 0))
    path = str(tmp_path_factory.mktemp("mix") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_targets_are_met_to_the_word(corpus, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 10)
    rows = M.mix_documents(corpus).collect()
    source = {r.doc_id: (r.source, len(words(r.text))) for r in corpus.collect()}
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows:
        s, n = source[r.doc_id]
        assert r["size"] == n and 0 <= r.taken <= 2 * n
        sizes[s] += n
        taken[s] += r.taken
        targets[s] = (r.source_size, r.target)
    wanted = slow_targets(sizes)
    for s in sizes:
        assert targets[s] == (sizes[s], pytest.approx(wanted[s]))
        assert abs(taken[s] - wanted[s]) <= 0.51
    assert sorted(rows) == sorted(M.mix_documents(corpus.repartition(5)).collect())  # however the rows are dealt


def test_blocks_and_shards(corpus, spark):
    sized = M.number_rows(corpus, "doc_id", "source", word_count("text").alias("size")).withColumnRenamed("__row", "row")
    pieces, targets = M.mixture(sized, block_words=50, shard_words=2500)
    rows = pieces.collect()
    size = {r.row: r["size"] for r in sized.collect()}
    by_shard, seen = defaultdict(list), set()
    for p in rows:
        assert (p.row, p.epoch, p.word) not in seen and p.word + p.words <= size[p.row]
        seen.add((p.row, p.epoch, p.word))
        by_shard[p.shard].append(p)
    total = sum(r.target for r in targets.collect())
    assert len(by_shard) == 1 << int(np.ceil(np.log2(total / 2500)))
    for own in by_shard.values():
        assert sorted(p.place for p in own) == list(range(1, len(own) + 1))
        source = len({p.row for p in own})
        assert source > 1
    assert all(sum(p.words for p in own) == pytest.approx(total / len(by_shard), rel=0.35) for own in by_shard.values())


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), (None, 5), ("c", 0)], "source string, quota long")
    rows = M.split_quotas(quotas, 8).collect()
    for source, quota in {"a": 1000, "b": 37, None: 5, "c": 0}.items():
        own = sorted((r.shard, r.blocks, r["first"]) for r in rows if r.source == source)
        assert [x[0] for x in own] == list(range(8)) and sum(x[1] for x in own) == quota and min(x[1] for x in own) >= 0
        assert [x[2] for x in own] == [sum(y[1] for y in own[:i]) for i in range(8)]
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.blocks
    assert max(loads.values()) - min(loads.values()) <= 1
    assert [r.blocks for r in M.split_quotas(quotas, 1).orderBy(F.col("source").asc_nulls_last()).collect()] == [1000, 37, 0, 5]


@pytest.mark.parametrize("population, marked, drawn", [(1000, 300, 600), (50, 45, 7), (10, 5, 5), (10**12, 3 * 10**11, 5 * 10**11)])
def test_hypergeometric(spark, population, marked, drawn):
    long = lambda n: F.lit(n).cast("long")
    got = spark.range(6000).select(M.hypergeometric(long(population), long(marked), long(drawn), F.col("id")).alias("x")).toPandas().x.to_numpy()
    share = marked / population
    mean, spread = drawn * share, (drawn * share * (1 - share) * (population - drawn) / (population - 1)) ** 0.5
    assert got.min() >= max(0, drawn + marked - population) and got.max() <= min(drawn, marked)
    assert abs(got.mean() - mean) < 5 * spread / 6000**0.5
    assert abs(got.std() - spread) < 0.06 * spread


def test_odd_rows(odd, none):
    rows = M.mix_documents(odd).collect()
    size = Counter((r.doc_id, len(words(r.text))) for r in odd.collect())
    assert Counter((r.doc_id, r["size"]) for r in rows) == size
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert M.mix_documents(none).count() == 0 and M.mixed_texts(none).count() == 0


def test_mixed_texts(corpus):
    wanted = {r.doc_id: r.taken for r in M.mix_documents(corpus).collect()}
    whole = {r.doc_id: r.text for r in corpus.collect()}
    out = M.mixed_texts(corpus)
    assert out.columns == corpus.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        if r.text != whole[r.doc_id]:
            assert r.n_chars == len(r.text) and set(words(r.text)) < set(words(whole[r.doc_id]))
    assert got == +Counter(wanted)

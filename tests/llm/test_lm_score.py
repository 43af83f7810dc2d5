import math
import re
from collections import Counter

import numpy as np
import pytest

from modelwatch.llm import lm_score as L


def slow_scores(texts, order, alpha, least):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(d[i : i + k]) for d in docs for k in range(1, order + 1) for i in range(len(d) - k + 1))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        score, seen = 0.0, 0
        for i in range(len(d)):
            have = min(i + 1, order)
            for k in range(have, 0, -1):
                gram = tuple(d[i - k + 1 : i + 1])
                if k == 1 or counts[gram] >= least:
                    share = counts[gram] / (total if k == 1 else counts[gram[:-1]])
                    score += math.log10(share) + (have - k) * math.log10(alpha)
                    seen += k == have and have > 1
                    break
        out.append((len(d), seen, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_counting(spark, odd, none, monkeypatch, order):
    monkeypatch.setattr(L, "BLOCK_BYTES", 20_000)  # several blocks and buckets
    monkeypatch.setattr(L, "BUCKET_BYTES", 9_000)
    rows = odd.collect()
    wanted = sorted((r.doc_id or -1, *s) for r, s in zip(rows, slow_scores([r.text for r in rows], order, 0.4, 2), strict=True))
    got = sorted((r.doc_id or -1, *r[1:]) for r in L.score_documents(odd, order).collect())
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in wanted], abs=1e-6)
    if order == 2:
        assert L.score_documents(none).count() == 0


def test_packing():
    for numbers in ([], [0], [1, 255], [256, 0, 2**63 + 5], [2**40]):
        assert L.unpack(L.pack(np.array(numbers, np.uint64))).tolist() == numbers


def test_packing_in_order():
    rng = np.random.default_rng(1)
    for top in (1 << 20, (1 << 64) - 1):
        numbers = np.unique(rng.integers(0, top, 500, np.uint64, endpoint=True))
        assert L.unpack_rising(L.pack_rising(numbers)).tolist() == numbers.tolist()
        parts = L.cut(numbers, 17)
        assert [i for _, start, end in parts for i in range(start, end)] == list(range(len(numbers)))
        assert all((int(x) >> 17) == bucket for bucket, start, end in parts for x in numbers[start:end])
    assert L.cut(numbers, 64) == [(0, 0, len(numbers))] and L.cut(numbers[:0], 64) == []


@pytest.mark.parametrize("cell_bits, least", [(1, 2), (25, 2), (25, 1)])
def test_shared_cells_change_no_count(spark, monkeypatch, cell_bits, least):
    """Cells so few that n-grams share them, and all n-grams counting from once on."""
    monkeypatch.setattr(L, "BLOCK_BYTES", 900)
    monkeypatch.setattr(L, "BUCKET_BYTES", 1_500)
    monkeypatch.setattr(L, "CELL_BITS", cell_bits)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.6, rng.integers(0, 60)) % 300) for _ in range(120)] + [None, "", "once only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in L.score_documents(docs, least=least).collect())
    wanted = [(i, *s) for i, s in enumerate(slow_scores(texts, 3, 0.4, least))]
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in wanted], abs=1e-6)


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \n")], "doc_id long, text string")
    assert sorted(tuple(r) for r in L.score_documents(docs).collect()) == [(i, 0, 0, 0.0) for i in (1, 2, 3)]


def test_registered_model_counts_trigrams(spark, tmp_path):
    import duckdb

    from modelwatch.llm.queries import ORACLES, QUERIES

    texts = ["a b c d a b c", "a b c", "b c d", "x b c", "a", "", None, "a b", "c d a b c d\ne  f", "a b c d a b c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op2_lm_scores"](spark, str(tmp_path)).collect())
    wanted = [(i, n, seen, round(score, 4)) for i, (n, seen, score) in enumerate(slow_scores(texts, 3, 0.4, 2))]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for rows in (got, sorted(con.execute(ORACLES["op2_lm_scores"]).fetchall())):
        assert [r[:3] for r in rows] == [w[:3] for w in wanted]
        assert [r[3] for r in rows] == pytest.approx([w[3] for w in wanted], abs=1e-4)

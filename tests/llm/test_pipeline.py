import hashlib
import math
import os
import random

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from modelwatch.llm.common import table
from modelwatch.llm.queries import ORACLES, QUERIES

from .test_neardup import slow_set

DATA = "/root/testdata/sf0.001"


def test_registered():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14)) and len(QUERIES) == 13
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "source_mix", "bpe_encoding"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_hand_on_what_they_keep(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
        if i < 4:
            assert docs.columns == columns
        if name == "near_duplicates":
            assert docs.count() == len(ids)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def _fixture():
    """Documents of four sources, some short, some toxic, some near a neighbour
    (two or three of 100 words changed: Jaccard 0.811 and less)."""
    rng = random.Random(12)
    plain = [a + b for a in ("riv", "sto", "clo", "gar", "yel", "let", "win", "tab", "mea", "hol") for b in ("er", "ne", "ud", "den", "low", "ter", "dow", "le", "dow", "ly")]
    docs, labels, toxic = [], [], set()
    for i in range(300):
        words = [rng.choice(plain) for _ in range(8 if i % 29 == 5 else 100)]
        if i % 4 == 0:
            words[10::20] = ["grobnik"] * len(words[10::20])
            toxic.add(i)
        docs.append((i, " ".join(words), f"s{i % 4}" if i % 4 else f"s{1 + i % 3}"))
        labels.append((i, int(i % 4 == 0)))
    for k, i in enumerate(range(1, 120, 4)):
        words = docs[i][1].split()
        for at in ([20, 70], [20, 50, 80], [50])[k % 3]:
            words[at % len(words)] = f"new{i}"
        docs.append((1000 + i, " ".join(words), "s2"))
    return docs, labels, toxic


def test_run_against_brute_force(spark, tmp_path):
    import duckdb
    from tokenizers import Tokenizer

    docs, labels, toxic = _fixture()
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()

    def ask(name, kept):
        con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", kept)
        return con.execute(ORACLES[name]).fetchdf().to_dict("records")

    good = {r["doc_id"] for r in ask("op4_host_quality", docs) if r["kept"]}
    left = [d for d in docs if d[0] in good and d[0] not in toxic]
    sets, up = {i: slow_set(t) for i, t, _ in left}, {i: i for i, _, _ in left}
    between = 0
    for a in sets:
        for b in sets:
            both, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and 100 * both >= 80 * whole:
                between += 100 * both < 85 * whole
                low, high = sorted((up[a], up[b]))
                up = {i: low if r == high else r for i, r in up.items()}
    assert between >= 5 and len(good) < len(docs)
    firsts = [d for d in left if up[d[0]] == d[0]]
    assert len(firsts) < len(left)
    wanted = {r["doc_id"]: (math.ceil(r["taken"] / r["size"]), r["taken"] // r["size"]) for r in ask("op3_source_mix", firsts) if r["taken"]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {i: (hashlib.sha256(t.encode()).hexdigest(), len(tokenizer.encode(t).ids)) for i, t, _ in firsts}
    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.decoded_sha256, r.n_tokens))
    assert {i: (len(rows), rows.count(texts.get(i))) for i, rows in got.items()} == wanted

import random
import zlib

import pytest

from modelwatch.llm import toxicity as X


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    plain = ["river", "stone", "cloud", "table", "window", "garden", "yellow", "letter"]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "Vlaxter"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs += [(900, None, "x"), (901, "", "x"), (None, "you grobnik", "x"), (3, docs[3][1], "x"), (902, "river stone " * 200_000 + "vlaxter", "x")]
    labels += [(0, 0), (None, 1), (1, None), (5000, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows(tables):
    docs, labels = tables
    rows = X.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    unseen = [r for r in rows if r.held_out and r.doc_id < 400]
    assert len(unseen) > 50 and all(r.predicted == int(r.doc_id % 4 == 0) for r in unseen)
    others = {r.doc_id: r.predicted for r in rows if r.doc_id is None or r.doc_id >= 900}
    assert others == {900: 0, 901: 0, None: 1, 902: 1}  # the very long text is read to its end


def test_clean_documents(tables):
    docs, labels = tables
    kept = X.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(400)) - set(ids) >= set(range(4, 400, 4)) and {900, 901} <= set(ids) and None not in ids and ids.count(3) == 2


def test_pieces_do_not_show(monkeypatch):
    text = "".join(random.Random(1).choice("abcdé ") for _ in range(3000))
    whole = X.slots_of(text).tolist()
    monkeypatch.setattr(X, "PIECE", 100)
    assert X.slots_of(text).tolist() == whole


@pytest.mark.parametrize("toxic, score", [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_one_kind_of_labels(spark, none, toxic, score):
    docs = spark.createDataFrame([(1, "a text"), (2, "b text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 1, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    assert {r.score for r in X.score_documents(docs, labels).collect()} == {score}
    if not toxic:
        assert X.score_documents(none, labels).count() == 0


def test_labels_without_documents_do_not_use_up_the_sample(spark, tables):
    docs, labels = tables
    others = spark.range(100_000, 105_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    wanted = X.labelled_sample(docs, labels, 100).count()
    assert wanted >= 100 and X.labelled_sample(docs, labels.unionByName(others), 100).count() == wanted

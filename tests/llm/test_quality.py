import re
from collections import Counter

import pytest

from modelwatch.llm import quality as Q


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_rows(odd, none):
    wanted = []
    for r in odd.collect():
        c = slow_counts(r.text)
        wanted.append((r.doc_id or -1, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    out = Q.document_quality(odd)
    assert out.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = out.collect()
    assert sorted((r.doc_id or -1, *r[1:7]) for r in got) == sorted(wanted)
    assert all(not r.kept for r in got if r.base_failed)
    assert Q.document_quality(none).count() == 0


def clean(i):
    return " ".join(f"w{i}x{j}" for j in range(40))


@pytest.mark.parametrize("limit", [20_000, 0])
def test_hosts(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "BROADCAST_HOSTS", limit)
    noisy = lambda i: clean(i) + " ### ### ### $$$ %%%"
    rows = [(i, clean(i), "good") for i in range(400)] + [(1000 + i, noisy(i) if i % 2 else clean(i), "bad") for i in range(100)]
    rows += [(2000, noisy(7), "good"), (2001, clean(8), None), (2002, noisy(9) + "\nx" * 90, "good")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in Q.document_quality(docs).collect()}
    assert all(kept[i] for i in [*range(400), *range(1000, 1100, 2), 2001])  # clean ones stay, on any host
    assert not any(kept[i] for i in range(1001, 1100, 2))  # one fault on a host known for it
    assert kept[2000] and not kept[2002]  # one fault elsewhere; two faults
    rates = {r.host: r.symbols_rate for r in Q.host_verdicts(Q.count_rules(docs)).collect()}
    assert 0 < rates["good"] < 0.01 < rates[None] < rates["bad"] < 0.5 + 1e-9


def test_kept_documents_have_their_columns(odd):
    kept = Q.keep_documents(odd)
    assert kept.columns == odd.columns
    wanted = {(r.doc_id, r.n_words) for r in Q.document_quality(odd).filter("kept").collect()}
    got = {(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in kept.collect()}
    assert got == wanted and got

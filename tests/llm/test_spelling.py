import random
import re
import zlib
from collections import Counter

import pytest

from modelwatch.llm import spelling as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows):
    words, out = slow_words(rows), {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if near and words[best] >= 2 * n else None, n, len(near))
    got = set()
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        got.add((w, form, root, n, near, words[form] if form else None))
    return got


def misspelt(rng, word):
    at, letters = rng.randrange(len(word) + 1), "abcdeéßÿ"
    kind = rng.randrange(3)
    if kind == 0:
        return word[:at] + rng.choice(letters) + word[at:]
    return word[:at] + (rng.choice(letters) if kind == 1 else "") + word[at + 1 :]


@pytest.mark.parametrize("partners", [S.PARTNERS, 0])
def test_against_all_pairs(spark, monkeypatch, partners):
    """Also where every group is told apart by further chunks."""
    monkeypatch.setattr(S, "PARTNERS", partners)
    rng = random.Random(5)
    words = ["international", "internationale", "Überraschung", "schön", "naïve", "aaaaa", "aaaaaa", "abababab", "strasse", "straße", "x" * 300]
    words += ["".join(rng.choice("abc") for _ in range(5)) for _ in range(30)]
    words += ["inter" + "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    for _ in range(3):
        words += [misspelt(rng, rng.choice(words)) for _ in range(40)]
    rows = []
    for i in range(60):
        picked = [w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, [1 / (k % 17 + 1) for k in range(len(words))], k=40)]
        rows.append((None if i == 7 else i % 50, " ,1".join(picked)))
    rows += [(60, ""), (61, None), (62, "-- 12"), (63, "schön×schön÷")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = slow_variants(rows)
    assert {tuple(r) for r in S.spelling_variants(docs).collect()} == wanted
    assert sum(r[1] is not None for r in wanted) > 20 and any(r[1] not in (None, r[2]) for r in wanted)


def test_every_slip_is_made():
    texts = {(i, f"word{'abcdefghij'[i % 10]}") for i in range(3000)}
    assert any(S.slipped(str(i), w) != w for i, w in texts) and all(len(w) - len(S.slipped(str(i), w)) in (0, 1) for i, w in texts)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in S.spelling_variants(odd).collect()} == slow_variants(rows)
    assert S.spelling_variants(none).collect() == []
    assert S.spelling_variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_hot_word_is_counted_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 2)
    docs = spark.createDataFrame([(i, "hotword " * 50 + f"cold{'abc'[i % 3]} colder") for i in range(90)], "doc_id long, text string").repartition(5)
    got = {r.word: r.n for r in S.count_words(docs).collect()}
    assert got == slow_words([(r.doc_id, r.text) for r in docs.collect()]) and got["hotword"] > 4000

import hashlib
import random

import numpy as np
import pytest

from modelwatch.llm import fingerprint as P

make = P.Fingerprinter()


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def test_spans_and_common_extensions():
    rng = random.Random(4)
    for _ in range(60):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 60)))
        b = a[: rng.randrange(len(a) + 1)] + "".join(rng.choice("ab") for _ in range(20))
        x, y = P.PrefixHashes(points(a), make.first), P.PrefixHashes(points(b), make.first)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.common_extension(i, y, j) == n
        k = rng.randrange(i, len(a) + 1)
        assert x.span(i, k) == P.PrefixHashes(points(a[i:k]), make.first).span(0, k - i)


def test_pieces_do_not_show(monkeypatch):
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(5000))
    whole = str(make(text))
    monkeypatch.setattr(P, "PIECE", 700)
    assert str(P.Fingerprinter()(text)) == whole


def test_likeness():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    same = lambda a, b: P.likeness(str(make(a)), str(make(b)))
    assert same(text, text) == 1 and same("", "") == 1 and same("", "x") == 0 and same("x", "x") == 1
    assert same(text, other) < 0.1
    assert 0.6 < same(text, text[:2700] + other[:1300]) <= 0.7  # a new end
    assert 0.6 < same(text, other[:1300] + text[1300:]) <= 0.7  # a new beginning
    assert same(text, text[:2000] + "X" + text[2000:]) > 0.9  # one letter more
    assert same(text, other[:500] + text + other[500:1000]) > 0.5  # inside another


@pytest.mark.parametrize("size", [16 << 20, 9000, 500])
def test_next_documents(spark, odd, none, monkeypatch, size):
    monkeypatch.setattr(P, "RANGE_BYTES", size)
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    wanted = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        marks = [str(make(t)) for t in (text, edited, after)]
        wanted.append((i or -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), *marks[:2], P.likeness(*marks[:2]), P.likeness(marks[0], marks[2])))
    got = [(r.doc_id or -1, *r[1:]) for r in P.compare_with_next(odd).collect()]
    assert sorted(got) == sorted(wanted)
    if size == 500:
        assert P.compare_with_next(none).count() == 0
        assert [(r.doc_id, r.near_next) for r in P.compare_with_next(odd.filter("doc_id = 9")).collect()] == [(9, 1.0)]
        assert P.compare_with_next(odd.filter("doc_id is null")).count() == 2

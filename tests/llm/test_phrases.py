import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from modelwatch.llm import phrases as P

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = []
        often = [(p, a) for p, a in counts.items() if len(p) > 1 and a >= least]
        for p, a in often:
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in often):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(25)] + ["New", "york", "Zürich", "İz", "the", "of"]
    rows = []
    for i in range(250):
        parts = rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(60))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", " ", "\x1f"]) for w in parts)
        rows.append((rng.choice(["en", "de", None, "und", ""]), text + "New York City hall! the the the the"))
    return rows + [("en", None), ("en", ""), ("fr", " .,; \t"), (None, "solo")]


@pytest.mark.parametrize("fan", [256, 2])
def test_against_plain_counts(spark, monkeypatch, fan):
    """Also where filters are merged over several levels."""
    monkeypatch.setattr(P, "FAN", fan)
    monkeypatch.setattr(P, "CUT_BITS", 8 if fan > 2 else 2)
    monkeypatch.setattr(P, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(P, "PLACES", 100)
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for top in (2000, 7):
        wanted = slow(rows, 10, top)
        assert {tuple(r) for r in P.collocations(docs, top=top).collect()} == wanted
    assert len(wanted) > 20


def test_filter_round_trip():
    rng = np.random.default_rng(3)
    for words, bits in ((2, 1), (2, 17), (3, 9), (3, 21), (3, 30), (3, 32)):
        layout = P.Layout(words, bits)
        numbers = [rng.integers(1, 1 << bits, 5000, dtype=np.uint64) for _ in range(words)]
        counts = rng.integers(1, 400, 5000).astype(np.uint64)
        q, r = layout.permute(numbers)
        assert all((a == b).all() for a, b in zip(layout.restore(q, r), numbers, strict=True))
        wanted = Counter()
        for row, c in zip(zip(*(x.tolist() for x in numbers), strict=True), counts.tolist(), strict=True):
            wanted[row] += c
        half = [P.Filter.collect(q[s], r[s], counts[s], bits, layout.rest) for s in (slice(0, 2000), slice(2000, None))]
        merged = P.Filter.merge([P.Filter.read(f.write(), bits, layout.rest) for f in half])
        assert (np.diff(merged.q.astype(np.float64)) >= 0).all()
        cut, got = min(4, bits), {}
        for head, part in merged.slices(cut):
            part = P.Filter.read(part.write(), bits - cut, layout.rest)
            back = layout.restore(part.q | np.uint64(head << (bits - cut)), part.r)
            got |= dict(zip(zip(*(x.tolist() for x in back), strict=True), part.counts.tolist(), strict=True))
        assert got == wanted


def test_wide_chunks(spark):
    """More words in one text than 16 bits can number."""
    rows = [("en", " ".join(f"w{i} the big" for i in range(70_000)))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in P.collocations(docs).collect()} == slow(rows, 10, 2000)


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007)], "a long, l long, r long")
    assert rows.select(P._score("a", "l", "r").alias("s")).first().s == 10**6 * 9 * 10**24 // (3_000_000_000_001 * 3_000_000_000_007)


def test_odd_rows(odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert {tuple(r) for r in P.collocations(odd, least=2).collect()} == slow(rows, 2, 2000)
    assert P.collocations(none).collect() == []

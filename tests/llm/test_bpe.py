import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from modelwatch.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.TextCoder(bpe.read_tokenizer(PATH)), Tokenizer.from_file(PATH)


def ids_of(coder, text):
    data = coder.encode(text)
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_random_texts_as_the_library(both):
    coder, library = both
    rng = random.Random(1)
    parts = ["a", "aa", " ", "  ", "\n", "\t", "the", "'s", "'ll", "é", "中", "👍🏽", "1", "23", "\x1c", "\x85", "\xa0", "!", "---", "<|endoftext|>", "<|endof", "²"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        ids = ids_of(coder, text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert coder.decode(coder.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_long_words_and_runs(both):
    coder, library = both
    for text in ["a" * 4000, " " * 3000, "ab" * 2000, "-=" * 2000, "!" * 777 + "a", "abc " * 3000]:
        assert ids_of(coder, text) == library.encode(text, add_special_tokens=False).ids


def slow_bpe(word, merges):
    pieces = [bytes([c]) for c in word]
    for left, right in merges:
        i = 0
        while i < len(pieces) - 1:
            if pieces[i] == left and pieces[i + 1] == right:
                pieces[i : i + 2] = [left + right]
            i += 1
    return pieces


def test_automaton_against_merging_in_order():
    rng = random.Random(5)
    for _ in range(150):
        labels, merges = [b"a", b"b", b"c"], []
        for _ in range(rng.randrange(1, 9)):
            left, right = rng.choice(labels), rng.choice(labels)
            if left + right not in labels:
                labels.append(left + right)
                merges.append((left, right))
        automaton = bpe.MergeAutomaton(labels, [(labels.index(u), labels.index(v), labels.index(u + v)) for u, v in merges])
        for _ in range(30):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 10)))
            assert [labels[i] for i in automaton.encode_word(word)] == slow_bpe(word, merges), (merges, word)


def test_documents_with_odd_rows(odd, none):
    library = Tokenizer.from_file(PATH)
    wanted = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        text = library.decode(ids, skip_special_tokens=False)
        wanted.append((r.doc_id or -1, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    out = bpe.encode_documents(odd, PATH)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r.doc_id or -1, *r[1:]) for r in out.collect()) == sorted(wanted)
    assert bpe.encode_documents(none, PATH).count() == 0
    kept = bpe.encode_documents(odd.filter("doc_id = 3"), PATH, keep_ids=True).first()
    assert len(kept.ids) == 4 * kept.n_tokens

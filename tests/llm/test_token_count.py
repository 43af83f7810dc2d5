import random

import public_tokenizers
from tokenizers import Tokenizer, models

from modelwatch.llm import token_count as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, byte_fallback):
    vocabulary = [("<unk>", 0.0), *pieces.items()] + [(f"<0x{i:02X}>", 0.0) for i in range(256)] * byte_fallback
    return Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))


def marked(text):
    return T.MARK + text.replace(" ", T.MARK)


def test_as_the_library():
    spec = T.read_vocabulary(PATH)
    counter, other = T.ViterbiCounter(**spec), library(spec["pieces"], True)
    rng = random.Random(2)
    parts = ["a", "th", "ing", " ", "  ", "\n", "é", "中", "👍🏽", "1", "▁", "of", "the", "\x00", "ab", "ba", "aa"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert counter.count(text) == len(other.encode(marked(text)).ids), text


def test_ties_and_unknowns_in_tiny_vocabularies():
    rng = random.Random(3)
    for _ in range(800):
        pieces = {T.MARK: -1.0} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -float(rng.randint(0, 4)) for _ in range(8)}
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12)))
        assert T.ViterbiCounter(pieces, False).count(text) == len(library(pieces, False).encode(marked(text)).ids), (pieces, text)


def test_documents_with_odd_rows(odd, none):
    other = library(T.read_vocabulary(PATH)["pieces"], True)
    wanted = [(r.doc_id or -1, len(r.text or ""), len(other.encode(marked(r.text)).ids) if r.text else 0) for r in odd.collect()]
    got = T.count_tokens(odd, PATH)
    assert sorted((r.doc_id or -1, *r[1:]) for r in got.collect()) == sorted(wanted)
    assert T.count_tokens(none, PATH).count() == 0

"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick machine over the vocabulary enumerates every piece that ends at
a character; dynamic programming carries the best score and the number of
pieces of the best path up to there. Ties follow the unigram tokenizers: of
equal scores the path whose last piece begins first (the longest piece) stays,
an unknown character costs the least score minus ten and only steps in where no
one-character piece matches, neighbouring unknown characters count as one
piece, or as their bytes under byte fallback.

No piece holds the word mark behind another character, so no piece crosses the
place before a word mark and the best path of a text is the best paths of its
words laid end to end. Words are counted once per worker and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import map_rows, runs_on_workers

runs_on_workers(__name__)

MARK = "▁"
#: Fixed value: what an unknown character costs beyond the least score.
UNKNOWN_PENALTY = 10.0
MEMO = 300_000


def read_vocabulary(path: str) -> dict:
    """Pieces with scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(model.get_piece_size())
    plain = [i for i in n if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {
        "pieces": {model.id_to_piece(i): float(model.get_score(i)) for i in plain},
        "byte_fallback": any(model.is_byte(i) for i in n),
    }


class ViterbiCounter:
    """Number of pieces of the best path of a text."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool):
        inside = [p for p in pieces if MARK in p.lstrip(MARK)]
        if inside:
            raise ValueError(f"pieces with a word mark behind another character: {inside[:3]}")
        self.byte_fallback = byte_fallback
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.young: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def best(self, word: str) -> tuple[float, int]:
        """Score and piece count of the best path of ``word``."""
        n = len(word)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        unknown = bytearray(n + 1)  # does the best path end in an unknown character?
        matches = self.machine.iter(word) if self.machine.kind != ahocorasick.EMPTY else iter(())
        ending = next(matches, None)
        for end in range(1, n + 1):
            top, single = None, False
            while ending is not None and ending[0] == end - 1:
                length, own = ending[1]
                single = single or length == 1
                value = score[end - length] + own
                if top is None or value > top:  # the longest comes first
                    top, pieces, odd = value, count[end - length] + 1, 0
                ending = next(matches, None)
            if not single:
                value = score[end - 1] + self.unknown
                if top is None or value > top:
                    top, odd = value, 1
                    if self.byte_fallback:
                        pieces = count[end - 1] + len(word[end - 1].encode())
                    else:
                        pieces = count[end - 1] + (not unknown[end - 1])
            score[end], count[end], unknown[end] = top, pieces, odd
        return score[n], count[n]

    def __getitem__(self, word: str) -> int:
        known = self.young.get(word) or self.older.get(word)
        if known is None:
            known = self.best(word)[1]
        if len(word) < 100:
            if len(self.young) > MEMO:  # what is not met again goes
                self.young, self.older = {}, self.young
            self.young[word] = known
        return known

    def count(self, text: str) -> int:
        """Pieces of ``text``: blanks become word marks and one goes before it."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if MARK * 2 in marked or not self.byte_fallback:
            words = self.words.findall(marked) if self.byte_fallback else [marked]
            return sum([self[w] for w in words])
        young = self.young
        return sum([young.get(w) or self[w] for w in [MARK + w for w in marked[1:].split(MARK)]])


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Tokens of every whole text.

    ``docs`` needs doc_id and text. Returns doc_id, n_chars, n_tokens. Null and
    empty texts have none; rows that repeat are answered each; other columns
    are left out.
    """
    spec = read_vocabulary(vocabulary)

    def start() -> Callable[..., tuple]:
        counter = ViterbiCounter(**spec)
        return lambda doc_id, text: (doc_id, len(text or ""), counter.count(text or ""))

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), start, "doc_id long, n_chars long, n_tokens long"
    )

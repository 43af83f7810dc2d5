"""Byte-level BPE through a tokenization automaton.

The merge list is compiled gadget by gadget into a deterministic automaton over
tokens. A state is the token read last, an arc carries the next token, and a
path spells exactly one byte string. Merging ``u v`` into ``w`` with rank ``k``

* bans arc ``v`` out of state ``u`` from time ``k`` on,
* makes state ``w`` as a copy of what state ``v`` is at time ``k``,
* adds arc ``w`` wherever arc ``u`` (and then ``v``) leads at time ``k``.

After the last merge the automaton accepts a token sequence if and only if it
is the BPE encoding of its bytes, so a text has one path. The gadgets are kept
as tables (bans, copies, left parts); an arc is expanded from them when it is
first asked for and then looked up, because the full table of 50,000 states
times 50,000 labels would not fit a worker.

Encoding walks a pre-split word left to right, the longest arc first. A byte
from which no arc goes on is marked and never entered again, so a word takes
time in proportion to its length. Decoding emits the labels of the arcs. Special tokens found in a text are cut out first and
become their ids, as the tokenizers library does by default.

Null texts count as empty: no ids, empty decoded text. A word of any length is
walked in time proportional to its bytes, in memory proportional to the text.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import map_rows, runs_on_workers

runs_on_workers(__name__)

#: Fixed value: the pre-split pattern of byte-level BPE, with white space as Unicode defines it.
PRESPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words that a worker remembers in each of two generations, and a quarter of the arcs.
MEMO = 300_000
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file: the
    byte itself where it is printable Latin-1, else the next letter from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> dict:
    """Labels by id, merges by rank and special tokens of a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    labels = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, i in vocab.items():
        labels[i] = bytes(letters[c] for c in token)
    merges = []
    for m in spec["model"]["merges"]:
        u, v = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[u], vocab[v], vocab[u + v]))
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for token, i in special.items():
        labels[i] = token.encode()
    return {"labels": labels, "merges": merges, "special": special}


class MergeAutomaton:
    """Deterministic automaton of all BPE encodings under a merge list."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int] | None = None):
        special = special or {}
        self.labels = labels
        n = len(labels)
        self.born, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.bans: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.by_label = {x: i for i, x in enumerate(labels) if len(x) == 1 and i not in special.values()}
        for k, merge in enumerate(merges):
            self._gadget(k, *merge)
        #: Tokens and, as -1, what only begins one.
        self.steps = {x[:i]: -1 for x in self.by_label for i in range(1, len(x))} | self.by_label

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        there = self.by_label.get
        if there(self.labels[u]) != u or there(self.labels[v]) != v or self.born[w] >= 0 or not self._open(u, v, k):
            return  # no path spells u v, or w is there already
        self.bans[u, v] = k
        self.born[w], self.left[w], self.right[w] = k, u, v
        self.by_label[self.labels[w]] = w

    def _open(self, state: int, label: int, until: int) -> bool:
        """Is arc ``label`` out of ``state`` there just before time ``until``?

        Both ends are followed back to single bytes: the state through what it
        was copied from, the label through its left parts. At each moment the
        newest of both that existed is the pair that a ban could name.
        """
        while True:
            changed = max(self.born[state], self.born[label])
            if self.bans.get((state, label), _NEVER) < until:
                return False
            if changed < 0:
                return True
            if self.born[label] >= self.born[state]:
                # the arc was added where its left part led; a merge of a token
                # with itself takes the leftmost pair, so it closes its own arc
                twin = self.left[label] == self.right[label] == state
                until = self.born[label] + twin
                label = self.left[label]
            else:
                until = self.born[state]
                state = self.right[state]

    def arc(self, state: int, label: int) -> bool:
        known = self.arcs.get((state, label))
        if known is None:
            if len(self.arcs) > 4 * MEMO:
                self.arcs.clear()
            known = self.arcs[state, label] = self._open(state, label, _NEVER)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        n, steps, arcs = len(word), self.steps, self.arcs
        if (whole := steps.get(word, -1)) >= 0:
            return [whole]
        path: list[int] = []
        ends = [0]
        dead = bytearray(n + 1)  # where no path goes on
        limit = n
        while True:
            start = ends[-1]
            found = []
            for end in range(start + 1, limit + 1):
                if (label := steps.get(word[start:end])) is None:
                    break
                if label >= 0 and not dead[end]:
                    found.append((end, label))
            for end, label in reversed(found):
                if not path:
                    break
                known = arcs.get((path[-1], label))
                if known or known is None and self.arc(path[-1], label):
                    break
            else:  # dead end: back over the last arc, then the next shorter one
                dead[start] = 1
                path.pop()
                limit = ends.pop() - 1
                continue
            path.append(label)
            ends.append(end)
            if end == n:
                return path
            limit = n

    def decode(self, ids: list[int]) -> bytes:
        """The labels along a path."""
        labels = self.labels
        return b"".join([labels[i] for i in ids])


class TextCoder:
    """Whole texts to ids as little-endian unsigned 32-bit integers and back."""

    def __init__(self, spec: dict):
        self.automaton = MergeAutomaton(**spec)
        self.special = spec["special"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.presplit = regex.compile(PRESPLIT)
        self.spaced = regex.compile(r" [\s\p{White_Space}]")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __getitem__(self, chunk: str) -> bytes:
        known = self.words.get(chunk) or self.older.get(chunk)
        if known is None:
            pieces = self.presplit.findall(chunk)
            if len(pieces) > 1:
                known = b"".join([self[piece] for piece in pieces])
            else:
                ids = self.automaton.encode_word(chunk.encode())
                known = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) < 100:
            if len(self.words) > MEMO:  # what is not met again goes
                self.words, self.older = {}, self.words
            self.words[chunk] = known
        return known

    def _plain(self, text: str) -> list[bytes]:
        if self.spaced.search(text):
            return [self[w] for w in self.presplit.findall(text)]
        # a word always begins at a space that is followed by something else
        words, (first, *rest) = self.words, text.split(" ")
        out = [self[first]] if first else []
        if not rest:
            return out
        if not rest[-1]:  # the text ends in a space
            rest.pop()
            tail = [self[" "]]
        else:
            tail = []
        for chunk in rest:
            chunk = " " + chunk
            out.append(words.get(chunk) or self[chunk])
        return out + tail

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(self._plain(text))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out += self._plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    ``docs`` needs doc_id and text; other columns are left out. Returns doc_id,
    n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256, and with ``keep_ids`` the ids themselves (binary). A null
    text is an empty one; rows that repeat are answered each.
    """
    spec = read_tokenizer(tokenizer)

    def start() -> Callable[..., tuple]:
        coder, sha = TextCoder(spec), lambda x: hashlib.sha256(x).hexdigest()

        def run(doc_id: int, text: str | None) -> tuple:
            ids = coder.encode(text or "")
            row = (doc_id, len(ids) // 4, sha(ids), sha(coder.decode(ids).encode()))
            return (*row, ids) if keep_ids else row

        return run

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), start, schema)

"""Document fingerprints from prefix polynomial hashes.

``prefix[i]`` is the polynomial hash of the first i code points, modulo the
prime 2^31 - 1. The difference of two entries, shifted to position 0, is the hash
of the span between them, so spans are compared in constant time, and the
longest common extension of two positions is found by binary search.

A fingerprint keeps, for a text of n code points: n and a 62-bit hash of the
whole; the prefix array at multiples of a power of two (17 to 32 entries); the
same of the text read backwards; and the least scrambled hashes of all its spans
of 16 code points. The likeness of two fingerprints is the larger of

* the share of the longer text that the longest common extensions from the start
  and from the end cover, by binary search over the kept entries, and
* the resemblance of their sets of spans, estimated from the least hashes.

It is 1 for equal texts and 0 if either text is empty and the other is not.
Fingerprints of equal texts are equal. Texts are hashed piece by piece, so a
long one needs memory in proportion to its own length only.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import runs_on_workers

runs_on_workers(__name__)

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 69_069_421)
SPAN = 16
SAMPLES = 32
SPANS = 32
PIECE = 1 << 16
#: Text bytes that one range of ids holds, about, the most ranges, and how many a task gets.
RANGE_BYTES = 2 << 20
MOST_RANGES = 20_000
TASK_RANGES = 4


class Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.base = base
        self.up = self._table(base)
        self.down = self._table(pow(base, -1, PRIME))

    @staticmethod
    def _table(base: int) -> np.ndarray:
        out = np.ones(PIECE + SPAN + 1, np.uint64)
        done = 1
        while done < len(out):
            n = min(done, len(out) - done)
            out[done : done + n] = out[:n] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
            done += n
        return out


class PrefixHashes:
    """The prefix array of one text that fits a piece; spans in constant time."""

    def __init__(self, points: np.ndarray, powers: Powers):
        terms = (points.astype(np.uint64) + np.uint64(1)) * powers.up[: len(points)] % np.uint64(PRIME)
        self.powers, self.n = powers, len(points)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(terms, out=self.prefix[1:])
        self.prefix %= np.uint64(PRIME)

    def span(self, start: int, end: int) -> int:
        """The hash of code points start to end, as if they began a text."""
        difference = (int(self.prefix[end]) - int(self.prefix[start])) % PRIME
        return difference * int(self.powers.down[start]) % PRIME

    def spans(self, length: int) -> np.ndarray:
        """The hashes of all spans of ``length``."""
        count = self.n - length + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        difference = self.prefix[length:] + np.uint64(PRIME) - self.prefix[:count]
        return difference % np.uint64(PRIME) * self.powers.down[:count] % np.uint64(PRIME)

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """How far the texts agree from these positions on."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(other_start, other_start + middle):
                low = middle
            else:
                high = middle - 1
        return low


class Fingerprint:
    """What is kept of a text."""

    def __init__(self, n: int, whole: int, step: int, forward: np.ndarray, backward: np.ndarray, spans: np.ndarray):
        self.n, self.whole, self.step, self.forward, self.backward, self.spans = n, whole, step, forward, backward, spans

    def __str__(self) -> str:
        head = struct.pack("<QQQBBB", self.n, self.whole, self.step, len(self.forward), len(self.backward), len(self.spans))
        return base64.b64encode(head + b"".join(a.astype("<u4").tobytes() for a in (self.forward, self.backward, self.spans))).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        data = base64.b64decode(text)
        n, whole, step, f, b, s = struct.unpack_from("<QQQBBB", data)
        kept = np.frombuffer(data, "<u4", offset=27)
        return cls(n, whole, step, kept[:f], kept[f : f + b], kept[f + b : f + b + s])

    def likeness(self, other: Fingerprint) -> float:
        if self.n == other.n and self.whole == other.whole:
            return 1.0
        if not self.n or not other.n:
            return 0.0
        step = max(self.step, other.step)

        def extension(a: np.ndarray, b: np.ndarray) -> int:
            a, b = a[step // self.step - 1 :: step // self.step], b[step // other.step - 1 :: step // other.step]
            low, high = 0, min(len(a), len(b))
            while low < high:
                middle = (low + high + 1) // 2
                if a[middle - 1] == b[middle - 1]:
                    low = middle
                else:
                    high = middle - 1
            return low * step

        both = extension(self.forward, other.forward) + extension(self.backward, other.backward)
        covered = min(both, self.n, other.n) / max(self.n, other.n)
        k = SPANS
        least = sorted({*self.spans.tolist(), *other.spans.tolist()})[:k]
        shared = set(self.spans.tolist()) & set(other.spans.tolist())
        return max(covered, sum(x in shared for x in least) / len(least))


def _sampled(points: np.ndarray, powers: Powers, step: int) -> tuple[np.ndarray, int]:
    """The prefix array at multiples of ``step``, and the hash of the whole."""
    before, kept = 0, []
    for at in range(0, len(points), PIECE):
        local = PrefixHashes(points[at : at + PIECE], powers)
        shift = np.uint64(pow(powers.base, at, PRIME))
        wanted = np.arange(step - at % step if at % step else step, local.n + 1, step) if step <= PIECE else _single(at, local.n, step)
        kept.append((local.prefix[wanted] * shift + np.uint64(before)) % np.uint64(PRIME))
        before = (int(local.prefix[-1]) * int(shift) + before) % PRIME
    return (np.concatenate(kept) if kept else np.zeros(0, np.uint64)), before


def _single(at: int, n: int, step: int) -> np.ndarray:
    first = -at % step or step
    return np.arange(first, n + 1, step)


def _least_spans(points: np.ndarray, powers: Powers) -> np.ndarray:
    """The least scrambled hashes of the spans of ``points``."""
    best = np.zeros(0, np.uint32)
    length = min(SPAN, len(points))
    if not length:
        return best
    for at in range(0, max(1, len(points) - length + 1), PIECE):
        spans = PrefixHashes(points[at : at + PIECE + length - 1], powers).spans(length)
        x = spans.astype(np.uint32) * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        some = x
        if len(x) > 8 * SPANS:
            some = np.partition(x, 4 * SPANS)[: 4 * SPANS]
        least = np.unique(some)
        if len(least) < SPANS and len(some) < len(x):  # the same span again and again
            least = np.unique(x)
        best = np.unique(np.concatenate([best, least[:SPANS]]))[:SPANS]
    return best


class Fingerprinter:
    def __init__(self) -> None:
        self.first, self.second = (Powers(b) for b in BASES)

    def __call__(self, text: str) -> Fingerprint:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, step = len(points), 1
        while n > SAMPLES * step:
            step *= 2
        forward, one = _sampled(points, self.first, step)
        backward, two = _sampled(points[::-1], self.second, step)
        return Fingerprint(n, one << 31 | two, step, forward, backward, _least_spans(points, self.first))


def likeness(a: str, b: str) -> float:
    """The likeness of two fingerprints in their text form, 0 to 1."""
    return Fingerprint.parse(a).likeness(Fingerprint.parse(b))


# ---------------------------------------------------------------- over a table


def _range_of(doc_id: Column, borders: list[int]) -> Column:
    """How many of ``borders`` (descending) are at least ``doc_id``; null: all."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(doc_id > borders[middle], below(low, middle)).otherwise(below(middle + 1, high))

    return F.when(doc_id.isNull(), F.lit(len(borders))).otherwise(below(0, len(borders))) if borders else F.lit(0)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text and compare with the next one.

    ``docs`` needs doc_id and text. Documents stand in descending doc_id, null
    ids last, rows with the same id in the order of their texts; after the last
    comes the first. Ids are cut into ranges at existing ids, each range is read
    in order, and the document that begins a range is also sent to the range
    before it, so texts are moved once and never gathered. A null text is an
    empty one; a single row is its own next document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, top = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.max("doc_id")).first()
    ranges = max(1, min(MOST_RANGES, -(-size // RANGE_BYTES)))
    borders: list[int] = []
    if ranges > 1 and top is not None:
        cuts = [i / ranges for i in range(1, ranges)]
        found = rows.agg(F.percentile_approx("doc_id", cuts, max(10_000, 20 * ranges))).first()[0]
        borders = sorted({*found} - {top}, reverse=True)
    last = len(borders)
    own = _range_of(F.col("doc_id"), borders)
    places = [F.struct(own.alias("range"), F.lit(False).alias("follows"))]
    if borders:
        border = F.when(F.col("doc_id").isin(borders), F.struct((own - 1).alias("range"), F.lit(True).alias("follows")))
        round_again = F.when(F.col("doc_id") == top, F.struct(F.lit(last).alias("range"), F.lit(True).alias("follows")))
        places += [border, round_again]
    placed = rows.select(F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p"), "doc_id", "text")
    dealt = placed.select("p.range", "p.follows", "doc_id", "text").repartition(last // TASK_RANGES + 1, "range")
    ordered = dealt.sortWithinPartitions("range", "follows", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter()
        out: list[tuple] = []

        def finish(row: tuple, follower: tuple) -> None:
            doc_id, text, mark = row
            next_text, next_mark = follower[1], follower[2]
            k = len(text) // 3
            edited = text[: len(text) - k] + next_text[:k]
            changed = make(edited)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(text), sha, str(mark), str(changed), mark.likeness(changed), mark.likeness(next_mark)))

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        here, opening, waiting = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at, follows, doc_id, text = (c[i].as_py() for c in batch.columns)
                if at != here:  # the range before has ended
                    if waiting:
                        finish(waiting, opening)
                    here, opening, waiting = at, None, None
                if follows:
                    if waiting:
                        finish(waiting, (doc_id, text, make(text)))
                        waiting = None
                    continue
                row = (doc_id, text, make(text))
                if waiting:
                    finish(waiting, row)
                opening, waiting = opening or row, row
                if len(out) >= 500:
                    yield flush()
        if waiting:
            finish(waiting, opening)
        if out:
            yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema)

"""Stupid-backoff language-model scores over the corpus's own n-gram counts.

The score of a word is the relative frequency of the longest n-gram that ends
there and was seen ``LEAST`` times or more in all documents, times ``ALPHA`` for
every order given up: count(n-gram) / count(context), or for a single word
count(word) / all words. A document's score is the sum of its words' log10.

Everything is a join by n-gram hash, with the n-grams of a block of documents
packed into sorted arrays:

1. documents are dealt to blocks of a few MB by a hash of their content;
2. every block lists the cells of its distinct n-grams, which are the leading bits
   of their hashes, in rows (block, bucket, cells), and the bucket answers with a
   bit for each: does another block hold the cell too?
3. an n-gram that a block holds once, in a cell that no other block holds, is known
   to occur once.  Of those that are left the rest of the hash is sent with the
   block's counts, in rows (block, bucket, n-grams);
4. the count table of a bucket is the sum over the blocks, and joined back to
   each block's n-grams it gives the corpus counts (block, bucket, counts);
5. these are joined to the block's documents, looked up for every position and
   summed per document.

Most n-grams occur once, so step 2 leaves fewer to send whole, and it loses
nothing: a cell that two n-grams share only makes them be sent in vain.  An n-gram
reaches its bucket once per block at most, so a word or passage that everybody uses
does not make a large group, and nothing is broadcast. Blocks and buckets have a
bounded size and grow in number with the corpus. The exchange that deals the
documents to blocks is the same in steps 2, 3 and 5, that of the cells the same in
steps 2 and 4, and Spark reads them again.

Words are runs of characters other than ASCII white space, case included; an
n-gram is known by a 64-bit hash. Null and empty texts have no words and score 0.
Rows that repeat count, and are scored, each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import runs_on_workers
from modelwatch.session import materialise

runs_on_workers(__name__)

ORDER = 3
ALPHA = 0.4
#: How often an n-gram of two words or more must be seen to be used.
LEAST = 2
BLOCK_BYTES = 8 << 20
#: Text bytes per bucket: about two million n-grams of the default order.
BUCKET_BYTES = 4 << 20
#: Cells of a bucket, as a power of two: about 16 for each of its n-grams.
CELL_BITS = 25


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, and that width first.
    Their lowest bytes come first, then the next ones, so that zeros lie together."""
    numbers = np.ascontiguousarray(numbers, "<u8")
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return bytes([width]) + numbers.view(np.uint8).reshape(-1, 8)[:, :width].tobytes("F")


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


class Grams:
    """The n-grams of the texts of a block, as hashes."""

    def __init__(self, texts: list[str | None], order: int):
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.n_words = np.array([len(w) for w in words], np.int64)
        total = int(self.n_words.sum())
        self.document = np.repeat(np.arange(len(texts)), self.n_words)
        self.place = np.arange(total) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)
        known: dict[bytes, int] = {}
        hashes = np.empty(total, np.uint64)
        at = 0
        for w in words:
            for x in w:
                if x not in known:
                    known[x] = xxhash.xxh3_64_intdigest(x)
            hashes[at : at + len(w)] = [known[x] for x in w]
            at += len(w)
        self.order = order
        #: per order: the positions that it ends at, and its hash there
        self.ends, self.hashes = [], []
        rolled = hashes * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, order + 1):
            if k > 1:
                rolled = rolled[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[k - 1 :] * np.uint64(0x9E3779B97F4A7C15)
            ends = np.flatnonzero(self.place >= k - 1)
            h = rolled[ends - (k - 1)] + np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(28)
            self.ends.append(ends)
            self.hashes.append(h)

    def everything(self) -> np.ndarray:
        return np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)


def cut(sorted_codes: np.ndarray, tail: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of sorted codes that differ in their last ``tail`` bits only."""
    bucket = (sorted_codes >> np.uint64(tail)).astype(np.int64) if tail < 64 else np.zeros(len(sorted_codes), np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(bucket))[: len(starts)]
    return [(int(bucket[start]), int(start), int(end)) for start, end in zip(starts, ends, strict=True)]


def pack_rising(numbers: np.ndarray) -> bytes:
    """Rising numbers, of which there is one at least, by their first and the steps between them."""
    return numbers[0].tobytes() + pack(np.diff(numbers))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], "<u8"), unpack(data[8:])]), dtype=np.uint64)


def bits_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def blocked(docs: DataFrame) -> tuple[DataFrame, int]:
    """block, doc_id, text, dealt out by block; and the number of leading hash
    bits that name a bucket."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    code = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    return rows.select(code, "doc_id", "text").repartition(int(min(blocks, 200_000)), "block"), bits


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_seen (positions scored at the full order that they have
    context for), score (sum of log10) for every row of ``docs`` (doc_id, text;
    other columns are left out)."""
    blocks, bits = blocked(docs)

    tail = max(0, 64 - bits - CELL_BITS)

    def distinct_grams(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of a block in order, their counts in it, and where a new cell begins."""
        distinct, counts = np.unique(Grams(rows.column("text").to_pylist(), order).everything(), return_counts=True)
        cells = distinct >> np.uint64(tail)
        return distinct, counts, np.diff(cells, prepend=cells[:1] + np.uint64(1)) != 0

    def list_cells(key: tuple, rows: pa.Table) -> pa.Table:
        distinct, _, opens = distinct_grams(rows)
        cells = distinct[opens] >> np.uint64(tail)
        parts = cut(cells, 64 - bits - tail)
        packed = [pack_rising(cells[start:end]) for _, start, end in parts]
        return pa.table(
            {"block": [key[0].as_py()] * len(parts), "bucket": [p[0] for p in parts], "cells": packed},
            pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("cells", pa.binary())]),
        )

    def mark_shared(_key: tuple, rows: pa.Table) -> pa.Table:
        within = np.uint64((1 << (64 - bits - tail)) - 1)
        once = np.zeros(1 << CELL_BITS, bool)
        twice = np.zeros(1 << CELL_BITS, bool)
        packed = rows.column("cells")
        for x in packed:
            cells = unpack_rising(x.as_py()) & within
            twice[cells[once[cells]]] = True
            once[cells] = True
        shared = [np.packbits(twice[unpack_rising(x.as_py()) & within]).tobytes() for x in packed]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "shared": pa.chunked_array([shared], pa.binary())})

    def ask(key: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        distinct, counts, opens = distinct_grams(rows)
        shared = dict(zip(marks.column("bucket").to_pylist(), marks.column("shared").to_pylist(), strict=True))
        first = np.append(np.flatnonzero(opens), len(distinct))  # n-gram of each cell
        repeated = np.logical_or.reduceat(counts > 1, first[:-1]) if len(distinct) else np.zeros(0, bool)
        rests = distinct & np.uint64((1 << tail) - 1)
        out: dict[str, list] = {"block": [], "bucket": [], "asked": [], "opens": [], "rests": [], "counts": []}
        for bucket, start, end in cut(distinct[opens] >> np.uint64(tail), 64 - bits - tail):
            asked = repeated[start:end] | bits_of(shared[bucket], end - start)
            if asked.any():
                grams = slice(first[start], first[end])
                which = np.repeat(asked, np.diff(first[start : end + 1]))
                out["block"].append(key[0].as_py())
                out["bucket"].append(bucket)
                out["asked"].append(np.packbits(asked).tobytes())
                out["opens"].append(np.packbits(opens[grams][which]).tobytes())
                out["rests"].append(pack(rests[grams][which]))
                out["counts"].append(pack(counts[grams][which]))
        binary = [(name, pa.binary()) for name in ("asked", "opens", "rests", "counts")]
        return pa.table(out, pa.schema([("block", pa.int64()), ("bucket", pa.int64()), *binary]))

    def answer(_key: tuple, rows: pa.Table, listed: pa.Table) -> pa.Table:
        cells_of = dict(zip(listed.column("block").to_pylist(), listed.column("cells"), strict=True))
        grams, counts = [], []
        for row in rows.to_pylist():
            cells = unpack_rising(cells_of[row["block"]].as_py())
            rests = unpack(row["rests"])
            cells = cells[bits_of(row["asked"], len(cells))][np.cumsum(bits_of(row["opens"], len(rests))) - 1]
            grams.append(cells << np.uint64(tail) | rests)
            counts.append(unpack(row["counts"]))
        packed = []
        if grams:
            _, place = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.zeros(int(place.max()) + 1, np.uint64)
            np.add.at(total, place, np.concatenate(counts))
            packed = [pack(m) for m in np.split(total[place], np.cumsum([len(g) for g in grams])[:-1])]
        return pa.table({**{c: rows.column(c) for c in ("block", "bucket", "asked")}, "counts": pa.chunked_array([packed], pa.binary())})

    def score(_key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(rows.column("text").to_pylist(), order)
        n = rows.num_rows
        distinct, place = np.unique(grams.everything(), return_inverse=True)
        total = np.ones(len(distinct))  # what was not asked for occurs once
        replies = zip(answers.column("asked").to_pylist(), answers.column("counts").to_pylist(), strict=True)
        of_bucket = dict(zip(answers.column("bucket").to_pylist(), replies, strict=True))
        cells = distinct >> np.uint64(tail)
        first = np.append(np.flatnonzero(np.diff(cells, prepend=cells[:1] + np.uint64(1))), len(distinct))
        for bucket, start, end in cut(cells[first[:-1]], 64 - bits - tail):
            if bucket in of_bucket:
                asked, found = of_bucket.pop(bucket)
                which = np.repeat(bits_of(asked, end - start), np.diff(first[start : end + 1]))
                total[first[start] : first[end]][which] = unpack(found)
        if of_bucket:
            raise ValueError(f"answers of buckets that the block does not hold: {sorted(of_bucket)[:5]}")
        counts, at = [], 0
        for ends in grams.ends:
            dense = np.zeros(len(grams.place))
            dense[ends] = total[place[at : at + len(ends)]]
            counts.append(dense)
            at += len(ends)
        have = np.minimum(grams.place + 1, order)  # the longest order there is context for
        value, level = np.zeros(len(have)), np.ones(len(have), np.int64)
        if len(have):
            value = np.log10(counts[0])  # over all words, which is subtracted at the end
            for k in range(2, order + 1):
                good = np.flatnonzero((have >= k) & (counts[k - 1] >= least))
                value[good] = np.log10(counts[k - 1][good] / counts[k - 2][good - 1])
                level[good] = k
            value += (have - level) * math.log10(alpha)
        total_of = lambda x: np.bincount(grams.document, x, n)
        return pa.table(
            {
                "doc_id": rows.column("doc_id").cast(pa.int64()),
                "n_words": pa.array(grams.n_words),
                "n_seen": pa.array(total_of((level == have) & (have > 1)).astype(np.int64)),
                "single": pa.array(total_of(level == 1).astype(np.int64)),
                "part": pa.array(total_of(value).astype(np.float64)),
            }
        )

    cells = blocks.groupBy("block").applyInArrow(list_cells, "block long, bucket long, cells binary")
    marks = cells.groupBy("bucket").applyInArrow(mark_shared, "block long, bucket long, shared binary")
    asked = (
        blocks.groupBy("block")
        .cogroup(marks.groupBy("block"))
        .applyInArrow(ask, "block long, bucket long, asked binary, opens binary, rests binary, counts binary")
    )
    answered = (
        asked.groupBy("bucket")
        .cogroup(cells.groupBy("bucket"))
        .applyInArrow(answer, "block long, bucket long, asked binary, counts binary")
    )
    scored = (
        blocks.groupBy("block")
        .cogroup(answered.groupBy("block"))
        .applyInArrow(score, "doc_id long, n_words long, n_seen long, single long, part double")
    )
    scored = materialise(scored, "scores")
    words = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    return scored.select("doc_id", "n_words", "n_seen", (F.col("part") - F.col("single") * math.log10(max(1, words))).alias("score"))

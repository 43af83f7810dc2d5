"""Collocations: phrases of two and three words, counted in quotient filters.

1. Every task turns its texts into chunks of about CHUNK_BYTES: the sequence of
   local word numbers, and the list of its words with their counts.
2. Words are summed over the chunks. Those of a language with LEAST occurrences
   or more get dense numbers; no other word can be part of a candidate. Each
   chunk gets the numbers of its words back by a join.
3. An n-gram of numbers is packed and permuted by three invertible rounds into a
   quotient (as wide as a number) and a remainder (the rest, in full), so the
   filter loses nothing: the permutation is undone at the end. A filter is its
   entries in sorted order: the quotients as a bit vector of runs, the remainders
   in full, a counter of a byte for each (longer ones apart).
4. Filters are cut by their leading quotient bits, and the slices of FAN shards
   with the same bits are merged in one task: sorted runs are joined and counters
   added. The merged filters are shards again, cut by the next bits, until every
   slice holds the whole corpus. So an exchange has FAN rows at most for each
   shard, and a merge reads FAN small slices, however large the corpus.
5. The n-grams with LEAST occurrences are few; their cuts, containment and ranks
   are joins and aggregates.

A frequent n-gram is one counter per chunk and, because quotients are hashed,
does not make its slice large.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.llm.common import runs_on_workers
from modelwatch.session import materialise

runs_on_workers(__name__)

LEAST = 10
TOP = 2000
#: A candidate goes if a longer one that holds it is at least so many percent as frequent.
COVERED = 50
SCALE = 1_000_000
CHUNK_BYTES = 8 << 20
#: Places whose n-grams a task collects at once, before it merges them to the filter of its chunk.
PLACES = 1 << 18
#: Shards merged at once, and the slices that each of them is cut into: 2 ** CUT_BITS.
CUT_BITS = 8
FAN = 256
#: Three numbers of this width fill the largest remainder and quotient.
MOST_BITS = 32

#: Lower case for A to Z; what ends a piece becomes a line end, a tab a space.
TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands between pieces; no UTF-8 text holds this byte.
END = b"\xff"


class _Numbers(dict):
    """Word to local number, given out in order over all languages."""

    def __init__(self, words: list[tuple[str, bytes]], lang: str):
        super().__init__({END: 0})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = len(self.words)
        return len(self.words)


def encode(docs: DataFrame) -> DataFrame:
    """Stored: chunk, sequence (local numbers, 0 between pieces, led by a byte for
    their width), words (lang, word, n) in the order of their numbers from 1."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    schema = "sequence binary, words array<struct<lang:string,word:string,n:bigint>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[tuple[str, bytes]] = []
        by_lang: dict[str, _Numbers] = {}
        sequence = array("I", [0])
        size = 0

        def chunk() -> pa.RecordBatch:
            numbers = np.frombuffer(sequence, np.uint32)
            width = 2 if len(words) < 1 << 16 else 4
            data = bytes([width]) + numbers.astype(f"<u{width}").tobytes()
            columns = [
                pa.array([lang for lang, _ in words], pa.string()),
                pa.array([word for _, word in words], pa.binary()).cast(pa.string()),
                pa.array(np.bincount(numbers, minlength=len(words) + 1)[1:], pa.int64()),
            ]
            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.StructArray.from_arrays(columns, ["lang", "word", "n"]))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), listed], ["sequence", "words"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    if lang not in by_lang:
                        by_lang[lang] = _Numbers(words, lang)
                    data = text.encode().translate(TABLE)
                    sequence.extend(map(by_lang[lang].__getitem__, data.replace(b"\n", b" " + END + b" ").split()))
                    sequence.append(0)
                    size += len(data)
                    if size > CHUNK_BYTES:
                        yield chunk()
                        words, by_lang, sequence, size = [], {}, array("I", [0]), 0
        if size:
            yield chunk()

    return materialise(rows.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")


def number_words(listed: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """id (from 1, without gaps), lang, word, f of the words with ``least``
    occurrences or more; lang, n of all words; the number of ids."""
    counted = materialise(listed.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    kept = counted.filter(F.col("f") >= least).withColumn("at", F.monotonically_increasing_id())
    kept = materialise(kept.withColumn("part", F.shiftright("at", 33).cast("int")), "kept")
    sizes = sorted((r.part, r.n) for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = kept.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.join(F.broadcast(before), "part").select(place.alias("id"), "lang", "word", "f"), totals, total


class Layout:
    """Packed n-grams of ``words`` numbers of ``bits`` bits: the quotient is the
    last number, the remainder the ones before, both permuted."""

    def __init__(self, words: int, bits: int):
        self.bits, self.rest = bits, (words - 1) * bits
        self.low = np.uint64((1 << bits) - 1)
        self.high = np.uint64((1 << self.rest) - 1)

    @staticmethod
    def _mix(x: np.ndarray, salt: int) -> np.ndarray:
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def permute(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        q, r = numbers[-1].copy(), numbers[0].copy()
        for x in numbers[1:-1]:
            r = (r << np.uint64(self.bits)) | x
        q ^= self._mix(r, 1) & self.low
        r ^= self._mix(q, 2) & self.high
        q ^= self._mix(r, 3) & self.low
        return q, r

    def restore(self, q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
        q = q ^ (self._mix(r, 3) & self.low)
        r = r ^ (self._mix(q, 2) & self.high)
        q = q ^ (self._mix(r, 1) & self.low)
        out = [q]
        for _ in range(self.rest // self.bits):
            out.insert(0, r & self.low)
            r = r >> np.uint64(self.bits)
        return out


class Filter:
    """A sorted counting quotient filter: distinct (quotient, remainder), ascending,
    and their counts. ``width`` is the number of quotient bits."""

    def __init__(self, q: np.ndarray, r: np.ndarray, counts: np.ndarray, width: int, rest: int):
        self.q, self.r, self.counts, self.width, self.rest = q, r, counts, width, rest

    @classmethod
    def collect(cls, q: np.ndarray, r: np.ndarray, counts: np.ndarray, width: int, rest: int) -> Filter:
        """Entries in any order; equal ones are added up. Sorted runs stay cheap."""
        if width + rest <= 64:
            order = np.argsort((q << np.uint64(rest)) | r if rest < 64 else r, kind="stable")
        else:
            order = np.lexsort((r, q))
        q, r = q[order], r[order]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
        starts = np.flatnonzero(first)
        total = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
        return cls(q[starts], r[starts], total, width, rest)

    @classmethod
    def merge(cls, filters: list[Filter]) -> Filter:
        one = filters[0]
        return cls.collect(*(np.concatenate([getattr(f, c) for f in filters]) for c in ("q", "r", "counts")), one.width, one.rest)

    def slices(self, bits: int) -> Iterator[tuple[int, Filter]]:
        """Cut by the ``bits`` leading quotient bits, which the parts no longer hold."""
        width = self.width - bits
        head = (self.q >> np.uint64(width)).astype(np.int64)
        starts = np.flatnonzero(np.diff(head, prepend=-1))
        low = np.uint64((1 << width) - 1)
        for at, end in zip(starts, np.append(starts[1:], len(head))[: len(starts)], strict=True):
            yield int(head[at]), Filter(self.q[at:end] & low, self.r[at:end], self.counts[at:end], width, self.rest)

    def write(self) -> bytes:
        """Number of entries; quotient bits that the run vector holds; the vector;
        the remainders, in whole bytes; a byte per counter, 255 for those in the tail."""
        n = len(self.q)
        held = min(self.width, n.bit_length())
        runs = np.zeros(n + (1 << held), np.uint8)
        runs[(self.q >> np.uint64(self.width - held)).astype(np.int64) + np.arange(n)] = 1
        large = self.counts >= 255
        return b"".join(
            (
                np.array([n, held], "<u4").tobytes(),
                np.packbits(runs).tobytes(),
                _narrow(self.q & np.uint64((1 << (self.width - held)) - 1), self.width - held),
                _narrow(self.r, self.rest),
                np.where(large, 255, self.counts).astype(np.uint8).tobytes(),
                self.counts[large].astype("<u8").tobytes(),
            )
        )

    @classmethod
    def read(cls, data: bytes, width: int, rest: int) -> Filter:
        n, held = (int(x) for x in np.frombuffer(data, "<u4", 2))
        at = 8 + (n + (1 << held) + 7) // 8
        runs = np.unpackbits(np.frombuffer(data, np.uint8, at - 8, 8), count=n + (1 << held))
        q = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
        low, at = _widen(data, at, n, width - held)
        r, at = _widen(data, at, n, rest)
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.uint64)
        counts[counts == 255] = np.frombuffer(data, "<u8", offset=at + n)
        return cls((q << np.uint64(width - held)) | low, r, counts, width, rest)


def _narrow(numbers: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8].tobytes()


def _widen(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    size = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").reshape(-1), at + n * size


_SLICES = pa.schema([("words", pa.int32()), ("part", pa.int64()), ("slice", pa.int64()), ("filter", pa.binary())])
_GRAMS = pa.schema([("words", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("f", pa.int64())])


def count_grams(chunks: DataFrame, numbers: DataFrame, bits: int, least: int) -> DataFrame:
    """words, w1, w2, w3 (null in pairs), f of the pairs and triples of numbered
    words with ``least`` occurrences or more in the stored ``chunks``."""
    shards = chunks.count()
    n_parts = -(-shards // FAN)
    cut = min(CUT_BITS, bits)

    def part_of(chunk: int) -> int:
        return ((chunk >> 33) + 7919 * (chunk & (1 << 33) - 1)) % max(1, n_parts)

    def fill(key: tuple, sequence: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in _SLICES.names}
        for data in sequence.column("sequence").to_pylist():
            local = np.frombuffer(data, f"<u{data[0]}", offset=1)
            known = np.zeros(int(local.max()) + 1, np.uint64)
            known[answers.column("pos").to_numpy()] = answers.column("id").to_numpy().astype(np.uint64)
            ids = known[local]
            for words in (2, 3):
                layout = Layout(words, bits)
                parts = []
                for at in range(0, len(ids), PLACES):
                    near = ids[at : at + PLACES + words - 1]
                    run = [near[k : max(0, len(near) - words + 1) + k] for k in range(words)]
                    whole = np.flatnonzero(np.logical_and.reduce([x > 0 for x in run]))
                    q, r = layout.permute([x[whole] for x in run])
                    parts.append(Filter.collect(q, r, np.ones(len(q), np.uint64), bits, layout.rest))
                for head, part in Filter.merge(parts).slices(cut):
                    out["words"].append(words)
                    out["part"].append(part_of(key[0].as_py()))
                    out["slice"].append(head)
                    out["filter"].append(part.write())
        return pa.table(out, _SLICES)

    name = ", ".join(f"{f.name} {'binary' if f.name == 'filter' else 'int' if f.name == 'words' else 'long'}" for f in _SLICES)
    answers = numbers.select(F.col("chunk").alias("of"), "pos", "id")
    filled = chunks.select("chunk", "sequence").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(fill, name)
    width, left = bits - cut, n_parts
    while left > 1:
        fewer, cut = -(-left // FAN), min(CUT_BITS, width)
        filled = materialise(filled.groupBy("words", "part", "slice").applyInArrow(_merging(bits, width, cut, fewer), name), "filters")
        left, width = fewer, width - cut

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        words, head = key[0].as_py(), key[1].as_py()
        layout = Layout(words, bits)
        merged = Filter.merge([Filter.read(x, width, layout.rest) for x in rows.column("filter").to_pylist()])
        often = merged.counts >= least
        q = merged.q[often] | np.uint64(head << width)
        found = [x.astype(np.int64) for x in layout.restore(q, merged.r[often])]
        n = len(q)
        return pa.table(
            {
                "words": pa.array(np.full(n, words, np.int32)),
                "w1": found[0],
                "w2": found[1],
                "w3": pa.array(found[2]) if words == 3 else pa.nulls(n, pa.int64()),
                "f": merged.counts[often].astype(np.int64),
            },
            _GRAMS,
        )

    return materialise(filled.groupBy("words", "slice").applyInArrow(finish, "words int, w1 long, w2 long, w3 long, f long"), "grams")


def _merging(bits: int, width: int, cut: int, parts: int) -> Callable:
    """Merges the slices of a part and cuts them by their next ``cut`` quotient bits."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        words, part, before = (k.as_py() for k in key)
        merged = Filter.merge([Filter.read(x, width, (words - 1) * bits) for x in rows.column("filter").to_pylist()])
        cuts = [(before << cut | head, f.write()) for head, f in merged.slices(cut)]
        n = len(cuts)
        return pa.table({"words": [words] * n, "part": [part % parts] * n, "slice": [h for h, _ in cuts], "filter": [f for _, f in cuts]}, _SLICES)

    return merge


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language
    of ``docs`` (lang, text; other columns are left out).

    A null language is ``und``; null and empty texts have no words; rows that
    repeat count each. Counts are exact, and scores are worked out in decimals of
    38 digits. Of cuts with equal scores the first counts; phrases with equal
    scores and counts are ranked in UTF-8 byte order.
    """
    chunks = encode(docs)
    listed = chunks.select("chunk", F.posexplode("words").alias("pos", "w")).select("chunk", (F.col("pos") + 1).alias("pos"), "w.lang", "w.word", "w.n")
    words, totals, n_ids = number_words(listed, least)
    words = materialise(words, "numbered")
    bits = max(1, n_ids.bit_length())
    if bits > MOST_BITS:
        raise ValueError(f"{n_ids} words have more than {MOST_BITS} bits")
    numbers = listed.join(words.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "pos", "id")
    grams = count_grams(chunks, numbers, bits, least)

    two, three = grams.filter("words = 2").select("w1", "w2", "f"), grams.filter("words = 3").select("w1", "w2", "w3", "f")
    inside = three.select("w1", "w2", "f").union(three.select("w2", "w3", "f")).groupBy("w1", "w2").agg(F.max("f").alias("longer"))
    single = lambda k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"))
    pairs = two.join(inside, ["w1", "w2"], "left").filter(F.coalesce(100 * F.col("longer") < COVERED * F.col("f"), F.lit(True)))
    pairs = pairs.join(single(1), "w1").join(single(2), "w2")
    pairs = pairs.select("w1", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"))

    triples = three.join(two.select("w1", "w2", F.col("f").alias("f12")), ["w1", "w2"])
    triples = triples.join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23")), ["w2", "w3"])
    triples = triples.join(single(1), "w1").join(single(2).drop("f2"), "w2").join(single(3), "w3")
    later = _score("f", "f12", "f3") < _score("f", "f1", "f23")
    triples = triples.select(
        "w1",
        F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"),
        F.col("f").alias("a"),
        F.when(later, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(later, F.col("f3")).otherwise(F.col("f23")).alias("r"),
    )

    found = pairs.union(triples).withColumn("score", _score("a", "l", "r"))
    found = found.join(words.select(F.col("id").alias("w1"), "lang"), "w1")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    ranked = ranked.join(totals.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score(a: str, left: str, right: str) -> object:
    """floor(SCALE * a * a / (left * right)), exactly."""
    wide = lambda c: f"cast({c} AS decimal(19,0))"
    return F.expr(f"({wide(a)} * {wide(a)} * cast({SCALE} AS decimal(7,0))) div ({wide(left)} * {wide(right)})")

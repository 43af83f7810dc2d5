"""Near duplicates: MinHash with sequential Bayesian verification.

1. Every text becomes the set of its five-word shingles (64-bit hashes) and a
   signature of 100 minima. Documents with equal sets are one class from here on.
2. Signatures are cut into 20 bands of 5, for thresholds below 0.85 into more and
   shorter ones (25 of 4 at 0.8). Classes that agree in a band meet in its bucket with a one-byte-a-minimum sketch. There all pairs are compared
   batch by batch: after each batch a pair goes if the posterior probability that
   its similarity reaches the threshold is below MISS (uniform prior, so a beta
   posterior). Only which classes hang together by surviving pairs leaves the
   bucket: a star, never the pairs.
3. The stars' components are families: every surviving pair lies inside one.
4. Families get their full sets, once per class, and every surviving pair of a
   family that isn't connected yet is verified on the full sets. Again only a
   forest of true links leaves the task; its components are the result.

A bucket or family beyond TILE members is cut into tiles by a hash, and each
pair of tiles is a task's work of its own, so no task holds a large group. A
pair at the threshold is in no common bucket with probability 8e-6 (0.85), 2e-6 (0.8).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import runs_on_workers
from modelwatch.llm.components import components
from modelwatch.session import materialise

runs_on_workers(__name__)

WORDS = 5
PERCENT = 85
BANDS = 20
ROWS = 5
BATCH = 20
MISS = 1e-6
TILE = 512
TILE_BYTES = 48 << 20
MEMO = 200_000
#: Groups beyond a tile that are broadcast, 16 bytes each; more are joined by shuffle.
BROADCAST_GROUPS = 100_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def rows_of_band(percent: int) -> int:
    """The longest bands, up to ROWS, in which a pair at the threshold agrees
    nowhere with a probability of 1e-5 or less."""
    fit = [r for r in (5, 4, 2, 1) if r <= ROWS and (1 - (percent / 100) ** r) ** (BANDS * ROWS // r) <= 1e-5]
    return max(fit, default=1)


class Shingler:
    """Texts to sets of shingles, as sorted 64-bit hashes."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20)
        self.factors = rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)
        self.a = rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32)
        self.words: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.words) > MEMO:
            self.words.clear()
        h = self.words[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        """Blanks are ASCII white space only, upper case is A to Z only. Fewer
        than five words are one shingle, no word is none."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known, hashed = self.words.get, self._hash
        h = np.array([known(w) or hashed(w) for w in words], np.uint64)
        n = min(WORDS, len(words))
        s = np.full(len(words) - n + 1, np.uint64(n) * self.factors[WORDS], np.uint64)
        for k in range(n):
            s += h[k : len(words) - n + 1 + k] * self.factors[k]
        s ^= s >> np.uint64(32)
        s *= np.uint64(0x9FB21C651E98DF25)
        s ^= s >> np.uint64(29)
        return np.unique(s)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(best, (x[at : at + 1024, None] * self.a + self.b).min(axis=0), out=best)
        # the minima are small numbers; scramble them for use as keys and bytes
        best ^= best >> np.uint32(16)
        best *= np.uint32(0x85EBCA6B)
        best ^= best >> np.uint32(13)
        return best


def least_matches(batches: list[int], threshold: float, miss: float = MISS) -> list[int]:
    """After each number of compared minima: the fewest equal ones with which the
    similarity still reaches ``threshold`` with a posterior probability of
    ``miss``. Bytes of different minima are equal once in 256."""
    out = []
    grid = (np.arange(20_000) + 0.5) / 20_000
    seen = grid + (1 - grid) / 256
    for n in batches:
        for m in range(n + 1):
            log = m * np.log(seen) + (n - m) * np.log1p(-np.minimum(seen, 1 - 1e-12))
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() >= miss * p.sum():
                out.append(m)
                break
    return out


class Forest:
    """Union-find over the members of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def surviving(sketches: np.ndarray, i: int, others: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Those of ``others`` that stay after all batches against member ``i``."""
    equal, done = np.zeros(len(others), np.int32), 0
    for upto, least in bounds:
        equal = equal + (sketches[others, done:upto] == sketches[i, done:upto]).sum(axis=1, dtype=np.int32)
        stays = equal >= least
        if not stays.all():
            others, equal = others[stays], equal[stays]
            if not len(others):
                break
        done = upto
    return others


def _later(sides: np.ndarray, tile: tuple[int, int], i: int) -> np.ndarray:
    """The members that ``i`` is to be compared with in this task."""
    if tile[0] == tile[1]:
        return np.arange(i + 1, len(sides))
    return np.flatnonzero(sides == tile[1]) if sides[i] == tile[0] else np.zeros(0, np.int64)


def _runs(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Neighbouring rows with equal first ``n_keys`` columns, two rows at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        if held:
            last = held[-1]
            if any(last.column(k)[last.num_rows - 1].as_py() != keys[k][0] for k in range(n_keys)):
                if sum(h.num_rows for h in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for at, end in zip(starts, starts[1:], strict=False):
            part = batch.slice(at, end - at)
            if end < batch.num_rows:
                if held or end - at > 1:
                    held.append(part)
                    if sum(h.num_rows for h in held) > 1:
                        yield pa.Table.from_batches(held)
                    held = []
            else:
                held.append(part)
    if sum(h.num_rows for h in held) > 1:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def sign(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Stored: row, doc_id, n (shingles), s1 and s2 (the set's 128-bit digest),
    sketch and keys (of the bands)."""
    length = rows_of_band(percent)
    bands = BANDS * ROWS // length

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        seeds = np.random.default_rng(7).integers(1, 1 << 63, length, dtype=np.uint64) | np.uint64(1)
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[list] = [[], [], [], [], []]
                for text in part.column(2).to_pylist():
                    s = make.shingles(text)
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    signature = make.signature(s)
                    keys = (signature.reshape(bands, length).astype(np.uint64) * seeds).sum(axis=1, dtype=np.uint64) + salt
                    keys ^= keys >> np.uint64(31)
                    keys *= np.uint64(0xD6E8FEB86659FD93)
                    for column, value in zip(
                        out,
                        (
                            len(s),
                            int.from_bytes(digest[:8], "little", signed=True),
                            int.from_bytes(digest[8:], "little", signed=True),
                            signature.astype(np.uint8).tobytes(),
                            keys.view(np.int64),
                        ),
                        strict=True,
                    ):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                arrays = [part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n", "s1", "s2", "sketch", "keys"])

    schema = "row long, doc_id long, n long, s1 long, s2 long, sketch binary, keys array<long>"
    return materialise(docs.select("row", "doc_id", "text").mapInArrow(run, schema), "signed")


def in_tiles(members: DataFrame, group: str, weight: str | None = None) -> DataFrame:
    """``members`` with columns tile, low and high: groups within one tile have
    low = high = 0; a larger one is cut into tiles, and each member goes to every
    pair (low, high) that its tile is part of."""
    bytes_of = F.sum(weight) if weight else F.lit(0)
    sizes = members.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__n"), bytes_of.alias("__b"))
    large = sizes.filter((F.col("__n") > TILE) | (F.col("__b") > TILE_BYTES))
    tiles = F.greatest(F.ceil(F.col("__n") / TILE), F.ceil(F.col("__b") / TILE_BYTES))
    large = materialise(large.select("__group", F.least(tiles, F.col("__n")).cast("int").alias("__tiles")), "large")
    n_large = large.limit(BROADCAST_GROUPS + 1).count()
    if not n_large:
        return members.select("*", *[F.lit(0).alias(c) for c in ("tile", "low", "high")])
    if n_large <= BROADCAST_GROUPS:
        large = F.broadcast(large)
    joined = members.join(large, F.col(group) == F.col("__group"), "left")
    tiles = F.coalesce("__tiles", F.lit(1))
    dealt = joined.withColumn("tile", F.pmod(F.xxhash64("row", F.lit(1)), tiles).cast("int"))
    pairs = dealt.withColumn("__with", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return pairs.select(
        *members.columns, "tile", F.least("tile", "__with").cast("int").alias("low"), F.greatest("tile", "__with").cast("int").alias("high")
    )


def families(signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, root: classes that hang together by pairs that survive in a bucket."""
    first = signed.filter("n > 0").groupBy(F.col("s1").alias("f1"), F.col("s2").alias("f2")).agg(F.min("row").alias("f"))
    # by row as well: the members of a large class go to different tasks
    classes = signed.join(first, (F.col("row") == F.col("f")) & (F.col("s1") == F.col("f1")) & (F.col("s2") == F.col("f2")))
    banded = classes.select("row", "sketch", F.explode("keys").alias("key"))
    tiled = in_tiles(banded, "key").select("key", "low", "high", "tile", "row", "sketch")
    met = tiled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = list(range(BATCH, BANDS * ROWS + 1, BATCH))
        bounds = list(zip(steps, least_matches(steps, percent / 100), strict=True))
        a, b = [], []
        for run in _runs(batches, 3):
            tile = (run.column("low")[0].as_py(), run.column("high")[0].as_py())
            rows, sides = run.column("row").to_numpy(), run.column("tile").to_numpy()
            sketches = _matrix(run.column("sketch"), BANDS * ROWS)
            forest = Forest(len(rows))
            for i in range(len(rows)):
                later = _later(sides, tile, i)
                if len(later) > 8:
                    roots = forest.roots()
                    later = later[roots[later] != roots[i]]
                if len(later):
                    for j in surviving(sketches, i, later, bounds).tolist():
                        forest.join(i, j)
            roots = forest.roots()
            away = np.flatnonzero(roots != np.arange(len(rows)))
            a += rows[away].tolist()
            b += rows[roots[away]].tolist()
            if len(a) > 20_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return components(met.mapInArrow(run, "a long, b long"))


def verified_links(numbered: DataFrame, family: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: a forest of true links inside every family."""
    grouped = materialise(family, "families")
    texts = numbered.select("row", "text").join(grouped, F.col("row") == F.col("node")).select("row", F.col("root").alias("family"), "text")

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [make.shingles(t) for t in part.column(2).to_pylist()]
                sketches = [make.signature(s).astype(np.uint8).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array(sketches, pa.binary()),
                        pa.array([s.nbytes for s in sets], pa.int64()),
                    ],
                    ["row", "family", "shingles", "sketch", "size"],
                )

    sets = materialise(texts.mapInArrow(expand, "row long, family long, shingles binary, sketch binary, size long"), "sets")
    tiled = in_tiles(sets, "family", "size").select("family", "low", "high", "tile", "row", "shingles", "sketch")
    met = tiled.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = list(range(BATCH, BANDS * ROWS + 1, BATCH))
        bounds = list(zip(steps, least_matches(steps, percent / 100), strict=True))
        for run in _runs(batches, 3):
            tile = (run.column("low")[0].as_py(), run.column("high")[0].as_py())
            rows, sides = run.column("row").to_numpy(), run.column("tile").to_numpy()
            sketches = _matrix(run.column("sketch"), BANDS * ROWS)
            sets = [np.frombuffer(x, np.uint64) for x in run.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
            marked = np.zeros(len(vocabulary), bool)
            forest, a, b = Forest(len(rows)), [], []
            for i in range(len(rows)):
                later = _later(sides, tile, i)
                later = later[100 * np.minimum(sizes[later], sizes[i]) >= percent * np.maximum(sizes[later], sizes[i])]
                if len(later) > 4:
                    roots = forest.roots()
                    later = later[roots[later] != roots[i]]
                if not len(later):
                    continue
                later = surviving(sketches, i, later, bounds)
                if not len(later):
                    continue
                own = ids[starts[i] : starts[i + 1]]
                marked[own] = True
                for j in later.tolist():
                    both = int(np.count_nonzero(marked[ids[starts[j] : starts[j + 1]]]))
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both) and forest.join(i, j):
                        a.append(int(rows[i]))
                        b.append(int(rows[j]))
                marked[own] = False
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.mapInArrow(run, "a long, b long")


def group_rows(numbered: DataFrame, percent: int = PERCENT) -> DataFrame:
    """row, doc_id, n, component_id, first (is it the row of its component with
    the least doc_id, then row, null ids last?) for the rows of a stored table
    (row, doc_id, text)."""
    signed = sign(numbered, percent)
    linked = components(verified_links(numbered, families(signed, percent), percent))
    signed = signed.select("row", "doc_id", "n", "s1", "s2")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = signed.filter("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("f"), F.min(order).alias("least"))
    rooted = classes.join(linked, F.col("f") == F.col("node"), "left").withColumn("root", F.coalesce("root", F.col("f")))
    best = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("best"))
    named = rooted.join(best, F.col("root") == F.col("r")).select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "best")
    # a class with a third of all rows is split by Spark's skew join
    joined = signed.join(named, (F.col("n") > 0) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
    alone = F.col("best").isNull()
    return joined.select(
        "row",
        "doc_id",
        "n",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("row") == F.col("best.row")).alias("first"),
    )


def number_rows(docs: DataFrame) -> DataFrame:
    """A stored copy with a number for each row: row, and the columns of ``docs``
    in one struct, ``all``."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")), "numbered")


def _texts(numbered: DataFrame) -> DataFrame:
    return numbered.select("row", F.col("all.doc_id").cast("long").alias("doc_id"), F.col("all.text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id,
    text; other columns are left out).

    Texts without words, null ones too, have no shingle and no link. A row
    without id belongs to its component, but doesn't name it; a component of such
    rows only has a null id, and its rows are kept.
    """
    grouped = group_rows(_texts(number_rows(docs.select("doc_id", "text"))), percent)
    return grouped.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns of ``docs`` as they are."""
    numbered = number_rows(docs)
    firsts = group_rows(_texts(numbered), percent).filter("first").select(F.col("row").alias("__row"))
    return numbered.join(firsts, F.col("row") == F.col("__row"), "left_semi").select("all.*")

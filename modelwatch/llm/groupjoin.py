"""Jaccard join of word n-gram sets by a token-group matrix. Exact.

1. Every text becomes the set of its four-word shingles (64-bit hashes); equal
   sets are one class from here on, whatever their number.
2. Part keys: two sets that reach the threshold differ in H tokens at most, H
   following from the smaller size. Tokens are dealt by hash to more than H
   parts, so some parts are equal, and a key is the hash of one part (of three,
   for small sets). Sizes are cut into intervals with an H each, and a set has
   the keys of every interval its smaller partner can be in. So two sets that
   link share a key, for certain; those that share none never meet. Where more
   than H parts of a set hold tokens, it shares as many keys of the interval as
   there are beyond H: a set with fewer keys that others have too is left out of
   the interval. So sets that only have some phrases in common drop out here,
   whose number grows with the square of the table.
3. Groups: a class goes to the group of the smallest leader (first class) of its
   shared keys, which gathers similar sets. Groups beyond MEMBERS sets or TOKENS
   tokens are cut by a hash.
4. The matrix: each group stores its token union, and its sets as columns of it.
   Sets of one group are compared when it is built.
5. Groups that share as many keys of an interval as their sets need are a cell. There a set's overlap with the other
   group's union bounds its overlap with every set in it; where the bound of no
   set reaches the threshold the group stays closed, else the sets that qualify
   on both sides are compared, as a product of 0/1 matrices over the common tokens.
   A cell returns a row for each set with a link (a head to hang below, and the
   number of links), never the pairs.

Only the texts are stored; keys go from the workers into the exchange. Texts are
not exchanged to find those of some rows: workers hold a filter of BITS bits, and
what it lets through is joined exactly.

Keys that a sample of 1 in SAMPLE shows to be frequent get their leader from the
sample and skip the exchange by key. The sample steers the work only: the result
does not depend on it. Siblings of a group that was cut are paired by number, not
by their keys.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.llm.common import runs_on_workers
from modelwatch.llm.components import components
from modelwatch.session import materialise

runs_on_workers(__name__)

WORDS = 4
PERCENT = 85
MEMBERS = 256
TOKENS = 400_000
#: One class in SAMPLE looks for frequent keys; those with FREQUENT hits or more are.
SAMPLE = 64
FREQUENT = 64
#: Keys of three parts up to this H, of one part beyond.
TRIPLES = 3
#: The lowest bits of a key tell its interval.
INTERVAL = 255
#: Bits of a filter of rows, whatever the number of rows.
BITS = 1 << 25
#: Columns of the matrices that are multiplied at once.
WIDE = 4096
MEMO = 200_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return (x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)


class Shingles:
    """Texts to sets of shingles, as ascending 64-bit hashes."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.factors = _mix(np.arange(1, WORDS + 2, dtype=np.uint64)) | np.uint64(1)

    def _number(self, word: bytes) -> int:
        if len(self.words) > MEMO:
            self.words.clear()
        self.words[word] = number = xxhash.xxh3_64_intdigest(word)
        return number

    def of(self, text: str | None) -> np.ndarray:
        """A to Z count as a to z, and only ASCII blanks part words. Fewer words
        than WORDS are one shingle, no word is none."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known, number = self.words.get, self._number
        h = np.array([known(w) or number(w) for w in words], np.uint64)
        k = min(WORDS, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k) * self.factors[WORDS], np.uint64)
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * self.factors[i]
        return np.unique(_mix(out))


class PartKeys:
    """The keys of a set, for a threshold in percent."""

    def __init__(self, percent: int):
        if not 0 < percent < 100:
            raise ValueError("the threshold is a percentage between 0 and 100")
        self.percent = percent
        #: upper ends of the intervals of smaller sizes; sets up to the first link with equal ones only
        self.ends = [(percent - 1) // (100 - percent)]
        while self.ends[-1] < 1 << 40:
            self.ends.append(max(self.ends[-1] + 1, self.ends[-1] * 100 // percent))

    def most_different(self, smaller: int) -> int:
        """Tokens in one of two linked sets only, the smaller having ``smaller``."""
        return (100 - self.percent) * smaller // self.percent

    def _dealt(self, tokens: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of every interval its number, H, the part of each token and the tokens in each part."""
        n = len(tokens)
        smallest = -(-n * self.percent // 100)
        for k in range(max(1, bisect_left(self.ends, smallest)), bisect_left(self.ends, n) + 1):
            most = self.most_different(self.ends[k])
            parts = most + 3 + (0 if most <= TRIPLES else most // 16)
            place = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            yield k, most, place, np.bincount(place, minlength=parts)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for k, most, place, held in self._dealt(tokens):
            parts = len(held)
            full = held > 0
            sums = np.zeros(parts, np.uint64)
            sums[full] = np.add.reduceat(_mix(tokens), np.flatnonzero(np.diff(place, prepend=-1)))
            keys = _mix(sums + _mix(np.arange(parts, dtype=np.uint64) + np.uint64(k << 32)) + held.astype(np.uint64))
            # a set with no more than H parts that hold tokens may agree with another in empty ones only
            empty_ones = full.sum() <= most
            if most <= TRIPLES:
                picked = [c for c in combinations(range(parts), 3) if empty_ones or full[list(c)].any()]
                keys = _mix(keys[np.array(picked)].sum(axis=1, dtype=np.uint64))
            elif not empty_ones:
                keys = keys[full]
            out.append(keys & np.uint64(~INTERVAL & (1 << 64) - 1) | np.uint64(k & INTERVAL))
        return np.concatenate(out).view(np.int64)

    def needs(self, tokens: np.ndarray) -> list[int]:
        """For each interval how many of its keys a set shares at least with a set
        that links, above the bits of the interval."""
        return [k & INTERVAL | (1 if most <= TRIPLES else max(1, int(np.count_nonzero(held)) - most)) << 8 for k, most, _, held in self._dealt(tokens)]


def pack(text: str | None) -> bytes:
    """A compressed text, led by its length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes) -> str:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") if size else ""


def sign(texts: DataFrame, percent: int) -> DataFrame:
    """Stored: row, doc_id, n (shingles), s1 and s2 (a 128-bit digest of the set),
    needs, packed (the text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, part_keys = Shingles(), PartKeys(percent)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(2).to_pylist()
                sets = [shingles.of(t) for t in texts]
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
                columns = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(digests[:, i]) for i in (0, 1))]
                columns.append(pa.array([part_keys.needs(s) for s in sets], pa.list_(pa.int64())))
                columns.append(pa.array([pack(t) for t in texts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "s1", "s2", "needs", "packed"])

    return materialise(texts.mapInArrow(run, "row long, doc_id long, n long, s1 long, s2 long, needs array<long>, packed binary"), "signed")


def _place() -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(BITS)).alias("place")


def row_filter(rows: DataFrame) -> np.ndarray:
    """A filter that lets the given rows through, and few others."""
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    words = rows.select(_place()).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _passes(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 6] >> (place & 63) & 1).astype(bool)


def passing(signed: DataFrame, bits: np.ndarray) -> DataFrame:
    """row, packed of the rows that the filter lets through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array(_passes(bits, part.column(1).to_numpy()))).select([0, 2])

    return signed.select("row", _place(), "packed").mapInArrow(run, "row long, packed binary")


def keys_of(signed: DataFrame, percent: int, stopped: np.ndarray | None = None) -> DataFrame:
    """row, key of the rows that the filter ``stopped`` does not know."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, part_keys = Shingles(), PartKeys(percent)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if stopped is not None:
                    part = part.filter(pa.array(~_passes(stopped, part.column(1).to_numpy())))
                keys = [part_keys.of(shingles.of(unpack(t))) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.list_(pa.int64()))], ["row", "keys"])

    return signed.select("row", _place(), "packed").mapInArrow(run, "row long, keys array<long>").select("row", F.explode("keys").alias("key"))


def shared_keys(signed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Stored: row, key, leader, need for the keys of a class that others have too,
    in intervals where they are as many as it needs."""
    several = classes.filter("size > 1").select("s1", "s2", "f")
    copies = materialise(signed.select("row", "s1", "s2").join(several, ["s1", "s2"]).filter("row <> f").select("row"), "copies")
    texts = signed.filter("n > 0").select("row", "packed")
    of_copies = row_filter(copies)
    keyed = keys_of(texts, percent, of_copies)
    if of_copies.any():
        keyed = keyed.union(keys_of(passing(texts, of_copies).join(copies.hint("merge"), "row", "left_anti"), percent))
    sample = signed.filter((F.size("needs") > 0) & (F.pmod("s1", F.lit(SAMPLE)) == 0)).dropDuplicates(["s1", "s2"])
    sample = keys_of(sample, percent).groupBy("key").agg(F.count(F.lit(1)).alias("hits"), F.min("row").alias("leader"))
    frequent = materialise(sample.filter(F.col("hits") >= FREQUENT).select("key", "leader"), "frequent")
    some = frequent.limit(1).count() > 0
    by_key = Window.partitionBy("key")
    leader, c = F.min("row").over(by_key).alias("leader"), F.count(F.lit(1)).over(by_key).alias("c")
    rare = keyed.join(frequent.select("key"), "key", "left_anti") if some else keyed
    out = rare.select("row", "key", c).filter("c > 1").select("row", "key", F.lit(None).cast("long").alias("leader"))
    if some:
        out = out.union(keyed.join(frequent, "key").select("row", "key", "leader"))
    found = materialise(out, "found")

    interval = F.col("key").bitwiseAND(F.lit(INTERVAL)).alias("interval")
    needs = signed.select("row", F.explode("needs").alias("x")).select("row", F.col("x").bitwiseAND(F.lit(INTERVAL)).alias("interval"), F.shiftright("x", 8).alias("need"))
    enough = found.groupBy("row", interval).agg(F.count(F.lit(1)).alias("keys")).join(needs, ["row", "interval"]).filter("keys >= need").select("row", "interval", "need")
    kept = found.withColumn("interval", interval).join(enough, ["row", "interval"])
    out = kept.filter("leader IS NULL").select("row", "key", leader, "need", c).filter("c > 1").drop("c")
    if some:
        out = out.union(kept.filter("leader IS NOT NULL").select("row", "key", "leader", "need"))
    return materialise(out, "shared")


def assign_groups(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Stored: row, home (the leader), tile, tiles, group, size (rows of the class)."""
    home = shared.groupBy("row").agg(F.min("leader").alias("home")).join(classes.select(F.col("f").alias("row"), "n", "size"), "row")
    home = materialise(home, "homes")
    sizes = home.groupBy("home").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("tokens"))
    tiles = F.least("c", F.greatest(F.ceil(F.col("c") / MEMBERS), F.ceil(F.col("tokens") / TOKENS))).cast("int")
    dealt = home.join(sizes.select("home", tiles.alias("tiles")), "home").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    return materialise(dealt.withColumn("group", F.xxhash64("home", "tile")).select("row", "home", "tile", "tiles", "group", "size"), "members")


_GROUP = "group long, rows array<long>, sizes array<long>, lengths array<int>, tokens binary, cells binary, heads array<long>, linked array<long>"
_LINKED = "row long, head long, linked long"


def build_groups(signed: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Stored: a row of the matrix for each group. tokens is the union, cells are
    the places in it of each set's tokens, lengths their numbers; heads and
    linked hold what came of comparing the sets with each other."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shingles = Shingles()
        sets = [shingles.of(unpack(t)) for t in rows.column("packed").to_pylist()]
        union, cells = np.unique(np.concatenate(sets), return_inverse=True)
        names, sizes = rows.column("row").to_numpy(), rows.column("size").to_numpy()
        lengths = np.array([len(s) for s in sets], np.int32)
        same = overlaps(cells, lengths, cells, lengths, len(union))
        links = reaches(same, lengths, lengths, percent) & ~np.eye(len(sets), dtype=bool)
        out = [key[0].as_py(), names, sizes, lengths, union.tobytes(), cells.astype(np.uint32).tobytes(), names[heads(links)], links @ sizes]
        return pa.table([pa.array([x], kind) for x, kind in zip(out, _KINDS, strict=True)], names=_NAMES)

    # a side that grows with the table is not broadcast at any size
    found = passing(signed, row_filter(members)).join(members.select("row", "group", "size").hint("merge"), "row")
    return materialise(found.groupBy("group").applyInArrow(run, _GROUP), "groups")


_NAMES = [c.split()[0] for c in _GROUP.split(", ")]
_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def overlaps(a: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_lengths: np.ndarray, width: int) -> np.ndarray:
    """Common tokens of every set of one side and every set of the other, from the
    columns of their tokens."""
    out = np.zeros((len(a_lengths), len(b_lengths)), np.float32)
    sides = []
    for cells, lengths in ((a, a_lengths), (b, b_lengths)):
        order = np.argsort(cells, kind="stable")
        sides.append((cells[order], np.repeat(np.arange(len(lengths)), lengths)[order], len(lengths)))
    for at in range(0, width, WIDE):
        block = []
        for cells, owner, n in sides:
            start, end = np.searchsorted(cells, (at, at + WIDE))
            dense = np.zeros((n, WIDE), np.float32)
            dense[owner[start:end], cells[start:end] - at] = 1
            block.append(dense)
        out += block[0] @ block[1].T
    return out.astype(np.int64)


def reaches(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a[:, None].astype(np.int64) + b[None, :] - common)


def heads(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row it hangs together with."""
    label = np.arange(len(links))
    if not len(links):
        return label
    while True:
        least = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


class Group:
    def __init__(self, rows: list, sizes: list, lengths: list, tokens: bytes, cells: bytes):
        self.rows, self.sizes = np.array(rows, np.int64), np.array(sizes, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.tokens, self.cells = np.frombuffer(tokens, np.uint64), np.frombuffer(cells, np.uint32)

    def within(self, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a union whose tokens have a ``place`` in the other one (or -1): the
        sets whose overlap with it reaches the threshold, and their common tokens."""
        common = place[self.cells]
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        bound = np.bincount(owner[common >= 0], minlength=len(self.lengths))
        good = 100 * bound >= percent * self.lengths
        kept = (common >= 0) & good[owner]
        return np.flatnonzero(good), common[kept], bound[good]


def compare(a: Group, b: Group, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """rows, heads and numbers of links of the sets that link across two groups."""
    _, mine, yours = np.intersect1d(a.tokens, b.tokens, assume_unique=True, return_indices=True)
    sides = []
    for group, at in ((a, mine), (b, yours)):
        place = np.full(len(group.tokens), -1, np.int64)
        place[at] = np.arange(len(at))
        sides.append(group.within(place, percent))
        if not len(sides[-1][0]):
            return None
    (i, ci, ni), (j, cj, nj) = sides
    links = reaches(overlaps(ci, ni, cj, nj, len(mine)), a.lengths[i], b.lengths[j], percent)
    if not links.any():
        return None
    k = len(i)
    both = np.zeros((k + len(j),) * 2, bool)
    both[:k, k:], both[k:, :k] = links, links.T
    rows = np.concatenate([a.rows[i], b.rows[j]])
    found = np.concatenate([links @ b.sizes[j], links.T @ a.sizes[i]])
    some = found > 0
    return rows[some], rows[heads(both)][some], found[some]


def cells(shared: DataFrame, members: DataFrame) -> DataFrame:
    """g1, g2: the groups of the matrix that may hold links between them, once.

    Sets that link share as many keys of an interval as either needs, and their
    groups share these. What a group needs for a key is the least of its sets."""
    tiles = members.filter("tiles > 1").select("home", "tile", "tiles", "group").distinct()
    other = F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("lower")
    siblings = tiles.select("home", "group", "tile", other).filter("lower < tile").select("group", F.xxhash64("home", "lower").alias("with"))
    keyed = shared.join(members.select("row", "home", "group"), "row").groupBy("key", "home", "group").agg(F.min("need").alias("need"))
    keyed = materialise(keyed, "matrix")
    with_ = keyed.select(F.col("key").alias("k"), F.col("home").alias("h"), F.col("group").alias("with"), F.col("need").alias("needs"))
    met = keyed.join(with_, (F.col("key") == F.col("k")) & (F.col("home") < F.col("h")))
    met = met.groupBy("group", "with", F.col("key").bitwiseAND(F.lit(INTERVAL))).agg(F.count(F.lit(1)).alias("keys"), F.min(F.greatest("need", "needs")).alias("need"))
    met = met.filter("keys >= need").select("group", "with").distinct()
    return met.union(siblings).select(F.col("group").alias("g1"), F.col("with").alias("g2"))


def cross_links(groups: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """row, head, linked from every cell that is opened."""
    columns = ["rows", "sizes", "lengths", "tokens", "cells"]
    used = pairs.select(F.explode(F.array("g1", "g2")).alias("group")).distinct()
    groups = groups.join(used, "group", "left_semi")
    one = groups.select(F.col("group").alias("g1"), *[F.col(c).alias(f"{c}1") for c in columns])
    two = groups.select(F.col("group").alias("g2"), *[F.col(c).alias(f"{c}2") for c in columns])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                values = [c[0].as_py() for c in batch.slice(at, 1).columns]
                found = compare(Group(*values[:5]), Group(*values[5:]), percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["row", "head", "linked"])

    met = pairs.join(one.hint("merge"), "g1").join(two.hint("merge"), "g2")
    return met.select(*[f"{c}1" for c in columns], *[f"{c}2" for c in columns]).mapInArrow(run, _LINKED)


def jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other rows linked to it, equal
    texts included) of every row of ``docs`` (doc_id, text; other columns are left out).

    Texts without words, null ones too, have no shingle and no link. A row without
    id belongs to its component, but does not name it; a component of such rows
    has a null id. Rows that repeat are linked with each other.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    signed = sign(docs.select(F.monotonically_increasing_id().alias("row"), *columns), percent)
    about = [F.min("row").alias("f"), F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least"), F.min("n").alias("n")]
    classes = materialise(signed.filter("n > 0").groupBy("s1", "s2").agg(*about), "classes")
    shared = shared_keys(signed, classes, percent)
    members = assign_groups(shared, classes)
    groups = build_groups(signed, members, percent)
    inner = groups.select(F.explode(F.arrays_zip("rows", "heads", "linked")).alias("m")).select(F.col("m.rows").alias("row"), F.col("m.heads").alias("head"), "m.linked")
    links = materialise(inner.filter("linked > 0").union(cross_links(groups, materialise(cells(shared, members), "cells"), percent)), "links")

    linked = links.groupBy(F.col("row").alias("r1")).agg(F.sum("linked").alias("linked"))
    rooted = components(links.select(F.col("row").alias("a"), F.col("head").alias("b")))
    named = classes.join(rooted, F.col("f") == F.col("node"), "left").join(linked, F.col("f") == F.col("r1"), "left")
    named = named.select("s1", "s2", "size", "least", F.coalesce("root", "f").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    ids = named.groupBy(F.col("root").alias("r2")).agg(F.min("least").alias("component"))
    named = named.join(ids, F.col("root") == F.col("r2")).select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), "component", (F.col("size") - 1 + F.col("linked")).alias("n_links"), F.lit(True).alias("known")
    )
    # a class with a third of all rows is split by Spark's skew join
    found = signed.select("doc_id", "n", "s1", "s2").join(named, (F.col("n") > 0) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
    component = F.when(F.col("known"), F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

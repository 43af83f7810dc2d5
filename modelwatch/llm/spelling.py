"""Spelling variants: words one edit apart, grouped by asymmetric q-chunks.

Of two words that differ by one inserted, deleted or replaced code point, the
shorter one (either, if they are as long) contributes two disjoint chunks: with
L code points and q = L div 2, its first and its last q. One edit can touch only
one of them, so the other is found in the longer word, moved by one place at
most. The longer word contributes its positional q-grams: those at the place of
a chunk, or one place further if it is longer, for no chunk can meet any other.
Words meet in an equi-join on (L, place, chunk) and are verified by their edit
distance.

A chunk that many words share ("inter", "ation") would make a large group. Where
a group would make more than PARTNERS times as many pairs as it has rows, it is
not paired: what is left of both words after the common chunk again differs by
one edit only, so it contributes two chunks and positional grams of its own
within the group. This is repeated until no group is too large; it ends because
the rest halves each time, and words that agree in all but one code point are no
more than the alphabet. No pair is lost, and no group is emitted as all its pairs.

Everything but the splitting of texts into words runs as joins and aggregates.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import runs_on_workers
from modelwatch.session import materialise

runs_on_workers(__name__)

#: What a word is, and which runs are read with a missing letter.
RUN = "[a-zÀ-ÿ]"
LEAST_LETTERS = 5
LEAST_COUNT = 3
SLIP = 97
#: A word is a form of a near word that is so many times as frequent.
TIMES = 2
#: Candidate pairs per row of a group; beyond that its words are told apart by further chunks.
PARTNERS = 16
#: Distinct words that a task counts before it hands them on.
HELD = 200_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def slipped(doc_id: str, run: str) -> str:
    """``run`` as it is counted: where 97 divides the CRC-32 of ``doc_id:run``,
    without its code point at CRC-32 modulo length."""
    code = zlib.crc32(f"{doc_id}:{run}".encode())
    if code % SLIP:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts with ``least`` occurrences or more."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(RUN + "{%d,}" % LEAST_LETTERS).findall
        total: Counter = Counter()

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                before = zlib.crc32(doc_id.encode() + b":")
                for word, n in Counter(find(text.encode().translate(LOWER).decode())).items():
                    if not zlib.crc32(word.encode(), before) % SLIP:
                        word = slipped(doc_id, word)
                        if len(word) < LEAST_LETTERS:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield handed()
        if total:
            yield handed()

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


def _chunks(rows: DataFrame) -> DataFrame:
    """Two disjoint chunks of the rest of each row, and what is left beside them."""
    length = F.length("rest")
    q = F.floor(length / 2).cast("int")
    sides = [
        (0, F.substr("rest", F.lit(1), q), F.substr("rest", q + 1)),
        (1, F.substr("rest", length - q + 1, q), F.substr("rest", F.lit(1), length - q)),
    ]
    found = [F.struct(F.xxhash64("key", length, F.lit(side), chunk).alias("key"), rest.alias("rest")) for side, chunk, rest in sides]
    return rows.select("word", "n", F.explode(F.array(*found)).alias("f")).select("word", "n", "f.key", "f.rest")


def _grams(rows: DataFrame) -> DataFrame:
    """The positional grams of the rest of each row that a chunk of a rest
    shorter by ``longer`` code points (0 or 1) can meet."""
    length = F.length("rest") - F.col("longer")
    q = F.floor(length / 2).cast("int")
    found = []
    for side, place in ((0, F.lit(0)), (1, length - q)):
        for shift in (0, 1):
            at = place + shift
            rest = F.concat(F.substr("rest", F.lit(1), at), F.substr("rest", at + q + 1))
            gram = F.struct(F.xxhash64("key", length, F.lit(side), F.substr("rest", at + 1, q)).alias("key"), rest.alias("rest"))
            found.append(F.when(F.col("longer") >= shift, gram))
    met = rows.select("word", "n", "longer", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return met.select("word", "n", "longer", "f.key", "f.rest")


def near_words(words: DataFrame) -> DataFrame:
    """a, na, b, nb: every pair of the stored ``words`` (word, n) that is one
    inserted, deleted or replaced code point apart, once."""
    start = words.select("word", "n", F.lit(0).cast("long").alias("key"), F.col("word").alias("rest"))
    chunks = _chunks(start)
    grams = _grams(start.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))))
    pairs = None
    while True:
        chunks, grams = materialise(chunks, "chunks"), materialise(grams, "grams")
        sizes = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.length("rest")).alias("left"))
        sizes = sizes.join(grams.groupBy("key").agg(F.count(F.lit(1)).alias("g")), "key")
        large = (F.col("c") * F.col("g") > PARTNERS * (F.col("c") + F.col("g"))) & (F.col("left") > 1)
        sizes = materialise(sizes.select("key", large.alias("large")), "sizes")
        few = sizes.filter("not large").select("key")
        left = chunks.join(few, "key", "left_semi").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
        right = grams.join(few, "key", "left_semi").select("key", F.col("word").alias("b"), F.col("n").alias("nb"), "longer")
        met = left.join(right, "key").filter("(longer = 1 or a < b) and levenshtein(a, b, 1) = 1")
        met = materialise(met.select("a", "na", "b", "nb"), "near")
        pairs = met if pairs is None else pairs.union(met)
        many = sizes.filter("large").select("key")
        if not many.limit(1).count():
            return pairs.distinct()
        chunks = _chunks(chunks.join(many, "key", "left_semi"))
        grams = _grams(grams.join(many, "key", "left_semi"))


def followed(forms: DataFrame) -> DataFrame:
    """word, root for the stored ``forms`` (word, form): where the forms lead in
    the end. Each round doubles the steps, and a form is at least twice as
    frequent as its word, so there are few."""
    walk = forms.select("word", F.col("form").alias("root"))
    while True:
        on = walk.select(F.col("word").alias("w"), F.col("root").alias("on"))
        walk = walk.join(on, F.col("root") == F.col("w"), "left")
        walk = materialise(walk.select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "walk")
        if not walk.filter("moved").limit(1).count():
            return walk.select("word", "root")
        walk = walk.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id,
    text; other columns are left out).

    Null and empty texts have no words, a null id counts as an empty one, and rows
    that repeat count each. Of near words with equal counts the smallest in
    code-point order is the form; without one form and form_n are null, and the
    word is its own root.
    """
    words = materialise(count_words(docs, least), "words")
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("w"), F.col("na").alias("own"), F.col("b").alias("o"), F.col("nb").alias("on"))
    both = both.union(pairs.select("b", "nb", "a", "na"))
    best = F.min(F.struct((-F.col("on")).alias("less"), F.col("o").alias("form"))).alias("best")
    grouped = both.groupBy("w", "own").agg(F.count(F.lit(1)).alias("near"), best)
    accepted = -F.col("best.less") >= TIMES * F.col("own")
    formed = materialise(
        grouped.select("w", "near", F.when(accepted, F.col("best.form")).alias("form"), F.when(accepted, -F.col("best.less")).alias("form_n")), "forms"
    )
    roots = followed(formed.filter("form is not null").select(F.col("w").alias("word"), "form")).withColumnRenamed("word", "v")
    out = words.join(formed, F.col("word") == F.col("w"), "left").join(roots, F.col("word") == F.col("v"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), "form_n")

"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes
log-count ratios.

Lower-cased texts give the set of their n-grams of 4 to 6 code points, hashed
into slots. On labelled rows each slot has a log-count ratio: how much likelier
a toxic document holds it than a clean one. The slots whose ratio is farthest
from chance carry ratio x presence into a logistic regression. A text of any
length is read whole, in pieces that overlap by what an n-gram needs.

The labelled rows that it learns from are a bounded sample (SAMPLE_ROWS by a
hash of the id); counts and the regression run as Spark jobs over it. Scoring
reads the weights only, which do not grow with the data. Labels, language,
source and id are never inputs of a score.

Null and empty texts score by the intercept. Rows that repeat are scored each.
Several labels of one document: one toxic label makes it toxic. Without labelled
rows, or with clean ones only, every score is 0; with toxic ones only it is 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import map_rows, runs_on_workers
from modelwatch.session import materialise

runs_on_workers(__name__)

ORDERS = (4, 5, 6)
SLOT_BITS = 20
#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 8000
#: Slots that it keeps, and in how many sampled documents one must be.
FEATURES = 1 << 14
LEAST_DOCUMENTS = 3
REGULARISATION = 1e-4
#: Code points that are hashed at a time.
PIECE = 1 << 20


def slots_of(text: str, kept: np.ndarray | None = None) -> np.ndarray:
    """The slots of the n-grams of ``text``, once each; of those in ``kept``."""
    text = f" {text.lower()} "
    found = []
    for at in range(0, max(1, len(text) - ORDERS[0] + 1), PIECE):
        points = np.frombuffer(text[at : at + PIECE + ORDERS[-1] - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = points * np.uint32(0x9E3779B1)
        for n in range(2, ORDERS[-1] + 1):
            if len(points) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ (points[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n))
            if n in ORDERS:
                x = h ^ (h >> np.uint32(15))
                x = x * np.uint32(0x2C1B3C6D)
                x ^= x >> np.uint32(12)
                x *= np.uint32(0x297A2D39)
                x >>= np.uint32(32 - SLOT_BITS)
                found.append(x if kept is None else x[kept[x]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of up to ``rows`` labelled documents that aren't held out."""
    docs = docs.select("doc_id", "text")
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    # labels of documents that aren't there must not use up the sample
    here = docs.select(F.col("doc_id").cast("long").alias("__here"))
    marked = marked.join(here, F.col("__id") == F.col("__here"), "left_semi")
    # rows of two numbers, at most ``rows`` of them
    chosen = marked.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    joined = docs.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("__id"))
    return joined.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("__toxic").alias("toxic"))


def slot_counts(sample: DataFrame) -> DataFrame:
    """slot, toxic and clean: in how many documents of each kind it is."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind = np.zeros((2, 1 << SLOT_BITS), np.int64)
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_kind[toxic, slots_of(text)] += 1
        there = np.flatnonzero(by_kind.any(axis=0))
        for part in np.array_split(there, max(1, len(there) // 50_000)):
            yield pa.RecordBatch.from_pydict({"slot": part.astype(np.int32), "toxic": by_kind[1, part], "clean": by_kind[0, part]})

    counted = sample.select("text", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")).mapInArrow(count, "slot int, toxic long, clean long")
    return counted.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Weights by slot and the intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    sample = materialise(labelled_sample(docs, labels).repartition(8), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return {"slots": [], "weights": [], "intercept": math.inf if n_toxic else -math.inf}
    ratio = F.log((F.col("toxic") + 1) / (n_toxic + 2)) - F.log((F.col("clean") + 1) / (n_clean + 2))
    far = F.abs(ratio) / F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1))
    counted = slot_counts(sample).filter(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS)
    best = counted.select("slot", ratio.alias("ratio"), far.alias("far")).orderBy(F.desc("far"), "slot").limit(FEATURES).collect()
    if not best:
        prior = math.log(n_toxic / n_clean)
        return {"slots": [], "weights": [], "intercept": prior}
    slots, ratios = [r["slot"] for r in best], [r["ratio"] for r in best]

    def present() -> Callable[..., tuple]:
        kept = np.zeros(1 << SLOT_BITS, bool)
        kept[slots] = True
        place = np.zeros(1 << SLOT_BITS, np.int32)
        place[slots] = np.arange(len(slots))

        def row(text: str, toxic: int) -> tuple:
            at = np.sort(place[slots_of(text, kept)])
            return int(toxic == 1), at.astype("<i4").tobytes()

        return row

    def vector(at: bytes) -> object:
        at = np.frombuffer(at, "<i4")
        return Vectors.sparse(len(ratios), at.tolist(), [ratios[i] for i in at])

    rows = materialise(map_rows(sample, present, "label int, at binary"), "present")
    rows = rows.select(F.col("label").cast("double").alias("label"), F.udf(vector, VectorUDT())("at").alias("features"))
    model = LogisticRegression(maxIter=60, regParam=REGULARISATION, standardization=False).fit(rows)
    return {"slots": slots, "weights": [w * r for w, r in zip(model.coefficients.toArray().tolist(), ratios, strict=True)], "intercept": model.intercept}


def scorer(model: dict) -> Callable[[], Callable[[str | None], float]]:
    """A maker of the function from text to score, for a task's start."""

    def start() -> Callable[[str | None], float]:
        kept, weight = np.zeros(1 << SLOT_BITS, bool), np.zeros(1 << SLOT_BITS)
        kept[model["slots"]] = True
        weight[model["slots"]] = model["weights"]
        offset = model["intercept"]

        def score(text: str | None) -> float:
            z = offset + float(weight[slots_of(text or "", kept)].sum())
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

        return score

    return start


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` needs doc_id and text, ``labels`` doc_id and toxic. Returns
    doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on)."""
    make = scorer(fit(docs, labels))

    def start() -> Callable[..., tuple]:
        score = make()

        def run(doc_id: int | None, held: bool, text: str | None) -> tuple:
            s = score(text)
            return doc_id, held, s, int(s >= 0.5)

        return run

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return map_rows(rows, start, "doc_id long, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns as they are."""
    make = scorer(fit(docs, labels))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array([score(t) < 0.5 for t in part.column(text_at).to_pylist()], pa.bool_()))

    text_at = docs.columns.index("text")
    return docs.mapInArrow(keep, docs.schema)

"""Mixing sources to target weights, exact to the word.

1. Every source's documents are laid end to end in a fixed random order and cut
   into blocks of whole documents, about ``block_words`` words each; only longer
   documents are cut into pieces.
2. A source's target fixes its quota of blocks: whole passes over all blocks,
   then a run of the permuted blocks, whose last one is taken in part.
3. A splitting tree deals the quotas out to the output shards: at each node the
   shards are halved and the left half's share of each source is one draw of a
   multivariate hypergeometric distribution. Each shard follows its own path
   from the root, every draw depends on the seed, the node and the source only,
   and so all shards agree without an exchange.
4. The shards take consecutive, hence disjoint, runs of each source's permuted
   blocks and shuffle them locally.

Random choices are hashes of seed, ids and block numbers: reruns and recomputed
tasks agree. Order within a source is found in two steps, inside ranges of the
hash and then over the ranges' totals, so that no task holds a whole source.
All of it is DataFrame work.

Null sources are a source of their own, the last one. Documents without words
are in no block and taken 0 times. Rows that repeat are mixed one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.llm.common import WORD, word_count
from modelwatch.session import materialise

BLOCK_WORDS = 2048
SHARD_WORDS = 4_000_000
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 42
#: Rows in one range of a two-step order, about.
RANGE_ROWS = 2_000
#: Tries of a rejection draw; each one fails with a chance under one half.
TRIES = 64


# ---------------------------------------------------------------- order in a source


def running(df: DataFrame, group: str, code: str, order: list[str], value: str, before: str) -> DataFrame:
    """``before``: the sum of ``value`` over the rows of ``group`` that come
    earlier by ``code`` (hexadecimal digits), then by ``order``."""
    digits = 0
    rows = df.count()
    while rows > RANGE_ROWS * 16**digits and digits < 12:
        digits += 1
    ranged = df.withColumn("__range", F.substring(code, 1, digits))
    keys = [F.col(group).eqNullSafe(F.col("__g")), F.col("__range") == F.col("__r")]
    within = Window.partitionBy(group, "__range").orderBy(code, *order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.sum(value).alias("__sum"))
    above = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__above", F.coalesce(F.sum("__sum").over(above), F.lit(0))).drop("__sum")
    inside = ranged.withColumn("__inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inside.join(totals, keys[0] & keys[1])
    return joined.select(*[F.col(c) for c in df.columns], (F.col("__inside") + F.col("__above")).cast("long").alias(before))


# ---------------------------------------------------------------- targets


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target (words, a double).

    Sources in code point order (null last) weigh WEIGHTS, repeating. The
    targets share SHARE of all words by weight, none above MOST times its
    source; what is above goes to the others by weight. Sources at their limit
    are those with the least limit per weight, so the level of the rest follows
    from running sums.
    """
    every = Window.partitionBy(F.lit(0))  # one row per source
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("ratio", F.lit(MOST) * F.col("source_size") / F.col("weight"))
    order = every.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(F.lit(MOST) * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(SHARE) * F.sum("source_size").over(every)
    levelled = ranked.withColumn("here", (total - before) / rest)
    level = F.min(F.when(F.col("ratio") > F.col("here"), F.struct("ratio", "here"))).over(every)["here"]
    # beyond the first source below its limit all are below it
    first = F.min(F.when(F.col("ratio") > F.col("here"), F.col("ratio"))).over(every)
    target = F.when(F.col("ratio") >= first, level * F.col("weight")).otherwise(F.lit(MOST) * F.col("source_size"))
    return levelled.select("source", "source_size", target.cast("double").alias("target"))


# ---------------------------------------------------------------- the splitting tree


def _uniform(*key: Column) -> Column:
    """A number between 0 and 1, both excluded, that depends on ``key`` only."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 12).cast("double") + 0.5) / float(1 << 52)


def _log_factorial(x: Column) -> Column:
    """ln x! : listed up to 15, Stirling's series beyond."""
    listed = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])

    def known(x: Column) -> Column:
        series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / x / x) / x / x) / x
        return F.when(x >= 16, series).otherwise(F.get(listed, F.greatest(x, F.lit(0.0)).cast("int")))

    return _let(x.cast("double"), known)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(population: Column, marked: Column, drawn: Column, *key: Column) -> Column:
    """How many of ``drawn`` out of ``population`` are ``marked`` ones.

    Ratio-of-uniforms rejection: the number of steps does not depend on the
    counts. By symmetry the smaller of marked and rest, and of drawn and left,
    is worked with.
    """

    def known(c: Column) -> Column:
        n, few, some = c["n"].cast("double"), c["few"].cast("double"), c["some"].cast("double")
        share = few / n
        spread = F.sqrt((n - some) * some * share * (1 - share) / F.greatest(n - 1, F.lit(1.0)) + 0.5)
        mode = F.floor((some + 1) * (few + 1) / (n + 2))
        weight = lambda z: _log_factorial(z) + _log_factorial(few - z) + _log_factorial(some - z) + _log_factorial(n - few - some + z)
        shape = F.struct(
            (some * share + 0.5).alias("centre"),
            (spread * (2 * math.sqrt(2 / math.e)) + (3 - 2 * math.sqrt(3 / math.e))).alias("width"),
            weight(mode).alias("top"),
            F.least(some, few).alias("most"),
            mode.alias("mode"),
        )

        def attempt(s: Column, i: Column) -> Column:
            x, y = _uniform(*key, i, F.lit(1)), _uniform(*key, i, F.lit(2))

            def tried(z: Column) -> Column:
                fits = (z >= 0) & (z <= s["most"]) & (2 * F.log(x) <= s["top"] - weight(z))
                return F.when(fits, z)

            return _let(F.floor(s["centre"] + s["width"] * (y - 0.5) / x), tried)

        def draw(s: Column) -> Column:
            got = F.aggregate(
                F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("long"), lambda a, i: F.when(a.isNull(), attempt(s, i)).otherwise(a)
            )
            return F.coalesce(got, s["mode"])

        return _let(shape, draw)

    few, some = F.least(marked, population - marked), F.least(drawn, population - drawn)

    def mirrored(z: Column) -> Column:
        marked_among_some = F.when(marked * 2 > population, some - z).otherwise(z)
        return F.when(drawn * 2 > population, marked - marked_among_some).otherwise(marked_among_some)

    case = F.struct(population.alias("n"), few.alias("few"), some.alias("some"))
    drawn_few = F.when((few <= 0) | (some <= 0), F.lit(0).cast("long")).otherwise(_let(case, known))
    return _let(drawn_few, mirrored).cast("long")


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Deal the blocks of each source out to ``shards`` (a power of two) shards
    whose sizes differ by one at most.

    ``quotas``: source, quota; one row per source, held as one list of numbers
    per shard. Returns shard, source, blocks, first (the rank of the shard's
    first block among the permuted blocks of the source).
    """
    levels = shards.bit_length() - 1
    listed = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota"))).alias("all"))
    spark = quotas.sparkSession
    # the list of quotas is one row
    every = spark.range(shards).withColumnRenamed("id", "shard").withColumn("all", listed.scalar())
    state = F.struct(F.transform("all", lambda x: x["quota"].cast("long")).alias("left"), F.lit(0).cast("long").alias("node"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def halve(node: Column, level: Column) -> Column:
        def dealt(case: Column) -> Column:
            """The left half's share: source by source, each out of what is left."""
            start = F.struct(case["all"].alias("rest"), case["half"].alias("open"), F.array().cast("array<bigint>").alias("took"))

            def draw(a: Column, own: Column) -> Column:
                got = hypergeometric(a["rest"], own, a["open"], F.lit(seed), level, node["node"], F.size(a["took"]))
                return _let(
                    got,
                    lambda x: F.struct((a["rest"] - own).alias("rest"), (a["open"] - x).alias("open"), F.concat(a["took"], F.array(x)).alias("took")),
                )

            return F.aggregate(node["left"], start, draw, lambda a: a["took"])

        n = total(node["left"])
        # halves differ by one at most; the node's number says which is larger
        case = F.struct(n.alias("all"), F.shiftright(n + 1, 1).alias("half"))
        right = F.call_function("shiftright", F.col("shard"), F.lit(levels) - level).bitwiseAND(F.lit(1).cast("long")) == 1
        return _let(
            _let(case, dealt),
            lambda took: F.struct(
                F.when(right, F.zip_with(node["left"], took, lambda a, b: a - b)).otherwise(took).alias("left"),
                (node["node"] * 2 + F.when(right, 1).otherwise(0)).cast("long").alias("node"),
            ),
        )

    steps = F.sequence(F.lit(1), F.lit(levels)) if levels else F.array().cast("array<int>")
    ended = every.withColumn("mine", F.aggregate(steps, state, halve, lambda a: a["left"]))
    dealt = ended.select("shard", F.posexplode("mine").alias("at", "blocks"), "all").select(
        "shard", F.get("all", F.col("at"))["source"].alias("source"), "blocks"
    )
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("first", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)))


# ---------------------------------------------------------------- the mixture


def _code(*parts: object) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def mixture(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The pieces of the mixture, and the sources with their targets.

    ``sized``: row (a number of its own for every row), doc_id, source, size; a
    stored table. Pieces: shard, place (in the shard), row, epoch, word (first
    word of the piece in its document), words.
    """
    targets = materialise(source_targets(sized), "targets")
    total = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    shards = 1 << max(0, math.ceil(math.log2(max(1.0, total / shard_words))))
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))

    laid = running(
        sized.filter("size > 0").withColumn("__code", _code(seed, text_of("doc_id"))),
        "source", "__code", ["doc_id", "size", "row"], "size", "start",
    )
    cut = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_words))
    pieces = laid.select("row", "source", "start", "size", F.explode(cut).alias("piece")).select(
        "row",
        "source",
        (F.col("piece") * block_words).alias("word"),
        F.least(F.lit(block_words), F.col("size") - F.col("piece") * block_words).cast("long").alias("words"),
        (F.col("start") + F.col("piece") * block_words).alias("begin"),
    )
    pieces = materialise(pieces.withColumn("block", F.floor(F.col("begin") / block_words).cast("long")), "pieces")

    blocks = pieces.groupBy("source", "block").agg(F.sum("words").alias("words"), F.min("begin").alias("begins"))
    coded = materialise(blocks.withColumn("__code", _code(seed, "block", text_of("source"), F.col("block").cast("string"))), "blocks")
    placed = running(coded.withColumn("__one", F.lit(1)), "source", "__code", ["block"], "words", "before")
    placed = running(placed, "source", "__code", ["block"], "__one", "rank")
    goal = targets.select(
        F.col("source").alias("__s"),
        F.round("target").cast("long").alias("goal"),
        "source_size",
    )
    n_blocks = coded.groupBy(F.col("source").alias("__b")).agg(F.count(F.lit(1)).alias("n_blocks"))
    goal = goal.join(n_blocks, F.col("__s").eqNullSafe(F.col("__b"))).drop("__b")
    passes = F.expr("try_divide(goal - goal % nullif(source_size, 0), source_size)").cast("long")
    part = F.col("goal") - passes * F.col("source_size") - F.col("before")
    drawn = placed.join(goal, F.col("source").eqNullSafe(F.col("__s"))).select(
        "source", "block", "begins", "rank", "n_blocks", passes.alias("passes"), F.greatest(F.least(part, F.col("words")), F.lit(0)).alias("part")
    )
    epochs = F.sequence(F.lit(0).cast("long"), F.col("passes"))
    drawn = drawn.select("*", F.explode(epochs).alias("epoch")).filter("epoch < passes or part > 0")
    drawn = drawn.select(
        F.col("source").alias("__s"),
        F.col("block").alias("__b"),
        "begins",
        "epoch",
        (F.col("epoch") * F.col("n_blocks") + F.col("rank")).alias("turn"),
        F.when(F.col("epoch") < F.col("passes"), F.lit(None)).otherwise(F.col("part")).alias("part"),
    )
    drawn = materialise(drawn, "drawn")

    quotas = drawn.groupBy(F.col("__s").alias("source")).agg(F.count(F.lit(1)).alias("quota"))
    dealt = split_quotas(quotas, shards, seed).filter("blocks > 0")
    turns = dealt.select(
        "shard", F.col("source").alias("__t"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("__turn")
    )
    drawn = drawn.join(turns, F.col("__s").eqNullSafe(F.col("__t")) & (F.col("turn") == F.col("__turn")))
    taken = pieces.join(drawn, pieces["source"].eqNullSafe(F.col("__s")) & (pieces["block"] == F.col("__b")))
    words = F.coalesce(F.greatest(F.least(F.col("part") - (F.col("begin") - F.col("begins")), F.col("words")), F.lit(0)), F.col("words"))
    taken = taken.select("shard", "row", "epoch", "word", words.alias("words"), "source", "block").filter("words > 0")
    local = Window.partitionBy("shard").orderBy(_code(seed, "place", text_of("source"), F.col("block").cast("string"), F.col("epoch").cast("string")), "row", "word")
    return taken.select("shard", F.row_number().over(local).alias("place"), "row", "epoch", "word", "words"), targets


def number_rows(docs: DataFrame, *columns: object) -> DataFrame:
    """A stored copy of ``columns`` with a number for every row; reading the copy
    again gives the same numbers."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("__row"), *columns), "rows")


def mix_documents(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document.

    ``docs`` needs doc_id, text and source. Returns doc_id, size, source_size,
    target, taken, one row per row of ``docs``. Empty tables give no row.
    """
    sized = number_rows(docs, F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count("text").alias("size"))
    sized = sized.withColumnRenamed("__row", "row")
    pieces, targets = mixture(sized)
    taken = pieces.groupBy(F.col("row").alias("__row")).agg(F.sum("words").alias("taken"))
    goal = targets.withColumnRenamed("source", "__s")
    joined = sized.join(taken, F.col("row") == F.col("__row"), "left").join(goal, F.col("source").eqNullSafe(F.col("__s")))
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mixture as documents: a row for each pass over a document, with the
    columns of ``docs``. A document that is taken in part keeps the words taken,
    one blank apart; ``n_chars`` follows if there is such a column."""
    # in one struct, so that no column of theirs meets one of ours
    stored = number_rows(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))
    sized = stored.select(
        F.col("__row").alias("row"), F.col("all.doc_id").cast("long").alias("doc_id"), F.col("all.source").cast("string").alias("source"), word_count("all.text").alias("size")
    )
    pieces, _ = mixture(materialise(sized, "sizes"))
    by_pass = pieces.groupBy(F.col("row").alias("__r"), "epoch").agg(
        F.sum("words").alias("__taken"), F.sort_array(F.collect_list(F.struct("word", "words"))).alias("__parts")
    )
    named = stored.join(by_pass, F.col("__row") == F.col("__r"))
    words = F.regexp_extract_all(F.col("all.text"), F.lit(WORD), F.lit(0))
    cut = _let(words, lambda w: F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice(w, p["word"].cast("int") + 1, p["words"].cast("int")))), " "))
    whole = F.col("__taken") == word_count("all.text")
    out = {c: F.col(f"all.`{c}`") for c in docs.columns}
    out["text"] = F.when(whole, F.col("all.text")).otherwise(cut)
    if "n_chars" in out:
        out["n_chars"] = F.when(whole, F.col("all.n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)
    return named.select(*[v.alias(c) for c, v in out.items()])

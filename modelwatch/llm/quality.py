"""Quality rules of documents, judged together with their host.

Every document gets counts of its own text. Rule failures are then summed up
per host, the failure rates are shrunk towards all hosts by a beta prior whose
mean and strength come from the hosts themselves (method of moments), and the
host's verdict is joined back: on a host that is known for a fault one fault of
a kind is enough to reject a document, elsewhere it takes two kinds. A document
that breaks no rule stays wherever it comes from.

All of it is DataFrame work: the counts stay inside the row, so a document of
any length is never spread over tasks or compared with others, and a host with
a third of all rows is summed up map-side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import BLANKS, WORD
from modelwatch.session import materialise

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Soft rules: name -> does a document with these counts break it?
SOFT_RULES: dict[str, str] = {
    "symbols": "10 * n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
    "lengths": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
#: A host is known for a fault from this (shrunk) rate on.
HOST_RATE = 0.01
#: Soft rules that a document may not break together, whatever its host.
TOO_MANY = 2
#: Hosts up to this number are broadcast, about 100 bytes each.
BROADCAST_HOSTS = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that the text has twice or more.

    A window is known by a 64-bit hash. Positions of equal windows come
    together by sorting; each adds what the window before it does not cover.
    """

    def windows(h: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        return F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), at))

    def placed(w: Column) -> Column:
        return F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        def near(e: Column, j: Column) -> Column:
            h = e["h"]
            before = F.coalesce(F.get(s, j - 1)["h"] == h, F.lit(False))
            return F.when(before | F.coalesce(F.get(s, j + 1)["h"] == h, F.lit(False)), e["i"])

        return F.sort_array(F.filter(F.transform(s, near), lambda i: i.isNotNull()))

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"))
        return F.aggregate(positions, start, step, lambda a: a["n"])

    # array_distinct is a cheap hash set: only texts that repeat a window are sorted
    count = lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), covered(_let(placed(w), twice))
    )
    windowed = _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.coalesce(_let(windowed, count), F.lit(0))


def count_rules(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the counts of its column ``text`` (null: an empty text):
    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines,
    n_repeat_words, each named with ``prefix``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(_without(x, BLANKS)) > 0)

    def all_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"))

    def all_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    of = {
        "n_words": F.col("__words.n_words"),
        "word_chars": F.length(_without(text, BLANKS)),
        "n_symbols": F.length(text) - F.length(_without(text, SYMBOLS)),
        "n_lines": F.col("__lines.n_lines"),
        "n_dup_lines": F.col("__lines.n_dup_lines"),
        "n_repeat_words": F.col("__words.n_repeat_words"),
    }
    counted = docs.withColumns({"__words": _let(words, all_words), "__lines": _let(lines, all_lines)})
    return counted.withColumns({prefix + k: v.cast("long") for k, v in of.items()}).drop("__words", "__lines")


def base_failed(prefix: str = "") -> Column:
    return F.expr(f"{prefix}n_words < 20 or 100 * {prefix}n_repeat_words > 30 * {prefix}n_words")


def _soft(prefix: str) -> dict[str, Column]:
    named = {}
    for name, rule in SOFT_RULES.items():
        for c in COUNTS:
            rule = rule.replace(c, f"{prefix}{c}") if prefix else rule
        named[name] = F.expr(rule)
    return named


def host_verdicts(counted: DataFrame, host: str = "source", prefix: str = "") -> DataFrame:
    """One row per host: documents, and per soft rule the shrunk failure rate.

    The prior is Beta(m s, (1 - m) s): m is the failure rate of all documents,
    and s makes the prior's variance equal the hosts' variance beyond what
    chance explains (at least 1, at most a million documents strong). Documents
    that fail the base rules count too.
    """
    rules = _soft(prefix)
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(broken).alias(f"{r}_failed") for r, broken in rules.items()]
    )
    total = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("docs"),
        *[F.sum(f"{r}_failed").alias(f"{r}_all") for r in rules],
        *[F.sum(F.col(f"{r}_failed") * F.col(f"{r}_failed") / F.col("n")).alias(f"{r}_square") for r in rules],
    ).first()  # one row

    def rate(r: str) -> Column:
        if not total["docs"]:
            return F.lit(0.0)
        m = total[f"{r}_all"] / total["docs"]
        spread = total[f"{r}_square"] / total["docs"] - m * m - m * (1 - m) * total["hosts"] / total["docs"]
        strength = min(max(m * (1 - m) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
        return (F.col(f"{r}_failed") + m * strength) / (F.col("n") + strength)

    return hosts.select("host", "n", *[rate(r).alias(f"{r}_rate") for r in rules])


def judge(counted: DataFrame, host: str = "source", prefix: str = "", verdict: str = "kept", kept_only: bool = False) -> DataFrame:
    """Join host verdicts back: ``counted`` with a boolean column ``verdict``.

    ``counted`` is read twice, so it should be a stored table. A null host is a
    host of its own. Hosts are broadcast up to BROADCAST_HOSTS of them; beyond
    that Spark joins by shuffle and splits a hot host's partition.
    """
    rules = _soft(prefix)
    hosts = host_verdicts(counted, host, prefix).select(F.col("host").alias("__host"), *[F.col(f"{r}_rate").alias(f"__{r}") for r in rules])
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    n_broken = sum((F.when(broken, 1).otherwise(0) for broken in rules.values()), F.lit(0))
    on_a_known_host = [broken & F.coalesce(F.col(f"__{r}") >= HOST_RATE, F.lit(False)) for r, broken in rules.items()]
    rejected = base_failed(prefix) | (n_broken >= TOO_MANY)
    for known in on_a_known_host:
        rejected = rejected | known
    joined = counted.join(hosts, counted[host].eqNullSafe(F.col("__host")), "left")
    if kept_only:
        return joined.filter(~rejected).select(*[counted[c] for c in counted.columns])
    return joined.select(*[counted[c] for c in counted.columns], (~rejected).alias(verdict))


def document_quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document.

    ``docs`` needs doc_id, text and source; other columns are left out. Returns
    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept. Null and empty texts have no words and fail the base
    rules; rows that repeat are judged each, and count each for their host.
    """
    counted = count_rules(docs.select("doc_id", F.col("text").cast("string").alias("text"), "source")).drop("text")
    judged = judge(materialise(counted, "quality"))
    return judged.select(
        F.col("doc_id").cast("long"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept"
    )


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they are."""
    # in one struct, so that no column of theirs meets one of ours
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")
    counted = count_rules(docs.select(whole, F.col("text").cast("string").alias("text"), "source")).drop("text")
    return judge(materialise(counted, "quality"), kept_only=True).select("all.*")

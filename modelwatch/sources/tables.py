"""The monitoring tables as append-only Parquet folders."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import feature_map
from ..operators import alerts as A
from ..operators import prediction_log as L
from ..operators import versions as V
from ..operators.bins import edge_columns, quantile_profile, to_long
from ..operators.drift import reference_counts
from ..operators.sizing import SMALL_SIDE_ROWS, join_small, match, settle
from ..schemas import DAILY, TABLES
from ..session import materialise
from .manifests import ManifestLog, micros

_PROFILE = "baseline_profile"
_COUNTS = "baseline_counts"


class MissingBaseline(ValueError):
    """No reference distribution has been stored yet."""


class MonitorTables:
    """Folders under ``root``, one per table.

    Rows are only appended.  Labels, acknowledgements, promotions and the
    states of a retraining run are events; the readers derive the current
    state.  Tables that grow with traffic are partitioned by day, so a time
    range reads only its days.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # -- generic ------------------------------------------------------------

    def create_all(self) -> list[str]:
        """Write an empty table for every name that has none yet."""
        made = []
        for name, schema in TABLES.items():
            try:
                self.spark.read.parquet(self.path(name)).schema  # noqa: B018
            except AnalysisException:
                self.spark.createDataFrame([], schema).write.mode("append").parquet(self.path(name))
                made.append(name)
        return made

    @staticmethod
    def schema(name: str) -> T.StructType:
        """Schema as read: daily tables also have their partition column."""
        fields = TABLES[name].fields
        return T.StructType([*fields, T.StructField("date", T.DateType())] if name in DAILY else fields)

    def _scan(self, name: str, folder: str) -> DataFrame | None:
        schema = self.schema(name)
        try:
            return self.spark.read.schema(schema).parquet(self.path(folder)).select(*schema.names)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            return None

    def read(self, name: str) -> DataFrame:
        """All rows of a table, landed streams included; empty if there is none."""
        parts = [p for p in (self._scan(name, name), self._scan(name, f"{name}_stream")) if p is not None]
        if not parts:
            return self.spark.createDataFrame([], self.schema(name))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        columns = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
        out = rows.select(*columns)
        return out.withColumn("date", F.to_date(DAILY[name])) if name in DAILY else out

    def append(self, name: str, rows: DataFrame) -> None:
        """Append rows; columns the table does not know are left out and
        missing ones are NULL."""
        out = self._shaped(name, rows)
        if name == "predictions":
            self._note_days(out)
        if name == "labels":
            out = out.sortWithinPartitions("id")  # row groups of few ids, which a window's range of ids skips
        if name in DAILY:
            # rows of one day meet in few files, and AQE splits a day that is too big
            out = out.hint("rebalance", "date")
            out.write.mode("append").partitionBy("date").parquet(self.path(name))
        else:
            out.write.mode("append").parquet(self.path(name))

    def land_batch(self, rows: DataFrame, stream: str, batch_id: int | str, name: str = "predictions") -> None:
        """Write one micro-batch to a folder of its own, replacing an earlier try."""
        part = f"stream={stream}/batch={batch_id}"
        out = self._shaped(name, rows)
        if name == "predictions":
            self._note_days(out, part)
        out.write.mode("overwrite").partitionBy("date").parquet(f"{self.path(name)}_stream/{part}")

    def overwrite(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.path(name))

    # -- predictions and labels ---------------------------------------------

    def log_predictions(self, rows: DataFrame) -> DataFrame:
        """Append predictions and return their ids.  Rows without an id get a
        hash of their content, which a retried write repeats."""
        if "features" not in rows.columns and "features_json" in rows.columns:
            rows = rows.withColumn("features", feature_map(F.col("features_json")))
        if "id" not in rows.columns:
            plain = [F.col(c) for c in rows.columns if c != "features"]
            rows = rows.withColumn("id", F.xxhash64(*plain, F.to_json("features")))
        self.append("predictions", rows)
        return rows.select("id")

    def log_in_order(self, rows: DataFrame, batch: str, order: Sequence[str] = ("timestamp",)) -> DataFrame:
        """Append the predictions of a batch under ids without gaps, in the given
        order (and that of the other columns), and return the ids.

        The batch's first id is one above the highest mark, and is recorded
        before its rows are written.  A batch that comes again keeps its ids and
        replaces its rows, so a retry adds nothing; equal rows keep an id each.
        Rows are ranged over the tasks by the order, each task numbers its own,
        and only the row counts of the tasks reach the driver.  Batches are
        logged one after the other.
        """
        if "features" not in rows.columns and "features_json" in rows.columns:
            rows = rows.withColumn("features", feature_map(F.col("features_json")))
        features = F.to_json("features") if "features" in rows.columns else F.lit(None)
        ties = [c for c in rows.columns if c not in (*order, "features", "id")]
        ranged = [*order, *ties]
        placed = rows.withColumn("_f", features).repartitionByRange(*ranged, "_f").sortWithinPartitions(*ranged, "_f")
        placed = materialise(placed.drop("_f").withColumn("_at", F.monotonically_increasing_id()), "ordered")
        part = F.shiftright("_at", 33).cast("int").alias("_part")
        counts = sorted((r["_part"], r["n"]) for r in placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
        n = sum(c for _, c in counts)
        marks = self.read("id_marks")
        known = marks.filter(F.col("batch") == batch).first()
        if known is not None and known["n"] != n:
            raise ValueError(f"batch {batch} had {known['n']} rows before, now {n}")
        first = known["first_id"] if known is not None else (marks.agg(F.max(F.col("first_id") + F.col("n"))).first()[0] or 1)
        if known is None:
            self.append("id_marks", self.spark.createDataFrame([(batch, first, n)], "batch string, first_id bigint, n bigint"))
        starts, total = [], first
        for at, c in counts:
            starts.append((at, total))
            total += c
        before = F.broadcast(self.spark.createDataFrame(starts, "_part int, _first bigint"))
        offset = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        numbered = placed.withColumn("_part", part).join(before, "_part").withColumn("id", F.col("_first") + offset)
        self.land_batch(numbered, "log", hashlib.sha1(batch.encode()).hexdigest())
        return self.spark.range(first, first + n)

    def log_prediction(
        self, features: Mapping[str, float], predicted_label: int, confidence: float, model_version: str,
        latency_ms: float, at, prediction_id: int | None = None,
    ) -> int:
        """Append a single prediction and return its id."""
        fields = [(dict(features), predicted_label, float(confidence), model_version, float(latency_ms), at)]
        row = self.spark.createDataFrame(
            fields,
            "features map<string,double>, predicted_label int, confidence double, model_version string, "
            "latency_ms double, timestamp timestamp",
        )
        if prediction_id is not None:
            row = row.withColumn("id", F.lit(prediction_id).cast("bigint"))
        return self.log_predictions(row).first()["id"]

    def log_labels(self, labels: DataFrame) -> DataFrame:
        """Append labels; returns those whose prediction is unknown."""
        self.append("labels", labels)
        return L.unmatched_labels(self.read("predictions"), labels)

    def predictions(self) -> DataFrame:
        """Predictions with their newest label."""
        return L.attach_labels(self.read("predictions"), self.read("labels"))

    # -- which days to read ---------------------------------------------------

    def _note_days(self, rows: DataFrame, part: str | None = None) -> None:
        """Index rows that are about to be written: model, day, number of rows.

        The index is written before the rows, so it lists every day that holds
        rows of a model; after a failed write it lists more, which readers notice.
        Only times and versions of ``rows`` are read for it.
        """
        self._day_index()
        counts = rows.groupBy("model_version", F.col("date").alias("day")).agg(F.count(F.lit(1)).alias("n")).coalesce(1)
        if part is None:
            self.append("prediction_days", counts)
        else:
            counts.write.mode("overwrite").parquet(f"{self.path('prediction_days')}_stream/{part}")

    def _day_index(self) -> DataFrame:
        """model_version, day, n.  A log from before the index is indexed first."""
        index = self.read("prediction_days")
        if index.isEmpty():
            held = self.read("predictions").groupBy("model_version", F.col("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
            held = settle(held, "days")
            if not held.isEmpty():
                self.append("prediction_days", held.coalesce(1))
                index = self.read("prediction_days")
        return index.groupBy("model_version", "day").agg(F.sum("n").alias("n"))

    def _days(self) -> list[tuple[object, int]]:
        """Days of the log, newest first, with at least as many rows as they hold."""
        counts = self._day_index().groupBy("day").agg(F.sum("n").alias("n"))
        return [(r["day"], r["n"]) for r in counts.orderBy(F.col("day").desc()).collect()]

    def recent_predictions(self, n: int) -> DataFrame:
        """The ``n`` newest predictions with their labels.

        Only the newest days that hold ``n`` rows are read, and labels are looked
        up for those rows alone.
        """
        rows, days, first = self.read("predictions"), self._days(), 0
        part = rows
        while first < len(days):
            total = 0
            for first, (_, count) in enumerate(days[first:], first):
                total += count
                if total >= n:
                    break
            cutoff, first = days[first][0], first + 1
            part = rows.filter(F.col("date") >= F.lit(cutoff)) if cutoff is not None else rows
            if first == len(days) or part.count() >= n:  # a count of footers
                break
        window = L.recent(part, n)
        ids = window.select("id")
        labels = self.read("labels").join(F.broadcast(ids) if n <= SMALL_SIDE_ROWS else ids, "id", "left_semi")
        return L.attach_labels(window, labels)

    def recent_by_model(self, n: int) -> DataFrame:
        """The ``n`` newest predictions of every model version with their labels.

        The index names the days that each model needs, so a model that has been
        idle for a year adds its own last days to the scan and no others.  Its
        counts are only a first guess: where a window comes out shorter than
        expected, the next days of those models are read too.  Labels are looked
        up within the range of the windows' ids.
        """
        key = "model_version"
        newest_first = W.partitionBy(key).orderBy(F.col("day").desc_nulls_last())
        index = self._day_index().withColumn("_before", F.coalesce(F.sum("n").over(newest_first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        index = settle(index.drop("n"), "days")
        needed = n
        while True:
            wanted = index.filter(F.col("_before") < needed).select(key, F.col("day").alias("date"))
            window = settle(L.recent(self._on_days(wanted), n, by=[key]), "window")
            cut = index.filter(F.col("_before") >= needed).select(key).distinct()  # models with unread days
            got = window.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
            if match(cut, got, [key], "left").filter(F.coalesce("_n", F.lit(0)) < n).isEmpty():
                break
            needed *= 2
        low, high = window.agg(F.min("id"), F.max("id")).first()
        labels = self.read("labels").filter(F.col("id").between(low, high))
        return L.attach_labels(window, join_small(labels, window.select("id").distinct(), ["id"]))

    def _on_days(self, wanted: DataFrame) -> DataFrame:
        """The predictions of the models and days in ``wanted`` (unique rows)."""
        rows = self.read("predictions")
        days = [r["date"] for r in wanted.select("date").distinct().collect()]  # no more than the log has days
        dated = F.col("date").isin([d for d in days if d is not None])
        rows = rows.filter(dated | F.col("date").isNull() if None in days else dated)
        return join_small(rows, wanted, ["model_version", "date"]).select(*rows.columns)

    def recent_labelled(self, n: int) -> DataFrame:
        """The ``n`` newest labelled predictions.  The days looked at double until
        they hold enough, so a long log is not joined as a whole, and labels are
        read within the range of the ids on those days."""
        days = [day for day, _ in self._days()]
        rows = self.read("predictions")
        span = 1
        while True:
            whole = span >= len(days)
            part = rows if whole else rows.filter(F.col("date") >= F.lit(days[span - 1]))
            labels = self.read("labels")
            if not whole:
                low, high = part.agg(F.min("id"), F.max("id")).first()
                labels = labels.filter(F.col("id").between(low, high))
            labelled = L.recent_labelled(L.attach_labels(part, labels), n)
            if whole or labelled.count() >= n:
                return labelled
            span *= 2

    # -- alerts ---------------------------------------------------------------

    def alerts(self) -> DataFrame:
        return A.with_acknowledgements(self.read("alerts"), self.read("acknowledgements"))

    def acknowledge(self, acks: DataFrame) -> DataFrame:
        """Record acknowledgements; returns those of unknown alerts."""
        self.append("acknowledgements", acks)
        return A.unmatched_acknowledgements(self.read("alerts"), acks)

    # -- versions -------------------------------------------------------------

    @property
    def promotion_log(self) -> ManifestLog:
        return ManifestLog(self.spark, self.path("promotion_log"))

    def promotions(self) -> DataFrame:
        """version, promoted_at, number: the numbered promotions and, without a
        number, the imported ones."""
        logged = self.promotion_log.read("version int, promoted_micros bigint")
        logged = logged.select("version", micros("promoted_micros").alias("promoted_at"), "number")
        return self.read("promotions").withColumn("number", F.lit(None).cast("bigint")).unionByName(logged)

    def versions(self) -> DataFrame:
        return V.promotion_state(self.read("model_versions"), self.promotions(), order=["number", "promoted_at", "version"])

    def promotion_number(self) -> int:
        """How many promotions there have been: what ``promote`` expects."""
        return self.promotion_log.last()

    def promote(self, version: int, at, expected: int | None = None) -> bool:
        """Make an existing version the production one; False if it is unknown, or
        if there has been a promotion after number ``expected`` (as read when the
        decision was prepared; the newest if not given).  Rolling back is promoting
        an older version."""
        before = self.promotion_number() if expected is None else expected
        if not self.read("model_versions").filter(F.col("version") == version).limit(1).count():
            return False
        return self.promotion_log.put(before + 1, {"version": version, "promoted_micros": T.TimestampType().toInternal(at)})

    def new_version(self, run_id: str) -> int:
        """A version number that no other run gets."""
        claims = ManifestLog(self.spark, self.path("version_claims"))
        known = self.read("model_versions").agg(F.max("version")).first()[0] or 0
        number = max(known, claims.last()) + 1
        while not claims.put(number, {"run_id": run_id}):
            number += 1
        return number

    def retraining_events(self) -> DataFrame:
        """Current state of every run: its last event."""
        events = self.read("retraining_events")
        rest = [c for c in events.columns if c != "event_id"]
        best = F.max_by(F.struct(*rest), "seq").alias("e")
        return events.groupBy("event_id").agg(best).select("event_id", "e.*")

    # -- baseline -------------------------------------------------------------

    def save_baseline(self, df: DataFrame, features: Sequence[str], version: int = 0, bins: int = 10) -> None:
        """Store the reference values of a version and, once, their bin edges and
        bin counts, which the checks read instead of the values."""
        at = f"version={version}"
        self.overwrite(f"baseline/{at}", to_long(df, features))
        values = self.spark.read.parquet(self.path(f"baseline/{at}"))
        self.overwrite(f"{_PROFILE}/{at}", quantile_profile(values, ["feature"], bins=bins))
        stored = self.spark.read.parquet(self.path(f"{_PROFILE}/{at}"))
        self.overwrite(f"{_COUNTS}/{at}", reference_counts(values, stored, ["feature"], bins))

    def baseline_version(self) -> int:
        """The newest version with a baseline (its profile is written last)."""
        try:
            found = self.spark.read.parquet(self.path(_COUNTS)).agg(F.max("version")).first()[0]
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            found = None
        if found is None:
            raise MissingBaseline(f"no reference distribution under {self.path('baseline')}")
        return found

    def load_baseline(self, version: int | None = None) -> DataFrame:
        version = self.baseline_version() if version is None else version
        return self.spark.read.parquet(self.path(f"baseline/version={version}"))

    def load_profile(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(edges, reference counts) of a stored baseline."""
        version = self.baseline_version() if version is None else version

        def read(folder: str) -> DataFrame:
            return self.spark.read.parquet(self.path(f"{folder}/version={version}"))

        profile = read(_PROFILE)
        bins = sum(c[0] == "e" and c[1:].isdigit() for c in profile.columns) - 1
        return profile.select("feature", "n_ref", "n_edges", "e_last", *edge_columns(bins)), read(_COUNTS)

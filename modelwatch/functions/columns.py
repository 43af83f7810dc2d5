"""Scalar building blocks: bands, ratios, text, maps, time. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITY_NAMES = ["none", "warning", "critical"]


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den``, or ``default`` where the denominator is zero."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


# -- bands ------------------------------------------------------------------

def severity(value: Column, warning: Column | float, critical: Column | float) -> Column:
    """Detector band: reaching a threshold counts (``>=``); no value is ``unknown``."""
    return (
        F.when(value.isNull() | F.isnan(value), "unknown")
        .when(value >= critical, "critical")
        .when(value >= warning, "warning")
        .otherwise("none")
    )


def severity_rank(name: Column) -> Column:
    """``unknown`` outranks ``none``: a check that saw nothing is not a good one."""
    return F.when(name == "critical", 3).when(name == "warning", 2).when(name == "unknown", 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "critical").when(rank == 2, "warning").when(rank == 1, "unknown").otherwise("none")


def overall_status(rank: Column) -> Column:
    """Worst severity as a status: nothing wrong reads ``healthy``."""
    return F.when(rank == 3, "critical").when(rank == 2, "warning").when(rank == 1, "unknown").otherwise("healthy")


def band_below(value: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """Display band: ``names[i]`` for the first cut that ``value`` is below."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for cut, name in zip(cuts, names):
        out = out.when(value < cut, name)
    return out.otherwise(names[len(cuts)])


def band_above(value: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """``names[i]`` for the first cut that ``value`` exceeds (cuts descending)."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for cut, name in zip(cuts, names):
        out = out.when(value > cut, name)
    return out.otherwise(names[len(cuts)])


def psi_card(value: Column) -> Column:
    return band_below(value, [0.10, 0.25], ["Stable", "Warning", "Critical"])


def psi_label(value: Column) -> Column:
    return band_below(value, [0.10, 0.25], ["Stable", "Moderate", "Significant"])


def hellinger_label(value: Column) -> Column:
    return band_below(value, [0.10, 0.20], ["Stable", "Moderate", "Significant"])


def metric_delta_band(delta: Column) -> Column:
    """Quality deltas: down to -0.03 good, to -0.05 warning, below that bad."""
    return F.when(delta >= -0.03, "good").when(delta >= -0.05, "warning").otherwise("bad")


def rate_delta_band(delta: Column) -> Column:
    return band_below(F.abs(delta), [0.02, 0.05], ["good", "warning", "bad"])


def confidence_delta_band(delta: Column) -> Column:
    return band_below(F.abs(delta), [0.05], ["good", "warning"])


def drifted_count_band(count: Column) -> Column:
    return F.when(count == 0, "good").when(count < 5, "warning").otherwise("bad")


def active_alert_band(count: Column) -> Column:
    return F.when(count == 0, "good").when(count < 3, "warning").otherwise("bad")


def coverage_band(pct: Column) -> Column:
    return band_above(pct, [50.0, 20.0], ["good", "warning", "bad"])


# -- text -------------------------------------------------------------------

def truncate(text: Column, width: int, ellipsis: bool = True) -> Column:
    """First ``width`` characters; ``...`` marks a cut unless told otherwise."""
    cut = F.substring(text, 1, width)
    if not ellipsis:
        return cut
    return F.when(F.length(text) > width, F.concat(cut, F.lit("..."))).otherwise(text)


def class_name(label: Column) -> Column:
    return F.when(label == 0, "Legitimate").when(label == 1, "Fraud")


def version_label(version: Column) -> Column:
    return F.concat(F.lit("v"), version.cast("string"))


def delta_arrow(delta: Column) -> Column:
    """``↑ 0.0123`` or ``↓ 0.0123``."""
    return F.format_string("%s %.4f", F.when(delta >= 0, "↑").otherwise("↓"), F.abs(delta))


# The alert box and its severity marks.
_BOX_TOP = "┌" + "─" * 45 + "┐"
_BOX_MID = "├" + "─" * 45 + "┤"
_BOX_END = "└" + "─" * 45 + "┘"
SEVERITY_MARKS = {"CRITICAL": "🔴", "WARNING": "⚠️", "RESOLVED": "✅"}
OTHER_MARK = "ℹ️"


def _pad(text: Column, width: int) -> Column:
    """Right-pad, never cut."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def alert_message(
    severity_name: Column,
    drift_type: Column,
    metric: Column,
    value: Column,
    threshold: Column,
    at: Column,
) -> Column:
    """The boxed alert text; a value above its threshold reads EXCEEDED."""
    level = F.upper(severity_name)
    mark = F.lit(OTHER_MARK)
    for name, sign in SEVERITY_MARKS.items():
        mark = F.when(level == name, sign).otherwise(mark)
    head = F.concat(mark, F.lit(" "), level, F.lit(" — "), F.upper(drift_type), F.lit(" DRIFT"))
    fields = {
        "Metric   ": metric,
        "Value    ": F.format_string("%.6f", value),
        "Threshold": F.format_string("%.6f", threshold),
        "Status   ": F.when(value > threshold, "EXCEEDED").otherwise("OK"),
        "Time     ": F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")),
    }
    rows = [F.concat(F.lit(f"│  {name}: "), _pad(text, 31), F.lit("│")) for name, text in fields.items()]
    return F.concat_ws(
        "\n",
        F.lit(_BOX_TOP),
        F.concat(F.lit("│  "), _pad(head, 43), F.lit("│")),
        F.lit(_BOX_MID),
        *rows,
        F.lit(_BOX_END),
    )


# -- feature maps -----------------------------------------------------------

def feature_map(features_json: Column) -> Column:
    """JSON text to ``map<string,double>``; unreadable text gives NULL."""
    return F.from_json(features_json, T.MapType(T.StringType(), T.DoubleType()), {"mode": "PERMISSIVE"})


def feature_or_zero(features: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(features, F.lit(name)), F.lit(0.0))


def missing_features(features: Column, required: Sequence[str]) -> Column:
    """Required names that the map lacks, sorted; all of them for a NULL map."""
    names = F.array(*[F.lit(n) for n in required])
    have = F.coalesce(F.map_keys(features), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(names, have))


# -- time -------------------------------------------------------------------

def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for either timestamp type."""
    return F.unix_micros(ts.cast("timestamp"))


def truncate_time(unit: str, ts: Column) -> Column:
    """``date_trunc`` that keeps a zone-less result (the function itself does not)."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")

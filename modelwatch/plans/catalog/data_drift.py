"""Data drift over lineitem: the rows before 1996 are the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.columns import band_above, drifted_count_band, psi_card, psi_label
from ...operators import bins as B
from ...operators import drift as D
from ...operators.results import psi_heatmap
from ...sources.fixtures import FEATURE_SPLIT, LINE_FEATURES, adapter, adapter_sql
from .registry import query, r6


def _sides(spark: SparkSession, sf_dir: str, name: str = "features_shifted") -> tuple[DataFrame, DataFrame]:
    return _cut(adapter(spark, sf_dir, name))


def _cut(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides by ship date, a filter the scan understands."""
    day, split = F.col("l_shipdate"), F.expr(FEATURE_SPLIT.replace("TIMESTAMP ", "TIMESTAMP_NTZ "))
    return rows.filter(day < split), rows.filter((day >= split) | day.isNull())


def _per_feature(spark, sf_dir, name="features_shifted", **options) -> DataFrame:
    reference, current = _sides(spark, sf_dir, name)
    return D.feature_drift(reference, current, LINE_FEATURES, **options)


# -- checking SQL -------------------------------------------------------------

# The fractions are ten equal steps in floating point (0.30000000000000004, not
# 0.3), as the statistic defines them; it matters where a decile hits a value.
_DECILES = "[" + ", ".join(f"{p!r}::DOUBLE" for p in [i * 0.1 for i in range(10)] + [1.0]) + "]"


def _line_long(name: str, keys: list[str]) -> str:
    key_list = "".join(f"{k}, " for k in keys)
    parts = [f"SELECT {key_list}'{f}' AS feature, side = 'ref' AS is_ref, {f} AS value FROM src" for f in LINE_FEATURES]
    return f"src AS ({adapter_sql(name)}),\nlong AS ({' UNION ALL '.join(parts)})"


def divergence_sql(long_cte: str, keys: list[str] = (), ref_keys: list[str] | None = None, open_ends: bool = False) -> str:
    """CTEs ending in ``psi(keys.., feature, psi, kl)``: deciles, explicit
    [lo, hi) intervals, a range join, shares."""
    ref_keys = list(keys) if ref_keys is None else ref_keys
    rk = "".join(f"{k}, " for k in ref_keys)
    ck = "".join(f"{k}, " for k in keys)
    ref_match = "".join(f" AND l.{k} = i.{k}" for k in ref_keys)
    low = "(b = 1 OR l.value >= i.lo)" if open_ends else "l.value >= i.lo"
    high = "(b = nb OR l.value < i.hi)" if open_ends else "(l.value < i.hi OR (b = nb AND l.value = i.hi))"
    return f"""WITH {long_cte},
edges AS (SELECT {rk}feature, unnest(list_distinct(quantile_cont(value, {_DECILES}))) AS lo
          FROM long WHERE is_ref GROUP BY {rk}feature),
steps AS (SELECT *, lead(lo) OVER w AS hi, row_number() OVER w AS b, count(*) OVER (PARTITION BY {rk}feature) - 1 AS nb
          FROM edges WINDOW w AS (PARTITION BY {rk}feature ORDER BY lo)),
inter AS (SELECT * FROM steps WHERE hi IS NOT NULL),
groups AS (SELECT DISTINCT {ck}feature FROM long WHERE NOT is_ref),
refc AS (SELECT {''.join(f'i.{k}, ' for k in ref_keys)}i.feature, i.b, count(*) AS n FROM inter i JOIN long l
         ON l.feature = i.feature{ref_match} AND l.is_ref AND {low} AND {high} GROUP BY ALL),
curc AS (SELECT {''.join(f'l.{k}, ' for k in keys)}i.feature, i.b, count(*) AS n FROM inter i JOIN long l
         ON l.feature = i.feature{ref_match} AND NOT l.is_ref AND {low} AND {high} GROUP BY ALL),
grid AS (SELECT {''.join(f'g.{k}, ' for k in keys)}g.feature, i.b, coalesce(r.n, 0) AS rn, coalesce(c.n, 0) AS cn
         FROM groups g JOIN inter i ON g.feature = i.feature{''.join(f' AND g.{k} = i.{k}' for k in ref_keys)}
         LEFT JOIN refc r ON r.feature = i.feature AND r.b = i.b{''.join(f' AND r.{k} = i.{k}' for k in ref_keys)}
         LEFT JOIN curc c ON c.feature = i.feature AND c.b = i.b{''.join(f' AND c.{k} = g.{k}' for k in keys)}),
share AS (SELECT *, rn / nullif(sum(rn) OVER w, 0) + 1e-6 AS p, cn / nullif(sum(cn) OVER w, 0) + 1e-6 AS q
          FROM grid WINDOW w AS (PARTITION BY {ck}feature)),
psi AS (SELECT {ck}feature, sum((q - p) * ln(q / p)) AS psi, sum(p * ln(p / q)) AS kl FROM share GROUP BY {ck}feature)
"""


_SHIFTED = divergence_sql(_line_long("features_shifted", []))
_PLAIN = divergence_sql(_line_long("features", []))


# -- per feature --------------------------------------------------------------

@query("data_drift_psi", _SHIFTED + "SELECT feature, round(psi, 6) AS psi FROM psi")
def data_drift_psi(spark, sf_dir):
    return _per_feature(spark, sf_dir).select("feature", r6("psi").alias("psi"))


@query("data_drift_kl", _SHIFTED + "SELECT feature, round(kl, 6) AS kl, "
       "CASE WHEN kl >= 0.15 THEN 'critical' WHEN kl >= 0.05 THEN 'warning' ELSE 'none' END AS kl_severity FROM psi")
def data_drift_kl(spark, sf_dir):
    return _per_feature(spark, sf_dir).select("feature", r6("kl").alias("kl"), "kl_severity")


@query("data_drift_stable", _PLAIN + "SELECT feature, round(psi, 6) AS psi, round(kl, 6) AS kl FROM psi")
def data_drift_stable(spark, sf_dir):
    return _per_feature(spark, sf_dir, "features").select("feature", r6("psi").alias("psi"), r6("kl").alias("kl"))


_BY_LINE = divergence_sql(_line_long("features_shifted", ["l_returnflag", "l_linenumber"]), ["l_returnflag", "l_linenumber"])


@query("data_drift_by_group", _BY_LINE + "SELECT l_returnflag, l_linenumber, feature, round(psi, 6) AS psi, round(kl, 6) AS kl FROM psi")
def data_drift_by_group(spark, sf_dir):
    found = _per_feature(spark, sf_dir, by=["l_returnflag", "l_linenumber"])
    return found.select("l_returnflag", "l_linenumber", "feature", r6("psi").alias("psi"), r6("kl").alias("kl"))


_OPEN = divergence_sql(_line_long("features_shifted", []), open_ends=True)


@query("data_drift_open_ends", _OPEN + "SELECT feature, round(psi, 6) AS psi FROM psi")
def data_drift_open_ends(spark, sf_dir):
    """Out-of-range values counted in the end bins instead of dropped."""
    return _per_feature(spark, sf_dir, open_ends=True).select("feature", r6("psi").alias("psi"))


@query("feature_status", _SHIFTED + """SELECT feature, round(psi, 6) AS psi,
 CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.10 THEN 'warning' ELSE 'none' END AS severity,
 CASE WHEN psi < 0.10 THEN 'Stable' WHEN psi < 0.25 THEN 'Warning' ELSE 'Critical' END AS card,
 CASE WHEN psi < 0.10 THEN 'Stable' WHEN psi < 0.25 THEN 'Moderate' ELSE 'Significant' END AS label,
 CASE WHEN psi > 0.25 THEN 'red' WHEN psi > 0.10 THEN 'amber' ELSE 'green' END AS bar FROM psi""")
def feature_status(spark, sf_dir):
    psi = F.col("psi")
    return _per_feature(spark, sf_dir).select(
        "feature",
        "severity",
        psi_card(psi).alias("card"),
        psi_label(psi).alias("label"),
        band_above(psi, [0.25, 0.10], ["red", "amber", "green"]).alias("bar"),
        r6("psi").alias("psi"),
    )


@query("top_drifted_features", _SHIFTED + "SELECT feature, round(psi, 6) AS psi FROM psi ORDER BY psi.psi DESC, feature LIMIT 3")
def top_drifted_features(spark, sf_dir):
    return D.top_drifted(_per_feature(spark, sf_dir), 3).select("feature", r6("psi").alias("psi"))


# -- overall ------------------------------------------------------------------

_CHECK = """SELECT round(max(psi), 6) AS overall_psi,
 CASE WHEN max(psi) >= 0.25 THEN 'critical' WHEN max(psi) >= 0.10 THEN 'warning' ELSE 'none' END AS severity,
 max(psi) >= 0.10 AS is_drifted, count(*) FILTER (psi >= 0.10) AS drifted_count,
 coalesce(string_agg(feature, ',' ORDER BY list_position(['l_quantity','l_extendedprice','l_discount','l_tax'], feature))
   FILTER (psi >= 0.10), '') AS drifted_features FROM psi"""


def _verdict(per_feature, by=()):
    return D.data_drift_check(per_feature, LINE_FEATURES, by).select(
        *by,
        r6("overall_psi").alias("overall_psi"),
        "severity",
        "is_drifted",
        F.size("drifted_features").cast("bigint").alias("drifted_count"),
        F.concat_ws(",", "drifted_features").alias("drifted_features"),
    )


@query("data_drift_check", _SHIFTED + _CHECK)
def data_drift_check(spark, sf_dir):
    return _verdict(_per_feature(spark, sf_dir))


@query("data_drift_check_stable", _PLAIN + _CHECK)
def data_drift_check_stable(spark, sf_dir):
    return _verdict(_per_feature(spark, sf_dir, "features"))


@query("data_drift_check_by_group", _BY_LINE + _CHECK.replace("SELECT ", "SELECT l_returnflag, l_linenumber, ", 1) + " GROUP BY l_returnflag, l_linenumber")
def data_drift_check_by_group(spark, sf_dir):
    by = ["l_returnflag", "l_linenumber"]
    return _verdict(_per_feature(spark, sf_dir, by=by), by)


@query("data_drift_new_group", f"""SELECT l_returnflag, l_returnflag = 'R' AS unmeasured, CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END AS skipped,
 l_returnflag = 'R' AS unknown FROM ({adapter_sql('features')}) x WHERE side = 'cur' GROUP BY 1""")
def data_drift_new_group(spark, sf_dir):
    """A group that only the current side has is there, as unknown."""
    by = ["l_returnflag"]
    reference, current = _cut(adapter(spark, sf_dir, "features"))
    found = D.feature_drift(reference.filter("l_returnflag <> 'R'"), current, LINE_FEATURES, by)
    checked = D.data_drift_check(found, LINE_FEATURES, by)
    return checked.select(
        *by, F.col("overall_psi").isNull().alias("unmeasured"), F.size("skipped_features").alias("skipped"),
        (F.col("severity") == "unknown").alias("unknown"),
    )


@query("drifted_feature_card", _SHIFTED + """SELECT count(*) FILTER (psi >= 0.10) AS drifted_count,
 CASE WHEN count(*) FILTER (psi >= 0.10) = 0 THEN 'good' WHEN count(*) FILTER (psi >= 0.10) < 5 THEN 'warning' ELSE 'bad' END AS band,
 count(*) AS feature_count FROM psi""")
def drifted_feature_card(spark, sf_dir):
    counted = _per_feature(spark, sf_dir).agg(
        F.count_if(F.col("psi") >= 0.10).alias("drifted_count"), F.count(F.lit(1)).alias("feature_count")
    )
    return counted.withColumn("band", drifted_count_band(F.col("drifted_count")))


@query("unprofiled_features", """SELECT 'l_tax' AS feature WHERE EXISTS (SELECT 1 FROM lineitem)""")
def unprofiled_features(spark, sf_dir):
    """Features of the data that the baseline does not know."""
    reference, current = _sides(spark, sf_dir)
    profile = B.quantile_profile(B.to_long(reference, LINE_FEATURES[:3]))
    return B.unprofiled_features(B.to_long(current, LINE_FEATURES), profile)


# -- edges and histograms -------------------------------------------------------

@query("quantile_edges", f"""WITH {_line_long('features', [])},
 e AS (SELECT feature, unnest(list_distinct(quantile_cont(value, {_DECILES}))) AS edge FROM long WHERE is_ref GROUP BY feature)
 SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY edge) - 1 AS INT) AS edge_no, round(edge, 6) AS edge FROM e""")
def quantile_edges(spark, sf_dir):
    reference, _ = _sides(spark, sf_dir, "features")
    profile = B.quantile_profile(B.to_long(reference, LINE_FEATURES))
    names = B.edge_columns(10)
    return profile.select("feature", F.posexplode(F.array(*names)).alias("edge_no", "edge")).filter(
        F.col("edge").isNotNull()
    ).select("feature", "edge_no", r6("edge").alias("edge"))


@query("quantile_histogram", _SHIFTED + "SELECT feature, CAST(b - 1 AS INT) AS bin, rn AS ref_count, cn AS cur_count FROM grid")
def quantile_histogram(spark, sf_dir):
    """Counts of both sides on the reference deciles."""
    reference, current = _sides(spark, sf_dir)
    ref_long, cur_long = B.to_long(reference, LINE_FEATURES), B.to_long(current, LINE_FEATURES)
    both = ref_long.withColumn("is_ref", F.lit(True)).unionByName(cur_long.withColumn("is_ref", F.lit(False)))
    counts = B.quantile_counts(both, B.quantile_profile(ref_long))
    return counts.filter("bin >= 0").select("feature", "bin", "ref_count", "cur_count")


def histogram_sql(source: str, value: str, bins: int) -> str:
    """Equal bins by a range join on explicit borders."""
    return f"""WITH v AS (SELECT {value} AS v FROM ({source}) s WHERE {value} IS NOT NULL),
 lim AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM v),
 grid AS (SELECT i AS bin, lo + i * ((hi - lo) / {bins}.0) AS a,
   CASE WHEN i = {bins} - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}.0) END AS z, lo, hi, n
   FROM lim, range({bins}) t(i))
 SELECT CAST(bin AS INT) AS bin, round(a, 4) AS bin_start, count(v) AS count,
   round(count(v) / (max(n) * ((max(hi) - max(lo)) / {bins}.0)), 6) AS density
 FROM grid LEFT JOIN v ON v >= a AND (v < z OR (bin = {bins} - 1 AND v = z)) GROUP BY bin, a"""


@query("reference_histogram", histogram_sql(f"SELECT * FROM ({adapter_sql('features')}) f WHERE side = 'ref'", "l_extendedprice", 50))
def reference_histogram(spark, sf_dir):
    """Density of one reference feature on 50 equal bins."""
    reference, _ = _sides(spark, sf_dir, "features")
    return B.histogram(reference, "l_extendedprice").select(
        "bin", F.round("bin_start", 4).alias("bin_start"), "count", r6("density").alias("density")
    )


# -- over time --------------------------------------------------------------------

def _monthly(spark, sf_dir):
    rows = adapter(spark, sf_dir, "features_shifted").withColumn(
        "month", F.date_format("l_shipdate", "yyyy-MM")
    )
    reference, current = _cut(rows)
    return D.feature_drift(reference, current, LINE_FEATURES, by=["month"], reference_by=[])


_MONTH_LONG = f"""src AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS month FROM ({adapter_sql('features_shifted')}) f),
long AS ({' UNION ALL '.join(f"SELECT month, '{f}' AS feature, side = 'ref' AS is_ref, {f} AS value FROM src" for f in LINE_FEATURES)})"""
_MONTHLY = divergence_sql(_MONTH_LONG, ["month"], [])


@query("psi_trend", _MONTHLY + "SELECT month, round(max(psi), 6) AS overall_psi FROM psi GROUP BY month")
def psi_trend(spark, sf_dir):
    """Worst PSI of every month against the one baseline."""
    return _monthly(spark, sf_dir).groupBy("month").agg(r6(F.max("psi")).alias("overall_psi"))


@query("psi_heatmap", _MONTHLY + """SELECT month, """ + ", ".join(
    f"coalesce(round(max(psi) FILTER (feature = '{f}'), 6), 0.0) AS {f}" for f in LINE_FEATURES) + " FROM psi GROUP BY month")
def psi_heatmap_query(spark, sf_dir):
    rounded = _monthly(spark, sf_dir).withColumn("psi", r6("psi"))
    return psi_heatmap(rounded, LINE_FEATURES, "month").select("month", *LINE_FEATURES)

"""Dataset preparation, training and scoring."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...config import Settings
from ...functions.columns import feature_map
from ...operators import dataset as S
from ...operators import training as T
from ...session import materialise, scratch_dir
from ...sources.fixtures import LINE_FEATURES, adapter, adapter_sql
from .registry import query, r6

_F = f"WITH f AS ({adapter_sql('features')}) "
_O = f"WITH o AS ({adapter_sql('order_features')}) "


@query("scaler", _F + "SELECT 'l_extendedprice' AS \"column\", round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std FROM f")
def scaler(spark, sf_dir):
    fitted = S.fit_scaler(adapter(spark, sf_dir, "features"), "l_extendedprice")
    return fitted.select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("standardised_price", _F + "SELECT side, l_quantity, round((l_extendedprice - (SELECT avg(l_extendedprice) FROM f)) / (SELECT stddev_pop(l_extendedprice) FROM f), 6) AS l_extendedprice FROM f")
def standardised_price(spark, sf_dir):
    rows = adapter(spark, sf_dir, "features")
    scaled = S.apply_scaler(rows, S.fit_scaler(rows, "l_extendedprice"), "l_extendedprice")
    return scaled.select("side", "l_quantity", r6("l_extendedprice").alias("l_extendedprice"))


_SPLIT = """, c AS (SELECT label, count(*) AS n FROM o GROUP BY 1)
 SELECT label, 'test' AS split, CAST(round(n * 0.2) AS BIGINT) AS n FROM c UNION ALL SELECT label, 'train', n - CAST(round(n * 0.2) AS BIGINT) FROM c"""


@query("stratified_split_counts", _O + _SPLIT)
def stratified_split_counts(spark, sf_dir):
    parts = S.stratified_split(adapter(spark, sf_dir, "order_features"), "label", "id")
    return parts.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("processed_dataset", _O + _SPLIT)
def processed_dataset(spark, sf_dir):
    """The split dataset stored by split and read back."""
    path = scratch_dir(spark, "processed")
    S.save_processed(S.stratified_split(adapter(spark, sf_dir, "order_features"), "label", "id"), path)
    return S.load_processed(spark, path).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("training_csv", _F + "SELECT l_quantity, l_discount, label FROM f")
def training_csv(spark, sf_dir):
    """A labelled CSV scanned by header name; columns that are not wanted stay unread."""
    path = scratch_dir(spark, "csv")
    rows = adapter(spark, sf_dir, "features").select("l_orderkey", "l_quantity", "l_tax", "l_discount", "label")
    rows.write.option("header", True).csv(path)
    return S.load_training_csv(spark, path, ["l_quantity", "l_discount", "not_there"], "label")


@query("class_weights", _F + "SELECT label, count(*) AS n, round((SELECT count(*) FROM f) / (2.0 * count(*)), 6) AS weight FROM f GROUP BY label")
def class_weights(spark, sf_dir):
    return S.class_weights(adapter(spark, sf_dir, "features"), "label").withColumn("weight", r6("weight"))


@query("retraining_dataset", f"""WITH p AS ({adapter_sql('predictions')}), w AS (SELECT * FROM p WHERE true_label IS NOT NULL ORDER BY pred_ts DESC, id DESC LIMIT 1000)
 SELECT price, CAST(NULL AS DOUBLE) AS k, label FROM ({adapter_sql('order_features')}) o
 UNION ALL SELECT NULL, CAST(json_extract_string(features_json, '$.k') AS DOUBLE), true_label FROM w""")
def retraining_dataset(spark, sf_dir):
    """All original rows plus the newest 1000 labelled predictions, by name."""
    original = adapter(spark, sf_dir, "order_features").select("price", "label")
    predictions = adapter(spark, sf_dir, "predictions").withColumn("features", feature_map(F.col("features_json")))
    return S.retraining_dataset(original, predictions, ["k"], "label", 1000, "pred_ts").select("price", "k", "label")


# -- training ---------------------------------------------------------------------

_FOREST = Settings()


def _training_rows(spark, sf_dir):
    """lineitem with a learnable label: is the unit price above the mean?"""
    return adapter(spark, sf_dir, "features").withColumn(
        "label", (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 40000).cast("int")
    )


@query("forest_evaluation")
def forest_evaluation(spark, sf_dir):
    """Train on the early rows, score the late ones, evaluate them."""
    rows = _training_rows(spark, sf_dir)
    model = T.train_forest(rows.filter("side = 'ref'"), LINE_FEATURES, "label", _FOREST)
    scored = T.score(model, rows.filter("side = 'cur'")).select("label", "predicted_label", "confidence")
    return T.evaluate(materialise(scored, "scored"), "label")


@query("score_transactions")
def score_transactions(spark, sf_dir):
    """Feature maps validated, ordered, scaled and scored."""
    rows = _training_rows(spark, sf_dir)
    scaler_row = S.fit_scaler(rows, "l_extendedprice")
    prepared = S.apply_scaler(rows, scaler_row, "l_extendedprice")
    model = T.train_forest(prepared.filter("side = 'ref'"), LINE_FEATURES, "label", _FOREST)
    pairs = [x for f in LINE_FEATURES for x in (F.lit(f), F.col(f))]
    scored, _ = T.score_transactions(
        model, rows.select("l_orderkey", F.create_map(*pairs).alias("features")), LINE_FEATURES, scaler_row, "l_extendedprice"
    )
    return scored.select("l_orderkey", "predicted_label", "confidence")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    model = T.train_forest(_training_rows(spark, sf_dir), LINE_FEATURES, "label", _FOREST)
    return T.feature_importance(model, LINE_FEATURES)


_LABELLED = f"WITH b AS (SELECT *, CAST(l_extendedprice * (1 - l_discount) > 40000 AS INT) AS dear FROM ({adapter_sql('features')}) x) "


@query("forest_facts", _LABELLED + """SELECT count(*) AS n, sum(dear)::BIGINT AS positives, true AS better_than_majority, true AS ranks_well
 FROM b WHERE side = 'cur'""")
def forest_facts(spark, sf_dir):
    """What holds for any good forest: every late row is judged, and better than by
    the more frequent label or by chance."""
    found = forest_evaluation(spark, sf_dir)
    positives = F.col("tp") + F.col("fn")
    return found.select(
        F.col("n").cast("bigint").alias("n"), positives.cast("bigint").alias("positives"),
        (F.col("accuracy") > F.greatest(positives, F.col("n") - positives) / F.col("n")).alias("better_than_majority"),
        (F.col("auc_roc") > 0.9).alias("ranks_well"),
    )


@query("scored_facts", f"""SELECT l_orderkey, count(*) AS n, count(*) AS judged FROM ({adapter_sql('features')}) x GROUP BY 1""")
def scored_facts(spark, sf_dir):
    """Every transaction is scored once, with a confidence that its label follows from."""
    right = F.col("confidence").between(0, 1) & (F.col("predicted_label") == (F.col("confidence") > 0.5).cast("int"))
    return score_transactions(spark, sf_dir).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(right, 1)).alias("judged"))


@query("importance_facts", _LABELLED + f"""SELECT feature, strength = max(strength) OVER () AS strongest, 1.0::DOUBLE AS whole FROM (
 {" UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, dear)) AS strength FROM b WHERE side = 'ref'" for f in LINE_FEATURES)}) y""")
def importance_facts(spark, sf_dir):
    """The feature that goes best with the label is the most important; the shares
    add up to one."""
    every = W.partitionBy()  # a row per feature
    found = feature_importance(spark, sf_dir)
    return found.select(
        "feature", (F.col("importance") == F.max("importance").over(every)).alias("strongest"),
        F.round(F.sum("importance").over(every), 9).alias("whole"),
    )

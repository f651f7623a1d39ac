"""Threshold anomaly scoring of device readings and the metrics it emits.

The scorer is row-local: the readings MAP is renamed to scorer metric names
and scored with higher-order functions, so scoring adds no shuffle and no
Python. Metric rows (AnomalyCount, RiskScore) are plain rows for a metrics
table, aggregated like any other fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S


def score_readings(msgs: DataFrame, readings_col: str = "readings",
                   patient_col: str = "patientId") -> DataFrame:
    """Adds anomalies, n_anomalies, risk_score, alert_level, readings_analyzed and
    the time of the evaluation.

    ``readings_col`` holds the message readings (camelCase keys); unknown keys
    are counted in ``readings_analyzed`` but never scored.
    """
    r = F.col(readings_col)
    out = msgs.withColumn("anomalies", S.threshold_anomalies(r))
    return out.withColumns({
        "patient_id": F.coalesce(F.col(patient_col), F.lit("unknown")),
        "n_anomalies": F.size("anomalies"),
        "risk_score": S.risk_score(F.col("anomalies")),
        "alert_level": S.alert_level(F.col("anomalies")),
        "readings_analyzed": S.readings_analyzed(r),
        "evaluated_at": F.current_timestamp(),
    })


def explode_anomalies(scored: DataFrame, *keys: str) -> DataFrame:
    """One row per anomaly: keys + metric, value, severity, message."""
    return (scored.select(*keys, F.explode("anomalies").alias("a"))
            .select(*keys, "a.metric", "a.value", "a.severity", "a.message"))


def anomaly_metric_rows(scored: DataFrame, *keys: str) -> DataFrame:
    """Two metric rows per evaluation: AnomalyCount (Count), RiskScore (None)."""
    pairs = F.array(
        F.struct(F.lit("AnomalyCount").alias("metric_name"),
                 F.col("n_anomalies").cast("double").alias("value"),
                 F.lit("Count").alias("unit")),
        F.struct(F.lit("RiskScore").alias("metric_name"),
                 F.col("risk_score").alias("value"), F.lit("None").alias("unit")))
    return (scored.select(*keys, F.explode(pairs).alias("m"))
            .select(*keys, "m.metric_name", "m.value", "m.unit"))


def summarize_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric_name", "unit").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
        F.avg("value").alias("avg_value"),
        F.max("value").alias("max_value"))

"""Patient risk prediction as a batch DataFrame job.

Features come from the patient registry (age, chronic conditions, ...) and,
for the variability features, from the readings history: sample variance of
heart rate and systolic BP per patient. The history aggregate is keyed by
patient, so the left join to the registry reuses its hash partitioning on
the aggregate side; a hot patient is pre-reduced by partial aggregation.

``features_asof`` builds the record as of a time: variability over the last whole days
before each request, merged from stored daily states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.vocab import (FEATURES_USED, PREDICTION_MODEL_VERSION,
                               UNKNOWN_PREDICTION_ERROR)

KNOWN_TYPES = ("readmission_risk", "deterioration_risk")


def history_features(readings: DataFrame) -> DataFrame:
    """Per patient: sample variance of heart rate and systolic BP (history)."""
    return (readings.where(F.col("patient_id").isNotNull())
            .groupBy("patient_id")
            .agg(F.var_samp("heart_rate").alias("lake_heart_rate_variance"),
                 F.var_samp("systolic_bp").alias("lake_bp_variance"),
                 F.count(F.lit(1)).alias("history_readings")))


def build_features(patients: DataFrame, readings: DataFrame | None = None,
                   keep: tuple = ()) -> DataFrame:
    """Feature record per patient with defaults for anything missing.

    With ``readings``, variability comes from the history first, then the
    registry value, then the default.
    """
    p = patients
    hr_var, bp_var = F.col("heart_rate_variance"), F.col("bp_variance")
    if readings is not None:
        p = p.join(history_features(readings), "patient_id", "left")
        hr_var = F.coalesce(F.col("lake_heart_rate_variance"), hr_var)
        bp_var = F.coalesce(F.col("lake_bp_variance"), bp_var)
    return p.select(
        "patient_id", *keep,
        S.with_default(F.col("age"), "age").alias("f_age"),
        S.with_default(F.col("chronic_conditions"), "chronic_conditions").alias("f_chronic"),
        S.with_default(F.col("recent_hospitalizations"), "recent_hospitalizations")
        .alias("f_hospitalizations"),
        S.with_default(F.col("medication_adherence"), "medication_adherence")
        .alias("f_adherence"),
        S.with_default(hr_var, "heart_rate_variance").alias("f_hr_variance"),
        S.with_default(bp_var, "bp_variance").alias("f_bp_variance"),
    )


HISTORY = {"heart_rate": "lake_heart_rate_variance", "systolic_bp": "lake_bp_variance"}


def daily_states(readings: DataFrame) -> DataFrame:
    """Per patient and day: number of readings, and count, mean and centred square
    sum of each history vital. Days that are over never change, so the table can be
    stored and extended; a hot patient is reduced in every map task."""
    stats = [x for c in HISTORY for x in (
        F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"),
        (F.var_pop(c) * F.count(c)).alias(f"{c}__m2"))]
    return (readings.where(F.col("patient_id").isNotNull() & F.col("ts").isNotNull())
            .groupBy("patient_id", F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("readings"), *stats))


def history_asof(requests: DataFrame, states: DataFrame, days: int = 7) -> DataFrame:
    """(patient_id, day) of the requests -> variances over the ``days`` whole days before.

    Each different patient and day asks for its days by an equality join (no range
    join), so the work is at most ``days`` states per patient-day, however many
    requests fall on it."""
    asked = requests.select("patient_id", F.to_date("requested_at").alias("asked")).distinct()
    back = asked.withColumn("day", F.explode(F.sequence(
        F.date_sub("asked", days), F.date_sub("asked", 1), F.expr("INTERVAL 1 DAY"))))
    found = back.join(states, ["patient_id", "day"])

    def variance(c: str) -> Column:
        n, mean = F.col(f"{c}__n"), F.col(f"{c}__mean")
        total = F.sum(n)
        # inside the days, plus between their means
        between = F.sum(n * mean * mean) - F.sum(n * mean) * F.sum(n * mean) / total
        return F.when(total > 1, (F.sum(f"{c}__m2") + F.greatest(between, F.lit(0.0))) / (total - 1))
    return found.groupBy("patient_id", "asked").agg(
        F.sum("readings").alias("history_readings"), *[variance(c).alias(name) for c, name in HISTORY.items()])


def features_asof(patients: DataFrame, requests: DataFrame, states: DataFrame, days: int = 7,
                  keep: tuple = ()) -> DataFrame:
    """Feature record per request (patient_id, requested_at, ...), with the history that
    was known at its time; requests of unknown patients get the defaults."""
    history = history_asof(requests, states, days)
    r = requests.withColumn("asked", F.to_date("requested_at")).join(
        history, ["patient_id", "asked"], "left").join(patients, "patient_id", "left")
    with_history = r.withColumns({
        "heart_rate_variance": F.coalesce("lake_heart_rate_variance", "heart_rate_variance"),
        "bp_variance": F.coalesce("lake_bp_variance", "bp_variance"),
        "history_readings": F.coalesce("history_readings", F.lit(0))})
    return build_features(with_history, keep=(*keep, "requested_at", "history_readings"))


def predict(features: DataFrame, prediction_type: Column | None = None) -> DataFrame:
    """Dispatch on prediction type (default readmission_risk); unknown -> error."""
    t = F.coalesce(prediction_type if prediction_type is not None else F.lit(None),
                   F.lit("readmission_risk")).cast("string")
    readm = S.readmission_score(F.col("f_age"), F.col("f_chronic"),
                                F.col("f_hospitalizations"), F.col("f_adherence"))
    det = S.deterioration_score(F.col("f_hr_variance"), F.col("f_bp_variance"),
                                F.col("f_chronic"))
    is_r = t == F.lit("readmission_risk")
    is_d = t == F.lit("deterioration_risk")
    df = features.withColumns({"prediction_type": t,
                               "_readm": readm, "_det": det})
    r, d = F.col("_readm"), F.col("_det")
    return df.withColumns({
        "score": F.when(is_r, r).when(is_d, d),
        "risk_level": F.when(is_r, S.readmission_level(r)).when(is_d, S.deterioration_level(d)),
        "recommendation": F.when(is_r, S.readmission_recommendation(r)),
        "alert_threshold_days": F.when(is_d, S.deterioration_horizon_days(d)),
        "error": F.when(~(is_r | is_d), F.lit(UNKNOWN_PREDICTION_ERROR)),
        "model_version": F.lit(PREDICTION_MODEL_VERSION),
        "features_used": F.array(*[F.lit(f) for f in FEATURES_USED]),
        "predicted_at": F.current_timestamp(),
    }).drop("_readm", "_det")

"""Threshold scorer, predictions, patient and device risk."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scoring as S
from pulsegrid.operators import anomaly, gold, predict


def _score(spark, readings):
    """Readings parsed from JSON text, like a message (key order kept)."""
    import json
    df = spark.createDataFrame([(json.dumps(readings), "p")], "j string, patientId string")
    df = df.select(F.from_json("j", "map<string,double>").alias("readings"), "patientId")
    return anomaly.score_readings(df).first()


def test_three_warnings_is_critical(spark):
    r = _score(spark, {"heartRate": 121.0, "temperature": 38.0, "respiratoryRate": 21.0})
    assert r["risk_score"] == pytest.approx(0.6) and r["alert_level"] == "CRITICAL"


def test_two_and_one_warning(spark):
    assert _score(spark, {"heartRate": 121.0, "temperature": 38.0})["alert_level"] == "WARNING"
    one = _score(spark, {"heartRate": 121.0})
    assert one["risk_score"] == pytest.approx(0.2) and one["alert_level"] == "NORMAL"


def test_first_band_wins_and_messages(spark):
    r = _score(spark, {"heartRate": 35.0, "bloodOxygen": 90.0, "temperature": 36.15})
    a = r["anomalies"]
    assert [(x["metric"], x["severity"]) for x in a] == [
        ("heart_rate", "CRITICAL"), ("blood_oxygen", "WARNING")]
    assert a[0]["message"] == "heart_rate critically low: 35"
    assert r["risk_score"] == pytest.approx(0.6)


def test_unknown_metric_counted_not_scored(spark):
    r = _score(spark, {"bloodGlucose": 500.0, "heartRate": 70.0})
    assert r["n_anomalies"] == 0 and r["readings_analyzed"] == 2


def test_score_capped(spark):
    r = _score(spark, {"heartRate": 10.0, "bloodOxygen": 10.0, "systolicBP": 10.0,
                       "diastolicBP": 10.0})
    assert r["risk_score"] == 1.0


def test_null_value_is_no_anomaly(spark):
    assert _score(spark, {"heartRate": None})["n_anomalies"] == 0


def _predict(spark, ptype, **hist):
    cols = "patient_id string, age int, chronic_conditions int, recent_hospitalizations int, " \
           "medication_adherence double, heart_rate_variance double, bp_variance double"
    row = ("p", hist.get("age"), hist.get("chronic_conditions"),
           hist.get("recent_hospitalizations"), hist.get("medication_adherence"),
           hist.get("heart_rate_variance"), hist.get("bp_variance"))
    f = predict.build_features(spark.createDataFrame([row], cols))
    return predict.predict(f, F.lit(ptype)).first()


def test_prediction_defaults(spark):
    r = _predict(spark, "readmission_risk")
    assert r["score"] == pytest.approx(0.24) and r["risk_level"] == "LOW"
    assert r["recommendation"].startswith("Standard follow-up")
    d = _predict(spark, "deterioration_risk")
    assert d["score"] == pytest.approx(0.40) and d["risk_level"] == "MEDIUM"
    assert d["alert_threshold_days"] == 14


def test_readmission_matches_python_arithmetic(spark):
    hist = dict(age=80, chronic_conditions=3, recent_hospitalizations=1,
                medication_adherence=0.3)
    expected = 0.2 + 0.15
    expected += min(3 * 0.08, 0.3)
    expected += min(1 * 0.15, 0.3)
    expected += (1 - 0.3) * 0.2
    r = _predict(spark, "readmission_risk", **hist)
    assert r["score"] == min(expected, 1.0) and r["risk_level"] == "HIGH"


def test_unknown_prediction_type(spark):
    r = _predict(spark, "batch_analysis")
    assert r["error"] == "Unknown prediction type" and r["score"] is None


def test_patient_risk_bands(spark):
    df = spark.createDataFrame([(90.0,), (93.0,), (97.0,)], "o2 double")
    got = df.select(S.oxygen_risk(F.col("o2")).alias("d"),
                    S.oxygen_risk(F.col("o2"), strict=True).alias("s")).collect()
    assert [(r["d"], r["s"]) for r in got] == [("concerning", "critical"),
                                               ("concerning", "concerning"),
                                               ("normal", "normal")]


def test_device_health_score(spark):
    rows = [("d1", "w", 1, True, 70.0)] * 25 + [("d2", "w", 0, False, 70.0)]
    df = spark.createDataFrame(
        [(d, t, "p", None, a, c, hr) for d, t, a, c, hr in rows],
        "device_id string, device_type string, patient_id string, ts timestamp, "
        "alert_count int, has_critical_alert boolean, heart_rate double")
    got = {r["device_id"]: r for r in gold.device_analytics(df).collect()}
    assert got["d1"]["device_health_score"] == 0
    assert got["d2"]["heart_rate_stddev"] is None and got["d2"]["device_health_score"] == 100

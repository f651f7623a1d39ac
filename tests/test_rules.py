"""Alert rules, severities and flattening on hand-written boundary rows."""

from pyspark.sql import functions as F

from pulsegrid.operators import enrich
from pulsegrid.schemas import RAW_MESSAGE


def _msgs(spark, readings_list, **extra):
    rows = []
    for i, r in enumerate(readings_list):
        row = {f.name: None for f in RAW_MESSAGE.fields}
        row.update(deviceId=f"d{i}", deviceType="smartwatch", patientId="p1",
                   timestamp="2024-01-01T10:00:00Z", readings=r, messageId=str(i),
                   topic="iomt/wearables/d")
        row.update(extra)
        rows.append(row)
    return spark.createDataFrame(rows, RAW_MESSAGE)


def _alerts(spark, readings_list, rules="full"):
    df = enrich.flatten_messages(_msgs(spark, readings_list), rules=rules)
    return [r["alert_types"] for r in df.orderBy(F.col("message_id").cast("int")).collect()]


def test_heart_rate_bounds(spark):
    got = _alerts(spark, [{"heartRate": v} for v in (120.0, 121.0, 50.0, 49.0)])
    assert got == ["", "tachycardia", "", "bradycardia"]


def test_oxygen_bounds(spark):
    got = _alerts(spark, [{"bloodOxygen": v} for v in (95.0, 94.0, 92.0, 91.0)])
    assert got == ["", "low_oxygen_warning", "low_oxygen_warning", "hypoxemia"]


def test_blood_pressure_needs_both(spark):
    rows = [{"systolicBP": 181.0, "diastolicBP": 80.0}, {"systolicBP": 120.0, "diastolicBP": 121.0},
            {"systolicBP": 141.0, "diastolicBP": 80.0}, {"systolicBP": 89.0, "diastolicBP": 70.0},
            {"systolicBP": 120.0, "diastolicBP": 59.0}, {"systolicBP": 200.0}]
    assert _alerts(spark, rows) == ["hypertensive_crisis", "hypertensive_crisis",
                                    "high_blood_pressure", "low_blood_pressure",
                                    "low_blood_pressure", ""]


def test_temperature_and_glucose_bounds(spark):
    t = _alerts(spark, [{"temperature": v} for v in (38.5, 38.6, 35.0, 34.9)])
    assert t == ["", "fever", "", "hypothermia"]
    g = _alerts(spark, [{"bloodGlucose": v} for v in (180.0, 181.0, 70.0, 69.0)])
    assert g == ["", "hyperglycemia", "", "hypoglycemia"]


def test_rule_order_and_null_value(spark):
    got = _alerts(spark, [{"bloodGlucose": 60.0, "heartRate": 130.0, "bloodOxygen": 90.0},
                          {"heartRate": None}])
    assert got == ["tachycardia,hypoxemia,hypoglycemia", ""]


def test_readme_sample_is_normal(spark):
    sample = {"heartRate": 72.0, "bloodOxygen": 98.0, "systolicBP": 120.0,
              "diastolicBP": 80.0, "temperature": 36.6, "respiratoryRate": 16.0}
    df = enrich.flatten_messages(_msgs(spark, [sample]))
    r = df.first()
    assert r["alert_count"] == 0 and r["alert_severity"] == "normal"
    assert r["has_critical_alert"] is False


def test_severity_and_critical_flag(spark):
    df = enrich.flatten_messages(_msgs(spark, [{"heartRate": 130.0}, {"bloodOxygen": 80.0},
                                               {}]))
    rows = df.orderBy(F.col("message_id").cast("int")).collect()
    assert [r["alert_severity"] for r in rows] == ["warning", "critical", "normal"]
    assert [r["has_critical_alert"] for r in rows] == [False, True, False]
    assert [r["alert_count"] for r in rows] == [1, 1, 0]


def test_basic_rules(spark):
    got = _alerts(spark, [{"heartRate": 130.0, "bloodOxygen": 90.0}, {"heartRate": 40.0},
                          {"bloodOxygen": 95.0}, {}], rules="basic")
    assert got == ["abnormal_heart_rate,low_blood_oxygen", "abnormal_heart_rate", "", ""]


def test_given_alerts_are_kept(spark):
    m = _msgs(spark, [{"heartRate": 72.0}], alerts=["hypoxemia"])
    r = enrich.flatten_messages(m).first()
    assert r["alert_types"] == "hypoxemia" and r["alert_severity"] == "critical"


def test_message_defaults(spark):
    m = spark.createDataFrame([(None, None, None, None, None)],
                              "deviceId string, deviceType string, patientId string, "
                              "timestamp string, readings map<string,double>")
    e = enrich.enrich_messages(m).first()
    assert e["deviceId"] == "unknown" and e["deviceType"] == "unknown"
    assert e["timestamp"] is not None and e["readings"] == {} and e["metadata"] == {}
    assert e["alerts"] == [] and e["alertSeverity"] == "normal"


def test_calendar_columns_are_utc(spark):
    m = _msgs(spark, [{}], timestamp="2024-03-01T23:30:00Z")
    r = enrich.flatten_messages(m).first()
    assert str(r["date"]) == "2024-03-01" and r["hour"] == 23


def test_malformed_timestamp_is_null(spark):
    r = enrich.flatten_messages(_msgs(spark, [{}], timestamp="not a time")).first()
    assert r["ts"] is None and r["date"] is None


def test_notifications(spark):
    df = enrich.flatten_messages(_msgs(spark, [{"heartRate": 130.0, "bloodOxygen": 90.0},
                                               {"heartRate": 130.0}, {}]))
    n = enrich.notifications(df).orderBy(F.col("message_id").cast("int")).collect()
    assert [r["severity"] for r in n] == ["HIGH", "MEDIUM"]
    assert n[0]["subject"] == "Healthcare Alert: tachycardia, hypoxemia"
    assert [r["alerts_sent"] for r in n] == [2, 1]


def test_null_alert_list_counts_zero(spark):
    """D9: a missing alert list counts 0 and joins to '' (ANSI-safe)."""
    m = _msgs(spark, [{"heartRate": 72.0}])
    m = m.withColumn("alerts", F.lit(None).cast("array<string>"))
    from pulsegrid.functions import alerts as A
    r = m.select(A.alert_count(F.col("alerts")).alias("n"),
                 A.alert_types(F.col("alerts")).alias("t"),
                 A.alert_severity(F.col("alerts")).alias("s")).first()
    assert (r["n"], r["t"], r["s"]) == (0, "", "normal")

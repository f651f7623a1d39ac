"""DuckDB oracle SQL for every registered query.

Each statement starts from the same deterministic mappings as the Spark side
(``events`` -> readings, ``customer`` -> patients) and then states the
operator's semantics independently in plain SQL. Floats are rounded to 6
places and timestamps are naive (TIMESTAMP) on both sides.
"""

from __future__ import annotations

READINGS = """
readings AS (
  WITH e AS (
    SELECT event_id, ts, user_id, user_id * 2 + event_id % 2 AS dn,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
    FROM events)
  SELECT event_id, ts,
    'device-' || CAST(dn AS VARCHAR) AS device_id,
    CASE dn % 5 WHEN 0 THEN 'smartwatch' WHEN 1 THEN 'pulse_oximeter' WHEN 2 THEN 'bp monitor'
                WHEN 3 THEN 'glucose_meter' ELSE 'thermometer' END AS device_type,
    CASE WHEN dn % 5 < 2 THEN 'iomt/wearables/device-' ELSE 'iomt/home-health/device-' END
      || CAST(dn AS VARCHAR) AS topic,
    CASE WHEN user_id % 29 = 0 THEN NULL ELSE 'patient-' || CAST(user_id AS VARCHAR) END AS patient_id,
    CASE WHEN event_id % 11 = 0 THEN NULL
         WHEN dn % 37 = 0 THEN CAST(38 + (event_id * 7 + k) % 120 AS DOUBLE)
         ELSE CAST(50 + user_id % 50 + (event_id * 7 + k) % 16
                   + CASE event_id % 23 WHEN 1 THEN 65 WHEN 2 THEN -25 ELSE 0 END AS DOUBLE) END AS heart_rate,
    CASE WHEN event_id % 13 = 0 THEN NULL
         ELSE CAST(96 + (event_id * 5 + k) % 5
                   - CASE event_id % 29 WHEN 3 THEN 12 WHEN 4 THEN 6 WHEN 5 THEN 4 ELSE 0 END
                   - CASE WHEN user_id % 31 = 7 THEN 4 WHEN user_id % 31 = 8 THEN 8 ELSE 0 END AS DOUBLE) END AS blood_oxygen,
    CASE WHEN event_id % 7 = 0 THEN NULL
         ELSE CAST(100 + (event_id * 11 + k) % 35
                   + CASE event_id % 31 WHEN 6 THEN 70 WHEN 7 THEN 30 WHEN 8 THEN -25 ELSE 0 END
                   + CASE user_id % 37 WHEN 5 THEN 40 WHEN 6 THEN -35 ELSE 0 END AS DOUBLE) END AS systolic_bp,
    CASE WHEN event_id % 7 = 0 OR event_id % 17 = 0 THEN NULL
         ELSE CAST(65 + (event_id * 3 + k) % 22
                   + CASE event_id % 31 WHEN 9 THEN 50 WHEN 10 THEN 15 WHEN 11 THEN -18 ELSE 0 END AS DOUBLE) END AS diastolic_bp,
    CASE WHEN event_id % 5 = 0 THEN NULL
         ELSE 36.2e0 + CAST((event_id * 13 + k) % 10 AS DOUBLE) / 10e0
              + CASE event_id % 41 WHEN 12 THEN 3e0 WHEN 13 THEN -2e0 WHEN 14 THEN 1e0 ELSE 0e0 END END AS temperature,
    CASE WHEN event_id % 3 <> 0 THEN NULL
         ELSE CAST(80 + (event_id * 17 + k) % 60
                   + CASE event_id % 43 WHEN 15 THEN 90 WHEN 16 THEN -25 ELSE 0 END AS DOUBLE) END AS blood_glucose,
    CASE WHEN event_id % 4 = 0 THEN NULL
         ELSE CAST(12 + (event_id * 19 + k) % 9
                   + CASE event_id % 47 WHEN 17 THEN 20 WHEN 18 THEN -7 WHEN 19 THEN 6 ELSE 0 END AS DOUBLE) END AS respiratory_rate
  FROM e)"""

# Full alert rule set, one column per rule group, then the flat reading.
ALERTED = """
rule_hits AS (
  SELECT r.*,
    CASE WHEN heart_rate > 120 THEN 'tachycardia' WHEN heart_rate < 50 THEN 'bradycardia' END AS a_hr,
    CASE WHEN blood_oxygen < 92 THEN 'hypoxemia' WHEN blood_oxygen < 95 THEN 'low_oxygen_warning' END AS a_o2,
    CASE WHEN systolic_bp IS NOT NULL AND diastolic_bp IS NOT NULL THEN
      CASE WHEN systolic_bp > 180 OR diastolic_bp > 120 THEN 'hypertensive_crisis'
           WHEN systolic_bp > 140 OR diastolic_bp > 90 THEN 'high_blood_pressure'
           WHEN systolic_bp < 90 OR diastolic_bp < 60 THEN 'low_blood_pressure' END END AS a_bp,
    CASE WHEN temperature > 38.5 THEN 'fever' WHEN temperature < 35 THEN 'hypothermia' END AS a_temp,
    CASE WHEN blood_glucose > 180 THEN 'hyperglycemia' WHEN blood_glucose < 70 THEN 'hypoglycemia' END AS a_glu
  FROM readings r),
alerted AS (
  SELECT *,
    concat_ws(',', a_hr, a_o2, a_bp, a_temp, a_glu) AS alert_types,
    CAST((a_hr IS NOT NULL)::INT + (a_o2 IS NOT NULL)::INT + (a_bp IS NOT NULL)::INT
         + (a_temp IS NOT NULL)::INT + (a_glu IS NOT NULL)::INT AS INTEGER) AS alert_count,
    CASE WHEN a_o2 = 'hypoxemia' OR a_bp = 'hypertensive_crisis' OR a_glu = 'hypoglycemia' THEN 'critical'
         WHEN coalesce(a_hr, a_o2, a_bp, a_temp, a_glu) IS NOT NULL THEN 'warning'
         ELSE 'normal' END AS alert_severity,
    CAST(ts AS DATE) AS date,
    CAST(hour(ts) AS INTEGER) AS hour,
    split_part(topic, '/', 2) AS channel
  FROM rule_hits),
flat AS (
  SELECT *,
    (alert_types LIKE '%hypertensive_crisis%' OR alert_types LIKE '%hypoxemia%'
     OR alert_types LIKE '%hypoglycemia%') AS has_critical_alert
  FROM alerted)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


BASE = with_ctes(READINGS, ALERTED)

SQL: dict[str, str] = {}

SQL["flatten_readings"] = BASE + """
SELECT event_id, device_id, device_type, patient_id, ts,
  heart_rate, blood_oxygen, systolic_bp, diastolic_bp, temperature, blood_glucose,
  respiratory_rate, date, hour, channel
FROM flat"""

SQL["vital_alerts"] = BASE + """
SELECT event_id, alert_count, alert_types, has_critical_alert, alert_severity
FROM flat"""

SQL["device_analytics"] = BASE + """,
agg AS (
  SELECT device_id, device_type, count(*) AS total_readings,
    min(ts) AS first_seen, max(ts) AS last_seen,
    count(DISTINCT patient_id) AS unique_patients,
    CAST(sum(alert_count) AS BIGINT) AS total_alerts,
    CAST(sum(CASE WHEN has_critical_alert THEN 1 ELSE 0 END) AS BIGINT) AS critical_alerts,
    avg(heart_rate) AS avg_hr, stddev_samp(heart_rate) AS sd_hr
  FROM flat GROUP BY device_id, device_type)
SELECT device_id, device_type, total_readings, first_seen, last_seen, unique_patients,
  total_alerts, critical_alerts,
  round(avg_hr, 6) AS avg_heart_rate_reading, round(sd_hr, 6) AS heart_rate_stddev,
  CAST(least(100, greatest(0, 100 - critical_alerts * 5
       - CASE WHEN sd_hr > 30 THEN 20 ELSE 0 END)) AS BIGINT) AS device_health_score
FROM agg"""

SQL["vital_alerts_basic"] = with_ctes(READINGS) + """
SELECT event_id,
  concat_ws(',', CASE WHEN heart_rate > 120 OR heart_rate < 50 THEN 'abnormal_heart_rate' END,
                 CASE WHEN blood_oxygen < 92 THEN 'low_blood_oxygen' END) AS alert_types,
  CAST(CASE WHEN heart_rate > 120 OR heart_rate < 50 THEN 1 ELSE 0 END
       + CASE WHEN blood_oxygen < 92 THEN 1 ELSE 0 END AS INTEGER) AS alert_count
FROM readings"""

SQL["alert_notifications"] = BASE + """
SELECT event_id, device_id, 'ANOMALY_DETECTED' AS alert_type,
  CASE WHEN alert_count > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  'Healthcare Alert: ' || concat_ws(', ', a_hr, a_o2, a_bp, a_temp, a_glu) AS subject,
  alert_count AS alerts_sent
FROM flat WHERE alert_count > 0"""

SQL["alert_counts"] = BASE + """
SELECT alert, count(*) AS n FROM (
  SELECT a_hr AS alert FROM flat UNION ALL SELECT a_o2 FROM flat
  UNION ALL SELECT a_bp FROM flat UNION ALL SELECT a_temp FROM flat
  UNION ALL SELECT a_glu FROM flat) u
WHERE alert IS NOT NULL GROUP BY alert"""

SQL["topic_route"] = with_ctes(READINGS) + """
SELECT split_part(topic, '/', 2) AS channel, split_part(topic, '/', 3) AS topic_device,
  count(*) AS n
FROM readings
WHERE regexp_full_match(topic, 'iomt/wearables/[^/]+') OR regexp_full_match(topic, 'iomt/home-health/[^/]+')
GROUP BY 1, 2"""

_N_VITALS = """CAST((heart_rate IS NOT NULL)::INT + (blood_oxygen IS NOT NULL)::INT
      + (systolic_bp IS NOT NULL)::INT + (diastolic_bp IS NOT NULL)::INT
      + (temperature IS NOT NULL)::INT + (blood_glucose IS NOT NULL)::INT
      + (respiratory_rate IS NOT NULL)::INT AS INTEGER)"""

SQL["message_defaults"] = BASE + f"""
SELECT event_id,
  CASE WHEN event_id % 53 = 0 THEN 'unknown' ELSE device_id END AS device_id,
  CASE WHEN event_id % 19 = 0 THEN 'unknown' ELSE device_type END AS device_type,
  patient_id,
  event_id % 61 <> 0 AS timestamp_given,
  CASE WHEN event_id % 67 = 0 THEN 0 ELSE {_N_VITALS} END AS n_readings,
  CASE WHEN event_id % 67 = 0 THEN '' ELSE alert_types END AS alert_types,
  CASE WHEN event_id % 67 = 0 THEN 'normal' ELSE alert_severity END AS alert_severity,
  CAST(0 AS INTEGER) AS n_metadata,
  TRUE AS has_processed_at, TRUE AS has_request_id
FROM flat"""


def _value_text(v: str) -> str:
    return (f"CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15 "
            f"THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END")


# metric, column, critical_min, min, max, critical_max (NULL = no bound)
_SCORER = [
    ("heart_rate", "heart_rate", "40", "50", "120", "150"),
    ("blood_oxygen", "blood_oxygen", "88", "92", None, None),
    ("blood_pressure_systolic", "systolic_bp", "80", "90", "140", "180"),
    ("blood_pressure_diastolic", "diastolic_bp", "50", "60", "90", "120"),
    ("temperature", "temperature", "35", "36.1", "37.8", "39.5"),
    ("respiratory_rate", "respiratory_rate", "8", "12", "20", "30"),
]


def _band(col, cmin, mn, mx, cmax):
    arms = []
    if cmin:
        arms.append(f"WHEN {col} < {cmin} THEN 'CRITICAL|critically low'")
    if cmax:
        arms.append(f"WHEN {col} > {cmax} THEN 'CRITICAL|critically high'")
    if mn:
        arms.append(f"WHEN {col} < {mn} THEN 'WARNING|below normal'")
    if mx:
        arms.append(f"WHEN {col} > {mx} THEN 'WARNING|above normal'")
    return "CASE " + " ".join(arms) + " END"


_BANDS = with_ctes(READINGS) + ",\nbands AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT event_id, patient_id, {i} AS pos, '{m}' AS metric, {c} AS value, "
    f"{_band(c, *b)} AS band FROM readings"
    for i, (m, c, *b) in enumerate(_SCORER)) + ")"

SQL["threshold_anomalies"] = _BANDS + f"""
SELECT event_id, metric, value, split_part(band, '|', 1) AS severity,
  metric || ' ' || split_part(band, '|', 2) || ': ' || {_value_text('value')} AS message
FROM bands WHERE band IS NOT NULL"""

_RISK = _BANDS + f""",
per_event AS (
  SELECT r.event_id, coalesce(r.patient_id, 'unknown') AS patient_id,
    {_N_VITALS.replace('heart_rate', 'r.heart_rate').replace('blood_oxygen', 'r.blood_oxygen')
     .replace('systolic_bp', 'r.systolic_bp').replace('diastolic_bp', 'r.diastolic_bp')
     .replace('temperature', 'r.temperature').replace('blood_glucose', 'r.blood_glucose')
     .replace('respiratory_rate', 'r.respiratory_rate')} AS readings_analyzed,
    CAST(count(CASE WHEN b.band LIKE 'CRITICAL%' THEN 1 END) AS INTEGER) AS n_crit,
    CAST(count(CASE WHEN b.band LIKE 'WARNING%' THEN 1 END) AS INTEGER) AS n_warn,
    coalesce(string_agg(CASE WHEN b.band IS NOT NULL THEN b.metric END, ',' ORDER BY b.pos), '')
      AS anomaly_metrics
  FROM readings r JOIN bands b ON b.event_id = r.event_id
  GROUP BY r.event_id, r.patient_id, r.heart_rate, r.blood_oxygen, r.systolic_bp,
    r.diastolic_bp, r.temperature, r.blood_glucose, r.respiratory_rate),
risk AS (
  SELECT *, least(10, 4 * n_crit + 2 * n_warn) AS tenths FROM per_event)"""

SQL["anomaly_risk"] = _RISK + """
SELECT event_id, patient_id, round(CAST(tenths AS DOUBLE) / 10e0, 6) AS risk_score,
  CASE WHEN tenths >= 6 THEN 'CRITICAL' WHEN tenths >= 3 THEN 'WARNING' ELSE 'NORMAL' END AS alert_level,
  CAST(n_crit + n_warn AS INTEGER) AS n_anomalies, readings_analyzed, anomaly_metrics
FROM risk"""

SQL["anomaly_metrics"] = _RISK + """,
m AS (
  SELECT 'AnomalyCount' AS metric_name, 'Count' AS unit, CAST(n_crit + n_warn AS DOUBLE) AS value FROM risk
  UNION ALL
  SELECT 'RiskScore', 'None', CAST(tenths AS DOUBLE) / 10e0 FROM risk)
SELECT metric_name, unit, count(*) AS n, round(sum(value), 6) AS total,
  round(avg(value), 6) AS avg_value, round(max(value), 6) AS max_value
FROM m GROUP BY metric_name, unit"""

SQL["hourly_trends"] = BASE + """
SELECT date, hour, device_type, count(*) AS reading_count,
  round(avg(heart_rate), 6) AS avg_heart_rate, round(avg(blood_oxygen), 6) AS avg_blood_oxygen,
  round(avg(systolic_bp), 6) AS avg_systolic_bp, round(avg(diastolic_bp), 6) AS avg_diastolic_bp,
  CAST(sum(alert_count) AS BIGINT) AS total_alerts,
  count(DISTINCT device_id) AS active_devices, count(DISTINCT patient_id) AS active_patients
FROM flat GROUP BY date, hour, device_type"""

PATIENTS = """
patients AS (
  SELECT 'patient-' || CAST(c_custkey AS VARCHAR) AS patient_id, c_custkey,
    c_name AS name, c_nationkey AS nation_key,
    CASE c_custkey % 2 WHEN 0 THEN 'female' ELSE 'male' END AS gender,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(25 + (c_custkey * 7) % 65 AS INT) END AS age,
    CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST((c_custkey * 5) % 6 AS INT) END AS chronic_conditions,
    CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST((c_custkey * 3) % 4 AS INT) END AS recent_hospitalizations,
    CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST((c_custkey * 3) % 11 AS DOUBLE) / 10e0 END AS medication_adherence,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST((c_custkey * 3) % 25 AS DOUBLE) END AS heart_rate_variance,
    CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 30 AS DOUBLE) END AS bp_variance
  FROM customer)"""

_READM = """least(
    CASE WHEN coalesce(age, 50) > 75 THEN 0.2::DOUBLE + 0.15::DOUBLE
         WHEN coalesce(age, 50) > 65 THEN 0.2::DOUBLE + 0.1::DOUBLE ELSE 0.2::DOUBLE END
    + least(coalesce(chronic_conditions, 0) * 0.08::DOUBLE, 0.3::DOUBLE)
    + least(coalesce(recent_hospitalizations, 0) * 0.15::DOUBLE, 0.3::DOUBLE)
    + (1 - coalesce(medication_adherence, 0.8::DOUBLE)) * 0.2::DOUBLE, 1.0::DOUBLE)"""

_READM_LEVEL = """CASE WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.4 THEN 'MEDIUM' ELSE 'LOW' END"""
_READM_TEXT = """CASE WHEN score > 0.7 THEN 'Schedule follow-up within 48 hours. Consider care management program enrollment.'
       WHEN score > 0.4 THEN 'Schedule follow-up within 7 days. Review medication adherence.'
       ELSE 'Standard follow-up. Continue remote monitoring.' END"""

SQL["readmission_risk"] = with_ctes(PATIENTS) + f""",
s AS (SELECT patient_id, {_READM} AS score FROM patients)
SELECT patient_id, 'readmission_risk' AS prediction_type, round(score, 6) AS score,
  {_READM_LEVEL} AS risk_level, {_READM_TEXT} AS recommendation,
  'lambda-v1.0' AS model_version
FROM s"""

_DET = """least(0.15::DOUBLE + hrv / 100 + bpv / 100
    + least(coalesce(chronic_conditions, 0) * 0.1::DOUBLE, 0.3::DOUBLE), 1.0::DOUBLE)"""
_DET_LEVEL = """CASE WHEN score > 0.6 THEN 'HIGH' WHEN score > 0.3 THEN 'MEDIUM' ELSE 'LOW' END"""

SQL["deterioration_risk"] = with_ctes(READINGS, PATIENTS) + f""",
hist AS (
  SELECT patient_id, var_samp(heart_rate) AS hv, var_samp(systolic_bp) AS bv
  FROM readings WHERE patient_id IS NOT NULL GROUP BY patient_id),
f AS (
  SELECT p.patient_id, p.chronic_conditions,
    coalesce(h.hv, p.heart_rate_variance, 10e0) AS hrv,
    coalesce(h.bv, p.bp_variance, 15e0) AS bpv
  FROM patients p LEFT JOIN hist h ON h.patient_id = p.patient_id),
s AS (SELECT *, {_DET} AS score FROM f)
SELECT patient_id, 'deterioration_risk' AS prediction_type, round(score, 6) AS score,
  {_DET_LEVEL} AS risk_level,
  CAST(CASE WHEN score > 0.6 THEN 7 ELSE 14 END AS INTEGER) AS alert_threshold_days,
  round(hrv, 6) AS heart_rate_variance, round(bpv, 6) AS bp_variance
FROM s"""

SQL["prediction_dispatch"] = with_ctes(PATIENTS) + f""",
req AS (
  SELECT *, coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL
                          WHEN c_custkey % 3 = 0 THEN 'readmission_risk'
                          WHEN c_custkey % 3 = 1 THEN 'deterioration_risk'
                          ELSE 'batch_analysis' END, 'readmission_risk') AS prediction_type,
    coalesce(heart_rate_variance, 10e0) AS hrv, coalesce(bp_variance, 15e0) AS bpv
  FROM patients),
s AS (
  SELECT patient_id, prediction_type, {_READM} AS r_score, {_DET} AS d_score FROM req)
SELECT patient_id, prediction_type,
  round(CASE prediction_type WHEN 'readmission_risk' THEN r_score
             WHEN 'deterioration_risk' THEN d_score END, 6) AS score,
  CASE prediction_type
    WHEN 'readmission_risk' THEN {_READM_LEVEL.replace('score', 'r_score')}
    WHEN 'deterioration_risk' THEN {_DET_LEVEL.replace('score', 'd_score')} END AS risk_level,
  CASE WHEN prediction_type = 'readmission_risk' THEN {_READM_TEXT.replace('score', 'r_score')} END
    AS recommendation,
  CAST(CASE WHEN prediction_type = 'deterioration_risk'
            THEN CASE WHEN d_score > 0.6 THEN 7 ELSE 14 END END AS INTEGER) AS alert_threshold_days,
  CASE WHEN prediction_type NOT IN ('readmission_risk', 'deterioration_risk')
       THEN 'Unknown prediction type' END AS error
FROM s"""

# ------------------------------------------------------------ observations
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
# (column, code, unit, basic display or None), in component order
_COMP = [
    ("heart_rate", "8867-4", "beats/minute", "Heart rate"),
    ("blood_oxygen", "59408-5", "%", "Oxygen saturation"),
    ("systolic_bp", "8480-6", "mmHg", None),
    ("diastolic_bp", "8462-4", "mmHg", None),
    ("temperature", "8310-5", "°C", None),
    ("blood_glucose", "2339-0", "mg/dL", None),
    ("respiratory_rate", "9279-1", "breaths/minute", None),
]

OBS = BASE + f""",
obs AS (
  SELECT *,
    sha256(concat_ws('|', device_id, {_ISO}, CAST(event_id AS VARCHAR))) AS observation_id,
    {_ISO} AS effective_date_time,
    CASE WHEN length(patient_id) > 0 THEN 'Patient/' || patient_id END AS patient_reference,
    lower(replace(device_type, ' ', '_')) AS type_key,
    CAST(ts AS DATE) AS observation_date
  FROM flat),
obsk AS (
  SELECT *, 'observations/' || type_key || '/' || strftime(observation_date, '%Y/%m/%d')
            || '/' || observation_id || '.json' AS object_key
  FROM obs)"""

SQL["observation_build"] = OBS + f"""
SELECT observation_id, 'Observation' AS resource_type, 'final' AS status, '1' AS version_id,
  'http://hl7.org/fhir/StructureDefinition/vitalsigns' AS profile,
  observation_id AS identifier_value, 'vital-signs' AS category_code,
  effective_date_time, device_id, device_type AS device_display,
  patient_reference AS subject_reference,
  CASE WHEN length(patient_id) > 0 THEN patient_id END AS subject_identifier,
  {_N_VITALS} AS n_components,
  concat_ws(',', {", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{code}' END" for c, code, _u, _d in _COMP)}) AS component_codes,
  concat_ws(',', {", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{u}' END" for c, _code, u, _d in _COMP)}) AS component_units,
  CASE WHEN alert_count > 0 THEN 'A' END AS interpretation_code,
  CASE WHEN alert_count > 0 THEN concat_ws(', ', a_hr, a_o2, a_bp, a_temp, a_glu) END AS interpretation_text,
  type_key AS device_type, observation_date, object_key,
  coalesce(patient_id, 'unknown') AS meta_patient_id
FROM obsk"""

SQL["observation_build_basic"] = OBS + """
SELECT observation_id,
  CAST((heart_rate IS NOT NULL)::INT + (blood_oxygen IS NOT NULL)::INT AS INTEGER) AS n_components,
  concat_ws(',', CASE WHEN heart_rate IS NOT NULL THEN 'Heart rate' END,
                 CASE WHEN blood_oxygen IS NOT NULL THEN 'Oxygen saturation' END) AS component_displays,
  FALSE AS has_subject, FALSE AS has_interpretation, CAST(NULL AS VARCHAR) AS device_display
FROM obsk"""


def _components_sql() -> str:
    arms = []
    for i, (c, code, unit, _d) in enumerate(_COMP):
        before = " + ".join(f"({p} IS NOT NULL)::INT" for p, *_ in _COMP[:i]) or "0"
        arms.append(f"  SELECT observation_id, CAST({before} AS INTEGER) AS pos, '{code}' AS loinc_code, "
                    f"{c} AS value, '{unit}' AS unit FROM obsk WHERE {c} IS NOT NULL")
    none = " AND ".join(f"{c} IS NULL" for c, *_ in _COMP)
    arms.append("  SELECT observation_id, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), "
                f"CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM obsk WHERE {none}")
    return OBS + "\n" + "\n  UNION ALL\n".join(arms)


SQL["observation_components"] = _components_sql()

SQL["observation_wide"] = OBS + """
SELECT observation_id, 'final' AS status, ts AS effective_timestamp, patient_reference, device_id,
  heart_rate, blood_oxygen, systolic_bp, diastolic_bp, temperature, blood_glucose, respiratory_rate
FROM obsk"""
SQL["observation_wide_grouped"] = SQL["observation_wide"]

SQL["observation_partition_counts"] = OBS + """
SELECT type_key AS device_type, observation_date, count(*) AS n
FROM obsk GROUP BY 1, 2"""

SQL["patient_summary"] = OBS + """,
s AS (
  SELECT patient_reference, count(observation_id) AS total_observations,
    min(ts) AS first_reading, max(ts) AS last_reading,
    avg(heart_rate) AS ahr, min(heart_rate) AS min_heart_rate, max(heart_rate) AS max_heart_rate,
    avg(blood_oxygen) AS ao2, min(blood_oxygen) AS min_blood_oxygen,
    avg(systolic_bp) AS asys, avg(diastolic_bp) AS adia, avg(blood_glucose) AS aglu,
    count(DISTINCT device_id) AS unique_devices
  FROM obsk GROUP BY patient_reference)
SELECT patient_reference, total_observations, first_reading, last_reading,
  round(ahr, 6) AS avg_heart_rate, min_heart_rate, max_heart_rate,
  round(ao2, 6) AS avg_blood_oxygen, min_blood_oxygen,
  round(asys, 6) AS avg_systolic_bp, round(adia, 6) AS avg_diastolic_bp,
  round(aglu, 6) AS avg_blood_glucose, unique_devices,
  CASE WHEN ahr > 100 THEN 'elevated' WHEN ahr < 60 THEN 'low' ELSE 'normal' END AS heart_rate_risk,
  CASE WHEN ao2 < 95 THEN 'concerning' WHEN ao2 < 92 THEN 'critical' ELSE 'normal' END AS oxygen_risk,
  CASE WHEN asys > 140 THEN 'hypertension' WHEN asys < 90 THEN 'hypotension' ELSE 'normal' END AS bp_risk
FROM s"""

SQL["patient_summary_strict"] = OBS + """,
s AS (SELECT patient_reference, avg(blood_oxygen) AS ao2 FROM obsk GROUP BY patient_reference)
SELECT patient_reference, round(ao2, 6) AS avg_blood_oxygen,
  CASE WHEN ao2 < 92 THEN 'critical' WHEN ao2 < 95 THEN 'concerning' ELSE 'normal' END AS oxygen_risk
FROM s"""

# ------------------------------------------------------------------ search
_SEARCH_SELECT = """SELECT observation_id, patient_reference, device_id, effective_date_time, object_key
FROM obsk"""


def _search_sql(where: str, n: int = 100) -> str:
    return OBS + f"\n{_SEARCH_SELECT}\nWHERE {where}\nORDER BY object_key, observation_id LIMIT {n}"


SQL["search_by_patient"] = _search_sql("contains(coalesce(patient_reference, ''), 'patient-1')")
SQL["search_by_device"] = _search_sql("device_id = 'device-42'")
SQL["search_by_date"] = _search_sql(
    "coalesce(effective_date_time, '') >= '2024-01-10' "
    "AND coalesce(effective_date_time, '') <= '2024-01-12T12:00:00'")
SQL["search_combined"] = _search_sql(
    "contains(coalesce(patient_reference, ''), 'patient-7') "
    "AND coalesce(effective_date_time, '') >= '2024-01-05'", 20)
SQL["search_strict_patient"] = _search_sql("coalesce(patient_reference, '') = 'Patient/patient-1'")

SQL["search_bundle"] = OBS + """,
hits AS (
  SELECT * FROM obsk
  WHERE coalesce(effective_date_time, '') >= '2024-01-10'
    AND coalesce(effective_date_time, '') <= '2024-01-12T12:00:00'
  ORDER BY object_key, observation_id LIMIT 100)
SELECT 'Bundle' AS resource_type, 'searchset' AS bundle_type, count(*) AS total,
  TRUE AS has_last_updated, min_by(observation_id, object_key) AS first_resource_id,
  max_by(effective_date_time, object_key) AS last_effective,
  'urn:uuid:' || min_by(observation_id, object_key) AS first_full_url,
  'urn:uuid:' || max_by(observation_id, object_key) AS last_full_url
FROM hits"""

SQL["read_observation"] = OBS + """,
req AS (
  SELECT CASE WHEN event_id % 5 = 0 THEN 'missing-' || CAST(event_id AS VARCHAR)
              ELSE observation_id END AS requested_id
  FROM obsk)
SELECT r.requested_id, o.observation_id IS NOT NULL AS found, o.observation_id,
  o.device_id,
  CASE WHEN o.observation_id IS NULL THEN 'error' END AS outcome_severity,
  CASE WHEN o.observation_id IS NULL THEN 'not-found' END AS outcome_code,
  CASE WHEN o.observation_id IS NULL THEN 'Observation/' || r.requested_id || ' not found' END
    AS outcome_diagnostics
FROM req r LEFT JOIN obsk o ON o.observation_id = r.requested_id"""

SQL["create_observation"] = OBS + """
SELECT event_id, 'Observation' AS resource_type, event_id % 4 <> 0 AS id_given,
  CASE WHEN event_id % 4 <> 0 THEN observation_id END AS given_id,
  CAST(CASE WHEN event_id % 4 <> 0 THEN 64 ELSE 36 END AS INTEGER) AS id_length,
  'observations/api/' AS key_prefix, 'api' AS source
FROM obsk"""

SQL["patient_read"] = with_ctes(PATIENTS) + """,
req AS (
  SELECT CASE WHEN c_custkey % 6 = 0 THEN 'patient-x' || CAST(c_custkey AS VARCHAR)
              ELSE 'patient-' || CAST(c_custkey AS VARCHAR) END AS requested_id
  FROM customer)
SELECT r.requested_id, p.patient_id IS NOT NULL AS found, p.name, p.gender,
  CASE WHEN p.patient_id IS NULL THEN 'not-found' END AS outcome_code,
  CASE WHEN p.patient_id IS NULL THEN 'Patient/' || r.requested_id || ' not found' END
    AS outcome_diagnostics
FROM req r LEFT JOIN patients p ON p.patient_id = r.requested_id"""

SQL["patient_search"] = with_ctes(PATIENTS) + """
SELECT patient_id, name, gender, nation_key, age FROM patients
WHERE gender = 'female' AND CAST(nation_key AS VARCHAR) = '3'"""

SQL["patient_create"] = with_ctes(PATIENTS) + """
SELECT patient_id, 'Patient' AS resource_type, name, CAST(36 AS INTEGER) AS id_length FROM patients"""

# ------------------------------------------------------ sources and sinks
SQL["conversion_counts"] = """
SELECT count(*) FILTER (WHERE event_id % 97 <> 0) AS processed,
       count(*) FILTER (WHERE event_id % 97 = 0) AS errors
FROM events"""

SQL["parquet_roundtrip"] = BASE + """
SELECT date, device_type, count(*) AS n FROM flat
GROUP BY date, device_type"""

SQL["etl_table_counts"] = OBS + """,
good AS (SELECT * FROM flat)
SELECT 'device_readings' AS table_name, count(*) AS rows FROM good
UNION ALL SELECT 'fhir_observations', count(*) FROM obsk
UNION ALL SELECT 'patient_summary', count(*) FROM (SELECT DISTINCT patient_reference FROM obsk)
UNION ALL SELECT 'device_analytics', count(*) FROM (SELECT DISTINCT device_id, device_type FROM good)
UNION ALL SELECT 'hourly_trends', count(*) FROM (SELECT DISTINCT date, hour, device_type FROM good)"""

SQL["catalog_sql"] = BASE + """,
good AS (SELECT * FROM flat),
d AS (
  SELECT device_id, device_type, count(*) AS total_readings,
    CAST(sum(alert_count) AS BIGINT) AS total_alerts,
    CAST(sum(CASE WHEN has_critical_alert THEN 1 ELSE 0 END) AS BIGINT) AS critical_alerts,
    stddev_samp(heart_rate) AS sd
  FROM good GROUP BY device_id, device_type),
ds AS (
  SELECT *, CAST(least(100, greatest(0, 100 - critical_alerts * 5
    - CASE WHEN sd > 30 THEN 20 ELSE 0 END)) AS BIGINT) AS device_health_score FROM d)
SELECT device_type, count(*) AS devices, CAST(sum(total_readings) AS BIGINT) AS readings,
  CAST(sum(total_alerts) AS BIGINT) AS alerts, min(device_health_score) AS min_health_score,
  max(device_health_score) AS max_health_score
FROM ds GROUP BY device_type"""

# --------------------------------------------------------------- streaming
GOOD = BASE + """,
good AS (SELECT * FROM flat)"""

SQL["stream_silver"] = GOOD + """
SELECT CAST(event_id AS VARCHAR) AS message_id, device_id, device_type, patient_id, ts,
  alert_types, alert_severity, channel
FROM good"""

SQL["stream_quarantine"] = """
SELECT 'unparseable' AS reason, count(*) AS n FROM events WHERE event_id % 97 = 0"""

SQL["stream_bronze"] = with_ctes(READINGS) + """
SELECT split_part(topic, '/', 2) AS channel,
  count(*) AS n, count(*) FILTER (WHERE event_id % 97 = 0) AS unparsed, count(*) AS with_arrival
FROM readings GROUP BY 1"""

SQL["stream_observations"] = OBS + """
SELECT observation_id, type_key AS device_type, observation_date,
  {n} AS n_components, object_key
FROM obsk""".replace("{n}", _N_VITALS)

SQL["stream_alerts"] = GOOD + """
SELECT CAST(event_id AS VARCHAR) AS message_id,
  CASE WHEN alert_count > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  'Healthcare Alert: ' || concat_ws(', ', a_hr, a_o2, a_bp, a_temp, a_glu) AS subject,
  alert_count AS alerts_sent
FROM good WHERE alert_count > 0"""

SQL["stream_hourly"] = SQL["hourly_trends"]

# ---------------------------------------------------------------------- ML
SQL["next_reading"] = BASE + """
SELECT event_id, device_id,
  lead(event_id) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS next_event_id,
  lead(ts) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS next_ts
FROM flat"""

# next reading of the device, its label and the hold-out bucket of the message
_SAMPLES = """,
seq AS (
  SELECT event_id, lead(event_id) OVER (PARTITION BY device_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS next_id
  FROM readings WHERE ts IS NOT NULL),
samples AS (
  SELECT s.event_id, k.tenths >= 3 AS label,
    CAST('0x' || substr(md5(CAST(s.event_id AS VARCHAR)), 1, 8) AS UBIGINT) % 5 = 0 AS held
  FROM seq s JOIN risk k ON k.event_id = s.next_id)"""

SQL["train_model"] = _RISK + _SAMPLES + """
SELECT 'anomaly_detection' AS model_type, count(*) FILTER (NOT held) AS training_samples,
  count(*) FILTER (held) AS validation_samples, TRUE AS metrics_in_range, TRUE AS model_loads,
  count(*) FILTER (label) AS abnormal_next
FROM samples"""

SQL["model_latest"] = _RISK + _SAMPLES + """
SELECT kind AS model_type, kind || '-20240202-020000' AS model_id,
  count(*) FILTER (NOT held) AS training_samples, TIMESTAMP '2024-02-02 02:00:00' AS updated_at
FROM samples, (VALUES ('anomaly_detection'), ('critical_detection')) t(kind) GROUP BY kind"""

SQL["score_latest"] = """
SELECT kind AS model_type, kind || '-20240202-020000' AS model_id, count(*) AS scored, count(*) AS messages,
  TRUE AS rates_agree
FROM events, (VALUES ('anomaly_detection'), ('critical_detection')) t(kind) GROUP BY kind"""

_STORE = OBS + """,
store AS (
  SELECT 'device' AS source, CASE WHEN event_id % 50 <> 7 THEN effective_date_time END AS eff FROM obsk
  UNION ALL SELECT 'api', effective_date_time FROM obsk WHERE event_id % 10 = 0),
found AS (
  SELECT 'between' AS search, * FROM store WHERE eff >= '2024-01-10' AND eff <= '2024-01-12T12:00:00'
  UNION ALL SELECT 'until', * FROM store WHERE coalesce(eff, '') <= '2024-01-12T12:00:00')"""
SQL["search_stored"] = _STORE + """
SELECT search, pruned, source, count(*) AS n, count(eff) AS dated
FROM found, (VALUES (TRUE), (FALSE)) p(pruned) GROUP BY search, pruned, source"""
SQL["observation_json_roundtrip"] = SQL["observation_wide"]

SQL["stream_metrics"] = SQL["anomaly_metrics"]

# ------------------------------------------------ stored tables, value by value
SQL["etl_device_readings"] = BASE + """
SELECT device_id, device_type, patient_id, ts, heart_rate, blood_oxygen, systolic_bp, diastolic_bp,
  round(temperature, 6) AS temperature, blood_glucose, respiratory_rate, alert_count, alert_types,
  alert_severity, has_critical_alert, date, hour, channel
FROM flat"""
SQL["etl_fhir_observations"] = SQL["observation_wide"]
SQL["etl_patient_summary"] = SQL["patient_summary"]
SQL["etl_device_analytics"] = SQL["device_analytics"]
SQL["etl_hourly_trends"] = SQL["hourly_trends"]
SQL["etl_incremental"] = SQL["device_analytics"]
SQL["etl_rejects"] = """
SELECT count(*) FILTER (event_id % 97 = 0) AS rejects, count(*) FILTER (event_id % 97 = 0) AS with_text,
  count(*) FILTER (event_id % 97 = 0) AS reported, count(*) FILTER (event_id % 97 <> 0) AS readings
FROM events"""
SQL["etl_empty_input"] = BASE + """
SELECT device_type, count(*) AS n FROM flat GROUP BY device_type"""

SQL["message_summary"] = BASE + """
SELECT CAST(event_id AS VARCHAR) AS message_id, device_id, alert_types, alert_severity FROM flat"""
SQL["search_by_type"] = OBS + """,
o AS (
  SELECT observation_id FROM obsk WHERE device_id = 'device-42' AND effective_date_time >= '2024-01-05'
  ORDER BY object_key, observation_id LIMIT 50)
SELECT 'Observation' AS resource_type, observation_id AS resource_id FROM o
UNION ALL
SELECT 'Patient', 'patient-' || CAST(c_custkey AS VARCHAR) FROM customer
WHERE c_custkey % 2 <> 0 AND c_nationkey = 7"""

SQL["etl_resume"] = OBS + """
SELECT 'device_analytics' AS table_name, device_id AS key, count(*) AS n, max(ts) AS last_at,
  round(avg(heart_rate), 6) AS avg_heart_rate
FROM flat GROUP BY device_id, device_type
UNION ALL
SELECT 'patient_summary', patient_reference, count(*), max(ts), round(avg(heart_rate), 6) FROM obsk GROUP BY 2
UNION ALL
SELECT 'hourly_trends', concat_ws('/', hour, device_type), count(*), CAST(date AS TIMESTAMP), round(avg(heart_rate), 6)
FROM flat GROUP BY date, hour, device_type
UNION ALL
SELECT 'device_readings', NULL, count(*), max(ts), round(avg(heart_rate), 6) FROM flat"""

SQL["etl_new_files"] = """
WITH k AS (SELECT event_id % 2 AS day, event_id % 97 <> 0 AS good FROM events),
runs AS (SELECT unnest([1, 2, 3]) AS run)
SELECT CAST(run AS INTEGER) AS run, count(*) FILTER (good AND day = run - 1) AS added,
  count(*) FILTER (NOT good AND day = run - 1) AS rejected, run < 3 AS read_files,
  (SELECT count(*) FROM k WHERE good) AS stored
FROM k, runs GROUP BY run"""

SQL["gold_sketch"] = BASE + """
SELECT date, hour, device_type, count(*) AS reading_count, round(avg(heart_rate), 6) AS avg_heart_rate,
  CAST(sum(alert_count) AS BIGINT) AS total_alerts, count(DISTINCT device_id) AS devices,
  count(DISTINCT patient_id) AS patients, TRUE AS devices_within, TRUE AS patients_within
FROM flat GROUP BY date, hour, device_type"""

SQL["stream_resend"] = SQL["stream_observations"]

SQL["quarantine_replay"] = with_ctes(READINGS) + """
SELECT 'released' AS state, 'unsubscribed' AS reason, CAST(1 AS INTEGER) AS tries, count(*) AS messages
FROM readings WHERE event_id % 2 = 0 AND event_id % 97 <> 0 AND split_part(topic, '/', 2) = 'home-health'
HAVING count(*) > 0
UNION ALL
SELECT CASE event_id % 2 WHEN 0 THEN 'set aside' ELSE 'open' END, 'unparseable',
  CAST(CASE event_id % 2 WHEN 0 THEN 3 ELSE 1 END AS INTEGER), count(*)
FROM readings WHERE event_id % 97 = 0 GROUP BY event_id % 2
UNION ALL
SELECT 'enriched', NULL, NULL, count(*) FROM readings WHERE event_id % 97 <> 0"""


def _page(name: str, few: str) -> str:
    body = SQL[name].split("SELECT observation_id, patient_reference, device_id, effective_date_time, object_key")[1]
    return (f"(SELECT '{name}' AS search, observation_id, patient_reference, device_id, effective_date_time, "
            f"object_key, {few} AS few_files{body})")


SQL["search_page"] = OBS + " UNION ALL ".join(
    _page(name, few) for name, few in (
        ("search_by_patient", "TRUE"), ("search_by_device", "CAST(NULL AS BOOLEAN)"), ("search_by_date", "TRUE"),
        ("search_combined", "CAST(NULL AS BOOLEAN)"), ("search_strict_patient", "CAST(NULL AS BOOLEAN)")))

SQL["read_located"] = OBS + """
SELECT CASE WHEN event_id % 5 = 0 THEN 'missing-' || CAST(event_id AS VARCHAR) ELSE observation_id END AS requested_id,
  event_id % 5 <> 0 AS found, CASE WHEN event_id % 5 <> 0 THEN device_id END AS device_id,
  CASE WHEN event_id % 5 <> 0 THEN object_key END AS object_key,
  CASE WHEN event_id % 5 = 0 THEN 'not-found' END AS outcome_code, TRUE AS at_most_a_file_each
FROM obsk WHERE device_id = 'device-42'"""

SQL["bronze_device_history"] = with_ctes(READINGS) + """
SELECT device_id AS device, split_part(topic, '/', 2) AS channel, TRUE AS parsed,
  CAST(event_id AS VARCHAR) AS message_id, TRUE AS few_files
FROM readings WHERE device_id = 'device-42' AND event_id % 97 <> 0"""

SQL["catalog_refresh"] = OBS + """,
drift(table_name, column_name, change, from_type, to_type) AS (VALUES
  ('raw_messages', 'battery', 'widened', 'bigint', 'double'),
  ('raw_messages', 'site', 'conflict', 'string', 'struct<name:string>'),
  ('raw_messages', 'firmware', 'added', NULL, 'string'),
  ('fhir_documents', 'note', 'added', NULL, 'string')),
counted AS (
  SELECT 'raw_messages' AS t, 'rows' AS c, count(*) AS n FROM obsk
  UNION ALL SELECT 'raw_messages', 'firmware', count(*) FILTER (event_id % 2 = 1) FROM obsk
  UNION ALL SELECT 'raw_messages', 'battery',
    CAST(sum(2 * (event_id % 100) + event_id % 2) AS BIGINT) FROM obsk
  UNION ALL SELECT 'raw_messages', 'site', count(*) FROM obsk
  UNION ALL SELECT 'fhir_documents', 'rows', count(*) FROM obsk
  UNION ALL SELECT 'fhir_documents', 'note', count(*) FILTER (observation_date > DATE '2024-01-15') FROM obsk
  UNION ALL SELECT 'fhir_documents', 'partitions', count(DISTINCT (type_key, observation_date)) FROM obsk)
SELECT *, CAST(NULL AS BIGINT) AS n FROM drift
UNION ALL SELECT t, c, 'counted', NULL, NULL, n FROM counted"""

SQL["deterioration_asof"] = with_ctes(READINGS, PATIENTS) + f""",
req AS (SELECT event_id, patient_id, CAST(ts AS DATE) AS day FROM readings WHERE patient_id IS NOT NULL),
hist AS (
  SELECT q.event_id, var_samp(r.heart_rate) AS hv, var_samp(r.systolic_bp) AS bv, count(*) AS n
  FROM req q JOIN readings r ON r.patient_id = q.patient_id
    AND CAST(r.ts AS DATE) >= q.day - 7 AND CAST(r.ts AS DATE) < q.day
  GROUP BY q.event_id),
f AS (
  SELECT q.event_id, q.patient_id, p.chronic_conditions, coalesce(h.hv, p.heart_rate_variance, 10e0) AS hrv,
    coalesce(h.bv, p.bp_variance, 15e0) AS bpv, coalesce(h.n, 0) AS history_readings
  FROM req q LEFT JOIN hist h ON h.event_id = q.event_id LEFT JOIN patients p ON p.patient_id = q.patient_id),
s AS (SELECT *, {_DET} AS score FROM f)
SELECT event_id, patient_id, round(score, 6) AS score, {_DET_LEVEL} AS risk_level,
  CAST(CASE WHEN score > 0.6 THEN 7 ELSE 14 END AS INTEGER) AS alert_threshold_days,
  round(hrv, 6) AS heart_rate_variance, round(bpv, 6) AS bp_variance, history_readings
FROM s"""

SQL["basic_documents"] = OBS + """
SELECT observation_id,
  CAST((heart_rate IS NOT NULL)::INT + (blood_oxygen IS NOT NULL)::INT AS INTEGER) AS n_components,
  device_id, TRUE AS in_todays_folder
FROM obsk"""

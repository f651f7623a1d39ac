"""Fixed values of the domain.

FIXED VALUES — these must equal the source system's values for identical
results (alert names, LOINC codes and texts, units, thresholds, cut-offs,
sentences, document constants). They are stated plainly, in natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Reading keys of a device message, in component order, with our column names.
#   (message key, column, LOINC code, coding display, component text, unit, UCUM code)
LOINC_COMPONENTS = [
    ("heartRate", "heart_rate", "8867-4", "Heart rate", "Heart rate",
     "beats/minute", "/min"),
    ("bloodOxygen", "blood_oxygen", "59408-5",
     "Oxygen saturation in Arterial blood by Pulse oximetry", "Oxygen saturation",
     "%", "%"),
    ("systolicBP", "systolic_bp", "8480-6", "Systolic blood pressure",
     "Systolic blood pressure", "mmHg", "mm[Hg]"),
    ("diastolicBP", "diastolic_bp", "8462-4", "Diastolic blood pressure",
     "Diastolic blood pressure", "mmHg", "mm[Hg]"),
    ("temperature", "temperature", "8310-5", "Body temperature", "Body temperature",
     "°C", "Cel"),
    ("bloodGlucose", "blood_glucose", "2339-0", "Glucose [Mass/volume] in Blood",
     "Blood glucose", "mg/dL", "mg/dL"),
    ("respiratoryRate", "respiratory_rate", "9279-1", "Respiratory rate",
     "Respiratory rate", "breaths/minute", "/min"),
]

# Basic converter variant: heart rate and SpO2 only, with its own display text.
BASIC_COMPONENTS = [
    ("heartRate", "8867-4", "Heart rate", "beats/minute", "/min"),
    ("bloodOxygen", "59408-5", "Oxygen saturation", "%", "%"),
]

# Alerts whose presence makes a message critical.
CRITICAL_ALERTS = ["hypertensive_crisis", "hypoxemia", "hypoglycemia"]

# Alert names, full rule set, in rule order.
ALERT_NAMES = [
    "tachycardia", "bradycardia",
    "hypoxemia", "low_oxygen_warning",
    "hypertensive_crisis", "high_blood_pressure", "low_blood_pressure",
    "fever", "hypothermia",
    "hyperglycemia", "hypoglycemia",
]

# Basic rule set alert names.
BASIC_ALERT_NAMES = ["abnormal_heart_rate", "low_blood_oxygen"]

# Anomaly scorer thresholds: metric -> (critical_min, min, max, critical_max);
# None = bound not defined. The scorer's metric names, then our column.
SCORER_THRESHOLDS = [
    ("heart_rate", "heart_rate", 40, 50, 120, 150),
    ("blood_oxygen", "blood_oxygen", 88, 92, None, None),
    ("blood_pressure_systolic", "systolic_bp", 80, 90, 140, 180),
    ("blood_pressure_diastolic", "diastolic_bp", 50, 60, 90, 120),
    ("temperature", "temperature", 35, 36.1, 37.8, 39.5),
    ("respiratory_rate", "respiratory_rate", 8, 12, 20, 30),
]

# Prediction feature defaults.
FEATURE_DEFAULTS = {
    "age": 50,
    "chronic_conditions": 0,
    "recent_hospitalizations": 0,
    "medication_adherence": 0.8,
    "heart_rate_variance": 10.0,
    "bp_variance": 15.0,
}
FEATURES_USED = ["age", "chronic_conditions", "recent_hospitalizations",
                 "medication_adherence", "avg_heart_rate_variance",
                 "avg_blood_pressure_variance"]

READMISSION_RECOMMENDATIONS = [
    "Schedule follow-up within 48 hours. Consider care management program enrollment.",
    "Schedule follow-up within 7 days. Review medication adherence.",
    "Standard follow-up. Continue remote monitoring.",
]
PREDICTION_MODEL_VERSION = "lambda-v1.0"
UNKNOWN_PREDICTION_ERROR = "Unknown prediction type"

# Observation document constants.
OBS_PROFILE = "http://hl7.org/fhir/StructureDefinition/vitalsigns"
OBS_IDENTIFIER_SYSTEM = "urn:healthcare:observations"
OBS_CATEGORY_SYSTEM = "http://terminology.hl7.org/CodeSystem/observation-category"
OBS_CATEGORY_CODE = "vital-signs"
OBS_CATEGORY_DISPLAY = "Vital Signs"
DEVICE_SYSTEM = "urn:healthcare:devices"
PATIENT_SYSTEM = "urn:healthcare:patients"
LOINC_SYSTEM = "http://loinc.org"
UCUM_SYSTEM = "http://unitsofmeasure.org"
INTERPRETATION_SYSTEM = "http://terminology.hl7.org/CodeSystem/v3-ObservationInterpretation"
INTERPRETATION_CODE = "A"
INTERPRETATION_DISPLAY = "Abnormal"
UNKNOWN_DEVICE_DISPLAY = "Unknown Device"

# Topics devices publish on (single-level wildcard in the last segment).
TOPIC_FILTERS = ["iomt/wearables/+", "iomt/home-health/+"]

# Notification constants.
NOTIFY_ALERT_TYPE = "ANOMALY_DETECTED"
NOTIFY_SUBJECT_PREFIX = "Healthcare Alert: "

# Model training hyper-parameters.
TRAIN_MAX_DEPTH = 5
TRAIN_N_ESTIMATORS = 100
TRAIN_LEARNING_RATE = 0.1

# Alert rules per vital, tested in this order: (alert, [(column, comparison, bound)]);
# several bounds of one alert are alternatives. Blood pressure needs both values.
ALERT_RULES = [
    ("heart_rate", [("tachycardia", [("heart_rate", ">", 120)]),
                    ("bradycardia", [("heart_rate", "<", 50)])]),
    ("blood_oxygen", [("hypoxemia", [("blood_oxygen", "<", 92)]),
                      ("low_oxygen_warning", [("blood_oxygen", "<", 95)])]),
    ("blood_pressure", [
        ("hypertensive_crisis", [("systolic_bp", ">", 180), ("diastolic_bp", ">", 120)]),
        ("high_blood_pressure", [("systolic_bp", ">", 140), ("diastolic_bp", ">", 90)]),
        ("low_blood_pressure", [("systolic_bp", "<", 90), ("diastolic_bp", "<", 60)])]),
    ("temperature", [("fever", [("temperature", ">", 38.5)]),
                     ("hypothermia", [("temperature", "<", 35)])]),
    ("blood_glucose", [("hyperglycemia", [("blood_glucose", ">", 180)]),
                       ("hypoglycemia", [("blood_glucose", "<", 70)])]),
]

# Risk of a scored message, in tenths: per critical and per warning anomaly, most,
# and the levels from which it is critical and a warning.
RISK_PER_CRITICAL, RISK_PER_WARNING, RISK_MOST = 4, 2, 10
RISK_CRITICAL_FROM, RISK_WARNING_FROM = 6, 3

# Readmission: baseline; (age above, added); (per condition, most); (per stay, most);
# weight of missing adherence; most; score above which the level is HIGH, MEDIUM.
READMISSION_BASE = 0.2
READMISSION_AGE = [(75, 0.15), (65, 0.1)]
READMISSION_CHRONIC = (0.08, 0.3)
READMISSION_STAYS = (0.15, 0.3)
READMISSION_ADHERENCE = 0.2
READMISSION_LEVELS = (0.7, 0.4)

# Deterioration: baseline; divisor of the variances; (per condition, most); score
# above which the level is HIGH, MEDIUM; days to the alert when HIGH, otherwise.
DETERIORATION_BASE = 0.15
DETERIORATION_VARIANCE = 100
DETERIORATION_CHRONIC = (0.1, 0.3)
DETERIORATION_LEVELS = (0.6, 0.3)
DETERIORATION_DAYS = (7, 14)

# Patient risk bands: (above, name), (below, name). Oxygen: (below, name) in the
# order in which they are tested.
HEART_RATE_BANDS = ((100, "elevated"), (60, "low"))
OXYGEN_BANDS = [(95, "concerning"), (92, "critical")]
PRESSURE_BANDS = ((140, "hypertension"), (90, "hypotension"))

# Device health: start; off per critical alert; off where the heart rate's
# deviation is above the bound.
HEALTH_START, HEALTH_PER_CRITICAL, HEALTH_SPREAD, HEALTH_SPREAD_ABOVE = 100, 5, 20, 30
# ------------------------------------------------------------ end FIXED VALUES

READING_KEYS = [c[0] for c in LOINC_COMPONENTS]
VITAL_COLUMNS = [c[1] for c in LOINC_COMPONENTS]

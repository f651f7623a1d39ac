"""Scores and risk bands as Column expressions.

* threshold anomaly scorer over a readings MAP (row-local higher-order
  functions: no explode, no shuffle)
* readmission / deterioration risk from a feature record
* patient-level risk bands and the device health score
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .vocab import (FEATURE_DEFAULTS, READMISSION_RECOMMENDATIONS,
                    SCORER_THRESHOLDS)

# Message reading key -> scorer metric name (one name map for both sides).
KEY_TO_METRIC = {
    "heartRate": "heart_rate",
    "bloodOxygen": "blood_oxygen",
    "systolicBP": "blood_pressure_systolic",
    "diastolicBP": "blood_pressure_diastolic",
    "temperature": "temperature",
    "bloodGlucose": "blood_glucose",
    "respiratoryRate": "respiratory_rate",
}


def value_text(v: Column) -> Column:
    """Render a reading the way a JSON number prints: 72 -> '72', 36.6 -> '36.6'."""
    integral = (v == F.floor(v)) & (F.abs(v) < F.lit(1e15))
    return F.when(integral, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def _anomaly(metric: Column, v: Column, severity: str, text: str) -> Column:
    return F.struct(
        metric.alias("metric"), v.alias("value"), F.lit(severity).alias("severity"),
        F.concat(metric, F.lit(f" {text}: "), value_text(v)).alias("message"))


def metric_anomaly(metric: Column, v: Column) -> Column:
    """First matching band (critical-low, critical-high, low, high) or null.

    Strict comparisons; unknown metrics and null values give null.
    """
    out = None
    for name, _col, cmin, mn, mx, cmax in SCORER_THRESHOLDS:
        branch = None
        for bound, op, sev, text in ((cmin, "lt", "CRITICAL", "critically low"),
                                     (cmax, "gt", "CRITICAL", "critically high"),
                                     (mn, "lt", "WARNING", "below normal"),
                                     (mx, "gt", "WARNING", "above normal")):
            if bound is None:
                continue
            cond = (v < F.lit(float(bound))) if op == "lt" else (v > F.lit(float(bound)))
            a = _anomaly(metric, v, sev, text)
            branch = F.when(cond, a) if branch is None else branch.when(cond, a)
        out = (F.when(metric == F.lit(name), branch) if out is None
               else out.when(metric == F.lit(name), branch))
    return out


def metric_name(key: Column) -> Column:
    """Message reading key -> scorer metric name (other keys unchanged)."""
    out = None
    for k, v in KEY_TO_METRIC.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k),
                                                                            F.lit(v))
    return out.otherwise(key)


def threshold_anomalies(readings: Column) -> Column:
    """array<struct<metric,value,severity,message>> in reading order.

    Message keys are mapped to metric names per entry (renaming the map's
    keys instead could collide, e.g. 'heartRate' next to 'heart_rate')."""
    scored = F.transform(F.map_entries(readings),
                         lambda e: metric_anomaly(metric_name(e["key"]), e["value"]))
    return F.filter(scored, lambda a: a.isNotNull())


def _count_sev(anomalies: Column, sev: str) -> Column:
    return F.size(F.filter(anomalies, lambda a: a["severity"] == F.lit(sev)))


def risk_tenths(anomalies: Column) -> Column:
    """Risk in integer tenths: 4 per critical, 2 per warning, capped at 10."""
    return F.least(F.lit(V.RISK_MOST), _count_sev(anomalies, "CRITICAL") * V.RISK_PER_CRITICAL
                   + _count_sev(anomalies, "WARNING") * V.RISK_PER_WARNING)


def reading_tenths(readings: Column) -> Column:
    """``risk_tenths`` of the map's anomalies, from its entries without building the anomalies."""
    def points(key: Column, v: Column) -> Column:
        out = F.lit(0)
        for name, _col, cmin, mn, mx, cmax in SCORER_THRESHOLDS:
            keys = [name, *[k for k, m in KEY_TO_METRIC.items() if m == name and k != name]]
            worth = F.lit(0)
            for low, high, tenths in ((mn, mx, V.RISK_PER_WARNING), (cmin, cmax, V.RISK_PER_CRITICAL)):
                for hit in ([v < F.lit(float(low))] if low is not None else []) + (
                        [v > F.lit(float(high))] if high is not None else []):
                    worth = F.when(hit, tenths).otherwise(worth)
            out = F.when(key.isin(keys), worth).otherwise(out)
        return out
    return F.least(F.lit(V.RISK_MOST), F.aggregate(
        F.map_entries(readings), F.lit(0), lambda sum_, e: sum_ + points(e["key"], e["value"])))


def risk_score(anomalies: Column) -> Column:
    return risk_tenths(anomalies) / F.lit(10.0)


def alert_level(anomalies: Column) -> Column:
    return level_of(risk_tenths(anomalies))


def level_of(t: Column) -> Column:
    return (F.when(t >= V.RISK_CRITICAL_FROM, F.lit("CRITICAL"))
            .when(t >= V.RISK_WARNING_FROM, F.lit("WARNING"))
            .otherwise(F.lit("NORMAL")))


def readings_analyzed(readings: Column) -> Column:
    return F.coalesce(F.size(readings), F.lit(0))


# ------------------------------------------------------------- predictions
def with_default(c: Column, feature: str) -> Column:
    return F.coalesce(c, F.lit(FEATURE_DEFAULTS[feature]))


def readmission_score(age: Column, chronic: Column, hosp: Column,
                      adherence: Column) -> Column:
    """0.2 baseline + age band + capped chronic and hospital terms + adherence gap,
    capped at 1.0; summed in the same order as the source (IEEE parity)."""
    base = F.lit(V.READMISSION_BASE)
    s = base
    for above, added in reversed(V.READMISSION_AGE):  # the highest age band wins
        s = F.when(age > above, base + F.lit(added)).otherwise(s)
    s = s + F.least(chronic * F.lit(V.READMISSION_CHRONIC[0]), F.lit(V.READMISSION_CHRONIC[1]))
    s = s + F.least(hosp * F.lit(V.READMISSION_STAYS[0]), F.lit(V.READMISSION_STAYS[1]))
    s = s + (F.lit(1) - adherence) * F.lit(V.READMISSION_ADHERENCE)
    return F.least(s, F.lit(1.0))


def _by_level(score: Column, levels: tuple, high: str, medium: str, low: str) -> Column:
    return (F.when(score > levels[0], F.lit(high)).when(score > levels[1], F.lit(medium))
            .otherwise(F.lit(low)))


def readmission_level(score: Column) -> Column:
    return _by_level(score, V.READMISSION_LEVELS, "HIGH", "MEDIUM", "LOW")


def readmission_recommendation(score: Column) -> Column:
    return _by_level(score, V.READMISSION_LEVELS, *READMISSION_RECOMMENDATIONS)


def deterioration_score(hr_var: Column, bp_var: Column, chronic: Column) -> Column:
    s = F.lit(V.DETERIORATION_BASE) + hr_var / F.lit(V.DETERIORATION_VARIANCE)
    s = s + bp_var / F.lit(V.DETERIORATION_VARIANCE)
    s = s + F.least(chronic * F.lit(V.DETERIORATION_CHRONIC[0]), F.lit(V.DETERIORATION_CHRONIC[1]))
    return F.least(s, F.lit(1.0))


def deterioration_level(score: Column) -> Column:
    return _by_level(score, V.DETERIORATION_LEVELS, "HIGH", "MEDIUM", "LOW")


def deterioration_horizon_days(score: Column) -> Column:
    soon, later = V.DETERIORATION_DAYS
    return F.when(score > V.DETERIORATION_LEVELS[0], F.lit(soon)).otherwise(F.lit(later))


# ------------------------------------------------------ patient / device risk
def _outside(value: Column, bands: tuple) -> Column:
    (above, high), (below, low) = bands
    return (F.when(value > above, F.lit(high)).when(value < below, F.lit(low))
            .otherwise(F.lit("normal")))


def heart_rate_risk(avg_hr: Column) -> Column:
    return _outside(avg_hr, V.HEART_RATE_BANDS)


def oxygen_risk(avg_o2: Column, strict: bool = False) -> Column:
    """Default keeps the source's order (the wider band first, so 'critical'
    never fires); strict tests the lowest bound first."""
    out = None
    for below, name in sorted(V.OXYGEN_BANDS) if strict else V.OXYGEN_BANDS:
        out = (F.when(avg_o2 < below, F.lit(name)) if out is None
               else out.when(avg_o2 < below, F.lit(name)))
    return out.otherwise(F.lit("normal"))


def bp_risk(avg_sys: Column) -> Column:
    return _outside(avg_sys, V.PRESSURE_BANDS)


def device_health_score(critical_alerts: Column, hr_stddev: Column) -> Column:
    """clamp(100 - 5 * critical - (20 if HR stddev > 30), 0, 100); null stddev: no penalty."""
    penalty = F.when(hr_stddev > V.HEALTH_SPREAD_ABOVE, F.lit(V.HEALTH_SPREAD)).otherwise(F.lit(0))
    start = F.lit(V.HEALTH_START)
    return F.least(start, F.greatest(F.lit(0), start - critical_alerts * V.HEALTH_PER_CRITICAL - penalty))

"""Alert rules and severities as Column expressions (no UDF).

Each vital is a nullable double column; a null (or absent) reading yields no
alert. Rules run in the fixed order heart rate, SpO2, blood pressure,
temperature, glucose; the result array keeps that order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import ALERT_RULES, CRITICAL_ALERTS


def compact(items: list[Column], elem_type: str = "string") -> Column:
    """Array of the non-null items, in order.

    A concat of conditional one-element arrays is fully code-generated,
    unlike a lambda-based filter, which Spark evaluates interpreted.
    """
    empty = F.array().cast(f"array<{elem_type}>")
    return F.concat(*[F.when(x.isNotNull(), F.array(x)).otherwise(empty) for x in items])


def vital_alert(vitals: dict[str, Column], rules: list) -> Column:
    """The first alert of a vital whose bounds one of its values crosses."""
    def crossed(column: str, comparison: str, bound: float) -> Column:
        return vitals[column] > bound if comparison == ">" else vitals[column] < bound

    out = None
    for name, bounds in rules:
        hit = reduce(lambda x, y: x | y, [crossed(*b) for b in bounds])
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    used = {c for _, bounds in rules for c, _, _ in bounds}
    if len(used) > 1:  # only when all values are present
        out = F.when(reduce(lambda x, y: x & y, [vitals[c].isNotNull() for c in sorted(used)]), out)
    return out


def validate_readings(hr: Column, o2: Column, sys_bp: Column, dia_bp: Column,
                      temp: Column, glucose: Column) -> Column:
    """array<string> of alerts in rule order (empty when all normal)."""
    vitals = {"heart_rate": hr, "blood_oxygen": o2, "systolic_bp": sys_bp, "diastolic_bp": dia_bp,
              "temperature": temp, "blood_glucose": glucose}
    return compact([vital_alert(vitals, rules) for _, rules in ALERT_RULES])


def validate_readings_basic(hr: Column, o2: Column) -> Column:
    """Basic rule set: one heart-rate alert for either bound, one SpO2 alert.

    A missing key defaults to a normal value; a null value raises no alert.
    """
    hr_alert = F.when((hr > 120) | (hr < 50), F.lit("abnormal_heart_rate"))
    o2_alert = F.when(o2 < 92, F.lit("low_blood_oxygen"))
    return compact([hr_alert, o2_alert])


def alert_count(alerts: Column) -> Column:
    """Number of alerts; a missing list counts 0."""
    return F.size(F.coalesce(alerts, F.array().cast("array<string>")))


def alert_types(alerts: Column) -> Column:
    """Alerts joined by ',' ('' when none)."""
    return F.array_join(F.coalesce(alerts, F.array().cast("array<string>")), ",")


def has_critical_alert(alert_types_col: Column) -> Column:
    """Substring test on the joined alert text, null -> False."""
    hit = None
    for name in CRITICAL_ALERTS:
        c = alert_types_col.contains(name)
        hit = c if hit is None else (hit | c)
    return F.coalesce(hit, F.lit(False))


def critical_array() -> Column:
    return F.array(*[F.lit(a) for a in CRITICAL_ALERTS])


def alert_severity(alerts: Column) -> Column:
    """critical if any critical alert is present, warning if any alert, else normal."""
    a = F.coalesce(alerts, F.array().cast("array<string>"))
    return (F.when(F.coalesce(F.arrays_overlap(a, critical_array()), F.lit(False)),
                   F.lit("critical"))
            .when(F.size(a) > 0, F.lit("warning"))
            .otherwise(F.lit("normal")))


def notification_severity(alerts: Column) -> Column:
    """HIGH for more than one alert, else MEDIUM."""
    return F.when(F.size(alerts) > 1, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def notification_subject(alerts: Column) -> Column:
    from .vocab import NOTIFY_SUBJECT_PREFIX
    return F.concat(F.lit(NOTIFY_SUBJECT_PREFIX), F.array_join(alerts, ", "))

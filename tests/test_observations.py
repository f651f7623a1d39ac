"""Observation build, round trip back to wide rows, search, read, create."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from pulsegrid.operators import enrich, search
from pulsegrid.operators import observations as O
from pulsegrid.plans import queries as Q
from pulsegrid.schemas import RAW_MESSAGE
from pulsegrid.sources import files


def _enriched(spark, rows):
    full = []
    for i, r in enumerate(rows):
        row = {f.name: None for f in RAW_MESSAGE.fields}
        row.update(deviceId=f"d{i}", deviceType="bp monitor", patientId="p1",
                   timestamp="2024-01-02T03:04:05Z", readings={}, messageId=str(i))
        row.update(r)
        full.append(row)
    return enrich.enrich_messages(spark.createDataFrame(full, RAW_MESSAGE))


def test_readme_sample_document(spark):
    sample = {"heartRate": 72.0, "bloodOxygen": 98.0, "systolicBP": 120.0,
              "diastolicBP": 80.0, "temperature": 36.6, "respiratoryRate": 16.0}
    o = O.build_observations(_enriched(spark, [{"readings": sample}])).first()
    assert o["resourceType"] == "Observation" and o["status"] == "final"
    assert len(o["component"]) == 6 and o["interpretation"] is None
    assert [c["code"]["coding"][0]["code"] for c in o["component"]] == [
        "8867-4", "59408-5", "8480-6", "8462-4", "8310-5", "9279-1"]
    assert o["subject"]["reference"] == "Patient/p1"
    assert o["device"]["display"] == "bp monitor"
    assert o["device_type"] == "bp_monitor" and str(o["observation_date"]) == "2024-01-02"
    assert o["object_key"] == f"observations/bp_monitor/2024/01/02/{o['id']}.json"


def test_subject_interpretation_and_null_value(spark):
    rows = [{"patientId": "", "readings": {"heartRate": None}},
            {"patientId": None, "readings": {"heartRate": 130.0, "bloodOxygen": 85.0}}]
    o = O.build_observations(_enriched(spark, rows))
    got = {r["device"]["identifier"]["value"]: r for r in o.collect()}
    assert got["d0"]["subject"] is None and got["d1"]["subject"] is None
    assert got["d0"]["component"][0]["valueQuantity"]["value"] is None
    assert got["d1"]["interpretation"][0]["text"] == "tachycardia, hypoxemia"
    assert got["d1"]["meta_patient_id"] == "unknown"


def test_malformed_timestamp_uses_processing_date(spark):
    """In the key; the pruning column has no date then."""
    o = O.build_observations(_enriched(spark, [{"timestamp": "yesterday"}]))
    r = o.select("observation_date", "object_key",
                 F.date_format(F.current_date(), "yyyy/MM/dd").alias("today")).first()
    assert r["observation_date"] is None and f"/{r['today']}/" in r["object_key"]


def test_ids_are_deterministic(spark):
    e = _enriched(spark, [{"readings": {"heartRate": 80.0}}])
    a = O.build_observations(e).first()["id"]
    b = O.build_observations(e).first()["id"]
    assert a == b and len(a) == 64


def test_round_trip_to_wide_rows(spark, sf_small):
    obs = Q.observations(spark, sf_small)
    wide = O.observations_wide(obs)
    grouped = O.observations_wide(obs, mode="grouped")
    flat = Q.readings(spark, sf_small)
    cols = ["heart_rate", "blood_oxygen", "systolic_bp", "diastolic_bp", "temperature",
            "blood_glucose", "respiratory_rate"]
    a = flat.select(F.col("device_id"), F.col("ts").alias("effective_timestamp"), *cols)
    b = wide.select("device_id", "effective_timestamp", *cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert grouped.exceptAll(wide).count() == 0 and wide.exceptAll(grouped).count() == 0


def test_first_component_wins_on_repeated_code(spark):
    o = O.build_observations(_enriched(spark, [{"readings": {"heartRate": 80.0}}]))
    comp = F.col("component")
    dup = o.withColumn("component", F.concat(comp, F.transform(
        comp, lambda c: c.withField("valueQuantity.value", F.lit(99.0)))))
    assert O.observations_wide(dup).first()["heart_rate"] == 80.0
    assert O.observations_wide(dup, mode="grouped").first()["heart_rate"] == 80.0


def _docs(spark):
    rows = [{"patientId": "12", "timestamp": "2024-01-05T00:00:00Z"},
            {"patientId": "3", "timestamp": "2024-01-06T00:00:00Z"},
            {"patientId": None, "timestamp": "2024-01-07T00:00:00Z"}]
    docs = O.build_observations(_enriched(spark, rows))
    # a stored document without effectiveDateTime (patient 3)
    return docs.withColumn("effectiveDateTime", F.when(
        F.col("subject.reference") == "Patient/3", F.lit(None).cast("string"))
        .otherwise(F.col("effectiveDateTime")))


def test_search_date_bounds_and_missing_date(spark):
    docs = _docs(spark)
    to_only = search.search_observations(docs, date_to="2024-01-06")
    assert to_only.count() == 2  # the row without a date is kept
    from_only = search.search_observations(docs, date_from="2024-01-01")
    assert from_only.count() == 2  # ... and dropped by a lower bound


def test_search_patient_substring_and_strict(spark):
    docs = _docs(spark)
    assert search.search_observations(docs, patient="1").count() == 1  # Patient/12
    assert search.search_observations(docs, patient="1", strict=True).count() == 0
    assert search.search_observations(docs, patient="").count() == 3  # empty = no filter


def test_search_count_zero_and_limit(spark):
    docs = _docs(spark)
    assert search.search_observations(docs, count=0).count() == 0
    assert search.search_observations(docs, count="2").count() == 2


def test_bundle(spark):
    b = search.bundle(search.search_observations(_docs(spark), count=2)).first()
    assert b["type"] == "searchset" and b["total"] == 2
    assert all(e["fullUrl"].startswith("urn:uuid:") for e in b["entry"])


def test_read_by_id_not_found(spark):
    docs = _docs(spark)
    some = docs.first()["id"]
    req = spark.createDataFrame([(some,), ("nope",)], "requested_id string")
    got = {r["requested_id"]: r for r in search.read_by_id(docs, req, "Observation").collect()}
    assert got[some]["found"] and got[some]["outcome_code"] is None
    assert not got["nope"]["found"]
    assert got["nope"]["outcome_diagnostics"] == "Observation/nope not found"


def test_create_fills_id(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y")], "id string, resourceType string")
    out = search.create_resources(df, "Observation").collect()
    assert {r["resourceType"] for r in out} == {"Observation"}
    assert out[0]["id"] == "a" and len(out[1]["id"]) == 36


def test_patient_search_params(spark, sf_small):
    from pulsegrid.sources import testdata
    p = testdata.load_patients(spark, sf_small)
    assert search.search_patients(p, "").count() == p.count()
    hits = search.search_patients(p, "gender=male&age=32").collect()
    assert all(r["gender"] == "male" and r["age"] == 32 for r in hits)


def test_multiline_documents_in_nested_folders(spark):
    """Indented one-document files under type/yyyy/MM/dd, as the converter writes."""
    docs = O.observation_json(_docs(spark)).collect()
    root = tempfile.mkdtemp(prefix="pg-obs-")
    for d in docs:
        path = os.path.join(root, d["object_key"])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as fh:
            fh.write(json.dumps(json.loads(d["document"]), indent=2))
    with open(os.path.join(root, "observations", "broken.json"), "w") as fh:
        fh.write("{ not json")
    raw = files.read_observations(spark, os.path.join(root, "observations"), multiline=True)
    assert files.corrupt_rows(raw).count() == 1
    back = files.valid_rows(raw)
    assert back.count() == len(docs)
    assert {r["id"] for r in back.collect()} == {d["id"] for d in docs}
    wide = O.observations_wide(back)
    assert wide.where(F.col("patient_reference") == "Patient/12").count() == 1


def test_missing_landing_area_is_empty(spark):
    df = files.read_device_messages(spark, "/nonexistent/pulsegrid/landing", missing_ok=True)
    assert df.count() == 0 and "readings" in df.columns


def test_resource_dispatch(spark):
    docs = _docs(spark)
    req = spark.createDataFrame([(docs.first()["id"],)], "requested_id string")
    ok = search.read_resources({"Observation": docs}, "Observation", req).first()
    assert ok["found"]
    bad = search.read_resources({"Observation": docs}, "Device", req).first()
    assert not bad["found"] and bad["outcome_code"] == "not-supported"


def test_device_type_defaults_per_place(spark):
    """D20: the processor defaults a missing type to 'unknown'; a converter
    given no type displays 'Unknown Device' and files it under 'unknown'."""
    raw = spark.createDataFrame([("d1", None, "p", "2024-01-02T00:00:00Z", {}, "1")],
                                "deviceId string, deviceType string, patientId string, "
                                "timestamp string, readings map<string,double>, messageId string")
    direct = O.build_observations(raw).first()
    assert direct["device"]["display"] == "Unknown Device"
    assert direct["device_type"] == "unknown"
    enriched = O.build_observations(enrich.enrich_messages(raw)).first()
    assert enriched["device"]["display"] == "unknown"

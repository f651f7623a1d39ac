"""Catalog refresh: schema drift, new files and partitions, repeated runs."""

import json

import pytest
from pyspark.sql import types as T

from pulsegrid.sources import catalog


@pytest.fixture
def db(spark):
    name = catalog.create_database(spark)
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def put(folder, name, *docs):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps(d) + "\n" for d in docs))


def test_merge_rules(spark):
    parse = T._parse_datatype_string
    old = parse("struct<a:bigint,b:string,c:struct<x:int>,d:array<int>,e:boolean,f:int,g:string>")
    new = parse("struct<b:struct<y:int>,a:double,c:struct<x:bigint,z:string>,d:array<double>,e:bigint,f:float,h:date>")
    changes = []
    merged = catalog.merge_schemas(old, new, changes)
    assert merged.simpleString() == ("struct<a:double,b:string,c:struct<x:bigint,z:string>,d:array<double>,"
                                     "e:string,f:double,g:string,h:date>")
    assert changes == [("a", "widened", "bigint", "double"), ("b", "conflict", "string", "struct<y:int>"),
                       ("c.x", "widened", "int", "bigint"), ("c.z", "added", None, "string"),
                       ("d[]", "widened", "int", "double"), ("e", "widened", "boolean", "string"),
                       ("f", "widened", "int", "double"), ("h", "added", None, "date")]
    again = []
    assert catalog.merge_schemas(merged, merged, again) == merged and not again
    # a narrower file changes nothing
    assert catalog.merge_schemas(parse("struct<a:double>"), parse("struct<a:bigint>"), again) and not again


def test_raw_area(spark, db, tmp_path):
    area, logs = tmp_path / "raw", str(tmp_path / "logs")
    put(area / "wearables" / "w1", "1.json", {"deviceId": "a", "readings": {"hr": 70}, "note": None})
    run = lambda: catalog.refresh(spark, db, "raw", str(area), logs)
    assert run() == []
    assert spark.table(f"{db}.raw").columns == ["deviceId", "readings"]
    assert run() == []  # nothing new
    put(area / "home" / "h1", "2.json", {"deviceId": "b", "readings": {"hr": 70.5, "spo2": 95}, "note": "x"})
    assert run() == [("readings.hr", "widened", "bigint", "double"), ("readings.spo2", "added", None, "bigint"),
                     ("note", "added", None, "string")]
    got = spark.sql(f"SELECT deviceId, readings.hr, readings.spo2, note FROM {db}.raw ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [("a", 70.0, None, None), ("b", 70.5, 95, "x")]
    put(area / "home" / "h1", "3.json", {"deviceId": {"id": 7}})
    assert run() == [("deviceId", "conflict", "string", "struct<id:bigint>")]
    assert spark.table(f"{db}.raw").where("deviceId like '%7%'").count() == 1  # kept as text
    kinds = [r.change for r in catalog.drift(spark, logs, "raw").orderBy("run", "column_name").collect()]
    assert kinds == ["added", "widened", "added", "conflict"]


def test_partitions_appear(spark, db, tmp_path):
    area, logs = tmp_path / "fhir", str(tmp_path / "logs")
    run = lambda: catalog.refresh(spark, db, "docs", str(area), logs, partitions=["kind", "day"])
    put(area / "kind=a" / "day=2024-01-01", "1.json", {"id": "1"})
    run()
    put(area / "kind=b" / "day=2024-01-02", "1.json", {"id": "2", "extra": 1})
    assert run() == [("extra", "added", None, "bigint")]
    put(area / "kind=b" / "day=2024-01-03", "1.json", {"id": "3"})
    assert run() == []
    rows = spark.sql(f"SELECT id, extra, kind, cast(day AS string) AS day FROM {db}.docs ORDER BY id").collect()
    assert [tuple(r) for r in rows] == [("1", None, "a", "2024-01-01"), ("2", 1, "b", "2024-01-02"),
                                        ("3", None, "b", "2024-01-03")]


def test_parquet_area(spark, db, tmp_path):
    area, logs = str(tmp_path / "p"), str(tmp_path / "logs")
    spark.range(3).write.parquet(f"{area}/one")
    catalog.refresh(spark, db, "p", area, logs, fmt="parquet")
    spark.range(2).selectExpr("id", "'x' AS label").write.parquet(f"{area}/two")
    assert catalog.refresh(spark, db, "p", area, logs, fmt="parquet") == [("label", "added", None, "string")]
    assert spark.sql(f"SELECT count(*), count(label) FROM {db}.p").first()[:] == (5, 2)


def test_a_stopped_refresh_is_repeated(spark, db, tmp_path, monkeypatch):
    area, logs = tmp_path / "raw", str(tmp_path / "logs")
    put(area, "1.json", {"a": 1})
    catalog.refresh(spark, db, "t", str(area), logs)
    put(area, "2.json", {"a": 1, "b": 2})
    real = catalog._register
    monkeypatch.setattr(catalog, "_register", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        catalog.refresh(spark, db, "t", str(area), logs)
    monkeypatch.setattr(catalog, "_register", real)
    assert catalog.refresh(spark, db, "t", str(area), logs) == [("b", "added", None, "bigint")]
    assert spark.table(f"{db}.t").count() == 2
    assert catalog.drift(spark, logs, "t").count() == 1

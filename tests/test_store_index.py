"""Store index: pages in key order, files that hold an id, device history of bronze."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import search as Q
from pulsegrid.sinks.storeindex import StoreIndex
from pulsegrid.streaming import bronze
from pulsegrid.streaming import pipeline as P


def small_store(spark, path, ids, files, mode="append"):
    rows = spark.createDataFrame([(f"k{i:04d}" if i % 50 else None, f"id{i}", i % 7) for i in ids],
                                 "object_key string, id string, v int")
    rows.repartitionByRange(files, "object_key").sortWithinPartitions("object_key").write.mode(mode).parquet(path)


@pytest.fixture
def index(spark, tmp_path):
    return StoreIndex(spark, str(tmp_path / "store"), str(tmp_path / "index"),
                      {"object_key": F.col("object_key"), "v": F.col("v")}, id_col="id", key="object_key", buckets=4)


def plain(spark, path, count, where):
    return [r.id for r in spark.read.parquet(path).where(where).orderBy(
        F.col("object_key").asc_nulls_last(), F.col("id").asc_nulls_last()).limit(count).collect()]


def test_pages_equal_a_sort_and_read_few_files(spark, index):
    small_store(spark, index.store, range(400), 20)
    assert index.refresh() == 20
    for count, where in ((5, F.lit(True)), (40, F.col("v") == 3), (100, F.col("v") == 3), (1000, F.lit(True)),
                         (3, F.col("id") == "id399"), (3, F.col("id") == "nothing")):
        rows, files = index.page(count, where)
        assert [r.id for r in rows.collect()] == plain(spark, index.store, count, where)
        assert files <= 20
    assert index.page(5)[1] == 4
    assert index.page(3, F.col("v") == 9, index.may_hold(equal={"v": 9}))[1] == 0


def test_overlapping_files_and_ties(spark, index):
    for k in range(3):  # every file spans the same keys
        small_store(spark, index.store, range(k, 300, 3), 5)
    small_store(spark, index.store, range(0, 30), 1)
    index.refresh()
    for count in (1, 10, 64, 400):
        assert [r.id for r in index.page(count)[0].collect()] == plain(spark, index.store, count, F.lit(True))


def test_only_files_that_hold_an_id_are_opened(spark, index):
    small_store(spark, index.store, range(400), 20)
    index.refresh()
    asked = spark.createDataFrame([("id7",), ("id399",), ("gone",), (None,), ("id7",)], "requested_id string")
    paths = index.holding(asked, "requested_id")
    assert len(paths) == 2
    assert {r.id for r in index.read(paths).join(asked, F.col("id") == F.col("requested_id"), "left_semi").collect()} == {
        "id7", "id399"}
    rows, files = Q.read_located(index, asked, "Thing")
    got = sorted((r.requested_id or "", r.found) for r in rows.collect())
    assert got == [("", False), ("gone", False), ("id399", True), ("id7", True), ("id7", True)] and files == 2
    none, files = Q.read_located(index, asked.where("requested_id = 'gone'"), "Thing")
    assert [(r.found, r.outcome_code) for r in none.collect()] == [(False, "not-found")] and files == 0


def test_refresh_follows_new_and_lost_files(spark, index):
    import pathlib
    small_store(spark, index.store, range(100), 4)
    assert index.refresh() == 4
    assert index.refresh() == 0
    small_store(spark, index.store, range(100, 200), 4)
    index.log.begin("index")  # a refresh that died
    assert index.refresh() == 4
    assert [r.id for r in index.page(500)[0].collect()] == plain(spark, index.store, 500, F.lit(True))
    lost = sorted(pathlib.Path(index.store).glob("*.parquet"))[0]
    lost.unlink()
    assert index.refresh() == 0
    assert index.files().count() == 7
    assert [r.id for r in index.page(500)[0].collect()] == plain(spark, index.store, 500, F.lit(True))


def test_an_empty_index_says_so(spark, index):
    with pytest.raises(ValueError, match="refresh"):
        index.page(1)


def test_clustered_bronze(spark, tmp_path):
    landing = tmp_path / "in" / "wearables" / "fleet"
    landing.mkdir(parents=True)
    paths = P.StreamPaths(str(tmp_path / "in"), str(tmp_path / "out"))
    index = bronze.device_index(spark, paths)
    sent = 0
    for part in range(2):
        lines = [f'{{"deviceId": "d{i % 40:02d}", "messageId": "{part}-{i}"}}\n' for i in range(400)]
        lines += ['{"deviceId": "d00", "messageId": "hot"}\n'] * 200 + ["broken\n"]
        (landing / f"{part}.json").write_text("".join(lines))
        P.run_to_completion(P.start_bronze(P.raw_stream(spark, paths.landing), paths))
        sent += bronze.cluster(spark, paths, rows_per_file=50)
        assert bronze.cluster(spark, paths) == 0
        index.refresh()
    assert sent == 1202
    rows, files = bronze.device_history(index, "d07")
    assert rows.count() == 20 and files <= 4 < index.files().count()
    assert bronze.device_history(index, "d00")[0].count() == 420  # a hot device spans several files
    assert bronze.device_history(index, "fleet")[0].select("raw").distinct().collect()[0].raw == "broken"
    assert bronze.device_history(index, "zzz")[1] == 0

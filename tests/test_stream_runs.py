"""Streams over several runs: parse once, re-sent messages, replay of the quarantine."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import replay
from pulsegrid.streaming import pipeline as P

DAY = datetime(2024, 3, 1, tzinfo=timezone.utc)


def body(n, device="w1", **extra):
    return {"deviceId": device, "deviceType": "smartwatch", "timestamp": f"2024-01-01T00:00:{n % 60:02d}Z",
            "readings": {"heartRate": 60 + n}, "messageId": str(n), **extra}


def land(tmp_path, name, lines, channel="wearables"):
    d = tmp_path / "in" / channel / "w1"
    d.mkdir(parents=True, exist_ok=True)
    (d / f"{name}.json").write_text("".join(x if isinstance(x, str) else json.dumps(x) + "\n" for x in lines))


@pytest.fixture
def paths(tmp_path):
    (tmp_path / "in").mkdir()
    return P.StreamPaths(str(tmp_path / "in"), str(tmp_path / "out"))


def store(spark, paths):
    P.run_ingest(spark, paths.landing, paths)
    P.run_to_completion(P.start_observations(P.enriched_source(spark, paths), paths))
    return sorted(r.n for r in spark.read.parquet(paths.sink("observations")).groupBy("id").agg(
        F.count("*").alias("n")).collect())


def test_a_message_sent_again_is_stored_once(spark, paths, tmp_path):
    undated = body(3, timestamp="no time")
    land(tmp_path, "a", [body(1), body(1), body(2), undated])
    assert store(spark, paths) == [1, 1, 1]
    # again, with one that is late by a year and one of another day
    land(tmp_path, "b", [body(1), undated, body(4, timestamp="2023-01-01T00:00:00Z"), body(5)])
    assert store(spark, paths) == [1] * 5


def test_a_batch_that_is_tried_again_stores_its_rows(spark, paths, tmp_path):
    """The rows of a batch's own first try are no reason to leave them out."""
    land(tmp_path, "a", [body(1), body(2)])
    P.run_ingest(spark, paths.landing, paths)
    from pulsegrid.operators import observations as O
    obs = O.build_observations(spark.read.parquet(paths.sink("enriched")))
    target = paths.sink("observations")
    for _ in range(2):
        rows = P.not_stored(obs, target, 0)
        assert rows.count() == 2
        rows.write.mode("overwrite").partitionBy(*P.OBSERVATION_PARTITIONS).parquet(f"{target}/batch=0")
    assert P.not_stored(obs, target, 1).count() == 0


def test_bronze_holds_the_parsed_message(spark, paths, tmp_path):
    land(tmp_path, "a", [body(1, metadata={"a": "b"}), "{broken\n", body(2, topic="other/topic/x")])
    P.run_ingest(spark, paths.landing, paths)
    b = {r.raw[:8]: r for r in spark.read.parquet(paths.sink("bronze")).collect() if not r.parsed}
    assert list(b) == ["{broken"] and b["{broken"].message is None
    plan = P.bronze_source(spark, paths)._jdf.queryExecution().analyzed().toString()
    assert "from_json" not in plan.lower() and "jsontostructs" not in plan.lower()
    rows = spark.read.parquet(paths.sink("enriched")).collect()
    assert [(r.messageId, r.topic, r.metadata) for r in rows] == [("1", "iomt/wearables/w1", {"a": "b"})]
    bad = {r.reason: (r.raw, r.topic) for r in spark.read.parquet(paths.sink("quarantine")).collect()}
    assert bad["unparseable"] == ("{broken", "iomt/wearables/w1")
    assert bad["unsubscribed"][1] == "other/topic/x"


def states(spark, paths):
    return {r.raw or r.key[:4]: (r.state, r.tries, r.copies) for r in replay.ledger(spark, paths).collect()}


def test_replay_outcomes(spark, paths, tmp_path):
    land(tmp_path, "a", [body(1), "{broken\n", "{broken\n"])
    land(tmp_path, "h", [body(2, "h1")], "home-health")
    P.run_ingest(spark, paths.landing, paths, filters=["iomt/wearables/+"])
    text = json.dumps(body(2, "h1"))
    assert replay.ledger(spark, paths).isEmpty()
    replay.replay(spark, paths, DAY, filters=["iomt/wearables/+"])
    assert states(spark, paths) == {"{broken": ("open", 1, 2), text: ("open", 1, 1)}
    replay.replay(spark, paths, DAY + timedelta(days=1))
    assert states(spark, paths) == {"{broken": ("open", 2, 2), text: ("released", 2, 1)}
    replay.replay(spark, paths, DAY + timedelta(days=2))
    assert states(spark, paths) == {"{broken": ("set aside", 3, 2), text: ("released", 2, 1)}
    kept = replay.ledger(spark, paths).where("state = 'set aside'").first()
    assert kept.expires_at - kept.last_tried == timedelta(days=14)
    replay.replay(spark, paths, DAY + timedelta(days=15))
    assert states(spark, paths)["{broken"] == ("set aside", 3, 2)
    replay.replay(spark, paths, DAY + timedelta(days=17))
    gone = replay.ledger(spark, paths).where("state = 'expired'").first()
    assert gone.raw is None and gone.tries == 3
    replay.replay(spark, paths, DAY + timedelta(days=18))
    assert replay.ledger(spark, paths).where("state = 'expired' AND raw IS NULL").count() == 1
    # what was released comes in once, with its channel
    for _ in range(2):
        P.run_ingest(spark, paths.landing, paths)
    rows = spark.read.parquet(paths.sink("enriched")).collect()
    assert sorted((r.messageId, r.channel) for r in rows) == [("1", "wearables"), ("2", "home-health")]


def test_a_stopped_replay_is_repeated_under_its_number(spark, paths, tmp_path, monkeypatch):
    land(tmp_path, "h", [body(2, "h1")], "home-health")
    P.run_ingest(spark, paths.landing, paths, filters=["iomt/wearables/+"])
    real = replay._give_back
    monkeypatch.setattr(replay, "_give_back", lambda *a: real(*a) or (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        replay.replay(spark, paths, DAY)
    assert replay.ledger(spark, paths).isEmpty()
    monkeypatch.undo()
    assert replay.replay(spark, paths, DAY + timedelta(days=9)) == "00000001"
    assert [(r.state, r.tries, r.last_tried.replace(tzinfo=timezone.utc).day) for r in replay.ledger(spark, paths).collect()] == [
        ("released", 1, 1)]
    P.run_ingest(spark, paths.landing, paths)
    assert [r.messageId for r in spark.read.parquet(paths.sink("enriched")).collect()] == ["2"]


def test_replay_without_a_quarantine(spark, paths):
    assert replay.replay(spark, paths, DAY) == "00000001"
    assert replay.ledger(spark, paths).isEmpty()


def test_hourly_batches_grow_with_the_cluster_not_with_the_files(spark, tmp_path):
    from pulsegrid.plans import queries
    paths = P.StreamPaths("", str(tmp_path))
    cores = spark.sparkContext.defaultParallelism
    for files, want in ((3, 1), (8, 2), (20 * cores, cores)):
        spark.range(files).repartition(files, "id").write.mode("overwrite").option("maxRecordsPerFile", 1).parquet(
            paths.sink("enriched"))
        assert queries._files_a_batch(spark, paths) == want

"""Topic filters, value formatting, compaction, streaming windows = batch."""

from pyspark.sql import functions as F

from pulsegrid.functions.scoring import value_text
from pulsegrid.sources import topics


def test_topic_filters(spark):
    df = spark.createDataFrame(
        [("iomt/wearables/d1",), ("iomt/home-health/d2",), ("iomt/wearables/d1/x",),
         ("iomt/wearablesX/d1",), ("other/wearables/d1",), (None,)], "topic string")
    got = [r["topic"] for r in topics.subscribe(df).collect()]
    assert got == ["iomt/wearables/d1", "iomt/home-health/d2"]
    multi = topics.subscribe(df, ["iomt/#"]).count()
    assert multi == 4
    r = topics.subscribe(df).orderBy("topic").first()
    assert r["channel"] == "home-health" and r["topic_device"] == "d2"


def test_fan_in_keeps_all_columns(spark):
    a = spark.createDataFrame([("x", 1)], "topic string, a int")
    b = spark.createDataFrame([("y", 2.0)], "topic string, b double")
    out = topics.fan_in(a, b)
    assert out.count() == 2 and set(out.columns) == {"topic", "a", "b"}


def test_value_text(spark):
    df = spark.createDataFrame([(72.0,), (36.6,), (36.300000000000004,), (-5.0,)], "v double")
    got = [r[0] for r in df.select(value_text(F.col("v"))).collect()]
    assert got == ["72", "36.6", "36.300000000000004", "-5"]


def test_compaction_reduces_files(spark, tmp_path):
    from pulsegrid.sinks.tables import compact
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.range(0, 2000, 1, 40).withColumn("p", F.col("id") % 2) \
        .write.partitionBy("p").parquet(src)
    n = compact(spark, src, dst, ["p"])
    assert n == 2000
    import glob
    before = len(glob.glob(src + "/p=*/*.parquet"))
    after = len(glob.glob(dst + "/p=*/*.parquet"))
    assert after < before
    assert spark.read.parquet(dst).count() == 2000


def test_stream_hourly_equals_batch(spark, sf_small):
    from pulsegrid.operators import gold
    from pulsegrid.plans import queries as Q
    from pulsegrid.session import scratch_path
    from pulsegrid.sources import testdata
    from pulsegrid.streaming import pipeline as P
    msgs = testdata.load_messages(spark, sf_small).where("event_id % 97 <> 0")
    landing = testdata.write_message_files(msgs, scratch_path(spark, "t_hourly"),
                                           corrupt_every=0)
    paths = P.run_ingest(spark, landing, bronze=False, quarantine=False)
    P.run_to_completion(P.start_hourly(P.enriched_source(spark, paths), paths))
    # later files with older times, and a row without a time, still count
    late = testdata.load_messages(spark, sf_small).where("event_id % 97 = 0").withColumn(
        "timestamp", F.when(F.col("event_id") > 0, F.col("timestamp")).otherwise("no time"))
    testdata.write_message_files(late, f"{landing}/late", corrupt_every=0)
    P.run_to_completion(P.start_enriched(P.raw_stream(spark, landing), paths))
    P.run_to_completion(P.start_hourly(P.enriched_source(spark, paths), paths))
    s = P.hourly_trends(spark, paths)
    assert s.agg(F.sum("reading_count")).first()[0] == testdata.load_messages(spark, sf_small).count()
    s = s.select("date", "hour", "device_type", "reading_count", "total_alerts")
    b = gold.hourly_trends(Q.readings(spark, sf_small).withColumn(
        "ts", F.when((F.col("event_id") % 97 != 0) | (F.col("event_id") > 0), F.col("ts"))).withColumns(
        {"date": F.to_date("ts"), "hour": F.hour("ts")})).select(
        "date", "hour", "device_type", "reading_count", "total_alerts")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_schemas_of_outputs(spark, sf_small):
    from pulsegrid import schemas
    from pulsegrid.operators import anomaly
    from pulsegrid.sinks.tables import quarantine_rows
    from pulsegrid.sources import testdata
    def same(a, b):  # names and types; nullability may differ (literals are non-null)
        return a.simpleString() == b.simpleString()
    assert same(testdata.load_patients(spark, sf_small).schema, schemas.PATIENT)
    scored = anomaly.score_readings(testdata.load_messages(spark, sf_small))
    assert same(scored.schema["anomalies"].dataType.elementType, schemas.ANOMALY)
    q = quarantine_rows(spark.createDataFrame([("{x",)], "_corrupt_record string"), "bad")
    assert same(q.schema, schemas.QUARANTINE)


def test_alert_vocabulary_is_closed(spark, sf_small):
    from pulsegrid.functions.vocab import ALERT_NAMES, BASIC_ALERT_NAMES
    from pulsegrid.plans import queries as Q
    full = {r[0] for r in Q.readings(spark, sf_small).select(F.explode("alerts")).collect()}
    basic = {r[0] for r in Q.readings(spark, sf_small, rules="basic")
             .select(F.explode("alerts")).collect()}
    assert full <= set(ALERT_NAMES) and basic <= set(BASIC_ALERT_NAMES) and full


def test_batch_alert_and_metric_writers(spark, sf_small, tmp_path):
    from pulsegrid.operators import anomaly, enrich
    from pulsegrid.plans import queries as Q
    from pulsegrid.sinks.tables import write_alerts, write_metrics
    from pulsegrid.sources import testdata
    n = write_alerts(enrich.notifications(Q.readings(spark, sf_small)), str(tmp_path / "a"))
    assert n == Q.readings(spark, sf_small).where("alert_count > 0").count()
    scored = anomaly.score_readings(testdata.load_messages(spark, sf_small))
    m = write_metrics(anomaly.anomaly_metric_rows(scored, "messageId"), str(tmp_path / "m"))
    assert m == 2 * scored.count()
    s = enrich.message_summary(enrich.enrich_messages(testdata.load_messages(spark, sf_small)))
    assert s.columns == ["deviceId", "alerts", "alertSeverity", "messageId"]


def test_messages_of_some_events(spark, sf_small):
    """The condition is applied to the table, below the mapping; the rows are the same."""
    from pulsegrid.sources import testdata
    some = testdata.load_messages(spark, sf_small, "event_id % 3 = 1")
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Filter")
    text = lambda df: sorted(r.value for r in testdata.message_lines(df, 0).collect())
    assert text(some) == text(testdata.load_messages(spark, sf_small).where("event_id % 3 = 1")) != []

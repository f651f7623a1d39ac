"""Documents are dealt and sorted as messages, and built where they are written."""

from pyspark.sql import functions as F

from pulsegrid.operators import observations as O
from pulsegrid.plans import queries as Q
from pulsegrid.sinks import tables


def exchanged(df):
    """Columns of every shuffle of the plan."""
    out, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() in ("RebalancePartitions", "Sort"):
            out.append({node.output().apply(i).name() for i in range(node.output().size())})
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_store_is_the_same_and_shuffles_messages(spark, sf_small, tmp_path, monkeypatch):
    plans = []
    write = tables.write_table
    monkeypatch.setattr(tables, "write_table", lambda df, *a, **k: plans.append(df) or write(df, *a, **k))
    obs = Q.observations(spark, sf_small)
    n = tables.write_messages_as_observations(Q.enriched(spark, sf_small), str(tmp_path / "new"), keep=("event_id",))
    moved = exchanged(plans[0])
    assert moved and all(not c & {"component", "object_key", "identifier"} for c in moved)
    tables.write_observations(obs, str(tmp_path / "old"))
    new, old = (spark.read.parquet(str(tmp_path / p)) for p in ("new", "old"))
    assert n == obs.count() == new.count() and dict(new.dtypes) == dict(old.dtypes)
    plain = [c for c in old.columns if c not in ("meta", "issued")]  # hold the time of the run
    assert new.select(plain).exceptAll(old.select(plain)).isEmpty()
    files = new.select("id", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    pairs = files.alias("a").join(files.alias("b"), (F.col("a.f") == F.col("b.f")) & (F.col("b.i") == F.col("a.i") + 1))
    assert pairs.where("a.id > b.id").isEmpty()


def test_keyed_messages_give_the_same_documents(spark, sf_small):
    e = Q.enriched(spark, sf_small).withColumn("timestamp", F.when(F.col("event_id") % 9 > 0, F.col("timestamp")))
    cols = [c for c in O.build_observations(e).columns if c not in ("meta", "issued")]
    a = O.build_observations(e).select(cols)
    b = O.build_observations(O.keyed_messages(e)).select(cols)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_compressed_export(spark, sf_small, tmp_path):
    from pulsegrid.sources import files
    obs = Q.observations(spark, sf_small)
    tables.export_documents(obs, str(tmp_path / "a"))
    tables.export_documents(obs, str(tmp_path / "b"), compression="gzip")
    size = lambda p: sum(f.stat().st_size for f in (tmp_path / p).rglob("part-*"))
    assert size("b") * 4 < size("a")
    back = files.read_observations(spark, str(tmp_path / "b"))
    assert back.where(F.col(files.CORRUPT).isNull()).count() == obs.count()
    assert back.select("id").exceptAll(obs.select("id")).isEmpty()

"""Files, streams and models end to end in a temporary folder."""

import datetime

import pytest
from pyspark.sql import functions as F

from talasik.operators import models
from talasik.sources import files
from talasik.streaming import jobs


def test_csv_with_mark_and_line_ends(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("﻿Date,Location/Purok,Narrative,narration\n2026-01-02,Purok 4,\"two\nlines, \"\"quoted\"\"\",\n,,,last\n".encode())
    df = files.canonical_headers(files.read_csv(spark, str(path)))
    assert df.columns == ["incident_date", "location_purok", "narrative_summary"]
    assert [r.narrative_summary for r in df.collect()] == ['two\nlines, "quoted"', "last"]


def test_append_and_dimension(spark, tmp_path):
    rows = files.audit_rows(spark, [(1, "u", "Encoder", "login", None, None, "success", "10.0.0.1")])
    files.append(rows, str(tmp_path / "audit"))
    files.append(rows, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    with pytest.raises(Exception):
        files.audit_rows(spark, [(1, "u", "r", "a", None, None, "maybe", "")]).collect()
    assert files.read_dimension(spark, str(tmp_path / "none.json")) == {}
    shape = {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}
    assert files.rings(shape) == [[(0, 0), (1, 0), (1, 1)]]


def test_training_rows(spark):
    df = spark.createDataFrame([("yes", "n", "t"), ("NO", "n", "t"), (None, " \t", "t"), (None, "n", "t")], "include_in_ml string, narrative_summary string, incident_type string")
    assert files.training_rows(df).count() == 2


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", start), ("a", start + datetime.timedelta(seconds=5)), ("b", start), ("a", start + datetime.timedelta(minutes=5))]
    spark.createDataFrame(rows, "k string, ts timestamp").repartition(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema("k string, ts timestamp").parquet(str(source))
    for name, df, mode, n in (("replay", jobs.without_replays(stream(), ["k"], "ts"), "append", 3), ("trend", jobs.trend(stream(), "ts"), "complete", 1)):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert spark.table(name).count() == n
    for run in range(2):
        query = jobs.import_new(stream(), "k", str(tmp_path / "table"), str(tmp_path / f"ckpt{run}"))
        query.awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "table")).collect()) == ["a", "b"]


def test_models(spark, tmp_path):
    rows = [(i, f"{'videoke music loud night' if i % 2 else 'stolen bicycle market'} {i % 7}", "Noise" if i % 2 else "Theft", "2024-01-05", "22:10", "Purok 4") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t string, y string, incident_date string, incident_time string, location_purok string")
    folds = models.folds(df, "id", "y", 4)
    best, table = models.train_and_compare(folds.filter("fold_no > 0"), folds.filter("fold_no = 0"), "t", "y", ("naive_bayes", "logistic"))
    assert table.count() == 2 and table.agg(F.max("macro_f1")).first()[0] == 1.0
    models.save(best, str(tmp_path / "m"))
    assert models.load(str(tmp_path / "m")) is not None and models.load(str(tmp_path / "none")) is None


def test_replays_across_slot_edges_and_batches(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    batches = [[("a", at(59)), ("a", at(60)), ("b", at(0)), ("a", at(400))], [("a", at(430)), ("a", at(115)), ("b", at(61))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, ts timestamp").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
        query = jobs.without_replays(stream, ["k"], "ts").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.k, r.s) for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("k", "unix_seconds(ts) - unix_seconds(timestamp'2024-01-01') AS s").collect())
    assert got == [("a", 59), ("a", 400), ("b", 0), ("b", 61)]

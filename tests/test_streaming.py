"""Streams give what the batch operators give."""

from mimiq.operators import identity, signal
from mimiq.streaming import stateful


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def write_in_files(spark, rows, schema, path, key):
    for k in sorted({r[key] for r in rows}):
        spark.createDataFrame([r for r in rows if r[key] == k], schema).coalesce(1).write.mode("append").parquet(path)


def test_smoothing_and_identities_on_streams(spark, tmp_path):
    rows = [("v", k, float(k), 0.0, float(k) + 10, 10.0, [1.0, 0.1 * (k % 2)] if k < 4 else [0.0, 1.0]) for k in range(6)]
    schema = "input string, frame long, left double, top double, right double, bottom double, v array<double>"
    path = str(tmp_path / "in")
    write_in_files(spark, rows, schema, path, 1)
    whole = spark.createDataFrame(rows, schema)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 100).parquet(path)
    got = run(spark, stateful.smoothed_boxes(stream.drop("v"), 0.5), "boxes").orderBy("frame").collect()
    assert got == signal.smooth_box_table(whole.drop("v"), 0.5).orderBy("frame").collect()
    named = run(spark, stateful.running_identities(stream, 0.8), "people").orderBy("frame").collect()
    batch = {r["id"]: r["Identity"] for r in identity.cluster_identities(whole.withColumnRenamed("frame", "id"), 0.8).collect()}
    assert {r["frame"]: r["Identity"] for r in named} == batch


def test_windows_of_event_time(spark, tmp_path):
    df = spark.sql("SELECT timestamp_seconds(id * 20) AS ts, 'a' AS s, double(id) AS value FROM range(12)")
    path = str(tmp_path / "ev")
    df.write.parquet(path)
    out = stateful.windowed_summary(spark.read.parquet(path), "value", "s").orderBy("start").collect()
    assert [r["n"] for r in out] == [3, 3, 3, 3] and out[0]["mean"] == 1.0
    assert stateful.session_activity(spark.read.parquet(path), "s").first()["n"] == 12

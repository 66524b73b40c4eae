"""Settings, thresholds, phases and progress: rules at their edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from canoply.functions import phases, settings, thresholds
from canoply.streaming import progress


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_parse_takes_the_first_colon_and_the_last_line(spark):
    lines = spark.createDataFrame([(1, "a:1"), (2, "a:2:3"), (3, ":x"), (4, "none"), (5, "b:")], "line_no long, value string")
    assert {(r.key, r.value) for r in settings.parse(lines).collect()} == {("a", "2:3"), ("", "x"), ("none\nb", "")}


def test_parse_ends_at_a_field_that_is_too_long(spark):
    lines = spark.createDataFrame([(1, "a:1"), (2, "k" * 1024 + ":2"), (3, "b:3")], "line_no long, value string")
    assert {(r.key, r.value) for r in settings.parse(lines).collect()} == {("a", "1"), ("k" * 1023, "")}
    lines = spark.createDataFrame([(1, "a:" + "v" * 2000), (2, "b:3")], "line_no long, value string")
    assert {(r.key, r.value) for r in settings.parse(lines).collect()} == {("a", "v" * 1023)}
    lines = spark.createDataFrame([(1, "a:1"), (2, "end")], "line_no long, value string")
    assert {(r.key, r.value) for r in settings.parse(lines).collect()} == {("a", "1"), ("end\n", "")}
    assert settings.parse(lines.where("false")).count() == 0


def test_files_are_read_apart_and_without_a_limit(spark):
    lines = spark.createDataFrame([("x", 1, "a:1"), ("y", 1, "a:2"), ("x", 2, "open"), ("y", 2, "b:" + "v" * 2000), ("y", 3, "c:3")], "file string, line_no long, value string")
    assert {tuple(r) for r in settings.parse(lines, ["file"]).collect()} == {("x", "a", "1"), ("x", "open\n", ""), ("y", "a", "2"), ("y", "b", "v" * 1023)}
    assert {(r.file, r.key, len(r.value)) for r in settings.parse(lines, ["file"], None).where("file = 'y'").collect()} == {("y", "a", 1), ("y", "b", 2000), ("y", "c", 1)}


def test_round_trip_of_lines(spark):
    pairs = spark.createDataFrame([("k", "v:w"), ("empty", "")], "key string, value string")
    lines = settings.to_lines(pairs).select(F.monotonically_increasing_id().alias("line_no"), F.col("line").alias("value"))
    assert {tuple(r) for r in settings.parse(lines).collect()} == {("k", "v:w"), ("empty", "")}


def test_getters(spark):
    values = ["12abc", " -7", "abc", "", "99999999999", None, "true", "1e3x", ".5", "+4"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(settings.as_int(F.col("v"), 5), settings.as_double(F.col("v"), 2.5), settings.as_bool(F.col("v"), True)).collect()
    assert [r[0] for r in got] == [12, -7, 0, 0, 2147483647, 5, 0, 1, 0, 4]
    assert [r[1] for r in got] == [12.0, -7.0, 0.0, 0.0, 99999999999.0, 2.5, 0.0, 1000.0, 0.5, 4.0]
    assert [r[2] for r in got] == [True, False, False, False, False, True, True, True, False, False]


def test_missing_lists_are_emptied(spark):
    current = spark.createDataFrame([("topsThresholds", "1,3"), ("doTops", "1"), ("settingsFile", "s")], "key string, value string")
    new = spark.createDataFrame([("settingsFile", "other")], "key string, value string")
    assert {tuple(r) for r in settings.load(new, current).collect()} == {("topsThresholds", ""), ("doTops", "1"), ("settingsFile", "s")}


def test_threshold_text(spark):
    for text, want in (("1,3,2.5,5", [(1.0, 3), (2.5, 5)]), ("", []), (None, []), ("1", []), ("1,3,x,5", [(1.0, 3)])):
        parsed = thresholds.parse(F.lit(text).cast("string"))
        got = one(spark, parsed.alias("x"), thresholds.parse(thresholds.to_text(parsed)).alias("y"))
        assert [tuple(r) for r in got.x] == want and got.x == got.y


def test_validation(spark):
    ok = lambda text: one(spark, thresholds.valid_tops(thresholds.parse(F.lit(text))).alias("x")).x
    assert [ok(t) for t in ("1,3", "1,4", "1,1", "0,3", "", "1,3,2,99")] == [True, False, False, False, False, True]


def test_change_mask_and_drivers(spark):
    got = one(spark, phases.changed(F.lit(5)).alias("x"), settings.driver_after(F.lit("/a/b.TIF"), F.lit("GTiff")).alias("d"), settings.driver_after(F.lit("/a/b.shp"), F.lit("GTiff")).alias("e"))
    assert got.x == ["SettingsFile", "DoTops"] and (got.d, got.e) == ("GTiff", "")


def test_progress(spark):
    events = spark.createDataFrame([(1, 1, 0.025, "a"), (1, 2, -1.0, ""), (1, 3, 0.5, None), (2, 1, -1.0, "")], "run long, seq long, status double, message string")
    got = {(r.run, r.seq): (r.status, r.message) for r in progress.filled(events).collect()}
    assert got == {(1, 1): (0.025, "a"), (1, 2): (0.025, "a"), (1, 3): (0.5, "a"), (2, 1): (0.0, "")}
    assert {tuple(r) for r in progress.latest(events).collect()} == {(1, 3, 0.5, "a"), (2, 1, 0.0, "")}
    assert one(spark, progress.percent(F.lit(0.025)).alias("x"), progress.percent(F.lit(-0.025)).alias("y")) == (3, -3)


def test_latest_of_a_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, 0.1, "a"), (1, 2, -1.0, "b"), (2, 5, 0.7, "")], "run long, seq long, status double, message string")
    events.write.parquet(f"{tmp_path}/in")
    stream = progress.latest(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("latest").collect()} == {(1, 2, 0.1, "b"), (2, 5, 0.7, "")}

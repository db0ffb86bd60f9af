from rasterloom.streaming import gates

SCHEMA = "dataset string, z int, min_zoom int, x int, y int, lo double, hi double"
ROWS = [("a", 3, 2, 0, 0, 1.0, 5.0), ("a", 2, 2, 1, 1, -2.0, 4.0), ("b", 5, 4, 2, 2, 0.0, 9.0), ("a", 3, 2, 4, 4, float("nan"), float("inf"))]


def stream(spark, tmp_path, build, mode, name):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = build(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return {tuple(r) for r in spark.table(name).collect()}


def test_running_range(spark, tmp_path):
    assert stream(spark, tmp_path, gates.running_z_range, "update", "zr") == {("a", -2.0, 5.0), ("b", 0.0, 9.0)}


def test_gate_opens_with_the_overview(spark, tmp_path):
    got = stream(spark, tmp_path, gates.progressive, "append", "gate")
    assert got == {("a", 3, 0, 0), ("a", 2, 1, 1), ("a", 3, 4, 4)}
    assert {tuple(r) for r in gates.shown(spark.createDataFrame(ROWS, SCHEMA)).collect()} == got


def test_gate_over_several_batches(spark, tmp_path):
    """Details come first, in a batch of their own; another dataset never opens."""
    import time as clock

    spark.createDataFrame(ROWS[:1] + ROWS[2:], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = gates.progressive(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = q.writeStream.outputMode("append").format("memory").queryName("late_gate").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    assert spark.table("late_gate").count() == 0
    clock.sleep(1.1)
    spark.createDataFrame(ROWS[1:2], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("late_gate").collect()} == {("a", 3, 0, 0), ("a", 2, 1, 1), ("a", 3, 4, 4)}


def test_gate_with_a_watermark(spark, tmp_path):
    schema = SCHEMA + ", ts timestamp"
    import datetime

    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(*r, at) for r in ROWS], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = gates.progressive(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "10 minutes")
    run = q.writeStream.outputMode("append").format("memory").queryName("timed_gate").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("timed_gate").collect()} == {("a", 3, 0, 0), ("a", 2, 1, 1), ("a", 3, 4, 4)}


def test_debounced_ranges(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    frames = gates.running_z_range(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    run = gates.debounced(frames, lambda df, k: seen.append({tuple(r) for r in df.collect()}), str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert {("a", -2.0, 5.0), ("b", 0.0, 9.0)} in seen

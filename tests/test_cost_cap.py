"""The streaming cost cap over several batches: told once, late rows of a run, expiry of its state."""

from pyspark.sql import functions as F

from sightline.streaming import jobs

SCHEMA = "run_id string, cost_usd double, created_at timestamp"


def run(spark, tmp_path, batches, keep="7 days"):
    """Rows told by a job that reads one file per batch, and the runs its state still holds."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        at = [(r, c, None if t is None else f"2026-03-{t}") for r, c, t in rows]
        frame = spark.createDataFrame(at, "run_id string, cost_usd double, t string").select("run_id", "cost_usd", F.col("t").cast("timestamp").alias("created_at"))
        frame.coalesce(1).write.parquet(str(folder / f"b{i}"))
    told = []
    state = str(tmp_path / "state")
    caps = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "run_id string, cap_usd double")
    for i in range(len(batches)):
        # One restart per batch: the state comes from the checkpoint each time.
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        parts = str(folder / ("{" + ",".join(f"b{j}" for j in range(i + 1)) + "}"))
        job = (
            jobs.cost_cap(stream.parquet(parts), caps, keep=keep).writeStream.outputMode("update").option("checkpointLocation", state)
            .trigger(availableNow=True).foreachBatch(lambda b, _: told.extend(b.collect())).start()
        )
        job.awaitTermination()
    held = spark.read.format("statestore").load(state).select("key.*").collect()
    return [(r.run_id, r.spent_usd, r.cap_usd) for r in told], sorted(r[0] for r in held)


def test_told_once_across_batches(spark, tmp_path):
    told, held = run(spark, tmp_path, [[("a", 0.6, "01"), ("b", 0.2, "01")], [("a", 0.6, "02"), ("x", 9.0, "02")], [("a", 5.0, "03"), ("b", None, "03")]])
    assert told == [("a", 1.2, 1.0)] and held == ["a", "b"]


def test_state_goes_after_its_time(spark, tmp_path):
    told, held = run(spark, tmp_path, [[("a", 0.6, "01"), ("b", 0.9, "01")], [("b", 0.2, "05")], [("c", 0.1, "10")], [("c", 0.1, None)]])
    assert told == [("b", 1.1, 1.0)] and held == ["b", "c"]


def test_late_row_within_the_time_counts(spark, tmp_path):
    told, _ = run(spark, tmp_path, [[("a", 0.6, "08")], [("a", 0.6, "03")]])
    assert told == [("a", 1.2, 1.0)]

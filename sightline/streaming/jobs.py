"""Incremental forms of ingest, counters, detection, daily rates and the cost cap.

Each takes a streaming DataFrame and returns one; ``run_available`` runs it over
what is available and writes to files, with its progress in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.functions import constants as K
from sightline.operators.detect import detect_rows
from sightline.sources.ingest import RESULT_KEY
from sightline.sources.stage import new_path


def read_files(spark: SparkSession, folder: str, schema, files: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def dedup_results(stream: DataFrame, keys: list[str] = RESULT_KEY, at: str = "created_at", delay: str = "2 days") -> DataFrame:
    """Each key once, among rows within the watermark delay; later copies are let through as new."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def run_counters(stream: DataFrame, at: str = "created_at", delay: str = "2 days") -> DataFrame:
    """Answers, errors and cost per run and day; use the update mode and add the days up with `run_totals`.

    The state holds the days that can still change: those older than the delay are let go.
    """
    rows = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    counted = rows.groupBy("run_id", F.window("_at", "1 day").alias("_day")).agg(
        F.count("*").alias("done_count"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"),
        F.sum(F.col("cost_usd").cast("decimal(20,9)")).alias("cost_usd"),
    )
    return counted.select("run_id", F.date_format("_day.start", "yyyy-MM-dd").alias("day"), "done_count", "error_count", "cost_usd")


def run_totals(updates: DataFrame) -> DataFrame:
    """Counters per run from the updates of `run_counters`."""
    days = latest_update(updates, ["run_id", "day"])
    return days.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("done_count", "error_count", "cost_usd")])


def detect(stream: DataFrame, entities: DataFrame) -> DataFrame:
    """Verdicts of each arriving answer against the static dictionaries, without state."""
    return detect_rows(stream, entities)


def daily_rates(stream: DataFrame, keys: list[str], at: str, delay: str = "1 day", zone: str = K.DEFAULT_TIME_ZONE) -> DataFrame:
    """Answers, cited and mentioned per local day; rows later than the delay are dropped and counted by Spark."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(at).cast("timestamp_ntz"))
    rows = stream.withColumn("_local", local.cast("timestamp")).withWatermark("_local", delay)
    return rows.groupBy(F.window("_local", "1 day").alias("_day"), *keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("cited")).alias("cited"), F.count_if(F.col("mentioned")).alias("mentioned")
    ).select(F.date_format("_day.start", "yyyy-MM-dd").alias("day"), *keys, "total", "cited", "mentioned")


def _partial_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the costs per run within a task, so a busy run sends a few rows on."""
    for batch in batches:
        if batch.num_rows:
            sums = pa.Table.from_batches([batch]).group_by(["run_id", "cap"]).aggregate([("cost", "sum"), ("at_ms", "max")])
            named = sums.select(["run_id", "cap", "cost_sum", "at_ms_max"]).rename_columns(["run_id", "cap", "cost", "at_ms"])
            yield from named.combine_chunks().to_batches()


def _check_cap(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    spent, told, last = state.get if state.exists else (0, False, 0)
    cap = None
    for frame in frames:
        spent += int(frame["cost"].sum())
        cap = int(frame["cap"].iloc[0])
        if frame["at_ms"].notna().any():
            last = max(last, int(frame["at_ms"].max()))
    if cap is not None and spent > cap and not told:
        told = True
        yield pd.DataFrame({"run_id": [key[0]], "spent_usd": [spent / 1e9], "cap_usd": [cap / 1e9]})
    state.update((spent, told, last))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)


def cost_cap(stream: DataFrame, caps: DataFrame, at: str = "created_at", keep: str = "7 days") -> DataFrame:
    """One row per run, the first time its cumulative cost exceeds its cap.

    The state is two numbers and one flag per run, let go once answers arrive that are more than
    ``keep`` younger than the run's last one; rows that are that late themselves are dropped
    and counted by Spark, so ``keep`` must exceed any delay of an answer. Time is that of the rows:
    a replay of old files behaves as the live job did, and ends. Rows without a time or a cost are
    counted as they are and cost nothing, respectively.
    Money travels as whole billionths, so the sum does not depend on the order.
    ``stream``: (run_id, cost_usd, created_at); ``caps``: (run_id or project_id, cap_usd), joined by the shared column.
    """
    key = "run_id" if "run_id" in caps.columns else "project_id"
    money = stream.join(caps, key).select(
        F.col("run_id").cast("string").alias("run_id"), F.round(F.col("cap_usd") * 1e9).cast("long").alias("cap"),
        F.coalesce(F.round(F.col("cost_usd") * 1e9).cast("long"), F.lit(0)).alias("cost"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"),
    )
    partial = money.mapInArrow(_partial_costs, "run_id string, cap long, cost long, at_ms long")
    timed = partial.withColumn("_at", F.timestamp_millis("at_ms")).withWatermark("_at", keep)
    return timed.groupBy("run_id").applyInPandasWithState(
        _check_cap, "run_id string, spent_usd double, cap_usd double", "spent long, told boolean, last long", "update", GroupStateTimeout.EventTimeTimeout
    )


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is available, one folder per micro-batch; a repeated batch replaces its own folder."""
    spark = stream.sparkSession
    out = new_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    job = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", new_path(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    job.awaitTermination()
    schema = stream.schema.add("batch", "long")
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Current value per key from the rows of an update-mode job."""
    rest = [c for c in updates.columns if c not in [*keys, "batch"]]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])

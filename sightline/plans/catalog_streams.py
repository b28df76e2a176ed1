"""Registered streaming jobs: each runs over the files of a table and is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.operators.detect import detect_rows
from sightline.plans.catalog import plain, query
from sightline.sources.binding import SCHEMAS
from sightline.sources.stage import dealt
from sightline.streaming import jobs


def _stream(log, table: str) -> DataFrame:
    return jobs.read_files(log.spark, log.root, SCHEMAS[table], f"{table}.parquet")


def listed_answers(log, orders: DataFrame) -> DataFrame:
    """Answers that hold their two sources as a list and name two entities in their text."""
    k = F.col("o_orderkey")

    def host(n):
        return F.concat(F.lit("https://www.s"), (n % 90).cast("string"), F.lit(".n"), (n % 25).cast("string"), F.lit(".example/x"))

    def source(n, cited):
        return F.struct(host(n).alias("url"), cited.alias("cited"))

    return orders.join(log.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("project_id")), "o_custkey").select(
        k.alias("result_id"),
        "project_id",
        F.array(source(k, k % 3 != 0), source(k + 5, F.when(k % 2 == 0, F.lit(True)))).alias("sources"),
        F.concat(F.lit("Nation_"), ((k + 5) % 25).cast("string"), F.lit(", NATION_"), (k % 25).cast("string"), F.lit(" n"), ((k + 10) % 25).cast("string"), F.lit(".example")).alias("raw_text"),
        F.when((F.col("o_orderstatus") == "P") & (k % 5 == 0), "err").alias("error"),
    )


@query("detect_rows")
def _detect_rows(log):
    return plain(detect_rows(listed_answers(log, dealt(log.raw("orders"), "o_orderkey")), log.entities))


@query("stream_detect")
def _stream_detect(log):
    verdicts = jobs.detect(listed_answers(log, _stream(log, "orders")), log.entities)
    return plain(jobs.run_available(verdicts, "stream-detect").drop("batch"))


@query("stream_dedup_results")
def _stream_dedup(log):
    """Every event arrives twice and is kept once."""
    e = _stream(log, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = jobs.run_available(jobs.dedup_results(twice, ["event_id"], "ts", "2 days"), "stream-dedup")
    return once.groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


@query("stream_run_counters")
def _stream_counters(log):
    answers = log.answers_from(_stream(log, "orders")).select("run_id", "created_at", "error", "cost_usd")
    updates = jobs.run_available(jobs.run_counters(answers), "stream-counters", "update")
    return jobs.run_totals(updates).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("stream_daily_rates")
def _stream_daily(log):
    e = _stream(log, "events").select(
        "event_type", "ts", (F.col("value") > 10).alias("cited"), (F.col("event_id") % 2 == 0).alias("mentioned")
    )
    updates = jobs.run_available(jobs.daily_rates(e, ["event_type"], "ts"), "stream-daily", "update")
    return jobs.latest_update(updates, ["day", "event_type"])


@query("stream_cost_cap")
def _stream_cap(log):
    caps = log.projects.select("project_id", (F.col("cost_cap_eur") / K.USD_TO_EUR).alias("cap_usd"))
    answers = log.answers_from(_stream(log, "orders")).select("run_id", "project_id", "cost_usd", "created_at")
    told = jobs.run_available(jobs.cost_cap(answers, caps), "stream-cap", "update")
    return told.select("run_id", F.round("cap_usd", 6).alias("cap_usd"), F.round("spent_usd", 6).alias("spent_usd"))

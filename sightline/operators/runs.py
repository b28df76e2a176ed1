"""Runs: planning, counters, cost cap, retries, unit costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.functions.pricing import estimate_cost, exact_sum, price_of
from sightline.operators.detect import brand_flags
from sightline.operators.rates import euros
from sightline.operators.windows import ordinal, top_per_group

_CAP_BLOCK = 1000


def runs(log) -> DataFrame:
    """Every run with its counters, recomputed from its answers; a run without answers counts 0."""
    counted = log.results.groupBy("run_id").agg(
        F.count("*").alias("done_count"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"),
        exact_sum(F.col("cost_usd")).alias("cost_usd"),
    )
    stored = log.runs.select("run_id", "project_id", "started_at", "finished_at", "status", "planned_count")
    return stored.join(counted, "run_id", "left").fillna(0, ["done_count", "error_count"]).fillna(0.0, ["cost_usd"])


def runs_recent(log, k: int = 50) -> DataFrame:
    return top_per_group(runs(log), ["project_id"], [F.desc("started_at"), F.asc("run_id")], k)


def run_duration(log) -> DataFrame:
    """Milliseconds until the end, or until now for a live run; null for a run that never ended."""
    live = F.col("status").isin("pending", "running")
    end = F.coalesce("finished_at", F.when(live, log.now))
    return log.runs.select("run_id", F.timestamp_diff("MILLISECOND", F.col("started_at"), end).alias("duration_ms"))


def run_detail(log) -> DataFrame:
    """Answers of every run with prompt text and the verdict on the brand."""
    b = brand_flags(log, log.results)
    return b.join(log.prompts.select("prompt_id", "text"), "prompt_id").select(
        "run_id", "result_id", "prompt_id", "text", "engine_id", "repeat_index", "created_at", "error", "latency_ms",
        "cost_usd", "cited", "mentioned",
    )


def plan_tasks(log) -> DataFrame:
    """Active prompts x enabled engines x repeats, engines taking turns.

    Prompts and engines meet on (project, web search or not): an engine lists
    the modes it supports, so the pairing is an equality join.
    """
    modes = F.when(F.col("provider") == "perplexity", F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    engines = log.project_engines.filter("enabled and usable").select(
        "project_id", "engine_id", F.col("ordinal").alias("engine_ordinal"), F.explode(modes).alias("web_search")
    )
    prompts = log.prompts.filter("active").select("project_id", "prompt_id", "web_search", "created_at")
    repeats = log.projects.select("project_id", "repeats")
    tasks = prompts.join(engines, ["project_id", "web_search"]).join(repeats, "project_id").select(
        "project_id", "prompt_id", "created_at", "engine_id", "engine_ordinal",
        F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("repeat_index"),
    )
    return ordinal(
        tasks, ["project_id", "engine_id"], ["created_at", "prompt_id", "repeat_index"], "turn", [F.date_trunc("DAY", F.col("created_at"))]
    ).drop("created_at")


def remaining_tasks(log) -> DataFrame:
    """Planned tasks of each project's latest run that have no answer yet."""
    latest = log.runs.groupBy("project_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    plan = plan_tasks(log).join(latest, "project_id").select("run_id", "project_id", "prompt_id", "engine_id", "repeat_index")
    done = log.results.select("run_id", "prompt_id", "engine_id", "repeat_index")
    return plan.join(done, ["run_id", "prompt_id", "engine_id", "repeat_index"], "left_anti")


def retry_set(log, engine_id: str | None = None) -> DataFrame:
    """Tasks to run again: answers in error, of all engines or of one."""
    failed = log.results.filter(F.col("error").isNotNull())
    if engine_id is not None:
        failed = failed.filter(F.col("engine_id") == engine_id)
    return failed.select("run_id", "prompt_id", "engine_id", "repeat_index", "result_id")


def cost_cap_stops(costs: DataFrame, caps: DataFrame) -> DataFrame:
    """First batch at which the cumulative cost of a run exceeds its cap.

    ``costs``: (run_id, batch, cost) with batches numbered from 1; ``caps``: (run_id, cap).
    Costs are first summed per block of batches; only the block where the cap is
    crossed is then read batch by batch, so no task walks a whole run.
    """
    blocks = costs.withColumn("block", F.floor((F.col("batch") - 1) / _CAP_BLOCK))
    per_block = blocks.groupBy("run_id", "block").agg(F.sum("cost").alias("_s"))
    running = W.partitionBy("run_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    crossed = (
        per_block.withColumn("_cum", F.sum("_s").over(running))
        .join(caps, "run_id")
        .filter(F.col("_cum") > F.col("cap"))
        .groupBy("run_id", "cap")
        .agg(F.min_by(F.struct("block", (F.col("_cum") - F.col("_s")).alias("before")), "block").alias("_b"))
        .select("run_id", "cap", "_b.block", "_b.before")
    )
    inside = W.partitionBy("run_id").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
    return (
        blocks.join(crossed, ["run_id", "block"])
        .withColumn("_cum", F.sum("cost").over(inside) + F.col("before"))
        .filter(F.col("_cum") > F.col("cap"))
        .groupBy("run_id")
        .agg(F.min("batch").alias("stop_batch"))
    )


def _money(column: Column) -> Column:
    return column.cast("decimal(20,9)")


def run_outcome(log) -> DataFrame:
    """Outcome of every run: failed when all tasks failed (or there were none) or the cap was exceeded, else done.

    Tasks count in the order of their answers, a few to a batch.
    """
    answers = log.results.select("run_id", "result_id", "created_at", "error", "cost_usd")
    tasks = ordinal(answers, ["run_id"], ["created_at", "result_id"], "task_no", [F.date_trunc("HOUR", F.col("created_at"))])
    tasks = tasks.withColumn("batch", F.ceil(F.col("task_no") / K.TASKS_PER_BATCH))
    costs = tasks.groupBy("run_id", "batch").agg(F.sum(_money(F.col("cost_usd"))).alias("cost"))
    counted = log.results.groupBy("run_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    totals = log.runs.select("run_id", "project_id").join(counted, "run_id", "left").fillna(0, ["tasks", "errors"])
    caps = totals.join(log.projects.select("project_id", "cost_cap_eur"), "project_id").select(
        "run_id", _money(F.col("cost_cap_eur") / K.USD_TO_EUR).alias("cap")
    )
    stops = cost_cap_stops(costs, caps)
    stopped = F.col("stop_batch").isNotNull()
    return totals.join(stops, "run_id", "left").select(
        "run_id",
        F.when(stopped | (F.col("errors") == F.col("tasks")), "failed").otherwise("done").alias("status"),
        F.when(stopped, F.least(F.col("stop_batch") * K.TASKS_PER_BATCH, F.col("tasks"))).otherwise(F.col("tasks")).alias("done"),
        "stop_batch",
    )


def engine_avg_cost(log) -> DataFrame:
    """Mean cost of an answer with web search per engine; a price estimate when nothing was measured."""
    measured = log.results.filter(F.col("error").isNull() & F.col("web_search")).groupBy("engine_id").agg(
        (exact_sum(F.col("cost_usd")) / F.count("*")).alias("_avg")
    )
    fallback = estimate_cost(
        price_of(F.col("model"), F.col("provider"), F.col("pricing")),
        F.lit(K.UNMEASURED_INPUT_TOKENS), F.lit(K.UNMEASURED_OUTPUT_TOKENS), F.lit(1),
    )
    return log.engines.join(measured, "engine_id", "left").select(
        "engine_id", F.coalesce("_avg", fallback).alias("avg_cost_usd"), fallback.alias("estimated_cost_usd")
    )


def answer_cost(log) -> DataFrame:
    """Price-list cost of every answer of the window from its usage; an engine's own prices come first."""
    engines = log.engines.select("engine_id", "provider", "model", "pricing")
    used = log.window().select("result_id", "engine_id", "usage").join(engines, "engine_id")
    price = price_of(F.col("model"), F.col("provider"), F.col("pricing"))
    cost = estimate_cost(price, F.col("usage.input_tokens"), F.col("usage.output_tokens"), F.col("usage.searches"))
    return used.select("result_id", "engine_id", F.round(cost, 9).alias("cost_usd"))


def inspection_cost_estimate(log) -> DataFrame:
    """Expected price of each inspection: valid questions x the mean costs of the enabled engines."""
    engines = log.project_engines.filter("enabled and usable").select("project_id", "engine_id")
    unit = engines.join(engine_avg_cost(log), "engine_id").groupBy("project_id").agg(exact_sum(F.col("avg_cost_usd")).alias("_unit"))
    valid = log.inspection_questions.filter(F.length(F.trim("text")) >= K.MIN_QUESTION_LENGTH)
    n = valid.groupBy("inspection_id", "project_id").agg(F.count("*").alias("questions"))
    return n.join(unit, "project_id").select(
        "inspection_id", "questions", euros(F.col("_unit") * F.col("questions")).alias("cost_eur")
    )

"""Rows with their children, lists in display order, and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _children(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """One list of structs per parent, sorted by the leading columns."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def result_detail(log, results: DataFrame) -> DataFrame:
    """Answers with prompt, engine, run, the verdicts on every entity and the project's dictionary.

    results: ``result_id`` of the answers wanted. The lists are as long as a project's list
    of tracked names.
    """
    answers = log.results.join(results.select("result_id"), "result_id", "left_semi")
    prompts = log.prompts.select("prompt_id", F.struct("text", "tags", "active").alias("prompt"))
    engines = log.engines.select("engine_id", F.struct("label", "provider", "model").alias("engine"))
    runs = log.runs.select("run_id", F.struct("status", "started_at").alias("run"))
    verdicts = log.detections.select(
        "result_id", "entity_type", "entity_id", "cited", "citation_rank", "retrieved", "mentioned", "mention_rank"
    ).join(results.select("result_id"), "result_id", "left_semi")
    listed = _children(verdicts, "result_id", ["entity_type", "entity_id"], "detections")
    entities = _children(
        log.entities.select("project_id", "ordinal", "entity_type", "entity_id", "name", "terms", "domains"),
        "project_id", ["ordinal"], "entities",
    )
    return (
        answers.join(prompts, "prompt_id")
        .join(engines, "engine_id")
        .join(runs, "run_id")
        .join(listed, "result_id", "left")
        .join(entities, "project_id")
        .select("result_id", "project_id", "created_at", "error", "prompt", "engine", "run", "detections", "entities")
    )


def nested_detail(log) -> DataFrame:
    """Projects with their rivals, in order."""
    rivals = log.entities.filter("entity_type = 'competitor'").select("project_id", "ordinal", "entity_id", "name", "domains")
    return log.projects.select("project_id", "brand_name").join(
        _children(rivals, "project_id", ["ordinal"], "competitors"), "project_id", "left"
    )


def inspection_detail(log, flags: DataFrame) -> DataFrame:
    """Inspections with their answers by question and engine; flags: `inspections.answer_flags`."""
    answers = flags.select("inspection_id", "question_index", "engine_id", "result_id", "error", "url_cited", "domain_cited")
    return log.inspections.select("inspection_id", "project_id", "url", "status").join(
        _children(answers, "inspection_id", ["question_index", "engine_id"], "answers"), "inspection_id", "left"
    )


def _placed(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def list_engines(log) -> DataFrame:
    """Engines by creation, under every project."""
    rows = log.project_engines.select("project_id", "engine_id", "label", "provider", "model", "enabled", "ordinal")
    return _placed(rows, ["project_id"], [F.asc("ordinal"), F.asc("engine_id")]).drop("ordinal")


def list_inspections(log, k: int = 50) -> DataFrame:
    """The newest inspections of each project."""
    rows = log.inspections.select("project_id", "inspection_id", "url", "status", "created_at")
    return _placed(rows, ["project_id"], [F.desc("created_at"), F.asc("inspection_id")]).filter(F.col("position") <= k)


def prompt_search(log, text: str | None = None, tag: str | None = None, active: bool | None = None) -> DataFrame:
    """Prompts whose text holds a string in any case, with a tag, and active or not; each condition can be left out."""
    found = log.prompts
    if text:
        found = found.filter(F.contains(F.lower("text"), F.lower(F.lit(text))))
    if tag is not None:
        found = found.filter(F.array_contains("tags", tag))
    if active is not None:
        found = found.filter(F.col("active") == active)
    return found.select("project_id", "prompt_id", "text")

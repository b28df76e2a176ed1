"""Ingest: prompts from text files, answers once only, latest version per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RESULT_KEY = ["run_id", "prompt_id", "engine_id", "repeat_index"]
MIN_PROMPT_LENGTH = 5


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def split_list(cell: Column) -> Column:
    """Comma- or line-separated values, trimmed, without blanks."""
    return F.filter(F.transform(F.split(cell, r"[,\n]"), lambda t: F.trim(t)), lambda t: t != "")


def import_prompts_csv(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """Prompt lines ``text;lang;tag1,tag2;web`` without header or quoting.

    ``on_error='fail'`` raises on a text of fewer than five characters, as an
    import is all or nothing; ``'mark'`` keeps the row with ``valid = false``.
    """
    line = F.trim(F.regexp_replace("value", r"\r$", ""))
    cells = F.split(line, ";")

    def cell(i: int) -> Column:
        return F.trim(F.coalesce(F.get(cells, i), F.lit("")))

    rows = lines.filter(line != "").select(
        cell(0).alias("text"),
        F.when(cell(1) == "", "fr").otherwise(cell(1)).alias("lang"),
        split_list(cell(2)).alias("tags"),
        (~cell(3).rlike(r"^(?i:non|no|false|0)$")).alias("web_search"),
        (F.length(cell(0)) >= MIN_PROMPT_LENGTH).alias("valid"),
    )
    if on_error == "mark":
        return rows
    checked = F.when(F.col("valid"), F.col("text")).otherwise(
        F.raise_error(F.concat(F.lit("prompt too short: "), F.col("text"))).cast("string")
    )
    return rows.select(checked.alias("text"), "lang", "tags", "web_search")


def ingest_results_idempotent(existing: DataFrame, incoming: DataFrame, keys: list[str] = RESULT_KEY) -> DataFrame:
    """Rows to insert: the first of each key in the batch, unless the key is already stored."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min(F.struct("created_at", "result_id", *[c for c in rest if c not in ("created_at", "result_id")])).alias("_r"))
    fresh = first.join(existing.select(*keys), keys, "left_anti")
    return fresh.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_latest_by_key(current: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Both tables merged, the newest row of each key kept."""
    rows = current.unionByName(changes)
    rest = [c for c in rows.columns if c not in keys]
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r"))
    return merged.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def promote_questions(questions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Questions that are not yet a prompt of the project, tagged with the last part of their page.

    ``questions``: (project_id, text, lang, page); ``prompts``: (project_id, text).
    """
    def key(text: Column) -> Column:
        return F.lower(F.trim(text))

    known = prompts.select("project_id", key(F.col("text")).alias("_k"))
    slug = F.element_at(F.filter(F.split("page", "/"), lambda p: p != ""), -1)
    return (
        questions.withColumn("_k", key(F.col("text")))
        .join(known, ["project_id", "_k"], "left_anti")
        .select(
            "project_id", "text", "lang",
            F.array(F.lit("inspection"), F.coalesce(F.substring(slug, 1, 40), F.lit("page"))).alias("tags"),
            F.lit(True).alias("web_search"),
        )
    )


def latest_within_ttl(rows: DataFrame, keys: list[str], at: str, now: Column, ttl_minutes: int) -> DataFrame:
    """Newest row of each key that is not older than the time to live."""
    rest = [c for c in rows.columns if c not in keys]
    fresh = rows.filter((F.col(at) <= now) & (F.timestamp_diff("SECOND", F.col(at), now) <= ttl_minutes * 60))
    best = fresh.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def asof_within_ttl(requests: DataFrame, history: DataFrame, key: str, at: str, value: str, ttl_minutes: int) -> DataFrame:
    """For every request, the newest earlier (or simultaneous) history row of its key within the time to live.

    Time is cut into slices as long as the time to live: the answer is in the
    request's slice or the one before, so rows are ordered per (key, slice) and a
    busy key is spread over its slices.
    """
    span = ttl_minutes * 60
    # One column orders everything: history sorts before a request of the same instant.
    slice_no = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(span * 1_000_000))
    old = history.select(key, at, F.lit(0).alias("_is_request"), F.struct(at, F.col(value).alias("found")).alias("_h"))
    new = requests.withColumn("_is_request", F.lit(1)).withColumn("_h", F.lit(None).cast(old.schema["_h"].dataType))
    rows = new.unionByName(old, allowMissingColumns=True).withColumn("_slice", slice_no)
    w = W.partitionBy(key, "_slice").orderBy(at, "_is_request").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumn("_near", F.last("_h", ignorenulls=True).over(w)).filter("_is_request = 1")
    ends = old.withColumn("_slice", slice_no + 1).groupBy(key, "_slice").agg(F.max("_h").alias("_far"))
    out = inside.join(ends, [key, "_slice"], "left").withColumn("_hit", F.coalesce("_near", "_far"))
    in_time = F.timestamp_diff("MICROSECOND", F.col(f"_hit.{at}"), F.col(at)) <= span * 1_000_000
    return out.select(
        *requests.columns,
        F.when(in_time, F.col(f"_hit.{at}")).alias("found_at"),
        F.when(in_time, F.col("_hit.found")).alias("found"),
    )

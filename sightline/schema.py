"""Schemas of the answer log and its quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()
STRINGS = T.ArrayType(S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SOURCE = _struct(url=S, title=S, domain=S, cited=B, retrieved=B)
USAGE = _struct(input_tokens=L, output_tokens=L, total_tokens=L, searches=L)
PRICE = _struct(input_per_mtok=D, output_per_mtok=D, per_search=D)
QUESTION = _struct(text=S, lang=S, source=S)
AGENT_ACCESS = _struct(agent=S, vendor=S, role=S, allowed=B, explicit=B)
SCORE_ROW = _struct(key=S, label=S, value=S, points=I, max=I, note=S)
SCORE = _struct(total=I, max=I, rows=T.ArrayType(SCORE_ROW), caps=STRINGS)

TABLES: dict[str, T.StructType] = {
    "projects": _struct(
        id=S, name=S, brand_name=S, aliases=STRINGS, domains=STRINGS, locale=S, repeats=I, cost_cap_eur=D,
        inspection_cost_cap_eur=D, inspections_per_day=I, created_at=TS,
    ),
    "competitors": _struct(id=S, project_id=S, name=S, aliases=STRINGS, domains=STRINGS, created_at=TS),
    "prompts": _struct(
        id=S, project_id=S, text=S, lang=S, tags=STRINGS, web_search=B, active=B, created_at=TS,
    ),
    "engines": _struct(
        id=S, provider=S, model=S, label=S, enabled=B, usable=B, pricing=PRICE, max_searches=I, created_at=TS,
    ),
    "runs": _struct(
        id=S, project_id=S, trigger=S, status=S, started_at=TS, finished_at=TS, planned_count=I, done_count=I,
        error_count=I, cost_estimate=D, error=S,
    ),
    "results": _struct(
        id=S, run_id=S, prompt_id=S, engine_id=S, repeat_index=I, web_search=B, raw_text=S,
        sources=T.ArrayType(SOURCE), search_queries=STRINGS, usage=USAGE, cost_estimate=D, latency_ms=I, error=S,
        created_at=TS,
    ),
    "detections": _struct(
        id=S, result_id=S, entity_type=S, entity_id=S, cited=B, citation_rank=I, retrieved=B, retrieved_rank=I,
        mentioned=B, mention_rank=I, matched_terms=STRINGS,
    ),
    "inspections": _struct(
        id=S, project_id=S, url=S, normalized_url=S, content_hash=S, status=S, access=T.ArrayType(AGENT_ACCESS),
        questions=T.ArrayType(QUESTION), engine_ids=STRINGS, planned_count=I, done_count=I, cost_estimate=D,
        error=S, created_at=TS, finished_at=TS,
    ),
    "inspection_answers": _struct(
        id=S, inspection_id=S, question_index=I, engine_id=S, raw_text=S, sources=T.ArrayType(SOURCE),
        search_queries=STRINGS, usage=USAGE, cost_estimate=D, latency_ms=I, error=S, url_cited=B, url_rank=I,
        domain_cited=B, domain_rank=I, url_retrieved=B, domain_retrieved=B, created_at=TS,
    ),
    "page_analyses": _struct(
        id=S, project_id=S, inspection_id=S, url=S, normalized_url=S, grid_version=S, status=S, content_hash=S,
        page_type=S, access=SCORE, content=SCORE, score=I, confidence=S, created_at=TS, finished_at=TS,
    ),
    "comparison_pages": _struct(
        id=S, normalized_url=S, url=S, content_hash=S, http_status=I, page_type=S, error=S, fetched_at=TS,
    ),
}

ALLOWED_VALUES = {
    ("runs", "status"): ["pending", "running", "done", "failed"],
    ("runs", "trigger"): ["manual", "cron"],
    ("detections", "entity_type"): ["brand", "competitor"],
    ("inspections", "status"): ["draft", "running", "done", "failed"],
}

PARENTS = [
    ("competitors", "project_id", "projects"),
    ("prompts", "project_id", "projects"),
    ("runs", "project_id", "projects"),
    ("results", "run_id", "runs"),
    ("results", "prompt_id", "prompts"),
    ("results", "engine_id", "engines"),
    ("detections", "result_id", "results"),
    ("inspection_answers", "inspection_id", "inspections"),
]


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is missing: the data-quality form of a foreign key."""
    keys = parent.select(F.col(parent_key).alias(key))
    return child.join(keys, key, "left_anti")


def outside_allowed(table: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return table.filter(~F.col(column).isin(allowed))


def quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that break a rule, per rule: a missing parent or a value that is not allowed."""
    rules = {
        f"{child}.{key}": orphans(tables[child], key, tables[parent])
        for child, key, parent in PARENTS
        if child in tables and parent in tables
    }
    rules |= {f"{t}.{c}": outside_allowed(tables[t], c, allowed) for (t, c), allowed in ALLOWED_VALUES.items() if t in tables}
    counts = [rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("rows")) for rule, rows in rules.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out

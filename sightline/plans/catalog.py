"""Every registered query: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import schema
from sightline.functions import urls
from sightline.operators import answers as A
from sightline.operators import details as X
from sightline.operators import detect as D
from sightline.operators import ranks as N
from sightline.operators import source_metrics as S
from sightline.operators.cube import DailyCube
from sightline.sources import tables
from sightline.sources.binding import ENGINE_MODELS, AnswerLog
from sightline.sources.snapshots import Snapshots
from sightline.sources.stage import kept_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(build: Callable[[AnswerLog], DataFrame]) -> Callable[[AnswerLog], DataFrame]:
        QUERIES[name] = lambda spark, root: build(AnswerLog(spark, root))
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as text and lists as comma-separated text, to compare across engines."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            out.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif kind == "array":
            out.append(F.array_join(f.name, ",").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


for _name, _op in {
    "brand_rates": A.brand_rates,
    "overview": lambda log: A.overview(log, zone="UTC"),
    "engine_rates": A.engine_rates,
    "engine_cards": A.engine_cards,
    "share_of_voice": A.share_of_voice,
    "quick_opportunities": A.quick_opportunities,
    "prompt_engine_rates": A.prompt_engine_rates,
    "engine_theme_matrix": A.engine_theme_matrix,
    "theme_summary": A.theme_summary,
    "theme_order": A.theme_summary_ordered,
    "engine_stats": A.engine_stats,
    "share_of_voice_series": A.share_of_voice_series,
    "sov_daily_share": A.sov_daily_share,
    "time_series": A.time_series,
    "trend_pivot": lambda log: A.trend_pivot(log, list(ENGINE_MODELS)),
    "answer_status": A.answer_status,
    "prompt_matrix": A.prompt_matrix,
    "prompt_history": lambda log: plain(A.prompt_history(log)),
    "prompt_competitors": A.prompt_competitors,
    "prompt_scorecard": A.prompt_scorecard,
    "prompt_timeline": lambda log: plain(A.prompt_timeline(log)),
    "competitor_overlap": A.competitor_overlap,
    "prompts_without_brand": A.prompts_without_brand,
    "project_stats": A.project_stats,
    "engine_domains": S.engine_domains,
    "top_domains": S.top_domains,
    "competitor_pages": S.competitor_pages,
    "domains_instead": S.domains_instead,
    "brand_pages": S.brand_pages,
    "brand_page_citations": lambda log: plain(S.brand_page_citations(log)),
    "url_history": lambda log: plain(S.url_history(log, log.inspections)),
    "source_owner": S.source_owner,
    "track_domain_candidates": S.track_domain_candidates,
    "detections": lambda log: plain(log.detected(log.entities)),
    "stored_detections": lambda log: plain(log.detections),
}.items():
    query(_name)(_op)

# --- runs, planning, costs ---------------------------------------------------------------
from sightline.operators import inspections as I  # noqa: E402
from sightline.operators import runs as R  # noqa: E402
from sightline.sources import ingest, responses  # noqa: E402
from sightline.sources.binding import ts  # noqa: E402

for _name, _op in {
    "run_counters": lambda log: R.runs(log).select("run_id", "project_id", "status", "planned_count", "done_count", "error_count", "cost_usd"),
    "runs_recent": lambda log: plain(R.runs_recent(log)),
    "run_duration": R.run_duration,
    "run_detail": lambda log: plain(R.run_detail(log)),
    "plan_tasks": R.plan_tasks,
    "remaining_tasks": R.remaining_tasks,
    "retry_set": R.retry_set,
    "run_outcome": R.run_outcome,
    "engine_avg_cost": R.engine_avg_cost,
    "answer_cost": R.answer_cost,
    "inspection_cost_estimate": R.inspection_cost_estimate,
    "inspection_answer_flags": I.answer_flags,
    "inspection_cells": I.cell_kinds,
    "inspection_verdict": I.verdict,
    "inspection_summaries": lambda log: plain(I.inspection_summaries(log)),
    "inspection_task_grid": I.planned_tasks,
    "cited_instead": I.cited_instead,
    "comparison_candidates": I.comparison_candidates,
    "inspections_cost_since": lambda log: I.inspections_cost_since(log, ts("2001-07-20 00:00:00")),
    "inspection_quota": lambda log: I.inspection_quota(log, ts("2001-08-01 00:00:00")),
    "result_per_engine": I.result_per_engine,
    "result_score": I.result_score,
}.items():
    query(_name)(_op)


@query("list_projects")
def _projects(log):
    return plain(log.projects)


@query("list_prompts")
def _prompts(log):
    return plain(log.prompts)


@query("prompt_search")
def _prompt_search(log):
    """Prompts whose text holds 9, with Europe as tag, active ones only."""
    return X.prompt_search(log, text="9", tag="EUROPE", active=True)


@query("prompt_positions")
def _prompt_positions(log):
    return plain(A.prompt_positions(log))


@query("list_engines")
def _engines(log):
    return X.list_engines(log)


@query("list_inspections")
def _inspection_list(log):
    return plain(X.list_inspections(log))


def _told(column: str, *fields: str) -> Column:
    """A list of structs as text, to compare across engines."""
    parts = lambda s: F.concat_ws(":", *[s[f].cast("string") for f in fields])
    return F.coalesce(F.array_join(F.transform(column, parts), ","), F.lit("")).alias(column)


@query("result_detail")
def _result_detail(log):
    """Every answer of the window with its verdicts and the dictionary of its project."""
    d = X.result_detail(log, log.window().select("result_id"))
    return d.select(
        "result_id", F.col("prompt.text").alias("prompt"), F.col("engine.provider").alias("provider"), F.col("run.status").alias("run_status"),
        _told("detections", "entity_type", "entity_id", "cited", "citation_rank", "mentioned", "mention_rank"), _told("entities", "entity_type", "name"),
    )


@query("nested_detail")
def _nested(log):
    return X.nested_detail(log).select("project_id", "brand_name", _told("competitors", "entity_id", "name"))


@query("inspection_detail")
def _inspection_detail(log):
    d = X.inspection_detail(log, I.answer_flags(log))
    return d.select("inspection_id", "url", "status", _told("answers", "question_index", "engine_id", "result_id", "url_cited"))


for _name, _op in {
    "wilson_interval": N.wilson_interval,
    "mean_citation_rank": N.mean_citation_rank,
    "brand_rank_among_domains": N.brand_rank_among_domains,
    "taken_by": N.taken_by,
    "competitor_duel": N.competitor_duel,
}.items():
    query(_name)(_op)


@query("tag_vocabulary")
def _tags(log):
    return log.prompts.select("project_id", F.explode("tags").alias("tag")).distinct()


@query("entity_dictionary")
def _entities(log):
    return plain(log.entities).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("orphan_checks")
def _orphans(log):
    """Rows per relation, and how many of them lack their parent."""
    from sightline.schema import orphans

    lines = log.raw("lineitem").select(F.col("l_orderkey").alias("result_id"))
    answers = log.raw("orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("prompt_id"), F.col("o_orderpriority").alias("engine_id"))
    runs = log.runs.select("run_id", "project_id")
    checks = {
        "sources.result_id": (lines, "result_id", answers),
        "results.prompt_id": (answers, "prompt_id", log.prompt_projects),
        "results.engine_id": (answers, "engine_id", log.engines),
        "results.run_id": (log.results, "run_id", runs),
        "runs.project_id": (runs, "project_id", log.projects),
        "prompts.project_id": (log.prompt_projects, "project_id", log.projects),
        "competitors.project_id": (log.entities, "project_id", log.projects),
        "detections.result_id": (log.detections, "result_id", answers),
        "inspection_answers.inspection_id": (log.inspection_answers, "inspection_id", log.inspections),
        "documents.labels": (log.raw("labels").select("doc_id"), "doc_id", log.raw("documents")),
    }
    out = None
    for relation, (child, key, parent) in checks.items():
        lost = orphans(child.select(key), key, parent.select(key).distinct(), key).agg(F.count("*").alias("orphans"))
        row = child.agg(F.count("*").alias("rows")).join(lost).select(F.lit(relation).alias("relation"), "rows", "orphans")
        out = row if out is None else out.unionByName(row)
    return out


# --- ingest --------------------------------------------------------------------------------
@query("import_prompts_csv")
def _import_csv(log):
    """Prompt lines written from the customers, read back by the importer."""
    web = F.when(F.col("prompt_id") % 3 == 0, " Non ").when(F.col("prompt_id") % 3 == 1, "oui").otherwise("")
    lang = F.when(F.col("prompt_id") % 2 == 0, " en").otherwise("")
    tags = F.array_join("tags", " , ")
    lines = log.prompts.select(F.concat_ws(";", F.col("text"), lang, tags, web).alias("value"))
    return plain(ingest.import_prompts_csv(lines))


@query("ingest_results")
def _ingest(log):
    """A batch that overlaps the stored answers and holds every row twice."""
    keys = [*ingest.RESULT_KEY, "created_at", "result_id"]
    stored = log.results.filter(F.col("created_at") < ts("2001-02-01 00:00:00"))
    batch = log.results.filter(F.col("created_at") >= ts("2001-01-10 00:00:00")).select(*keys)
    return plain(ingest.ingest_results_idempotent(stored, batch.union(batch)))


@query("upsert_page_cache")
def _upsert(log):
    """Pages by normalised URL, the latest fetch kept."""
    from sightline.functions.urls import normalize_url

    pages = log.raw("pages").select(
        normalize_url(F.col("url")).alias("normalized_url"), "url", "page_id", (F.col("page_id") * 7919 % 1000003).alias("fetched_at")
    )
    old = pages.withColumn("fetched_at", F.col("fetched_at") - 500_000)
    return ingest.upsert_latest_by_key(old, pages, ["normalized_url"], ["fetched_at", "page_id"])


@query("promote_questions")
def _promote(log):
    """User turns that are not already an opening question, tagged with the page of the same number."""
    turns = log.raw("conversations").filter("role = 'user'")
    opening = turns.filter("turn = 0").select(F.lit("p").alias("project_id"), "text")
    pages = log.raw("pages").select(F.col("page_id").alias("conv_id"), F.regexp_extract("url", "^[^?#]*", 0).alias("page"))
    questions = turns.join(pages, "conv_id", "left").select(
        F.lit("p").alias("project_id"), "text", F.lit("fr").alias("lang"), F.coalesce("page", F.lit("")).alias("page")
    )
    return plain(ingest.promote_questions(questions, opening)).select("text", "tags")


@query("latest_within_ttl")
def _latest_ttl(log):
    """Last event of each user in the seven days before a moment."""
    e = log.raw("events").select("user_id", "ts", "event_id", "event_type")
    return plain(ingest.latest_within_ttl(e, ["user_id"], "ts", ts("2024-01-20 00:00:00"), 7 * 1440))


@query("asof_within_ttl")
def _asof(log):
    """For each error, the last view of the same user within an hour."""
    e = log.raw("events")
    errors = e.filter("event_type = 'error'").select("user_id", "ts", "event_id")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return plain(ingest.asof_within_ttl(errors, views, "user_id", "ts", "view_id", 60))


@query("normalize_engine_responses")
def _responses(log):
    """One raw response per answer, in the shape of its provider."""
    k = F.col("result_id").cast("string")
    page = F.concat(F.lit("https://www.s"), (F.col("result_id") % 90).cast("string"), F.lit(".example/p/"))
    providers = log.engines.select("engine_id", "provider")
    a = log.window().join(providers, "engine_id").select("result_id", "provider", k.alias("k"), page.alias("u"))
    google = F.concat(
        F.lit('{"sources":[{"sourceType":"url","url":"'), F.col("u"), F.lit('1"},{"sourceType":"url","url":"'), F.col("u"),
        F.lit('2"},{"sourceType":"url","url":"'), F.col("u"), F.lit('1"}],"providerMetadata":{"google":{"groundingMetadata":{"webSearchQueries":[" q'),
        F.col("k"), F.lit(' ","q'), F.col("k"), F.lit('",""],"groundingChunks":[{"web":{"uri":"'), F.col("u"), F.lit('1"}},{"web":{"uri":"'),
        F.col("u"), F.lit('2"}},{"web":{"uri":"'), F.col("u"), F.lit('3"}}],"groundingSupports":[{"groundingChunkIndices":[1]}]}}}}'),
    )
    tool = F.concat(
        F.lit('{"sources":[{"sourceType":"url","url":"'), F.col("u"), F.lit('1"},{"sourceType":"doc","url":"'), F.col("u"),
        F.lit('9"}],"steps":[{"toolCalls":[{"toolName":"web_search","input":{"query":"q'), F.col("k"),
        F.lit('"}},{"toolName":"other","input":{"query":"z"}}],"toolResults":[{"toolName":"web_search","output":'),
        F.when(F.col("provider") == "anthropic", F.concat(F.lit('[{"url":"'), F.col("u"), F.lit('1"},{"url":"'), F.col("u"), F.lit('4","title":"T"}]')))
        .otherwise(F.concat(F.lit('{"action":{"query":"r'), F.col("k"), F.lit('","sources":[{"type":"url","url":"'), F.col("u"), F.lit('5"},{"type":"x","url":"n"}]}}'))),
        F.lit("}]}]}"),
    )
    pplx = F.concat(
        F.lit('{"sources":[{"sourceType":"url","url":"'), F.col("u"), F.lit('1"}],"providerMetadata":{"perplexity":{"usage":{"numSearchQueries":'),
        (F.col("result_id") % 3).cast("string"), F.lit("}}}}"),
    )
    raw = F.when(F.col("provider") == "google", google).when(F.col("provider") == "perplexity", pplx).otherwise(tool)
    out = responses.normalize_engine_responses(a.select("result_id", "provider", raw.alias("response")))
    return out.select(
        "result_id",
        F.array_join(F.transform("sources", lambda s: F.concat(s["url"], F.when(s["cited"], "+").otherwise("-"))), ",").alias("sources"),
        F.array_join("search_queries", ",").alias("search_queries"),
        "searches",
    )


@query("resolve_redirects")
def _redirects(log):
    """Sources given as search redirects; some of them never resolve."""
    w = log.window().select("result_id")
    s = log.sources.join(w, "result_id")
    supplier, part = F.col("pos.l_suppkey"), F.col("pos.l_partkey") % 50
    link = F.concat(
        F.lit("https://vertexaisearch.cloud.google.com/grounding-api-redirect/"), supplier.cast("string"), F.lit("-"), part.cast("string")
    )
    given = s.select(
        "result_id", "pos", F.when(part % 2 == 1, link).otherwise(F.col("url")).alias("url"), F.col("domain").alias("title"),
        F.when(part % 2 == 1, "vertexaisearch.cloud.google.com").otherwise(F.col("domain")).alias("domain"),
    )
    table = s.filter((part % 2 == 1) & (supplier % 3 != 0)).select(link.alias("url"), F.concat(F.lit("https://"), F.col("domain"), F.lit("/r/"), part.cast("string")).alias("location")).distinct()
    return responses.resolve_source_redirects(given, table).select("result_id", "url", "domain")


@query("neutrality_violations")
def _neutrality(log):
    """Answer texts checked as if they were questions."""
    w = log.window()
    q = log.texts_of(w).join(w.select("result_id", "project_id"), "result_id").select(
        F.col("result_id").alias("question_id"), "project_id", F.col("raw_text").alias("text")
    )
    return I.neutrality_violations(q, log.entities)


@query("valid_questions")
def _valid(log):
    turns = log.raw("conversations").filter("role = 'user'")
    return I.valid_questions(turns.select(F.col("conv_id").alias("group_id"), "text"))


@query("mention_spans")
def _spans(log):
    """Spans of the brand's and rivals' names in the answer texts."""
    w = log.window()
    t = log.texts_of(w).join(w.select("result_id", "project_id"), "result_id")
    spans = D.spans_in_texts(t, log.entities).select("result_id", F.explode("spans").alias("s"))
    return spans.select("result_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.term").alias("term"))


def without_rival(log) -> DataFrame:
    """The dictionaries after one project has dropped a rival."""
    return log.entities.filter(F.col("entity_id") != DROPPED_RIVAL)


DROPPED_RIVAL = 20


@query("recompute_detections")
def _recompute(log):
    """All verdicts after the dictionary of one project has changed; the other projects keep their files."""
    kept = Snapshots(log.spark, kept_path(log.spark, "recomputed", log.root), ["project_id"])
    kept.current(lambda: log.detections)
    changed = log.entities.filter(F.col("entity_id") == DROPPED_RIVAL).select("project_id")
    D.recompute_projects(kept, log, without_rival(log), changed)
    return plain(kept.read())


@query("snapshot_copy")
def _copied(log):
    """Prompts and projects copied twice, and read back through the declared schemas."""
    def as_declared(name: str, df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.TABLES[name].fields])

    given = {
        "prompts": as_declared("prompts", log.prompts.withColumn("id", F.col("prompt_id"))),
        "projects": as_declared("projects", log.projects.withColumn("id", F.col("project_id"))),
    }
    target = kept_path(log.spark, "copy", log.root)
    tables.snapshot_copy(log.spark, {"projects": given["projects"]}, target, force=True)
    tables.snapshot_copy(log.spark, given, target, force=True)
    copied = {name: tables.scan_table(log.spark, target, name) for name in given}
    prompts = copied["prompts"].groupBy(F.col("project_id").alias("id")).agg(
        F.count("*").alias("prompts"), F.count_if("active").alias("active"), F.min("text").alias("first_text"), F.sum(F.size("tags")).alias("tags")
    )
    return copied["projects"].select("id", "brand_name", "repeats").join(prompts, "id")


@query("domain_matches")
def _on_domain(log):
    """Source URLs of the window on the domain of each project's brand."""
    w = log.window().select("result_id", "project_id")
    brands = log.entities.filter("entity_type = 'brand'").select("project_id", F.get("domains", F.lit(0)).alias("domain"))
    rows = log.sources.join(w, "result_id").select("project_id", "url").join(brands, "project_id")
    return rows.groupBy("project_id").agg(F.count("*").alias("sources"), F.count_if(urls.domain_matches(F.col("url"), F.col("domain"))).alias("own"))


def daily_cube(log) -> DailyCube:
    """The cube of all days, kept per application."""
    cube = DailyCube(log.spark, kept_path(log.spark, "cube", log.root))
    if cube.entities.version == 0:
        cube.refresh(log)
    return cube


@query("overview_from_cube")
def _overview_from_cube(log):
    return daily_cube(log).overview(log, zone="UTC")


@query("share_of_voice_from_cube")
def _voice_from_cube(log):
    return daily_cube(log).share_of_voice(log)


# Names of the survey for queries registered under a shorter one.
ALIASES = {
    "ingest_results_idempotent": "ingest_results",
    "upsert_latest_by_key": "upsert_page_cache",
    "promote_questions_to_prompts": "promote_questions",
    "resolve_source_redirects": "resolve_redirects",
    "verdict": "inspection_verdict",
    "cell_kind": "inspection_cells",
    "answer_value": "result_per_engine",
    "round_robin_order": "plan_tasks",
    "running_cost_cap": "run_outcome",
    "estimate_cost": "answer_cost",
    "page_citations": "brand_page_citations",
}
for _alias, _name in ALIASES.items():
    QUERIES[_alias] = QUERIES[_name]

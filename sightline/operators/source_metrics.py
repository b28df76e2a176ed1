"""Metrics over the sources of answers: domains, pages, URL history.

Counts are reduced per host or per page before owners are looked up, and top-k
lists are cut per task before the shuffle, so a host that holds a large part of
all sources costs one partial count per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.urls import bare_url, normalize_url
from sightline.operators.detect import cited_pairs
from sightline.operators.domains import all_owners, with_owner
from sightline.operators.rates import rate
from sightline.operators.windows import top_per_group


def _sources(log, answers: DataFrame, *columns: str) -> DataFrame:
    return log.sources.join(answers.select("result_id", "project_id", *columns), "result_id")


def _page(url: Column) -> Column:
    return F.coalesce(normalize_url(url), url)


def engine_domains(log, k: int = 8) -> DataFrame:
    """Per engine its most frequent hosts, with owner (answers with an error count too)."""
    answers = log.window()
    counts = _sources(log, answers, "engine_id").groupBy("project_id", "engine_id", "domain").agg(F.count("*").alias("count"))
    top = top_per_group(counts, ["project_id", "engine_id"], [F.desc("count"), F.asc("domain")], k)
    totals = answers.groupBy("project_id", "engine_id").agg(F.count_if(F.col("error").isNull()).alias("answers"))
    return with_owner(top.join(totals, ["project_id", "engine_id"]), log.entities, ["engine_id", "domain"]).select(
        "project_id", "engine_id", "answers", "rank", "domain", "count", "owner_type", "owner_name"
    )


def top_domains(log, k: int = 10) -> DataFrame:
    """Most frequent hosts per project; the share is per answer without error and can exceed 1."""
    answers = log.window()
    counts = _sources(log, answers).groupBy("project_id", "domain").agg(F.count("*").alias("count"))
    top = top_per_group(counts, ["project_id"], [F.desc("count"), F.asc("domain")], k)
    totals = answers.groupBy("project_id").agg(F.count_if(F.col("error").isNull()).alias("_t"))
    out = with_owner(top.join(totals, "project_id"), log.entities, ["domain"])
    return out.select(
        "project_id", "rank", "domain", "count", F.coalesce(rate(F.col("count"), F.col("_t")), F.lit(0.0)).alias("share"),
        "owner_type", "owner_name",
    )


def competitor_pages(log, k: int = 8) -> DataFrame:
    """Most cited pages per rival, one row per normalised URL; every rival that owns the host counts."""
    # One row per URL spelling before the URL is parsed: the parsing runs on distinct URLs only.
    urls = _sources(log, log.window()).groupBy("project_id", "domain", "url").agg(F.count("*").alias("n"))
    owned = all_owners(urls, log.entities.filter(F.col("entity_type") == "competitor"))
    pages = owned.groupBy("project_id", "entity_id", "name", _page(F.col("url")).alias("page")).agg(
        F.min("url").alias("url"), F.sum("n").alias("count")
    )
    return top_per_group(pages, ["project_id", "entity_id"], [F.desc("count"), F.asc("page")], k).select(
        "project_id", "entity_id", "name", "rank", "page", "url", "count"
    )


def domains_instead(log, k: int = 30) -> DataFrame:
    """Third-party hosts in answers that do not cite the brand."""
    answers = log.window().filter(F.col("error").isNull())
    brand = cited_pairs(log, answers).filter("entity_type = 'brand'")
    # One row per (answer, host): the distinct count becomes a plain count.
    seen = (
        _sources(log, answers, "engine_id")
        .select("result_id", "project_id", "engine_id", "domain")
        .distinct()
        .join(brand.select("result_id", F.lit(True).alias("_b")), "result_id", "left")
    )
    per_engine = seen.groupBy("project_id", "domain", "engine_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("_b").isNull()).alias("w")
    )
    per_domain = per_engine.groupBy("project_id", "domain").agg(
        F.sum("n").alias("answers"),
        F.sum("w").alias("without_brand"),
        F.array_join(F.array_sort(F.collect_set("engine_id")), ",").alias("engines"),
    )
    owned = with_owner(per_domain.filter(F.col("without_brand") > 0), log.entities, ["domain"])
    third = owned.filter(F.coalesce(F.col("owner_type"), F.lit("")) != "brand")
    top = top_per_group(third, ["project_id"], [F.desc("without_brand"), F.desc("answers"), F.asc("domain")], k)
    return top.select(
        "project_id", "rank", "domain", "answers", "without_brand",
        (F.col("answers") > F.col("without_brand")).alias("brand_present"), "engines",
        F.col("owner_type").alias("entity"), F.col("owner_name").alias("entity_name"),
    )


def _brand_sources(log, ranked: bool) -> DataFrame:
    """Source rows on the brand's own hosts, with their page."""
    answers = log.window().select("result_id", "project_id", "prompt_id", "engine_id", "created_at")
    table = log.ranked_of(answers) if ranked else log.sources
    rows = table.join(answers, "result_id")
    owned = all_owners(rows, log.entities.filter(F.col("entity_type") == "brand"))
    return owned.withColumn("page", _page(F.col("url")))


def brand_pages(log, k: int = 50) -> DataFrame:
    """Pages of the brand among the sources: source rows, distinct prompts, engines."""
    rows = _brand_sources(log, ranked=False)
    per_prompt = rows.groupBy("project_id", "page", "prompt_id", "engine_id").agg(
        F.count("*").alias("n"), F.min("url").alias("url")
    )
    pages = per_prompt.groupBy("project_id", "page").agg(
        F.min("url").alias("url"),
        F.sum("n").alias("count"),
        F.count_distinct("prompt_id").alias("prompt_count"),
        F.array_join(F.array_sort(F.collect_set("engine_id")), ",").alias("engines"),
    )
    return top_per_group(pages, ["project_id"], [F.desc("count"), F.asc("page")], k).select(
        "project_id", "rank", "page", "url", "count", "prompt_count", "engines"
    )


def brand_page_citations(log) -> DataFrame:
    """Detail of brand pages, in rows: the first appearance of the page in each answer."""
    rows = _brand_sources(log, ranked=True)
    return rows.groupBy("project_id", "page", "result_id", "prompt_id", "engine_id", "created_at").agg(
        F.min("rank").alias("rank"), F.min_by("cited", "rank").alias("cited")
    )


def url_history(log, urls: DataFrame) -> DataFrame:
    """Appearances of given URLs (project_id, url) among the sources, with their rank.

    Both sides are compared in lower case: an upper-case path still matches.
    """
    wanted = urls.select("project_id", F.regexp_extract(F.lower(normalize_url(F.col("url"))), r"^[^?]*", 0).alias("bare")).distinct()
    answers = log.window().select("result_id", "project_id", "prompt_id", "engine_id", "created_at")
    # Answers that hold one of the URLs first; only their sources are ranked.
    held = log.sources.select("result_id", bare_url(F.col("url")).alias("bare")).join(answers.select("result_id", "project_id"), "result_id")
    holders = answers.join(held.join(wanted, ["project_id", "bare"], "left_semi").select("result_id").distinct(), "result_id", "left_semi")
    rows = log.ranked_of(holders).withColumn("bare", bare_url(F.col("url")))
    return rows.join(answers, "result_id").join(wanted, ["project_id", "bare"]).select(
        "project_id", F.col("bare").alias("page"), "result_id", "prompt_id", "engine_id", "created_at", "rank"
    )


def source_owner(log) -> DataFrame:
    """How many sources belong to the brand, to each rival, or to nobody."""
    counts = _sources(log, log.window()).groupBy("project_id", "domain").agg(F.count("*").alias("n"))
    owned = with_owner(counts, log.entities, ["domain"])
    return owned.groupBy(
        "project_id", F.coalesce("owner_type", F.lit("none")).alias("owner"), F.coalesce("owner_name", F.lit("")).alias("owner_name")
    ).agg(F.sum("n").alias("sources"))


def track_domain_candidates(log) -> DataFrame:
    """Hosts of the sources that could become a tracked rival: not owned, with a readable name."""
    from sightline.functions.urls import name_from_domain

    hosts = _sources(log, log.window()).select("project_id", "domain").distinct()
    owned = with_owner(hosts, log.entities, ["domain"])
    reason = (
        F.when(F.col("owner_type") == "brand", "brand")
        .when(F.col("owner_type") == "competitor", F.concat(F.lit("tracked as "), F.col("owner_name")))
        .otherwise("ok")
    )
    return owned.select("project_id", "domain", reason.alias("verdict"), name_from_domain(F.col("domain")).alias("suggested_name"))



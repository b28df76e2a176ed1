"""Ranks, intervals and duels on top of the metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.urls import normalize_url
from sightline.operators.answers import brand_rates
from sightline.operators.detect import cited_pairs
from sightline.operators.domains import with_owner
from sightline.operators.rates import rate
from sightline.operators.windows import top_per_group


def wilson_bounds(part: Column, whole: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a share; null when there is nothing to divide by."""
    n = F.when(whole > 0, whole.cast("double"))
    p = part / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (middle - half) / scale, (middle + half) / scale


def wilson_interval(log, z: float = 1.96) -> DataFrame:
    """Citation and mention rate of each project on the window, with their intervals."""
    r = brand_rates(log)
    cited, mentioned = (wilson_bounds(F.col(c), F.col("total"), z) for c in ("cited", "mentioned"))
    return r.select(
        "project_id", "total",
        rate(F.col("cited"), F.col("total")).alias("citation_rate"), cited[0].alias("citation_low"), cited[1].alias("citation_high"),
        rate(F.col("mentioned"), F.col("total")).alias("mention_rate"), mentioned[0].alias("mention_low"), mentioned[1].alias("mention_high"),
    )


def mean_citation_rank(log) -> DataFrame:
    """Mean place of each entity among the cited sources of the answers that cite it."""
    ok = log.window().filter(F.col("error").isNull()).select("result_id", "project_id")
    ranks = log.detections.filter("cited").select("result_id", "entity_id", "entity_type", "citation_rank")
    seen = ranks.join(ok, "result_id").groupBy("project_id", "entity_type", "entity_id").agg(
        F.count("*").alias("cited"), F.sum("citation_rank").alias("_sum")
    )
    e = log.entities.select("project_id", "entity_type", "entity_id", "name")
    return e.join(seen, ["project_id", "entity_type", "entity_id"], "left").select(
        "project_id", "entity_type", "entity_id", "name", F.coalesce("cited", F.lit(0)).alias("cited"),
        rate(F.col("_sum"), F.col("cited")).alias("mean_rank"),
    )


def brand_rank_among_domains(log) -> DataFrame:
    """Place of each of the brand's hosts among all hosts of the project's sources, by answers."""
    answers = log.window().select("result_id", "project_id")
    hosts = log.sources.select("result_id", "domain").join(answers, "result_id").distinct()
    counts = hosts.groupBy("project_id", "domain").agg(F.count("*").alias("answers"))
    # Hosts with equal counts share a place, so places follow from the few distinct counts.
    levels = counts.groupBy("project_id", "answers").agg(F.count("*").alias("_hosts"))
    above = W.partitionBy("project_id").orderBy(F.desc("answers")).rowsBetween(W.unboundedPreceding, -1)
    places = levels.select("project_id", "answers", (F.coalesce(F.sum("_hosts").over(above), F.lit(0)) + 1).alias("place"))
    owned = with_owner(counts, log.entities, ["domain"]).filter("owner_type = 'brand'")
    return owned.join(places, ["project_id", "answers"]).select("project_id", "domain", "answers", "place")


def taken_by(log, k: int = 3) -> DataFrame:
    """Per prompt the hosts cited most in answers that do not cite the brand, with their owner."""
    answers = log.window().filter(F.col("error").isNull()).select("result_id", "project_id", "prompt_id", "error")
    brand = cited_pairs(log, answers).filter("entity_type = 'brand'").select("result_id")
    open_ = answers.join(brand, "result_id", "left_anti")
    hosts = log.sources.filter("cited").select("result_id", "domain").join(open_, "result_id").select(
        "project_id", "prompt_id", "result_id", "domain"
    ).distinct()
    counts = hosts.groupBy("project_id", "prompt_id", "domain").agg(F.count("*").alias("answers"))
    top = top_per_group(counts, ["project_id", "prompt_id"], [F.desc("answers"), F.asc("domain")], k)
    return with_owner(top, log.entities, ["prompt_id", "domain"]).select(
        "project_id", "prompt_id", "rank", "domain", "answers", "owner_type", "owner_name"
    )


def competitor_duel(log) -> DataFrame:
    """Brand against each rival: answers that cite both, only one, or neither."""
    answers = log.window().filter(F.col("error").isNull()).select("result_id", "project_id", "error")
    cited = cited_pairs(log, answers).join(answers.select("result_id", "project_id"), "result_id")
    brand = cited.filter("entity_type = 'brand'").select("result_id", "project_id")
    rivals = cited.filter("entity_type = 'competitor'").select("result_id", "project_id", "entity_id")
    by_rival = rivals.join(brand.select("result_id", F.lit(True).alias("_b")), "result_id", "left").groupBy("project_id", "entity_id").agg(
        F.count_if(F.col("_b")).alias("both"), F.count_if(F.col("_b").isNull()).alias("rival_only")
    )
    own = brand.groupBy("project_id").agg(F.count("*").alias("_own"))
    total = answers.groupBy("project_id").agg(F.count("*").alias("_all"))
    e = log.entities.filter("entity_type = 'competitor'").select("project_id", "entity_id", "name")
    j = e.join(by_rival, ["project_id", "entity_id"], "left").join(own, "project_id", "left").join(total, "project_id", "left")
    j = j.fillna(0, ["both", "rival_only", "_own", "_all"])
    return j.select(
        "project_id", "entity_id", "name", "both", "rival_only", (F.col("_own") - F.col("both")).alias("brand_only"),
        (F.col("_all") - F.col("_own") - F.col("rival_only")).alias("neither"),
    )


def _some(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def page_flags() -> dict[str, Column]:
    """Signals of a page record as yes or no, by name, to be held against citations."""
    many = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    count = lambda c, least=1: F.coalesce(F.col(c), F.lit(0)) >= least
    return {
        "description": _some("description"),
        "canonical_self": F.col("canonical_self"),
        "snippet_directive": many("snippet_directives"),
        "structured_data": many("json_ld_types"),
        "person_schema": F.col("person_schema"),
        "organization_schema": F.col("organization_schema"),
        "same_as": many("same_as"),
        "author": _some("author"),
        "dated": _some("date_modified") | _some("date_published"),
        "title_year": F.col("title_year").isNotNull(),
        "question_headings": count("h2_questions"),
        "entity_headings": count("h2_entities"),
        "lists": count("lists_count"),
        "tables": count("tables_count"),
        "numbers": count("numbers_count", 5),
        "quotes": count("quote_count"),
        "faq": F.col("has_faq"),
        "summary_block": F.col("has_summary_block"),
        "outbound_links": count("outbound_links"),
        "about_contact_links": F.col("about_contact_links"),
        "brand_consistent": F.col("brand_consistent"),
        "contact_form": F.col("contact_form"),
        "long_text": count("word_count", 300),
        "script_rendered": F.col("js_suspect"),
    }


def cited_pages(log) -> DataFrame:
    """``page, engine_id, cited``: pages that answers of the window have as a source, and whether one cites it."""
    answers = log.window().select("result_id", "engine_id")
    return log.sources.join(answers, "result_id").groupBy("engine_id", normalize_url(F.col("url")).alias("page")).agg(
        F.max("cited").alias("cited")
    )


def signal_calibration(pages: DataFrame, cited: DataFrame, signals: dict[str, Column] | list[str]) -> DataFrame:
    """Per engine and signal: share of cited pages among those that have the signal and those that do not.

    pages: one record per ``page``; signals: conditions on it by name, or names of boolean
    columns; an unknown signal counts as absent. cited: ``page, engine_id, cited``.
    """
    tests = signals if isinstance(signals, dict) else {s: F.col(s) for s in signals}
    flags = pages.select("page", *[F.coalesce(test, F.lit(False)).alias(f"_f{i}") for i, test in enumerate(tests.values())])
    # Per engine, one pass counts all signals: a row per page and signal is never made.
    met = cited.join(flags, "page").groupBy("engine_id").agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("cited")).alias("_c"),
        F.array(*[_met(name, F.col(f"_f{i}")) for i, name in enumerate(tests)]).alias("_signals"),
    )
    each = met.select("engine_id", "_n", "_c", F.explode("_signals").alias("s"))
    has = F.struct(F.lit(True).alias("has"), F.col("s.n").alias("n"), F.col("s.cited").alias("cited"))
    lacks = F.struct(F.lit(False).alias("has"), (F.col("_n") - F.col("s.n")).alias("n"), (F.col("_c") - F.col("s.cited")).alias("cited"))
    sides = each.select("engine_id", F.col("s.signal").alias("signal"), F.explode(F.array(has, lacks)).alias("side")).where("side.n > 0")
    return sides.select(
        "engine_id", "signal", F.col("side.has").alias("has_signal"), F.col("side.n").alias("n"),
        (F.col("side.cited") / F.col("side.n")).alias("cited_share"),
    )


def _met(name: str, flag: Column) -> Column:
    return F.struct(F.lit(name).alias("signal"), F.count_if(flag).alias("n"), F.count_if(flag & F.col("cited")).alias("cited"))

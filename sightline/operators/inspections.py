"""Inspections: one URL tested with several questions on several engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.functions.pricing import exact_sum
from sightline.functions.text import find_term, normalize_text
from sightline.functions.urls import host_suffixes, normalize_domain, normalize_url, url_matches
from sightline.operators.domains import all_owners, tracked_domains, with_owner
from sightline.operators.term_index import holding
from sightline.operators.windows import top_per_group


def answer_sources(log) -> DataFrame:
    """Sources of inspection answers, with the target page of the inspection."""
    targets = log.inspections.select("inspection_id", normalize_url(F.col("url")).alias("target"))
    cells = log.inspection_answers.select("inspection_id", "project_id", "question_index", "engine_id", "result_id", "error")
    return cells.join(targets, "inspection_id")


def _marked(ranked: DataFrame, cells: DataFrame, brands: DataFrame) -> DataFrame:
    """Sources of inspection answers beside their cells: is each the target page (``on_url``), is its host the brand's (``on_site``).

    A brand's own hosts are a short list by design and go along with its project, so the sources are read once for both.
    """
    own = tracked_domains(brands).groupBy("project_id").agg(F.collect_set("suffix").alias("_own"))
    rows = ranked.join(cells, "result_id").join(F.broadcast(own), "project_id", "left")
    on_site = F.coalesce(F.arrays_overlap(host_suffixes(F.col("domain")), F.col("_own")), F.lit(False))
    return rows.withColumns({"on_url": url_matches(F.col("url"), F.col("target")), "on_site": on_site}).drop("_own")


def answer_flags(log) -> DataFrame:
    """Per inspection answer: is the URL cited (rank), its site cited (rank), either retrieved."""
    cells = answer_sources(log)
    brands = log.entities.filter(F.col("entity_type") == "brand")

    ranked = log.inspection_ranked_of(cells).select("result_id", "rank", "cited_rank", "domain", "url")
    rows = _marked(ranked, cells.select("result_id", "project_id", "target"), brands)
    first = lambda mark, rank: F.min(F.when(F.col(mark), F.col(rank)))
    found = rows.filter("on_url or on_site").groupBy("result_id").agg(
        first("on_url", "cited_rank").alias("url_rank"), first("on_url", "rank").alias("url_seen"),
        first("on_site", "cited_rank").alias("domain_rank"), first("on_site", "rank").alias("domain_seen"),
    )
    out = cells.join(found, "result_id", "left")
    return out.select(
        "inspection_id", "project_id", "question_index", "engine_id", "result_id", "error",
        F.col("url_rank").isNotNull().alias("url_cited"), "url_rank",
        F.col("domain_rank").isNotNull().alias("domain_cited"), "domain_rank",
        F.col("url_seen").isNotNull().alias("url_retrieved"),
        F.col("domain_seen").isNotNull().alias("domain_retrieved"),
    )


def _rival_seen(log, cells: DataFrame) -> DataFrame:
    """Answers with a rival among any of their sources, retrieved-only ones included."""
    rivals = log.entities.filter(F.col("entity_type") == "competitor")
    rows = log.inspection_sources.select("result_id", "domain").join(cells.select("result_id", "project_id"), "result_id")
    return all_owners(rows, rivals).select("result_id").distinct()


def _kind(error: Column, url: Column, domain: Column, rival: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(url, "url").when(domain, "domain").when(rival, "competitor").otherwise("none")


def cell_kinds(log) -> DataFrame:
    """State of every question x engine cell of every inspection; pending without an answer."""
    flags = answer_flags(log)
    rivals = _rival_seen(log, flags).withColumn("_rival", F.lit(True))
    done = flags.join(rivals, "result_id", "left").select(
        "inspection_id", "question_index", "engine_id",
        _kind(F.col("error"), F.col("url_cited"), F.col("domain_cited"), F.coalesce("_rival", F.lit(False))).alias("_kind"),
    )
    return task_grid(log).join(done, ["inspection_id", "question_index", "engine_id"], "left").select(
        "inspection_id", "question_index", "engine_id", F.coalesce("_kind", F.lit("pending")).alias("kind")
    )


def task_grid(log) -> DataFrame:
    """Questions x engines of each inspection."""
    q = log.inspection_questions.select("inspection_id", "question_index", "project_id")
    return q.join(log.project_engines.select("project_id", "engine_id"), "project_id")


def planned_tasks(log) -> DataFrame:
    return task_grid(log).groupBy("inspection_id", "project_id").agg(F.count("*").alias("planned"))


def verdict(log) -> DataFrame:
    """Counts per inspection on an exclusive ladder: URL, other page of the site, rival only, errors."""
    k = cell_kinds(log).filter(F.col("kind") != "pending")
    n = {name: F.count_if(F.col("kind") == name) for name in ("url", "domain", "competitor", "error")}
    return k.groupBy("inspection_id").agg(
        F.count_if(F.col("kind") != "error").alias("ok"),
        n["url"].alias("url_cited"), n["domain"].alias("domain_only"), n["competitor"].alias("competitor_only"), n["error"].alias("errors"),
    )


def inspection_summaries(log) -> DataFrame:
    """Every inspection with the summary of its answers, zero without any."""
    s = answer_flags(log).groupBy("inspection_id").agg(
        F.count_if(F.col("error").isNull()).alias("ok"),
        F.count_if(F.col("url_cited")).alias("url_cited"),
        F.count_if(F.col("domain_cited") & ~F.col("url_cited")).alias("domain_cited"),
    )
    return log.inspections.select("inspection_id", "project_id", "url", "created_at", "status").join(
        s, "inspection_id", "left"
    ).fillna(0, ["ok", "url_cited", "domain_cited"])


def cited_instead(log, k: int = 8) -> DataFrame:
    """Hosts in the answers that do not cite the URL, one count per answer, with owner."""
    open_answers = answer_flags(log).filter(F.col("error").isNull() & ~F.col("url_cited"))
    hosts = (
        log.inspection_sources.select("result_id", normalize_domain(F.col("domain")).alias("domain"))
        .join(open_answers.select("result_id", "inspection_id", "project_id"), "result_id")
        .filter(F.col("domain") != "")
        .distinct()
    )
    counts = hosts.groupBy("inspection_id", "project_id", "domain").agg(F.count("*").alias("count"))
    top = top_per_group(counts, ["inspection_id"], [F.desc("count"), F.asc("domain")], k)
    return with_owner(top, log.entities, ["inspection_id", "domain"]).select(
        "inspection_id", "rank", "domain", "count", "owner_type", "owner_name"
    )


def comparison_candidates(log, k: int = K.MAX_COMPARISON_PAGES, per_answer: int = 3) -> DataFrame:
    """Top k pages cited in place of the URL, by number of questions: the first ``per_answer`` third-party
    sources of each answer count."""
    cells = answer_sources(log)
    own = log.entities.filter(F.col("entity_type") == "brand")
    cited = log.inspection_ranked_of(cells).filter("cited").select("result_id", "rank", "domain", "url")
    # The sources are numbered and joined once: what one of them tells of its answer is told to the others of the answer.
    rows = _marked(cited, cells, own).withColumns({
        "_url_cited": F.max("on_url").over(W.partitionBy("result_id")),
        "_own": F.max(F.col("on_site") & F.col("error").isNull()).over(W.partitionBy("result_id", "rank")),
    })
    third = rows.filter(F.col("error").isNull() & ~F.col("_url_cited") & ~F.col("_own")).withColumn(
        "page", F.coalesce(normalize_url(F.col("url")), F.col("url"))
    ).filter(F.col("page") != F.col("target"))
    first = top_per_group(third, ["result_id"], [F.asc("rank")], per_answer, rank="_r")
    pages = first.groupBy("inspection_id", "page").agg(
        F.min("url").alias("url"),
        F.count_distinct("question_index").alias("questions"),
        # Bounded by the number of engines.
        F.array_join(F.array_sort(F.collect_set("engine_id")), ",").alias("engines"),
    )
    return top_per_group(pages, ["inspection_id"], [F.desc("questions"), F.asc("page")], k).select(
        "inspection_id", "rank", "page", "url", "questions", "engines"
    )


def inspections_cost_since(log, since: Column) -> DataFrame:
    return log.inspections.filter(F.col("created_at") >= since).groupBy("project_id").agg(exact_sum(F.col("cost_usd")).alias("cost_usd"))


def inspection_quota(log, day_start: Column) -> DataFrame:
    """Running inspections and inspections of the day per project, against the daily cap."""
    n = log.inspections.groupBy("project_id").agg(
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("created_at") >= day_start).alias("today"),
    )
    caps = log.projects.select("project_id", "inspections_per_day")
    return caps.join(n, "project_id", "left").fillna(0, ["running", "today"]).withColumn(
        "allowed", (F.col("running") == 0) & (F.col("today") < F.col("inspections_per_day"))
    )


def answer_value(url: Column, domain: Column, retrieved: Column, mentioned: Column) -> Column:
    return F.when(url, 1.0).when(domain, 0.6).when(retrieved, 0.4).when(mentioned, 0.3).otherwise(0.0)


def _scored_answers(log) -> DataFrame:
    from sightline.operators.detect import mention_pairs

    flags = answer_flags(log).filter(F.col("error").isNull())
    brands = log.entities.filter(F.col("entity_type") == "brand").withColumn("domains", F.array().cast("array<string>"))
    said = mention_pairs(flags, log.inspection_texts_of(flags), brands).select("result_id", F.lit(True).alias("_m"))
    j = flags.join(said, "result_id", "left").withColumn("mentioned", F.coalesce("_m", F.lit(False)))
    return j.withColumn("retrieved", F.col("url_retrieved") | F.col("domain_retrieved")).withColumn(
        "value", answer_value(F.col("url_cited"), F.col("domain_cited"), F.col("retrieved"), F.col("mentioned"))
    )


def result_per_engine(log) -> DataFrame:
    """Mean value and exclusive tallies of the answers, per inspection and engine."""
    a = _scored_answers(log)
    url, site, seen = F.col("url_cited"), F.col("domain_cited"), F.col("retrieved")
    return a.groupBy("inspection_id", "engine_id").agg(
        F.count("*").alias("answers"),
        (F.sum(F.col("value").cast("decimal(4,1)")).cast("double") / F.count("*")).alias("value"),
        F.count_if(url).alias("cited"),
        F.count_if(~url & site).alias("domain_cited"),
        F.count_if(~url & ~site & seen).alias("retrieved"),
        F.count_if(~url & ~site & ~seen & F.col("mentioned")).alias("mentioned"),
    )


def result_score(log) -> DataFrame:
    """Result block out of 40: the mean of the engine means, with its confidence."""
    e = result_per_engine(log).groupBy("inspection_id").agg(
        exact_sum(F.col("value")).alias("_s"), F.count("*").alias("engines"), F.sum("answers").alias("answers")
    )
    return e.select(
        "inspection_id", "engines", "answers",
        F.floor(F.col("_s") / F.col("engines") * K.RESULT_WEIGHT + 0.5).alias("result"),
        F.when(F.col("answers") < 5, "low").when(F.col("answers") < 10, "medium").otherwise("high").alias("confidence"),
    )


def forbidden_terms(entities: DataFrame, min_length: int = 3) -> DataFrame:
    """Terms a neutral question must not name, in list order: brand, its domains and their first label, rivals."""
    brand = F.col("entity_type") == "brand"
    with_labels = F.flatten(F.transform("domains", lambda d: F.array(d, F.substring_index(d, ".", 1))))
    terms = F.concat("terms", F.when(brand, with_labels).otherwise(F.col("domains")))
    return (
        entities.select("project_id", "ordinal", F.posexplode(terms).alias("no", "term"))
        .withColumn("term", F.trim("term"))
        .filter(F.length("term") >= min_length)
        .withColumn("bare", F.trim(normalize_text(F.col("term"))))
    )


def neutrality_violations(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """First forbidden term each question names, null when it is neutral. ``questions``: (question_id, project_id, text)."""
    q = questions.select("question_id", "project_id", normalize_text(F.col("text")).alias("body"))
    hits = holding(q, forbidden_terms(entities).withColumn("is_term", F.lit(True)), "question_id").filter(find_term(F.col("body"), F.col("term")) >= 0)
    first = hits.groupBy("question_id").agg(F.min_by("term", F.struct("ordinal", "no")).alias("term"))
    return questions.select("question_id", "project_id").join(first, "question_id", "left")


def valid_questions(questions: DataFrame) -> DataFrame:
    """Per group of questions: how many are long enough, and whether the group is accepted (1 to 5)."""
    n = questions.groupBy("group_id").agg(
        F.count("*").alias("questions"), F.count_if(F.length(F.trim("text")) >= K.MIN_QUESTION_LENGTH).alias("valid")
    )
    return n.withColumn("accepted", F.col("valid").between(1, K.MAX_QUESTIONS))

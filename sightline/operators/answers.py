"""Metrics over answers: rates, shares of voice, themes, series.

Every function takes an answer log and returns one lazy DataFrame for all
projects at once; a single project is a filter on ``project_id``, which Spark
pushes down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.functions.dates import local_day
from sightline.functions.pricing import exact_sum
from sightline.operators.detect import brand_flags, cited_pairs, entity_flags
from sightline.operators.rates import euros, percent, points, rate, status, theme_order, themes
from sightline.operators.windows import exact_median, ordinal, top_per_group


def _brand(log, answers: DataFrame) -> DataFrame:
    return brand_flags(log, answers)


def _ok(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("error").isNull())


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def _sizes(log, answers: DataFrame, name: str) -> DataFrame:
    """Number of sources of each of some answers."""
    inside = log.sources.select("result_id").join(answers.select("result_id"), "result_id", "left_semi")
    return inside.groupBy("result_id").agg(F.count("*").alias(name))


def brand_rates(log) -> DataFrame:
    """Answers without error, cited and mentioned, per project on the window."""
    return _brand(log, _ok(log.window())).groupBy("project_id").agg(
        F.count("*").alias("total"), _n(F.col("cited")).alias("cited"), _n(F.col("mentioned")).alias("mentioned")
    )


def month_start(now: Column, zone: str) -> Column:
    """Start of the calendar month of a moment in a time zone, as UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), now)
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_trunc("MONTH", local).cast("timestamp_ntz"))


def overview(log, zone: str = K.DEFAULT_TIME_ZONE) -> DataFrame:
    """Headline figures per project: answers of both periods in one pass, and the month's costs."""
    cur, ok = log.in_current(), F.col("error").isNull()
    b = _brand(log, log.window(2)).groupBy("project_id").agg(
        _n(cur & ok).alias("answers"),
        _n(cur & ok & F.col("cited")).alias("_cc"),
        _n(cur & ok & F.col("mentioned")).alias("_cm"),
        _n(~cur & ok).alias("_pt"),
        _n(~cur & ok & F.col("cited")).alias("_pc"),
        _n(~cur & ok & F.col("mentioned")).alias("_pm"),
    )
    answers = _ok(log.window())
    pairs = cited_pairs(log, answers)
    sov = pairs.join(answers.select("result_id", "project_id"), "result_id").groupBy("project_id").agg(
        _n(F.col("entity_type") == "brand").alias("_brand"), F.count("*").alias("_all")
    )
    return headline(log, b, sov, zone)


def headline(log, counts: DataFrame, voice: DataFrame, zone: str) -> DataFrame:
    """Rates and changes from a project's counts of both periods and its citations, with the month's costs."""
    month = month_start(log.now, zone)
    runs = log.runs.filter(F.col("started_at") >= month).groupBy("project_id").agg(exact_sum(F.col("cost_usd")).alias("_runs"))
    insp = log.inspections.filter(F.col("created_at") >= month).groupBy("project_id").agg(exact_sum(F.col("cost_usd")).alias("_insp"))
    j = counts.join(voice, "project_id", "left").join(runs, "project_id", "left").join(insp, "project_id", "left")
    zero = F.lit(0.0)
    c, m = rate(F.col("_cc"), F.col("answers")), rate(F.col("_cm"), F.col("answers"))
    return j.select(
        "project_id",
        "answers",
        c.alias("citation_rate"),
        m.alias("mention_rate"),
        rate(F.col("_brand"), F.col("_all")).alias("share_of_voice"),
        points(c, rate(F.col("_pc"), F.col("_pt"))).alias("citation_delta"),
        points(m, rate(F.col("_pm"), F.col("_pt"))).alias("mention_delta"),
        euros(F.coalesce("_runs", zero)).alias("cost_runs_eur"),
        euros(F.coalesce("_insp", zero)).alias("cost_inspections_eur"),
        euros(F.coalesce("_runs", zero) + F.coalesce("_insp", zero)).alias("cost_month_eur"),
    )


def engine_rates(log) -> DataFrame:
    """Per project and engine on the window: answers without error, verdicts, cost with errors."""
    return _brand(log, log.window()).groupBy("project_id", "engine_id").agg(
        _n(F.col("error").isNull()).alias("total"),
        _n(F.col("cited")).alias("cited"),
        _n(F.col("mentioned")).alias("mentioned"),
        exact_sum(F.col("cost_usd")).alias("cost_usd"),
    )


def engine_cards(log) -> DataFrame:
    """One row per project and engine, with the change against the previous period."""
    cur, ok = log.in_current(), F.col("error").isNull()
    agg = _brand(log, log.window(2)).groupBy("project_id", "engine_id").agg(
        _n(cur & ok).alias("_t"),
        _n(cur & F.col("cited")).alias("_c"),
        _n(cur & F.col("mentioned")).alias("_m"),
        exact_sum(F.when(cur, F.col("cost_usd"))).alias("_usd"),
        _n(~cur & ok).alias("_pt"),
        _n(~cur & F.col("cited")).alias("_pc"),
        _n(~cur & F.col("mentioned")).alias("_pm"),
    )
    c, m = rate(F.col("_c"), F.col("_t")), rate(F.col("_m"), F.col("_t"))
    return log.project_engines.join(agg, ["project_id", "engine_id"], "left").select(
        "project_id", "engine_id", "label", "model", "provider", "enabled",
        F.coalesce("_t", F.lit(0)).alias("answers"),
        c.alias("citation_rate"),
        m.alias("mention_rate"),
        points(c, rate(F.col("_pc"), F.col("_pt"))).alias("citation_delta"),
        points(m, rate(F.col("_pm"), F.col("_pt"))).alias("mention_delta"),
        euros(F.coalesce("_usd", F.lit(0.0))).alias("cost_eur"),
    )


def share_of_voice(log) -> DataFrame:
    """Brand and rivals of each project: counts, rates over all answers of the project, share of citations."""
    cur = log.in_current()
    answers = _ok(log.window(2))
    totals = answers.groupBy("project_id").agg(_n(cur).alias("answers"), _n(~cur).alias("_prev"))
    seen = entity_flags(log, answers).join(
        answers.select("result_id", "project_id", "prompt_id", "created_at"), "result_id"
    )
    counts = seen.groupBy("project_id", "entity_id").agg(
        _n(cur & F.col("cited")).alias("cited"),
        _n(cur & F.col("mentioned")).alias("mentioned"),
        _n(~cur & F.col("cited")).alias("_pc"),
        F.count_distinct(F.when(cur, F.col("prompt_id"))).alias("prompt_count"),
    )
    return voices(log, totals, counts)


def voices(log, totals: DataFrame, counts: DataFrame) -> DataFrame:
    """Every entity of each project with its rates, from the project's answers and the entity's counts."""
    j = (
        log.entities.select("project_id", "entity_id", "entity_type", "name")
        .join(totals, "project_id", "left")
        .join(counts, ["project_id", "entity_id"], "left")
        .fillna(0, ["answers", "_prev", "cited", "mentioned", "_pc", "prompt_count"])
    )
    citation = rate(F.col("cited"), F.col("answers"))
    return j.select(
        "project_id", "entity_type", "entity_id", "name", "answers", "cited", "mentioned",
        citation.alias("citation_rate"),
        rate(F.col("mentioned"), F.col("answers")).alias("mention_rate"),
        points(citation, rate(F.col("_pc"), F.col("_prev"))).alias("citation_delta"),
        rate(F.col("cited"), F.sum("cited").over(W.partitionBy("project_id"))).alias("share"),
        "prompt_count",
    )


def _uncontested(log) -> DataFrame:
    """Cited rivals in answers that do not cite the brand: (result, entity) with the answer's columns."""
    answers = _ok(log.window())
    cited = cited_pairs(log, answers)
    rivals = cited.filter(F.col("entity_type") == "competitor").select("result_id", "entity_id")
    brand = cited.filter(F.col("entity_type") == "brand").select("result_id")
    return rivals.join(brand, "result_id", "left_anti").join(
        answers.select("result_id", "project_id", "prompt_id"), "result_id"
    )


def quick_opportunities(log, k: int = 5) -> DataFrame:
    """Top prompts where a rival is cited without the brand, with the rivals and their answers."""
    pairs = _uncontested(log)
    answers = pairs.select("project_id", "prompt_id", "result_id").distinct().groupBy("project_id", "prompt_id").agg(
        F.count("*").alias("answers")
    )
    names = log.entities.select("project_id", "entity_id", "name")
    # At most one entry per rival of the project, so the list stays short.
    rivals = (
        pairs.groupBy("project_id", "prompt_id", "entity_id")
        .agg(F.count("*").alias("n"))
        .join(names, ["project_id", "entity_id"], "left")
        .groupBy("project_id", "prompt_id")
        .agg(
            F.count("*").alias("competitor_count"),
            F.array_sort(
                F.collect_list(F.struct((-F.col("n")).alias("key"), "entity_id", F.coalesce("name", F.lit(K.UNKNOWN_COMPETITOR)).alias("name"), "n"))
            ).alias("_r"),
        )
    )
    top = top_per_group(
        answers.join(rivals, ["project_id", "prompt_id"]),
        ["project_id"],
        [F.desc("answers"), F.desc("competitor_count"), F.asc("prompt_id")],
        k,
    )
    return top.join(log.prompts.select("prompt_id", "text", "tags"), "prompt_id").select(
        "project_id", "rank", "prompt_id", "text", F.array_join("tags", ",").alias("tags"), "answers", "competitor_count",
        F.array_join(F.transform("_r", lambda r: F.concat(r["name"], F.lit(":"), r["n"].cast("string"))), ",").alias("competitors"),
    )


def prompt_engine_rates(log) -> DataFrame:
    return _brand(log, _ok(log.window())).groupBy("project_id", "prompt_id", "engine_id").agg(
        F.count("*").alias("total"), _n(F.col("cited")).alias("cited"), _n(F.col("mentioned")).alias("mentioned")
    )


def engine_theme_matrix(log) -> DataFrame:
    """Long form of the theme x engine matrix; a prompt counts in each of its themes."""
    rows = prompt_engine_rates(log).join(log.prompts.select("prompt_id", "tags"), "prompt_id")
    return (
        rows.withColumn("theme", F.explode(themes(F.col("tags"))))
        .groupBy("project_id", "theme", "engine_id")
        .agg(F.sum("total").alias("total"), F.sum("cited").alias("cited"), F.sum("mentioned").alias("mentioned"))
    )


def theme_summary(log) -> DataFrame:
    """One row per theme: all prompts, answers, rates, and the figures per engine as a short list."""
    prompts = log.prompts.withColumn("theme", F.explode(themes(F.col("tags")))).groupBy("project_id", "theme").agg(
        F.count("*").alias("prompt_count")
    )
    cell = F.concat_ws(":", "engine_id", F.col("total").cast("string"), F.col("cited").cast("string"), F.col("mentioned").cast("string"))
    measured = engine_theme_matrix(log).groupBy("project_id", "theme").agg(
        F.sum("total").alias("answers"),
        F.sum("cited").alias("_c"),
        F.sum("mentioned").alias("_m"),
        F.array_join(F.array_sort(F.collect_list(cell)), ";").alias("engines"),
    )
    j = prompts.join(measured, ["project_id", "theme"], "full_outer")
    return j.select(
        "project_id",
        "theme",
        F.coalesce("prompt_count", F.lit(0)).alias("prompt_count"),
        F.coalesce("answers", F.lit(0)).alias("answers"),
        rate(F.col("_c"), F.col("answers")).alias("citation_rate"),
        rate(F.col("_m"), F.col("answers")).alias("mention_rate"),
        F.coalesce("engines", F.lit("")).alias("engines"),
    )


def theme_summary_ordered(log) -> DataFrame:
    """Themes of each project in display order: best citation rate first, no-theme last."""
    t = theme_summary(log)
    last, by_name, by_raw = theme_order(F.col("theme"))
    w = W.partitionBy("project_id").orderBy(last, F.coalesce("citation_rate", F.lit(-1.0)).desc(), by_name, by_raw)
    return t.select("project_id", "theme", F.row_number().over(w).alias("position"))


def engine_stats(log) -> DataFrame:
    """Latency, cost, sources and errors per project and engine."""
    answers = log.window()
    sizes = _sizes(log, answers, "n_sources")
    a = answers.join(sizes, "result_id", "left").fillna(0, ["n_sources"])
    ok = F.col("error").isNull()
    g = a.groupBy("project_id", "engine_id").agg(
        _n(ok).alias("answers"),
        _n(~ok).alias("errors"),
        exact_sum(F.when(ok, F.col("cost_usd"))).alias("_usd"),
        F.sum(F.when(ok, F.col("n_sources"))).alias("_src"),
        _n(ok & (F.col("n_sources") > 0)).alias("_with"),
    )
    median = exact_median(answers.filter(ok), ["project_id", "engine_id"], "latency_ms", "_median")
    return g.join(median, ["project_id", "engine_id"], "left").select(
        "project_id", "engine_id", "answers", "errors",
        F.floor(F.col("_median") + 0.5).alias("median_latency_ms"),
        euros(F.when(F.col("answers") > 0, F.col("_usd") / F.col("answers"))).alias("avg_cost_eur"),
        rate(F.col("_src"), F.col("answers")).alias("avg_sources"),
        rate(F.col("_with"), F.col("answers")).alias("with_sources_rate"),
    )


def share_of_voice_series(log, zone: str = K.DEFAULT_TIME_ZONE) -> DataFrame:
    """Citations per local day and entity; every tracked entity appears on a day that has answers."""
    answers = _ok(log.window()).withColumn("day", local_day(F.col("created_at"), zone))
    days = answers.select("project_id", "day").distinct()
    cited = cited_pairs(log, answers)
    counts = cited.join(answers.select("result_id", "project_id", "day"), "result_id").groupBy("project_id", "day", "entity_id").agg(
        F.count("*").alias("cited")
    )
    grid = days.join(log.entities.select("project_id", "entity_id", "entity_type", "name"), "project_id")
    return grid.join(counts, ["project_id", "day", "entity_id"], "left").select(
        "project_id", "day", "entity_type", "entity_id", "name", F.coalesce("cited", F.lit(0)).alias("cited")
    )


def sov_daily_share(log) -> DataFrame:
    """Share of each entity in the citations of a day, in percent; null on a day without any."""
    s = share_of_voice_series(log)
    day = W.partitionBy("project_id", "day")
    return s.select("project_id", "day", "entity_id", percent(F.col("cited"), F.sum("cited").over(day)).alias("share"))


def time_series(log, zone: str = K.DEFAULT_TIME_ZONE) -> DataFrame:
    b = _brand(log, _ok(log.window())).withColumn("day", local_day(F.col("created_at"), zone))
    return b.groupBy("project_id", "day", "engine_id").agg(
        F.count("*").alias("total"), _n(F.col("cited")).alias("cited"), _n(F.col("mentioned")).alias("mentioned")
    )


def trend_pivot(log, engines: list[str], metric: str = "cited") -> DataFrame:
    """One row per day, one column per engine, rate in percent with one decimal."""
    t = time_series(log).withColumn("share", percent(F.col(metric), F.col("total")))
    return t.groupBy("project_id", "day").pivot("engine_id", engines).agg(F.first("share"))


def _by_status(log, answers: DataFrame) -> DataFrame:
    return _brand(log, answers).withColumn("status", status(F.col("error"), F.col("cited"), F.col("mentioned")))


def answer_status(log) -> DataFrame:
    """Answers of the window by status, per project and engine."""
    return _by_status(log, log.window()).groupBy("project_id", "engine_id", "status").agg(F.count("*").alias("answers"))


def prompt_positions(log) -> DataFrame:
    """Place of every prompt in its project's list: active ones first, then the newest.

    Numbered by slices of (active, day), so a project with very many prompts is no single sort.
    Unknown activity and an unknown time come last.
    """
    order = [F.desc("active"), F.desc("created_at"), F.asc("prompt_id")]
    # Slices in the order of the list: counted backwards, as later days come first.
    slices = [F.coalesce((~F.col("active")).cast("int"), F.lit(2)), F.coalesce(-F.unix_date(F.to_date("created_at")), F.lit(2**31 - 1))]
    listed = log.prompts.select("project_id", "prompt_id", "active", "created_at")
    return ordinal(listed, ["project_id"], order, "position", slices)


def prompt_matrix(log) -> DataFrame:
    """Every prompt in display order with its latest answer per engine over all time (errors included) and
    its citation rate on the window; a prompt without answers has one row with an empty cell."""
    latest = log.results.groupBy("prompt_id", "engine_id").agg(
        F.max_by(F.struct("result_id", "error"), F.struct("created_at", "result_id")).alias("a")
    )
    cells = _by_status(log, latest.select("prompt_id", "engine_id", "a.*")).select("prompt_id", "engine_id", "result_id", "status")
    rates = _brand(log, _ok(log.window())).groupBy("prompt_id").agg(
        F.count("*").alias("_t"), _n(F.col("cited")).alias("_c")
    )
    return prompt_positions(log).join(cells, "prompt_id", "left").join(rates, "prompt_id", "left").select(
        "project_id", "position", "prompt_id", "engine_id", "result_id", "status", rate(F.col("_c"), F.col("_t")).alias("citation_rate")
    )


def prompt_history(log) -> DataFrame:
    """Every answer of every prompt on the window, with status and the rivals cited in it."""
    answers = log.window()
    cited = cited_pairs(log, _ok(answers)).filter("entity_type = 'competitor'")
    names = log.entities.select("entity_id", "name").distinct()
    # At most one entry per rival of the project.
    rivals = cited.join(names, "entity_id", "left").groupBy("result_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.coalesce("name", F.lit(K.UNKNOWN_COMPETITOR)))), ",").alias("competitors")
    )
    sizes = _sizes(log, answers, "sources_count")
    return (
        _by_status(log, answers)
        .join(rivals, "result_id", "left")
        .join(sizes, "result_id", "left")
        .select(
            "result_id", "run_id", "project_id", "prompt_id", "engine_id", "created_at", "status", "cited", "mentioned", "error",
            F.coalesce("sources_count", F.lit(0)).alias("sources_count"), "latency_ms",
            euros(F.col("cost_usd")).alias("cost_eur"),
            F.coalesce("competitors", F.lit("")).alias("competitors"),
        )
    )


def prompt_competitors(log) -> DataFrame:
    """Rivals per prompt: cited and mentioned answers, zero when never seen."""
    answers = _ok(log.window())
    rivals = log.entities.filter(F.col("entity_type") == "competitor")
    seen = entity_flags(log, answers).filter("entity_type = 'competitor'").join(answers.select("result_id", "prompt_id"), "result_id")
    counts = seen.groupBy("prompt_id", "entity_id").agg(
        _n(F.col("cited")).alias("cited"), _n(F.col("mentioned")).alias("mentioned")
    )
    totals = answers.groupBy("prompt_id").agg(F.count("*").alias("answers"))
    grid = log.prompt_projects.join(rivals.select("project_id", "entity_id", "name"), "project_id")
    return (
        grid.join(counts, ["prompt_id", "entity_id"], "left")
        .join(totals, "prompt_id", "left")
        .fillna(0, ["cited", "mentioned", "answers"])
        .select("project_id", "prompt_id", "entity_id", "name", "cited", "mentioned", "answers")
    )


def prompt_scorecard(log) -> DataFrame:
    """Per prompt: answers without error, cited, mentioned, and the number of rivals seen."""
    answers = _ok(log.window())
    own = _brand(log, answers).groupBy("project_id", "prompt_id").agg(
        F.count("*").alias("ok"), _n(F.col("cited")).alias("cited"), _n(F.col("mentioned")).alias("mentioned")
    )
    rivals = log.entities.filter(F.col("entity_type") == "competitor")
    seen = entity_flags(log, answers).filter("entity_type = 'competitor'").join(answers.select("result_id", "prompt_id"), "result_id")
    rival_count = seen.groupBy("prompt_id").agg(F.count_distinct("entity_id").alias("rivals"))
    return own.join(rival_count, "prompt_id", "left").fillna(0, ["rivals"])


def prompt_timeline(log) -> DataFrame:
    """Chronology per prompt and engine as rows, with the cited share of its answers.

    The chronology stays in rows: sort by ``created_at`` to display it.
    """
    s = _by_status(log, log.window())
    totals = s.groupBy("prompt_id", "engine_id").agg(
        F.count("*").alias("answers"), _n(F.col("status") == "cited").alias("cited_answers")
    )
    rows = s.select("prompt_id", "engine_id", "result_id", "created_at", "status")
    return rows.join(totals, ["prompt_id", "engine_id"])


def competitor_overlap(log, k: int = 8) -> DataFrame:
    """Per rival, the prompts where it is cited without the brand."""
    counts = _uncontested(log).groupBy("project_id", "entity_id", "prompt_id").agg(F.count("*").alias("answers"))
    top = top_per_group(counts, ["project_id", "entity_id"], [F.desc("answers"), F.asc("prompt_id")], k)
    return top.join(log.prompts.select("prompt_id", "text"), "prompt_id").join(
        log.entities.select("project_id", "entity_id", "name"), ["project_id", "entity_id"]
    ).select("project_id", "entity_id", "name", "rank", "prompt_id", "text", "answers")


def prompts_without_brand(log) -> DataFrame:
    """Prompts with answers that never cite the brand, and the rivals cited on them.

    The rivals come from every answer of the prompt on the window; detections
    exist for answers without error only.
    """
    answers = _ok(log.window())
    own = _brand(log, answers).groupBy("project_id", "prompt_id").agg(
        F.count("*").alias("answers"), _n(F.col("cited")).alias("_c"), _n(F.col("mentioned")).alias("mentioned")
    )
    never = own.filter(F.col("_c") == 0).drop("_c")
    cited = cited_pairs(log, answers).filter("entity_type = 'competitor'")
    names = log.entities.select("entity_id", "name").distinct()
    rivals = (
        cited.join(answers.select("result_id", "prompt_id"), "result_id")
        .select("prompt_id", "entity_id")
        .distinct()
        .join(names, "entity_id", "left")
        .groupBy("prompt_id")
        .agg(F.array_sort(F.collect_set(F.coalesce("name", F.lit(K.UNKNOWN_COMPETITOR)))).alias("_names"))
    )
    j = never.join(rivals, "prompt_id", "left").join(log.prompts.select("prompt_id", "text", "tags"), "prompt_id")
    names_or_none = F.coalesce("_names", F.array().cast("array<string>"))
    return j.select(
        "project_id", "prompt_id", "text", F.array_join("tags", ",").alias("tags"), "answers", "mentioned",
        F.size(names_or_none).cast("long").alias("competitor_count"), F.array_join(names_or_none, ",").alias("competitors"),
    )


def project_stats(log) -> DataFrame:
    """Cited and mentioned answers per entity over all detections."""
    answers = _ok(log.results)
    seen = entity_flags(log, answers).groupBy("entity_id").agg(
        _n(F.col("cited")).alias("cited"), _n(F.col("mentioned")).alias("mentioned")
    )
    e = log.entities.select("project_id", "entity_id", "entity_type", "name")
    return e.join(seen, "entity_id", "left").fillna(0, ["cited", "mentioned"])

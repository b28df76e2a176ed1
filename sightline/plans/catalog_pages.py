"""Registered queries over texts, URLs, dates and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.functions import dates, text, urls
from sightline.functions.text import once
from sightline.operators import analysis as Y
from sightline.operators import inspections as I
from sightline.operators import ranks as N
from sightline.operators import robots as B
from sightline.operators import scoring as S
from sightline.operators.page_type import with_page_type
from sightline.operators.signals import content_hash, extract_signals, page_info
from sightline.plans.built_pages import built_pages
from sightline.plans.catalog import plain, query
from sightline.sources.binding import ts
from sightline.sources.page_cache import PageCache
from sightline.sources.snapshots import Snapshots
from sightline.sources.stage import dealt, kept_path

NOW = "2026-09-08 12:00:00"
NOW_INDEX = "2001-08-02 00:00:00"


# --- texts ------------------------------------------------------------------------------
@query("normalize_documents")
def _normalize(log):
    return documents(log).select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("fingerprint"))


@query("document_languages")
def _langs(log):
    return documents(log).select("doc_id", text.guess_lang(F.col("text")).alias("lang"))


@query("document_figures")
def _figures(log):
    return documents(log).select("doc_id", text.count_numbers(F.col("text")).alias("figures"))


@query("question_terms")
def _terms(log):
    return user_turns(log).select("conv_id", "turn", F.array_join(text.key_terms(F.col("text")), " ").alias("terms"))


def _classified(questions: DataFrame) -> DataFrame:
    placed = questions.withColumn("place", text.find_place(F.col("text")))
    return placed.withColumn("intent", text.question_intent(F.col("text"), F.col("place")))


@query("question_intents")
def _intents(log):
    return _classified(user_turns(log)).select("conv_id", "turn", "intent", "place")


@query("question_headings")
def _question_lines(log):
    """Lines of the documents that read like a question or an entity heading, counted per document."""
    lines = documents(log).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        F.count_if(text.is_question_heading(F.col("line"))).alias("questions"),
        F.count_if(text.is_entity_heading(F.col("line"))).alias("entities"),
    )


# --- URLs and dates -----------------------------------------------------------------------
@query("normalize_urls")
def _urls(log):
    url = F.col("url")
    return log.raw("pages").select(
        "page_id",
        urls.normalize_url(url).alias("normalized"),
        urls.bare_url(url).alias("bare"),
        urls.normalize_domain(url).alias("host"),
        urls.root_domain(urls.normalize_domain(url)).alias("root"),
        urls.origin_of(url).alias("origin"),
        urls.same_site(url, F.lit("example.com")).alias("on_example_com"),
    )


@query("pages_per_root")
def _roots(log):
    host = urls.normalize_domain(F.col("url"))
    return log.raw("pages").groupBy(urls.root_domain(host).alias("root")).agg(
        F.count("*").alias("pages"), F.count_distinct(host).alias("hosts"), F.count_distinct(urls.normalize_url(F.col("url"))).alias("urls")
    )


def _written(day: Column, style: Column) -> Column:
    fr = F.element_at(F.array(*[F.lit(m) for m in ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]]), F.month(day))
    en = F.date_format(day, "MMMM")
    d, y = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    return (
        F.when(style == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm"))
        .when(style == 1, F.concat_ws(" ", d, fr, y))
        .when(style == 2, F.concat(en, F.lit(" "), d, F.lit(", "), y))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )


@query("written_dates")
def _dates(log):
    """Order dates written in four styles, read back."""
    o = log.raw("orders").select("o_orderkey", _written(F.col("o_orderdate"), F.col("o_orderkey") % 4).alias("written"))
    marked = F.concat(F.lit("page mise a jour le "), text.normalize_text(F.col("written")), F.lit(" fin"))
    return o.select(
        "o_orderkey",
        dates.parse_written_date(F.col("written")).alias("day"),
        dates.date_after_marker(marked, K.UPDATED_MARKERS).alias("marked_day"),
    )


@query("page_ages")
def _ages(log):
    """Age in months and freshness points of every order date, and the source of the effective date."""
    now = ts("2001-08-02 00:00:00")
    modified = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = log.raw("orders").select(
        "o_orderkey", dates.age_in_months(modified, F.lit(None).cast("string"), now).alias("months"),
        dates.effective_date(modified, F.lit(None).cast("string"), F.lit(2000), now).alias("e"),
    )
    return o.select(
        "o_orderkey", "months", dates.freshness_points(F.col("months")).alias("points"),
        F.date_format("e.date", "yyyy-MM-dd").alias("effective"), F.col("e.source").alias("source"),
    )


@query("events_by_local_day")
def _local(log):
    e = log.raw("events")
    return e.groupBy(dates.local_day(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("events"))


# --- pages ------------------------------------------------------------------------------------
def pages(log) -> DataFrame:
    return dealt(log.raw("pages"), "page_id")


def documents(log) -> DataFrame:
    return dealt(log.raw("documents").select("doc_id", "text"), "doc_id")


def user_turns(log) -> DataFrame:
    return dealt(log.raw("conversations").filter("role = 'user'").select("conv_id", "turn", "text"), "conv_id")


def typed_signals(log) -> DataFrame:
    """Signals and page type of every page; lazy, so a query computes only the signals it reads."""
    return with_page_type(extract_signals(pages(log))).drop("main_text", "body_text")


@query("page_info")
def _info(log):
    return page_info(pages(log)).select(
        "page_id", "title", "h1", F.col("html_lang").alias("lang"), "word_count", F.md5("main_text").alias("main_text_md5"),
        "js_suspect", F.size("h2").alias("h2_count"), "published_at", "canonical", F.length("excerpt").alias("excerpt_length"),
    )


@query("page_signals")
def _signals(log):
    s = extract_signals(pages(log)).drop("main_text", "body_text", "excerpt", "text_in_first_quarter", "headings", "sections")
    return plain(s)


@query("page_types")
def _types(log):
    return with_page_type(extract_signals(pages(log))).select("page_id", "host", "page_type", "type_confidence", F.array_join("type_reasons", "; ").alias("reasons"))


@query("page_hashes")
def _hashes(log):
    """Pages with the same content."""
    h = page_info(pages(log)).select("page_id", content_hash(F.col("title")).alias("hash"))
    return h.groupBy("hash").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


def robots_files(log) -> DataFrame:
    """One robots.txt per origin of the pages, in five shapes by the length of the origin."""
    origin = urls.origin_of(F.col("url"))
    shape = F.length("origin") % 5
    body = (
        F.when(shape == 1, "User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nAllow: /")
        .when(shape == 2, "# rules\nUser-agent: ClaudeBot\nUser-agent: PerplexityBot\nDisallow: /en/\nAllow: /en/4\n")
        .when(shape == 3, "User-Agent: *\nDisallow: /*?page=\nDisallow: /fr/")
        .when(shape == 4, "user-agent: Google-Extended\ndisallow:\n\nuser-agent: *\ndisallow: /*.html$")
    )
    return log.raw("pages").select(origin.alias("origin")).distinct().select("origin", body.alias("body"))


def page_access(log) -> DataFrame:
    p = pages(log).select(
        "page_id", urls.origin_of(F.col("url")).alias("origin"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1).alias("page_path")
    )
    return B.robots_access(p, robots_files(log))


@query("robots_access")
def _access(log):
    return page_access(log)


@query("robots_by_vendor")
def _vendors(log):
    return B.access_by_vendor(page_access(log))


def fetched(log, signals: DataFrame) -> DataFrame:
    """Signals with page type and the facts of the fetch."""
    s = signals.join(B.access_report(page_access(log)), "page_id")
    n = F.col("page_id")
    return s.withColumns(
        {
            "http_status": F.when(n % 11 == 0, 404).otherwise(200),
            "response_ms": n * 7919 % 4000,
            "redirects": (n % 3 == 0).cast("int"),
            "llms_txt": F.lit(None).cast("boolean"),
        }
    )


@query("access_scores")
def _access_scores(log):
    signals = typed_signals(log)
    a = S.score_access(fetched(log, signals)).select("page_id", F.explode("access.rows").alias("r"))
    return a.select("page_id", "r.key", "r.points", "r.max")


def questions_of_pages(log) -> DataFrame:
    """Questions put to a page: the user turns of the conversation of the same number."""
    q = user_turns(log).select(
        F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("question_index"), F.col("text")
    )
    return _classified(q).withColumnRenamed("text", "question")


def content_scores(log, signals: DataFrame) -> DataFrame:
    return S.score_content(signals.join(questions_of_pages(log), "page_id"), ts(NOW))


@query("content_scores")
def _content(log):
    c = content_scores(log, typed_signals(log))
    return c.select("page_id", "question_index", "intent", "page_type", F.col("content.total").alias("total"), F.array_join("content.caps", "; ").alias("caps"), F.explode("content.rows").alias("r")).select(
        "page_id", "question_index", "intent", "page_type", "total", "caps", "r.key", "r.points"
    )


def analysed(log, wanted: DataFrame) -> DataFrame:
    """Signals, page type and fetch facts of normalised URLs."""
    return with_page_type(extract_signals(dealt(built_pages(log, wanted), "page"))).drop("main_text", "body_text")


def page_cache(log) -> PageCache:
    """The kept page records of this folder of tables, which all queries of the analysis share."""
    return PageCache(log.spark, kept_path(log.spark, "pages", log.root), lambda wanted: analysed(log, wanted))


def target_pages(log) -> DataFrame:
    """Records of the pages inspected."""
    return page_cache(log).refresh(Y.targets(log), ts(NOW_INDEX))


def compared(log) -> DataFrame:
    """The pages cited in place of each inspection's URL, kept for all queries of the analysis."""
    kept = Snapshots(log.spark, kept_path(log.spark, "compared", log.root), ["inspection_id"])
    return kept.current(lambda: Y.compared_pages(log))


def compared_records(log) -> DataFrame:
    """Records of the pages inspected and of those cited in their place."""
    return page_cache(log).refresh(Y.targets(log).select("page").union(compared(log).select("page")), ts(NOW_INDEX))


@query("citability_index")
def _index(log):
    return Y.citability_index(log, target_pages(log), ts(NOW_INDEX))


def source_pages(log) -> DataFrame:
    """The normalised URLs of all sources of the window."""
    seen = log.sources.join(log.window().select("result_id"), "result_id", "left_semi")
    return once(seen.select("url").distinct(), {"page": urls.normalize_url(F.col("url"))}).select("page")


@query("built_page_signals")
def _built_signals(log):
    """Signals of every page that answers of the window give as a source."""
    asked = built_pages(log, source_pages(log)).withColumns({"question_lang": F.lit("en-GB"), "place": F.lit("Paris")})
    s = with_page_type(extract_signals(dealt(asked, "page")))
    size = lambda c: F.size(c).alias(c)
    first = F.try_element_at(F.col("sections"), F.lit(1))
    return s.select(
        "page", "title", "h1", "description", F.col("lang"), "word_count", "canonical", "canonical_self", "robots_meta",
        F.array_join(F.array_sort("json_ld_types"), ",").alias("json_ld_types"), "js_suspect", size("h2"), size("h3"), size("headings"), size("sections"),
        F.when(F.size("sections") >= 2, first["lead"]).otherwise("").alias("first_lead"), "date_modified", "date_published", "author", "author_role",
        "person_schema", "organization_schema", size("same_as"), "about_contact_links", "outbound_links",
        F.array_join("outbound_domains", ",").alias("outbound_domains"), "numbers_count", "lists_count", "tables_count", "has_faq",
        "has_summary_block", "h2_questions", "h2_entities", "quote_count", "title_year", "place_mentioned", "lang_matches",
        F.array_join("snippet_directives", ",").alias("snippet_directives"), "brand_name", "brand_consistent", "contact_form",
        F.size(F.split("text_in_first_quarter", " ")).alias("first_quarter_words"), "page_type", "type_confidence",
    )


@query("signal_calibration")
def _calibration(log):
    """Signals of the kept page records held against whether answers cite the page, per engine."""
    records = page_cache(log).refresh(source_pages(log), ts(NOW_INDEX))
    return N.signal_calibration(records, N.cited_pages(log), N.page_flags())


@query("inspection_content_scores")
def _inspection_content(log):
    """Grid rows of each inspection's target for each of its questions."""
    c = Y.content_scores(log, target_pages(log), ts(NOW_INDEX))
    return c.select("inspection_id", "question_index", "page_type", F.col("content.total").alias("total"), F.explode("content.rows").alias("r")).select(
        "inspection_id", "question_index", "page_type", "total", "r.key", "r.points", "r.max"
    )


@query("compare_signals")
def _compare(log):
    return Y.compare_signals(log, compared_records(log), ts(NOW_INDEX), compared(log))


@query("top_gaps")
def _gaps(log):
    return Y.top_gaps(log, compared_records(log), ts(NOW_INDEX), compared=compared(log)).select("inspection_id", "rank", "key", "gap")


@query("page_typology")
def _typology(log):
    return Y.page_typology(log, compared_records(log), compared(log))


@query("stale_analyses")
def _stale(log):
    """Analyses (one per inspection) that should be run again."""
    a = log.inspections.select(
        "inspection_id", "created_at", F.when(F.col("inspection_id") % 4 == 0, "2026-01-01.0").otherwise(K.GRID_VERSION).alias("grid_version")
    )
    return a.select("inspection_id", S.is_stale(F.col("grid_version"), F.col("created_at"), log.now).alias("stale"))

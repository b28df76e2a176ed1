"""Raw engine responses: one JSON text per answer -> sources, queries, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.functions.text import let
from sightline.functions.urls import normalize_domain

_LINK = "struct<url:string,title:string>"
_CALL = "struct<toolName:string,input:struct<query:string>>"
_RESULT = "struct<toolName:string,output:string>"
_STEP = f"struct<toolCalls:array<{_CALL}>,toolResults:array<{_RESULT}>>"
RESPONSE = """
struct<
  sources: array<struct<sourceType:string,url:string,title:string>>,
  steps: array<struct<
    toolCalls: array<struct<toolName:string,input:struct<query:string>>>,
    toolResults: array<struct<toolName:string,output:string>>>>,
  providerMetadata: struct<
    google: struct<groundingMetadata: struct<
      webSearchQueries: array<string>,
      groundingChunks: array<struct<web:struct<uri:string,title:string>>>,
      groundingSupports: array<struct<groundingChunkIndices:array<int>>>>>,
    perplexity: struct<usage:struct<numSearchQueries:long>>>>
"""
RESULT_LIST = f"array<{_LINK}>"
RESULT_ACTION = "struct<action:struct<query:string,queries:array<string>,sources:array<struct<type:string,url:string>>>>"


def _flat(nested: Column) -> Column:
    return F.flatten(F.filter(F.coalesce(nested, F.array()), lambda x: x.isNotNull()))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def normalize_engine_responses(responses: DataFrame) -> DataFrame:
    """(result_id, provider, response JSON) -> (result_id, sources, search_queries, searches).

    A URL is kept once, at its first place; cited sources come first, pages that
    were only read follow. Which pages count as cited depends on the provider:
    one that reports the chunks behind its sentences cites those only.
    """
    r = responses.select("result_id", "provider", F.from_json("response", RESPONSE).alias("r"))
    meta = F.col("r.providerMetadata.google.groundingMetadata")
    is_google = F.col("provider") == "google"
    calls = F.filter(_flat(F.col("r.steps.toolCalls")), lambda c: c["toolName"] == "web_search")
    steps = F.transform(
        F.coalesce(F.col("r.steps"), _empty(_STEP)),
        lambda s: F.struct(
            F.filter(F.coalesce(s["toolCalls"], _empty(_CALL)), lambda c: c["toolName"] == "web_search").alias("calls"),
            F.transform(
                F.filter(F.coalesce(s["toolResults"], _empty(_RESULT)), lambda o: o["toolName"] == "web_search"),
                lambda o: F.struct(
                    F.from_json(F.when(F.ltrim(o["output"]).startswith("["), o["output"]), RESULT_LIST).alias("links"),
                    F.from_json(F.when(F.ltrim(o["output"]).startswith("{"), o["output"]), RESULT_ACTION)["action"].alias("action"),
                ),
            ).alias("outputs"),
        ),
    )
    step = r.select("*", calls.alias("calls"), steps.alias("steps"), meta.alias("meta")).withColumn(
        "outputs", F.flatten(F.col("steps.outputs"))
    )

    chunks = F.transform(
        F.coalesce(F.col("meta.groundingChunks"), _empty("struct<web:struct<uri:string,title:string>>")),
        lambda c: F.struct(c["web"]["uri"].alias("url"), c["web"]["title"].alias("title")),
    )
    tool_pages = F.flatten(
        F.transform(
            "outputs",
            lambda o: F.coalesce(
                o["links"],
                F.transform(
                    F.filter(o["action"]["sources"], lambda s: s["type"] == "url"),
                    lambda s: F.struct(s["url"].alias("url"), F.lit(None).cast("string").alias("title")),
                ),
                _empty(_LINK),
            ),
        )
    )
    queries = F.when(is_google, F.coalesce(F.col("meta.webSearchQueries"), _empty("string"))).otherwise(
        F.flatten(
            F.transform(
                "steps",
                lambda s: F.concat(
                    F.transform(s["calls"], lambda c: c["input"]["query"]),
                    F.flatten(
                        F.transform(
                            s["outputs"],
                            lambda o: F.concat(F.array(o["action"]["query"]), F.coalesce(o["action"]["queries"], _empty("string"))),
                        )
                    ),
                ),
            )
        )
    )
    supported = F.flatten(
        F.transform(
            F.coalesce(F.col("meta.groundingSupports"), _empty("struct<groundingChunkIndices:array<int>>")),
            lambda s: F.coalesce(s["groundingChunkIndices"], _empty("int")),
        )
    )
    listed = F.transform(
        F.filter(F.coalesce(F.col("r.sources"), _empty("struct<sourceType:string,url:string,title:string>")),
                 lambda s: (s["sourceType"] == "url") & s["url"].isNotNull() & (s["url"] != "")),
        lambda s: F.struct(s["url"].alias("url"), s["title"].alias("title")),
    )
    parts = step.select(
        "result_id", "provider", "calls",
        F.col("meta.webSearchQueries").alias("google_queries"),
        F.col("r.providerMetadata.perplexity.usage.numSearchQueries").alias("counted"),
        listed.alias("listed"),
        F.filter(F.when(is_google, chunks).otherwise(tool_pages), lambda p: p["url"].isNotNull() & (p["url"] != "")).alias("read"),
        F.when(
            is_google & (F.size(F.coalesce(F.col("meta.groundingSupports"), _empty("struct<groundingChunkIndices:array<int>>"))) > 0),
            F.transform(supported, lambda i: F.get(F.col("meta.groundingChunks"), i)["web"]["uri"]),
        ).alias("cited_urls"),
        F.array_distinct(F.filter(F.transform(queries, lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != ""))).alias("search_queries"),
    )

    def entry(page: Column, cited: Column) -> Column:
        return F.struct(
            page["url"].alias("url"), page["title"].alias("title"), normalize_domain(page["url"]).alias("domain"),
            cited.alias("cited"), F.lit(True).alias("retrieved"),
        )

    def is_cited(page: Column) -> Column:
        return F.coalesce(F.array_contains("cited_urls", page["url"]), F.lit(True))

    tagged = F.concat(
        F.transform("listed", lambda p: F.struct(p["url"].alias("url"), p["title"].alias("title"), F.lit(True).alias("listed"))),
        F.transform("read", lambda p: F.struct(p["url"].alias("url"), p["title"].alias("title"), F.lit(False).alias("listed"))),
    )
    kept = _first_of_each(tagged)
    first_listed = F.filter(kept, lambda p: p["listed"])
    first_read = F.filter(kept, lambda p: ~p["listed"])
    cited = F.transform(F.filter(first_listed, is_cited), lambda p: entry(p, F.lit(True)))
    unused = F.transform(F.filter(first_listed, lambda p: ~is_cited(p)), lambda p: entry(p, F.lit(False)))
    extra = F.transform(first_read, lambda p: entry(p, F.lit(False)))
    searches = (
        F.when(F.col("provider") == "perplexity", F.coalesce("counted", F.lit(1)))
        .when(F.col("provider") == "google", F.when(F.size(F.coalesce("google_queries", _empty("string"))) > 0, 1).otherwise(0))
        .otherwise(F.size("calls"))
    )
    return parts.select("result_id", F.concat(cited, unused, extra).alias("sources"), "search_queries", searches.cast("long").alias("searches"))


def _first_of_each(pages: Column) -> Column:
    """The first page of each URL, in order: one sort by URL and place, so long lists stay cheap."""
    placed = F.array_sort(
        F.transform(F.filter(pages, lambda p: p["url"].isNotNull()), lambda p, i: F.struct(p["url"].alias("url"), i.alias("i"), p.alias("page")))
    )
    first = let(placed, lambda t: F.filter(t, lambda x, i: (i == 0) | (F.get(t, i - 1)["url"] != x["url"])))
    in_order = F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["page"].alias("page"))))
    return F.transform(in_order, lambda x: x["page"])


def resolve_source_redirects(sources: DataFrame, redirects: DataFrame) -> DataFrame:
    """Replace search redirects by their target and keep each URL once per answer.

    ``sources``: (result_id, pos, url, title, domain); ``redirects``: (url, location).
    An unresolved redirect takes its title as host when the title looks like one.
    """
    spread = F.lit(0).cast("long").alias("_spread")
    known = redirects.select(F.col("url").alias("_from"), F.col("location").alias("_to"), spread).filter(F.col("_to").isNotNull())
    marked = sources.withColumn("_from", F.when(F.col("url").rlike(K.SEARCH_REDIRECT), F.col("url")))
    # Sources that are no redirect have no key; hashed by their answer and URL too, they do not meet in one task.
    marked = marked.withColumn("_spread", F.when(F.col("_from").isNull(), F.xxhash64("result_id", "url")).otherwise(0))
    j = marked.join(known, ["_from", "_spread"], "left")
    host_like = F.trim("title").rlike(r"^(?i:[a-z0-9.-]+\.[a-z]{2,})$")
    resolved = j.select(
        "result_id", "pos", "title",
        F.coalesce("_to", "url").alias("url"),
        F.when(F.col("_to").isNotNull(), normalize_domain(F.col("_to")))
        .when(F.col("_from").isNotNull() & host_like, normalize_domain(F.col("title")))
        .otherwise(F.col("domain"))
        .alias("domain"),
    )
    first = resolved.groupBy("result_id", "url").agg(F.min(F.struct("pos", "title", "domain")).alias("_f"))
    return first.select("result_id", "_f.pos", "url", "_f.title", "_f.domain")

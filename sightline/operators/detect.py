"""Detection: which tracked entities an answer cites, retrieves or mentions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.text import normalize_text, once, term_pattern
from sightline.functions.urls import normalize_domain
from sightline.operators.domains import all_owners
from sightline.operators.term_index import few, holding


def _in_scope(rows: DataFrame, answers: DataFrame) -> DataFrame:
    return rows.join(answers.select("result_id", "project_id"), "result_id")


def first_ranks(answers: DataFrame, ranked: DataFrame, entities: DataFrame) -> DataFrame:
    """Rank of the first source of each entity in each answer, among the cited sources and among all.

    ranked: sources of answers; where it has the answers' ``project_id`` already, it is not joined
    with them. Sources without an owner are left out before anything is grouped.
    """
    scoped = ranked if "project_id" in ranked.columns else _in_scope(ranked, answers)
    hosts = scoped.select("result_id", "project_id", "domain", "cited_rank", "rank")
    return all_owners(hosts, entities).groupBy("result_id", "entity_id").agg(
        F.min("cited_rank").alias("citation_rank"), F.min("rank").alias("retrieved_rank")
    )


def needles(entities: DataFrame) -> DataFrame:
    """What to look for in a text: the terms of each entity, and its domains as a fallback."""
    base = entities.select("project_id", "entity_id", "entity_type", "ordinal", "terms", "domains")
    terms = base.select(
        "project_id", "entity_id", "entity_type", "ordinal", F.lit(True).alias("is_term"), F.posexplode("terms").alias("no", "needle")
    ).withColumn("bare", F.trim(normalize_text(F.col("needle"))))
    domains = base.select(
        "project_id", "entity_id", "entity_type", "ordinal", F.lit(False).alias("is_term"), F.posexplode("domains").alias("no", "needle")
    ).withColumn("bare", normalize_domain(F.col("needle")))
    return (
        terms.unionByName(domains).filter(F.col("bare") != "").withColumn("pattern", term_pattern(F.col("needle")))
    )


def mention_pairs(answers: DataFrame, texts: DataFrame, entities: DataFrame, small: bool = False) -> DataFrame:
    """(result, entity) pairs mentioned in the text: first position and matched terms.

    The term index finds the texts that hold a needle; the word-edge pattern runs on those
    alone. Domains count (as plain substrings) only when no term of the entity was found.
    small: see ``holding``.
    """
    inside, body = _in_scope(texts, answers), normalize_text(F.col("raw_text"))
    # In one pass the window below keeps the body from being computed again.
    t = inside.withColumn("body", body) if small else once(inside, {"body": body})
    t = t.select("result_id", "project_id", "body")
    hits = holding(t, needles(entities), "result_id", small).select(
        "result_id", "entity_id", "entity_type", "ordinal", "is_term", "no", "needle",
        F.when(F.col("is_term"), F.regexp_instr("body", F.col("pattern"))).otherwise(F.expr("locate(bare, body)")).alias("at"),
    )
    found = hits.filter(F.col("at") > 0).groupBy("result_id", "entity_id", "entity_type", "ordinal").agg(
        F.min(F.when(F.col("is_term"), F.col("at"))).alias("_term_at"),
        F.min(F.when(~F.col("is_term"), F.col("at"))).alias("_domain_at"),
        F.array_sort(F.collect_list(F.struct("is_term", "no", "needle"))).alias("_hits"),
    )
    by_term = F.col("_term_at").isNotNull()
    chosen = F.filter("_hits", lambda h: h["is_term"] == by_term)
    return found.select(
        "result_id", "entity_id", "entity_type", "ordinal",
        (F.coalesce("_term_at", "_domain_at") - 1).alias("first_index"),
        F.transform(chosen, lambda h: h["needle"]).alias("matched_terms"),
    )


def detections(answers: DataFrame, ranked: DataFrame, texts: DataFrame, entities: DataFrame) -> DataFrame:
    """One verdict per (answer, entity of its project), for answers without error."""
    ok = answers.filter(F.col("error").isNull()).select("result_id", "project_id")
    grid = ok.join(entities.select("project_id", "entity_id", "entity_type", "ordinal"), "project_id")
    ranks = first_ranks(ok, ranked, entities)
    order = W.partitionBy("result_id").orderBy("first_index", "ordinal")
    mentioned = mention_pairs(ok, texts, entities, few(needles(entities))).select(
        "result_id", "entity_id", "matched_terms", F.row_number().over(order).cast("long").alias("mention_rank")
    )
    keys = ["result_id", "entity_id"]
    joined = grid.join(ranks, keys, "left").join(mentioned, keys, "left")
    return joined.select(
        "result_id", "project_id", "entity_type", "entity_id",
        F.col("citation_rank").isNotNull().alias("cited"), "citation_rank",
        F.col("retrieved_rank").isNotNull().alias("retrieved"), "retrieved_rank",
        F.col("mention_rank").isNotNull().alias("mentioned"), "mention_rank",
        F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"),
    )


def recompute_detections(detected: DataFrame, path: str) -> None:
    """Replace the detections of the projects present in ``detected`` and keep the others, in plain
    files in place; ``recompute_projects`` does so without readers seeing half of it."""
    (
        detected.write.partitionBy("project_id")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def recompute_projects(verdicts, log, entities: DataFrame, projects: DataFrame) -> int:
    """New verdicts for the answers of some projects after their dictionaries changed, as a new version.

    verdicts: the snapshots that hold them (``project_id`` slices); entities: the changed
    dictionaries; projects: ``project_id``. Also projects that no answer names any more lose
    their old rows. Other projects are neither read again nor written.
    """
    chosen = projects.select("project_id").distinct()
    answers = log.results.join(chosen, "project_id", "left_semi")
    return verdicts.replace(log.detected(entities.join(chosen, "project_id", "left_semi"), answers), chosen)


def entity_flags(log, answers: DataFrame) -> DataFrame:
    """Sparse (result, entity) verdicts of some answers, cited or mentioned, from the stored detections.
    Pairs seen nowhere are left out: sums over this table equal sums over the dense verdicts."""
    ok = answers.filter(F.col("error").isNull()).select("result_id")
    seen = log.detections.filter("cited or mentioned")
    return seen.select("result_id", "entity_id", "entity_type", "cited", "mentioned").join(ok, "result_id", "left_semi")


def cited_pairs(log, answers: DataFrame) -> DataFrame:
    """(result, entity) pairs cited in some answers."""
    return entity_flags(log, answers).filter("cited").select("result_id", "entity_id", "entity_type")


def brand_flags(log, answers: DataFrame) -> DataFrame:
    """Every answer (errors included) with the verdict on its own brand."""
    brand = log.detections.filter("entity_type = 'brand' and (cited or mentioned)").select("result_id", "cited", "mentioned")
    return answers.join(brand, "result_id", "left").withColumns(
        {c: F.col("error").isNull() & F.coalesce(c, F.lit(False)) for c in ("cited", "mentioned")}
    )


def _utf16(text: str) -> int:
    return len(text) + sum(1 for c in text if ord(c) > 0xFFFF)


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("term", T.StringType())])
)


@F.pandas_udf(SPANS)
def mention_spans(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """Spans of every term in the original text, blind to case and accents.
    Offsets count UTF-16 units, as a browser does."""
    import regex

    compiled: dict[str, regex.Pattern] = {}

    def pattern(term: str) -> regex.Pattern:
        if term not in compiled:
            parts = []
            for char in term.strip():
                base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.category(c).startswith("M"))
                parts.append(r"\s+" if base == " " else regex.escape(base) + r"\p{M}*")
            compiled[term] = regex.compile(r"(?<![\p{L}\p{N}])" + "".join(parts) + r"(?![\p{L}\p{N}])", regex.I)
        return compiled[term]

    def spans(text: str | None, wanted) -> list[dict]:
        if text is None or wanted is None:
            return []
        decomposed = unicodedata.normalize("NFD", text)
        found = sorted((m.start(), m.group(), term) for term in wanted if term.strip() for m in pattern(term).finditer(decomposed))
        out, at, units = [], 0, 0
        for start, matched, term in found:
            # A match starts at a letter, never inside one, so offsets add up from match to match.
            units += _utf16(unicodedata.normalize("NFC", decomposed[at:start]))
            at = start
            out.append({"start": units, "end": units + _utf16(unicodedata.normalize("NFC", matched)), "term": term})
        return out

    return pd.Series([spans(x, w) for x, w in zip(texts, terms)])


def spans_in_texts(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """``result_id, spans`` of the texts (``result_id, project_id, raw_text``) that hold a term of their project.

    Only terms whose bare letters occur in the text go to the span search, and texts without any never leave the JVM.
    """
    bare = lambda term: F.trim(normalize_text(term))
    each = entities.select("project_id", F.explode("terms").alias("term")).select("project_id", F.struct("term", bare(F.col("term")).alias("bare")).alias("t"))
    lists = each.where("t.bare <> ''").groupBy("project_id").agg(F.array_sort(F.collect_list("t")).alias("_terms"))
    body = normalize_text(F.col("raw_text"))
    near = once(texts.join(lists, "project_id"), {"_body": body}).withColumn("_near", F.filter("_terms", lambda t: F.contains("_body", t["bare"])))
    wanted = near.where(F.size("_near") > 0).select("result_id", "raw_text", F.transform("_near", lambda t: t["term"]).alias("terms"))
    return wanted.select("result_id", mention_spans("raw_text", "terms").alias("spans"))


def project_dictionaries(entities: DataFrame) -> DataFrame:
    """The entities of each project as one list; a project tracks a short list of names by design."""
    domains = F.filter(F.transform("domains", normalize_domain), lambda d: d != "")
    terms = F.transform(
        F.filter("terms", lambda t: F.trim(t) != ""),
        lambda t: F.struct(t.alias("term"), F.trim(normalize_text(t)).alias("bare"), term_pattern(t).alias("pattern")),
    )
    entry = F.struct("ordinal", "entity_id", "entity_type", domains.alias("domains"), terms.alias("terms"))
    return entities.groupBy("project_id").agg(F.array_sort(F.collect_list(entry.alias("e"))).alias("dictionary"))


def detect_rows(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Detection inside each answer row (result_id, project_id, raw_text, sources, error).

    For answers that hold their sources as a list: one join with the small
    dictionaries, then expressions only. It keeps no state, so it also runs on a stream.
    """
    rows = answers.filter(F.col("error").isNull()).join(project_dictionaries(entities), "project_id")
    flat = rows.select(
        "result_id",
        "project_id",
        "dictionary",
        normalize_text(F.col("raw_text")).alias("body"),
        F.transform("sources", lambda s: normalize_domain(s["url"])).alias("hosts"),
        F.transform(
            F.filter("sources", lambda s: F.coalesce(s["cited"], F.lit(True))), lambda s: normalize_domain(s["url"])
        ).alias("cited_hosts"),
    )

    def rank(hosts: str, e) -> Column:
        owned = F.transform(
            F.col(hosts), lambda h: F.exists(e["domains"], lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))
        )
        return F.nullif(F.array_position(owned, True), F.lit(0))

    def term_hits(e) -> Column:
        found = F.transform(
            e["terms"],
            lambda t: F.struct(
                F.when(F.contains(F.col("body"), t["bare"]), F.regexp_instr("body", t["pattern"])).otherwise(0).alias("at"),
                t["term"].alias("term"),
            ),
        )
        return F.filter(found, lambda h: h["at"] > 0)

    def domain_hits(e) -> Column:
        found = F.transform(e["domains"], lambda d: F.struct(F.position(d, F.col("body")).alias("at"), d.alias("term")))
        return F.filter(found, lambda h: h["at"] > 0)

    verdicts = F.transform(
        "dictionary",
        lambda e: F.struct(
            e["ordinal"].alias("ordinal"), e["entity_id"].alias("entity_id"), e["entity_type"].alias("entity_type"),
            rank("cited_hosts", e).alias("citation_rank"), rank("hosts", e).alias("retrieved_rank"),
            term_hits(e).alias("terms"), domain_hits(e).alias("domains"),
        ),
    )
    with_hits = flat.withColumn("_v", verdicts).withColumn(
        "_v",
        F.transform(
            "_v",
            lambda v: F.struct(
                v["ordinal"].alias("ordinal"), v["entity_id"].alias("entity_id"), v["entity_type"].alias("entity_type"),
                v["citation_rank"].alias("citation_rank"), v["retrieved_rank"].alias("retrieved_rank"),
                F.when(F.size(v["terms"]) > 0, v["terms"]).otherwise(v["domains"]).alias("hits"),
            ),
        ),
    )
    order = F.array_sort(
        F.transform(
            F.filter("_v", lambda v: F.size(v["hits"]) > 0),
            lambda v: F.struct(F.array_min(F.transform(v["hits"], lambda h: h["at"])).alias("at"), v["ordinal"].alias("ordinal")),
        )
    )
    v = with_hits.withColumn("_order", F.transform(order, lambda o: o["ordinal"])).select(
        "result_id", "project_id", "_order", F.explode("_v").alias("v")
    )
    return v.select(
        "result_id", "project_id", F.col("v.entity_type").alias("entity_type"), F.col("v.entity_id").alias("entity_id"),
        F.col("v.citation_rank").isNotNull().alias("cited"), F.col("v.citation_rank").alias("citation_rank"),
        F.col("v.retrieved_rank").isNotNull().alias("retrieved"), F.col("v.retrieved_rank").alias("retrieved_rank"),
        (F.size("v.hits") > 0).alias("mentioned"),
        F.nullif(F.array_position("_order", F.col("v.ordinal")), F.lit(0)).alias("mention_rank"),
        F.transform("v.hits", lambda h: h["term"]).alias("matched_terms"),
    )

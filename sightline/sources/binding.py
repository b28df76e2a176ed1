"""The answer log seen through the shared test tables.

Orders become answers, order lines become the sources of an answer, customers
become prompts, nations become brands and competitors. Everything stays lazy:
a query reads only the columns and rows it needs.

Sources and texts are kept as rows, never gathered into one value per answer,
so an answer with very many lines stays spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.pricing import exact_sum
from sightline.operators.detect import detections
from sightline.operators.windows import ordinal
from sightline.sources.log import engines_per_project
from sightline.sources.snapshots import Snapshots
from sightline.sources.stage import kept_path

AS_OF = "2001-08-02 00:00:00"
DAYS = 365
ENTITY_COUNT = 25

# The five projects, in name order, and the five engines.
PROJECTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ENGINE_MODELS = {
    "1-URGENT": ("openai", "gpt-5.4-mini"),
    "2-HIGH": ("anthropic", "claude-haiku-4-5"),
    "3-MEDIUM": ("perplexity", "sonar"),
    "4-NOT SPECIFIED": ("google", "gemini-3.8-flash"),
    "5-LOW": ("openai", "unlisted-model"),
}

# Schemas of the shared tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def project_number(segment: Column) -> Column:
    out = F.when(segment == PROJECTS[0], 0)
    for i, name in enumerate(PROJECTS[1:], 1):
        out = out.when(segment == name, i)
    return out


def engine_attribute(engine: Column, position: int) -> Column:
    out = None
    for name, attributes in ENGINE_MODELS.items():
        out = (F.when if out is None else out.when)(engine == name, attributes[position])
    return out


@dataclass
class AnswerLog:
    """Lazy tables of the answer log over one folder of test tables."""

    spark: SparkSession
    root: str
    as_of: str = AS_OF
    days: int = DAYS
    _raw: dict = field(default_factory=dict, repr=False)

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            reader = self.spark.read.schema(SCHEMAS[name])  # declared, so no job reads footers first
            self._raw[name] = reader.parquet(f"{self.root}/{name}.parquet")
        return self._raw[name]

    @property
    def now(self) -> Column:
        return ts(self.as_of)

    # --- dimensions -----------------------------------------------------------------
    @cached_property
    def entities(self) -> DataFrame:
        """One row per (project, entity): the brand first, then its rivals."""
        n = self.raw("nation").filter(F.col("n_regionkey").between(0, 4))
        project = F.element_at(F.array(*[F.lit(p) for p in PROJECTS]), F.col("n_regionkey") + 1)
        return n.select(
            project.alias("project_id"),
            F.col("n_nationkey").cast("long").alias("entity_id"),
            F.when(F.col("n_nationkey") == F.col("n_regionkey"), "brand").otherwise("competitor").alias("entity_type"),
            F.when(F.col("n_nationkey") == F.col("n_regionkey"), 0).otherwise(F.col("n_nationkey") + 1).alias("ordinal"),
            F.col("n_name").alias("name"),
            F.array("n_name").alias("terms"),
            F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".example"))).alias("domains"),
        )

    @cached_property
    def projects(self) -> DataFrame:
        p = project_number(F.col("project_id"))
        return (
            self.entities.filter(F.col("entity_type") == "brand")
            .select("project_id", F.col("name").alias("brand_name"), "domains")
            .withColumn("repeats", p % 2 + 1)
            .withColumn("cost_cap_eur", p * 0.05 + 0.5)
            .withColumn("inspections_per_day", p % 3 + 1)
        )

    @cached_property
    def prompts(self) -> DataFrame:
        c = self.raw("customer")
        n = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.raw("region")
        places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
        kind = F.col("c_custkey") % 4
        return c.join(places, c.c_nationkey == places.n_nationkey).select(
            F.col("c_custkey").alias("prompt_id"),
            F.col("c_mktsegment").alias("project_id"),
            F.col("c_name").alias("text"),
            F.when(kind == 0, F.array().cast("array<string>"))
            .when(kind == 1, F.array("r_name"))
            .when(kind == 2, F.array("r_name", "n_name"))
            .otherwise(F.array("n_name"))
            .alias("tags"),
            (F.col("c_acctbal") >= 0).alias("active"),
            (F.col("c_custkey") % 3 != 0).alias("web_search"),
            F.timestamp_add("MINUTE", F.col("c_custkey").cast("int"), ts("1995-01-01 00:00:00")).alias("created_at"),
        )

    @cached_property
    def prompt_projects(self) -> DataFrame:
        """Prompt to project only: two columns of the customer table."""
        return self.raw("customer").select(
            F.col("c_custkey").alias("prompt_id"), F.col("c_mktsegment").alias("project_id")
        )

    @cached_property
    def engines(self) -> DataFrame:
        e = self.raw("orders").select(F.col("o_orderpriority").alias("engine_id")).distinct()
        return e.select(
            "engine_id",
            F.col("engine_id").alias("label"),
            engine_attribute(F.col("engine_id"), 0).alias("provider"),
            engine_attribute(F.col("engine_id"), 1).alias("model"),
            (F.col("engine_id") != "5-LOW").alias("enabled"),
            F.lit(True).alias("usable"),
            F.when(
                F.col("engine_id") == "5-LOW",
                F.struct(F.lit(2.0).alias("input_per_mtok"), F.lit(12.0).alias("output_per_mtok"), F.lit(0.02).alias("per_search")),
            ).alias("pricing"),
            F.substring("engine_id", 1, 1).cast("int").alias("ordinal"),
        )

    @cached_property
    def project_engines(self) -> DataFrame:
        """Every engine under every project, disabled engines included."""
        return engines_per_project(self.projects, self.engines)

    # --- facts --------------------------------------------------------------------------
    def answers_from(self, orders: DataFrame) -> DataFrame:
        latency = F.col("o_orderkey") * 7919 % 9000 + 200
        a = orders.select(
            F.col("o_orderkey").alias("result_id"),
            F.col("o_custkey").alias("prompt_id"),
            F.col("o_orderpriority").alias("engine_id"),
            F.col("o_orderdate").alias("created_at"),
            F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0), "err").alias("error"),
            (F.col("o_totalprice") / 1e7).alias("cost_usd"),
            latency.alias("latency_ms"),
            (F.col("o_orderkey") % 7 != 0).alias("web_search"),
            (F.col("o_orderkey") % 2).cast("int").alias("repeat_index"),
            F.struct(
                (latency * 3).alias("input_tokens"), latency.alias("output_tokens"), (F.col("o_orderkey") % 4).alias("searches")
            ).alias("usage"),
        )
        return a.join(self.prompt_projects, "prompt_id").withColumn(
            "run_id", F.concat("project_id", F.lit(":"), F.date_format("created_at", "yyyy-MM"))
        )

    @cached_property
    def results(self) -> DataFrame:
        """Every answer, all time."""
        return self.answers_from(self.raw("orders"))

    @cached_property
    def runs(self) -> DataFrame:
        """One run per project and month; the month of ``as_of`` is still running."""
        r = self.results.groupBy("run_id", "project_id").agg(
            F.min("created_at").alias("started_at"), F.max("created_at").alias("_last"), F.count("*").cast("int").alias("planned_count"),
            exact_sum(F.col("cost_usd")).alias("cost_usd"),
        )
        live = F.col("_last") >= F.date_trunc("MONTH", self.now).cast("timestamp_ntz")
        return r.select(
            "run_id", "project_id", "started_at", F.when(~live, F.col("_last")).alias("finished_at"),
            F.when(live, "running").otherwise("done").alias("status"), "planned_count", "cost_usd",
        )

    def window(self, periods: int = 1) -> DataFrame:
        """Answers of the last ``periods`` windows; the bound reaches the parquet scan."""
        start = F.expr(f"timestamp_ntz'{self.as_of}' - interval {self.days * periods} days")
        return self.answers_from(self.raw("orders").filter(F.col("o_orderdate") >= start))

    def in_current(self) -> Column:
        return F.col("created_at") >= F.expr(f"timestamp_ntz'{self.as_of}' - interval {self.days} days")

    @cached_property
    def sources(self) -> DataFrame:
        """One row per source of an answer; ``pos`` orders the sources of an answer."""
        owner = F.col("l_suppkey") % ENTITY_COUNT
        domain = F.concat(
            F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".n"), owner.cast("string"), F.lit(".example")
        )
        page = (F.col("l_partkey") % 50).cast("string")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("result_id"),
            F.struct(*self._line_order).alias("pos"),
            domain.alias("domain"),
            F.when(
                F.col("l_linenumber") % 2 == 1,
                F.concat(F.lit("https://www."), domain, F.lit("/p/"), page, F.lit("/?utm_source=x")),
            )
            .otherwise(F.concat(F.lit("http://"), domain, F.lit("/p/"), page))
            .alias("url"),
            (F.col("l_returnflag") != "N").alias("cited"),
        )

    _line_order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
    ]

    def ranked_of(self, answers: DataFrame) -> DataFrame:
        """Sources of some answers with their 1-based rank, and the rank among the cited ones."""
        return self._ranked(self._sources_of(answers))

    def _sources_of(self, answers: DataFrame) -> DataFrame:
        return self.sources.join(answers.select("result_id"), "result_id", "left_semi")

    @staticmethod
    def _ranked(sources: DataFrame, of: DataFrame | None = None) -> DataFrame:
        return ordinal(
            sources,
            ["result_id"],
            ["pos"],
            "rank",
            slices=[F.col("pos.l_linenumber")],
            flag="cited",
            flag_out="cited_rank",
            of=of,
        )

    def texts_of(self, answers: DataFrame) -> DataFrame:
        """Texts of some answers: the names they give, in order of first appearance.

        Names are reduced to their first position per answer before they are
        joined into a text, so a text holds at most one entry per known entity.
        """
        lines = self.raw("lineitem").filter(F.col("l_discount") >= 0.05)
        first = (
            lines.join(answers.select(F.col("result_id").alias("l_orderkey")), "l_orderkey", "left_semi")
            .groupBy(F.col("l_orderkey").alias("result_id"), (F.col("l_suppkey") % ENTITY_COUNT).cast("int").alias("n_nationkey"))
            .agg(F.min(F.struct(*self._line_order)).alias("pos"))
        )
        named = first.join(self.raw("nation").select("n_nationkey", "n_name"), "n_nationkey")
        # array_sort makes an ordering per comparison, and so does a struct within a struct.
        entries = F.sort_array(F.collect_list(F.struct("pos.*", "n_name")))
        return named.groupBy("result_id").agg(
            F.array_join(F.transform(entries, lambda e: e["n_name"]), " ").alias("raw_text")
        )

    @cached_property
    def verdicts(self) -> Snapshots:
        """The kept verdicts of this folder of tables."""
        return Snapshots(self.spark, kept_path(self.spark, "detections", self.root), ["project_id"])

    @property
    def detections(self) -> DataFrame:
        """The newest verdicts on every answer; computed when they are first read."""
        return self.verdicts.current(lambda: self.detected(self.entities))

    def detected(self, entities: DataFrame, answers: DataFrame | None = None) -> DataFrame:
        """The verdicts on answers (by default all) by a dictionary."""
        a = self.results if answers is None else answers
        # Of all answers, no source has to be looked up before it is numbered.
        sources = self.sources if answers is None else self._sources_of(a)
        ranked = self._ranked(sources, a.filter(F.col("error").isNull()).select("result_id", "project_id"))
        return detections(a, ranked, self.texts_of(a), entities)

    # Inspection answers are answers of the log, so they share its sources and texts.
    inspection_sources = property(lambda self: self.sources)

    def inspection_ranked_of(self, answers: DataFrame) -> DataFrame:
        return self.ranked_of(answers)

    def inspection_texts_of(self, answers: DataFrame) -> DataFrame:
        return self.texts_of(answers)

    # --- inspections ------------------------------------------------------------------------
    @staticmethod
    def _inspection(prompt_id: Column, project_id: Column) -> Column:
        return F.floor(prompt_id / 25) * len(PROJECTS) + project_number(project_id)

    @cached_property
    def inspection_questions(self) -> DataFrame:
        """Questions of each inspection: the prompts of one project within a block of 25 ids."""
        return self.raw("customer").select(
            self._inspection(F.col("c_custkey"), F.col("c_mktsegment")).alias("inspection_id"),
            (F.col("c_custkey") % 25).cast("int").alias("question_index"),
            F.col("c_custkey").alias("prompt_id"),
            F.col("c_mktsegment").alias("project_id"),
            F.col("c_name").alias("text"),
        )

    @cached_property
    def inspections(self) -> DataFrame:
        q = self.inspection_questions.groupBy("inspection_id", "project_id").agg(F.count("*").alias("questions"))
        p = project_number(F.col("project_id")).cast("string")
        block = F.floor(F.col("inspection_id") / len(PROJECTS))
        return q.select(
            "inspection_id",
            "project_id",
            "questions",
            F.concat(F.lit("http://s"), p, F.lit(".n"), p, F.lit(".example/p/"), (block % 50).cast("string")).alias("url"),
            F.timestamp_add("HOUR", -(F.col("inspection_id") % 900).cast("int"), self.now).alias("created_at"),
            F.when(F.col("inspection_id") % 7 == 0, "running").otherwise("done").alias("status"),
            ((F.col("inspection_id") * 37 % 100) / 1000).alias("cost_usd"),
        )

    @cached_property
    def inspection_answers(self) -> DataFrame:
        """Latest answer per question and engine (at most one per cell of the grid)."""
        latest = self.results.groupBy("prompt_id", "engine_id").agg(
            F.max_by(F.struct("result_id", "error", "cost_usd"), F.struct("created_at", "result_id")).alias("a")
        )
        q = self.inspection_questions.select("inspection_id", "question_index", "prompt_id", "project_id")
        return latest.join(q, "prompt_id").select(
            "inspection_id", "project_id", "question_index", "prompt_id", "engine_id", "a.result_id", "a.error", "a.cost_usd"
        )

"""The answer log over its own tables (see ``schema``), as the metrics read it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.functions.urls import normalize_domain
from sightline.operators.detect import detections


def engines_per_project(projects: DataFrame, engines: DataFrame) -> DataFrame:
    """Every engine under every project: both are short lists, joined on a constant."""
    one = F.lit(1).alias("_all")
    return projects.select("project_id", one).join(engines.select("*", one), "_all").drop("_all")


@dataclass
class TableLog:
    """Lazy view of the tables at a moment; ``tables`` maps names to DataFrames."""

    tables: dict[str, DataFrame]
    as_of: str
    days: int = K.DEFAULT_DAYS

    @property
    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp_ntz")

    def _start(self, periods: int) -> Column:
        return F.expr(f"timestamp_ntz'{self.as_of}' - interval {self.days * periods} days")

    @cached_property
    def entities(self) -> DataFrame:
        def row(source: DataFrame, kind: str, name: str, project: str, ordinal: Column) -> DataFrame:
            return source.select(
                F.col(project).alias("project_id"), F.col("id").alias("entity_id"), F.lit(kind).alias("entity_type"),
                ordinal.alias("ordinal"), F.col(name).alias("name"),
                F.concat(F.array(name), F.coalesce("aliases", F.array().cast("array<string>"))).alias("terms"), "domains",
            )

        first = row(self.tables["projects"], "brand", "brand_name", "id", F.lit(0).cast("long"))
        rivals = row(self.tables["competitors"], "competitor", "name", "project_id", F.unix_micros(F.col("created_at").cast("timestamp")))
        return first.unionByName(rivals)

    @cached_property
    def projects(self) -> DataFrame:
        return self.tables["projects"].withColumnRenamed("id", "project_id")

    @cached_property
    def prompts(self) -> DataFrame:
        return self.tables["prompts"].withColumnRenamed("id", "prompt_id")

    @cached_property
    def prompt_projects(self) -> DataFrame:
        return self.prompts.select("prompt_id", "project_id")

    @cached_property
    def engines(self) -> DataFrame:
        return self.tables["engines"].withColumn("ordinal", F.unix_micros(F.col("created_at").cast("timestamp"))).withColumnRenamed(
            "id", "engine_id"
        )

    @cached_property
    def project_engines(self) -> DataFrame:
        return engines_per_project(self.projects, self.engines)

    @cached_property
    def runs(self) -> DataFrame:
        return self.tables["runs"].withColumnRenamed("id", "run_id").withColumnRenamed("cost_estimate", "cost_usd")

    def _answers(self, rows: DataFrame) -> DataFrame:
        runs = self.tables["runs"].select(F.col("id").alias("run_id"), "project_id")
        a = rows.select(
            F.col("id").alias("result_id"), "run_id", "prompt_id", "engine_id", "repeat_index", "created_at", "error",
            F.col("cost_estimate").alias("cost_usd"), "latency_ms", "web_search", "usage",
        )
        return a.join(runs, "run_id")

    @cached_property
    def results(self) -> DataFrame:
        return self._answers(self.tables["results"])

    def window(self, periods: int = 1) -> DataFrame:
        return self._answers(self.tables["results"].filter(F.col("created_at") >= self._start(periods)))

    def in_current(self) -> Column:
        return F.col("created_at") >= self._start(1)

    @staticmethod
    def _unnested(table: DataFrame) -> DataFrame:
        """One row per source; its place in the list is its rank. A missing ``cited`` flag means cited.

        The rank among cited sources is a running count over the rows of one list.
        """
        rows = table.select(F.col("id").alias("result_id"), F.posexplode("sources").alias("_i", "s"))
        flat = rows.select(
            "result_id",
            (F.col("_i") + 1).cast("long").alias("rank"),
            F.col("s.url").alias("url"),
            F.coalesce("s.domain", normalize_domain(F.col("s.url"))).alias("domain"),
            F.coalesce("s.cited", F.lit(True)).alias("cited"),
        )
        upto = W.partitionBy("result_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
        return flat.withColumn("cited_rank", F.when(F.col("cited"), F.count_if("cited").over(upto)))

    @cached_property
    def sources(self) -> DataFrame:
        return self._unnested(self.tables["results"])

    def ranked_of(self, answers: DataFrame) -> DataFrame:
        return self.sources.join(answers.select("result_id"), "result_id", "left_semi")

    @staticmethod
    def _texts(table: DataFrame, answers: DataFrame) -> DataFrame:
        return table.select(F.col("id").alias("result_id"), "raw_text").join(answers.select("result_id"), "result_id", "left_semi")

    def texts_of(self, answers: DataFrame) -> DataFrame:
        return self._texts(self.tables["results"], answers)

    @cached_property
    def detections(self) -> DataFrame:
        """The stored verdicts; computed from the answers where the tables hold none."""
        if "detections" in self.tables:
            return self.tables["detections"]
        return detections(self.results, self.ranked_of(self.results), self.texts_of(self.results), self.entities)

    # --- inspections -----------------------------------------------------------------
    @cached_property
    def inspections(self) -> DataFrame:
        return self.tables["inspections"].select(
            F.col("id").alias("inspection_id"), "project_id", "url", "status", "created_at", F.col("cost_estimate").alias("cost_usd"),
            F.size("questions").alias("questions"),
        )

    @cached_property
    def inspection_questions(self) -> DataFrame:
        return self.tables["inspections"].select(
            F.col("id").alias("inspection_id"), "project_id", F.posexplode("questions").alias("question_index", "q")
        ).select("inspection_id", "project_id", "question_index", F.col("q.text").alias("text"))

    @cached_property
    def inspection_answers(self) -> DataFrame:
        owners = self.tables["inspections"].select(F.col("id").alias("inspection_id"), "project_id")
        return self.tables["inspection_answers"].select(
            "inspection_id", "question_index", "engine_id", F.col("id").alias("result_id"), "error", F.col("cost_estimate").alias("cost_usd")
        ).join(owners, "inspection_id")

    @cached_property
    def inspection_sources(self) -> DataFrame:
        return self._unnested(self.tables["inspection_answers"])

    def inspection_ranked_of(self, answers: DataFrame) -> DataFrame:
        return self.inspection_sources.join(answers.select("result_id"), "result_id", "left_semi")

    def inspection_texts_of(self, answers: DataFrame) -> DataFrame:
        return self._texts(self.tables["inspection_answers"], answers)

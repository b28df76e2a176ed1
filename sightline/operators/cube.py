"""A daily cube of the answers: sums per day that add up to the figures of any window of whole days.

Counts are kept per project, day and engine, and per project, day and entity. Distinct prompts do
not add up, so each entity's cell keeps them as a bitmap: prompts have lasting numbers, a cell
holds those of one range of numbers (4 KB at most), and a window joins the bitmaps of its days.
A day that gains answers or whose dictionary has changed is counted anew; other days keep theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.operators import answers as A
from sightline.operators.detect import brand_flags, entity_flags
from sightline.operators.windows import ordinal
from sightline.sources.snapshots import Snapshots


def _first_day(log, periods: int) -> Column:
    """First day of the window and of the one before. A window must begin at midnight."""
    day, _, time = str(log.as_of).partition(" ")
    if time.strip("0:. "):
        raise ValueError(f"a window up to {log.as_of} begins inside a day; the cube knows whole days")
    return F.date_sub(F.lit(day).cast("date"), log.days * periods)


class DailyCube:
    def __init__(self, spark: SparkSession, path: str):
        self.numbers = Snapshots(spark, f"{path}/prompt_numbers", ["project_id"])
        self.answers = Snapshots(spark, f"{path}/answers", ["day"])
        self.entities = Snapshots(spark, f"{path}/entities", ["day"])

    def _number(self, prompts: DataFrame) -> DataFrame:
        """Numbers from 0 per project; prompts that have one keep it, new ones follow."""
        known = self.numbers.read()
        key = ["project_id", "prompt_id"]
        fresh = prompts if known is None else prompts.join(known, key, "left_anti")
        placed = ordinal(fresh, ["project_id"], ["prompt_id"], "place", [F.pmod(F.xxhash64("prompt_id"), F.lit(64))])
        if known is None:
            self.numbers.write(placed.select(*key, (F.col("place") - 1).alias("number")))
        elif not fresh.isEmpty():
            used = known.groupBy("project_id").agg(F.max("number").alias("used"))
            placed = placed.join(used, "project_id", "left")
            self.numbers.add(placed.select(*key, (F.col("place") + F.coalesce("used", F.lit(-1))).alias("number")))
        return self.numbers.read()

    def refresh(self, log, days: DataFrame | None = None) -> None:
        """Count some days (rows of ``day``; None: all) anew from the log; a day without answers goes."""
        rows = log.results.withColumn("day", F.to_date("created_at"))
        if days is not None:
            rows = rows.join(days, "day", "left_semi")
        prompts = rows.select("project_id", "prompt_id").where("prompt_id IS NOT NULL").distinct()
        numbers = self._number(prompts)
        ok = F.col("error").isNull()
        answers = brand_flags(log, rows).groupBy("project_id", "day", "engine_id").agg(
            F.count_if(ok).alias("total"), F.count_if("cited").alias("cited"), F.count_if("mentioned").alias("mentioned")
        )
        seen = entity_flags(log, rows).join(rows.select("result_id", "project_id", "prompt_id", "day"), "result_id")
        seen = seen.join(numbers, ["project_id", "prompt_id"], "left")
        entities = seen.groupBy("project_id", "day", "entity_id", "entity_type", F.bitmap_bucket_number("number").alias("bucket")).agg(
            F.count_if("cited").alias("cited"), F.count_if("mentioned").alias("mentioned"),
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("prompts"),
        )
        for table, cells in ((self.answers, answers), (self.entities, entities)):
            if days is None:
                table.write(cells)
            else:
                table.replace(cells, days.select("day"))

    def _answers(self, log) -> tuple[DataFrame, Column]:
        return self.answers.read().filter(F.col("day") >= _first_day(log, 2)), F.col("day") >= _first_day(log, 1)

    def _entities(self, log) -> DataFrame:
        return self.entities.read().filter(F.col("day") >= _first_day(log, 2))

    def overview(self, log, zone: str = K.DEFAULT_TIME_ZONE) -> DataFrame:
        """The headline figures of ``answers.overview`` from the cube."""
        cells, cur = self._answers(log)
        sums = {"answers": (cur, "total"), "_cc": (cur, "cited"), "_cm": (cur, "mentioned")}
        sums |= {"_pt": (~cur, "total"), "_pc": (~cur, "cited"), "_pm": (~cur, "mentioned")}
        both = cells.groupBy("project_id").agg(*[F.sum(F.when(when, F.col(c)).otherwise(0)).alias(n) for n, (when, c) in sums.items()])
        cited = self._entities(log).filter(cur).filter("cited > 0")
        voice = cited.groupBy("project_id").agg(
            F.sum(F.when(F.col("entity_type") == "brand", F.col("cited")).otherwise(0)).alias("_brand"), F.sum("cited").alias("_all")
        )
        return A.headline(log, both, voice, zone)

    def share_of_voice(self, log) -> DataFrame:
        """The rows of ``answers.share_of_voice`` from the cube."""
        cells, cur = self._answers(log)
        totals = cells.groupBy("project_id").agg(
            F.sum(F.when(cur, F.col("total")).otherwise(0)).alias("answers"), F.sum(F.when(~cur, F.col("total")).otherwise(0)).alias("_prev")
        )
        merged = self._entities(log).groupBy("project_id", "entity_id", "bucket").agg(
            F.sum(F.when(cur, F.col("cited")).otherwise(0)).alias("cited"),
            F.sum(F.when(cur, F.col("mentioned")).otherwise(0)).alias("mentioned"),
            F.sum(F.when(~cur, F.col("cited")).otherwise(0)).alias("_pc"),
            F.bitmap_count(F.bitmap_or_agg(F.when(cur, F.col("prompts")))).alias("prompt_count"),
        )
        counts = merged.groupBy("project_id", "entity_id").agg(*[F.sum(c).alias(c) for c in ("cited", "mentioned", "_pc", "prompt_count")])
        return A.voices(log, totals, counts)

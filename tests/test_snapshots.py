import os

import pytest
from pyspark.sql import functions as F

from sightline import schema
from sightline.operators import detect as D
from sightline.sources import tables
from sightline.sources.binding import AnswerLog
from sightline.sources.page_cache import PageCache
from sightline.sources.snapshots import Files, Snapshots
from sightline.sources.stage import kept_path


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, path, n=50):
    t = Snapshots(spark, str(path), ["k"], n_slices=8)
    t.write(spark.range(n).select((F.col("id") % 10).alias("k"), F.col("id").alias("v")))
    return t


def test_other_slices_keep_their_files(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    before = t.folders()
    keys = spark.createDataFrame([(3,)], "k long")
    t.replace(spark.createDataFrame([(3, 1000), (3, 1001)], "k long, v long"), keys)
    (touched,) = t.slices_of(keys)
    assert {k: f for k, f in t.folders().items() if k != touched} == {k: f for k, f in before.items() if k != touched}
    assert rows(t.read()) == sorted([(i % 10, i) for i in range(50) if i % 10 != 3] + [(3, 1000), (3, 1001)])
    assert rows(t.read(version=1)) == sorted((i % 10, i) for i in range(50))  # a reader of the old version


def test_added_rows_rewrite_nothing_until_a_slice_has_many_files(spark, tmp_path):
    t = table(spark, tmp_path / "t", n=10)
    want = [(i, i) for i in range(10)]
    for step in range(10):
        before = t.folders()
        t.add(spark.createDataFrame([(100, step)], "k long, v long"))
        want.append((100, step))
        (touched,) = t.slices_of(spark.createDataFrame([(100,)], "k long"))
        assert all(t.folders()[k] == f for k, f in before.items() if k != touched)
        assert len(t.folders()[touched]) <= 8 and rows(t.read()) == sorted(want)


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    fail = F.when(F.col("v") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long")
    with pytest.raises(Exception, match="lost"):
        t.write(spark.range(20).select(F.col("id").alias("k"), F.col("id").alias("v")).withColumn("v", fail))
    assert t.version == 1 and t.read().count() == 50


def test_two_writers_of_one_version(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    files.create("manifests/000000000001.json", "{}")
    with pytest.raises(FileExistsError):
        files.create("manifests/000000000001.json", "{}")
    assert files.names() == ["manifests"]


def test_expire_keeps_what_the_newest_versions_name(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for step in range(3):
        t.replace(spark.createDataFrame([(3, step)], "k long, v long"), spark.createDataFrame([(3,)], "k long"))
    newest, before = rows(t.read()), rows(t.read(version=3))
    assert t.expire(keep=2) and t.manifests.versions() == [3, 4]
    assert rows(t.read()) == newest and rows(t.read(version=3)) == before
    assert len(os.listdir(tmp_path / "t" / "data")) == 3  # the first write's other slices, and two replacements


def test_empty_tables_and_other_columns(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"), ["k"])
    assert t.read() is None
    t.write(spark.createDataFrame([], "k long, v long"))
    assert rows(t.read()) == [] and t.read().columns == ["k", "v"]
    with pytest.raises(ValueError):
        t.add(spark.createDataFrame([(1,)], "k long"))


def test_a_page_is_parsed_once(spark, tmp_path):
    parsed = spark.sparkContext.accumulator(0)

    def analyse(pages):
        def count(batches):
            for batch in batches:
                parsed.add(batch.num_rows)
                yield batch

        return pages.select("page", F.length("page").alias("size")).mapInArrow(count, "page string, size int")

    def pages(*names):
        return spark.createDataFrame([(n,) for n in names], "page string")

    def refresh(cache, wanted, day):
        before = parsed.value
        found = cache.refresh(wanted, F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp"))
        return rows(found.select("page", "size", F.dayofmonth("analysed_at"))), parsed.value - before

    cache = PageCache(spark, str(tmp_path / "c"), analyse, "v1")
    assert refresh(cache, pages("a.com/x", "b.com", "a.com/x", None), 1) == ([("a.com/x", 7, 1), ("b.com", 5, 1)], 2)
    assert refresh(cache, pages("a.com/x"), 2)[1] == 0
    got, n = refresh(cache, pages("a.com/x", "a.com/y"), 3)
    assert (got, n) == ([("a.com/x", 7, 1), ("a.com/y", 7, 3), ("b.com", 5, 1)], 1)
    # Past the time to live: the wanted page only; b.com stays as old as it is.
    assert refresh(cache, pages("a.com/x"), 9) == ([("a.com/x", 7, 9), ("a.com/y", 7, 3), ("b.com", 5, 1)], 1)
    newer = PageCache(spark, str(tmp_path / "c"), analyse, "v2")
    assert refresh(newer, pages("b.com"), 9) == ([("a.com/x", 7, 9), ("a.com/y", 7, 3), ("b.com", 5, 9)], 1)
    assert refresh(newer, pages(), 9)[1] == 0


def test_metrics_see_recomputed_verdicts(spark, sf):
    log = AnswerLog(spark, sf)
    before = log.detections
    project = log.entities.where("entity_id = 20").select("project_id")
    others = {k: f for k, f in log.verdicts.folders().items() if k not in log.verdicts.slices_of(project)}
    try:
        D.recompute_projects(log.verdicts, log, log.entities.where("entity_id <> 20"), project)
        now = log.detections
        assert now.where("entity_id = 20").isEmpty() and not before.where("entity_id = 20").isEmpty()
        assert {k: f for k, f in log.verdicts.folders().items() if k in others} == others
        want = D.detections(log.results, log.ranked_of(log.results), log.texts_of(log.results), log.entities.where("entity_id <> 20"))
        assert now.exceptAll(want).isEmpty() and want.exceptAll(now).isEmpty()
        assert AnswerLog(spark, sf).detections.count() == want.count()
    finally:
        D.recompute_projects(log.verdicts, log, log.entities, project)
    assert log.detections.exceptAll(before).isEmpty()


def test_kept_tables_follow_their_inputs(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    first = kept_path(spark, "x", str(tmp_path))
    assert kept_path(spark, "x", str(tmp_path)) == first
    spark.range(3).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert kept_path(spark, "x", str(tmp_path)) != first


def test_a_copy_that_dies_leaves_the_old_one(spark, tmp_path):
    def full(name, n):
        kinds = schema.TABLES[name].fields
        return spark.range(n).select(*[F.col("id").cast("string").alias(f.name) if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])

    target = str(tmp_path / "copy")
    tables.snapshot_copy(spark, {"projects": full("projects", 2), "results": full("results", 3)}, target)
    broken = full("results", 5).withColumn("raw_text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.snapshot_copy(spark, {"projects": full("projects", 9), "results": broken}, target, force=True)
    assert tables.scan_table(spark, target, "projects").count() == 2 and tables.scan_table(spark, target, "results").count() == 3
    tables.snapshot_copy(spark, {"projects": full("projects", 9)}, target, force=True)
    assert tables.scan_table(spark, target, "projects").count() == 9 and tables.scan_table(spark, target, "results").count() == 3

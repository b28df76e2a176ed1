"""The daily cube against the figures counted from the answers."""

import pytest
from pyspark.sql import functions as F

import sightline.operators.answers as A
from sightline.operators.cube import DailyCube
from sightline.sources.binding import AnswerLog

from answer_fixture import answer_log


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def same(cube, log):
    assert rounded(cube.overview(log, "UTC")) == rounded(A.overview(log, "UTC"))
    assert rounded(cube.share_of_voice(log)) == rounded(A.share_of_voice(log))


def folders(table):
    return {k: tuple(v) for k, v in table.folders().items()}


def test_any_window_from_the_cube(spark, sf, tmp_path):
    log = AnswerLog(spark, sf)
    cube = DailyCube(spark, str(tmp_path / "cube"))
    cube.refresh(log)
    for days in (1, 45, log.days):
        same(cube, AnswerLog(spark, sf, days=days))


def test_days_are_added_and_counted_again(spark, sf, tmp_path):
    """Built day range by day range, with new prompts later on; numbers last, other days keep their files."""
    log = AnswerLog(spark, sf)
    days = log.results.select(F.to_date("created_at").alias("day")).distinct()
    cube = DailyCube(spark, str(tmp_path / "cube"))
    early = F.col("day") < F.lit("2001-03-01").cast("date")
    cube.refresh(log, days.filter(early))
    first = {(r.project_id, r.prompt_id): r.number for r in cube.numbers.read().collect()}
    cube.refresh(log, days.filter(~early))
    numbers = {(r.project_id, r.prompt_id): r.number for r in cube.numbers.read().collect()}
    assert first.items() <= numbers.items() and len({(p, n) for (p, _), n in numbers.items()}) == len(numbers)
    same(cube, log)
    before = folders(cube.entities)
    one = days.filter(~early).orderBy("day").limit(1)
    cube.refresh(log, one)
    changed = [k for k, v in folders(cube.entities).items() if before.get(k) != v]
    assert len(changed) <= 1
    same(cube, log)


def test_a_window_inside_a_day_is_refused(spark, tmp_path):
    log = answer_log(spark)
    cube = DailyCube(spark, str(tmp_path / "cube"))
    cube.refresh(log)
    with pytest.raises(ValueError):
        cube.overview(log)

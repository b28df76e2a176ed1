"""Small expressions shared by the metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import constants as K


def rate(part: Column, whole: Column) -> Column:
    """Share in 0..1, null when there is nothing to divide by."""
    return F.try_divide(part, whole)


def points(current: Column, previous: Column) -> Column:
    """Change in percentage points, null when a side is null."""
    return (current - previous) * 100


def euros(usd: Column) -> Column:
    return usd * K.USD_TO_EUR


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, rounded half up."""
    return F.floor(F.try_divide(part, whole) * 1000 + 0.5) / 10


def status(error: Column, cited: Column, mentioned: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(cited, "cited").when(mentioned, "mentioned").otherwise("none")


def themes(tags: Column) -> Column:
    """Tags of a prompt, or the theme of prompts without any."""
    return F.when(F.size(tags) == 0, F.array(F.lit(K.NO_THEME))).otherwise(tags)


def joined(column: Column, sep: str = ",") -> Column:
    return F.array_join(column, sep)


def theme_order(theme: Column) -> list[Column]:
    """French-style order of themes: accents and case ignored, the no-theme group last."""
    from sightline.functions.text import normalize_text

    return [(theme == K.NO_THEME).cast("int").asc(), normalize_text(theme).asc(), theme.asc()]

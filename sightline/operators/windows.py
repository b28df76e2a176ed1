"""Window-shaped building blocks that survive a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Top k rows per key. Spark cuts each task to k rows per key before the shuffle
    (window group limit), so a hot key costs k rows per task, not all of its rows."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def ordinal(
    df: DataFrame, keys: list[str], order: list[str], out: str, slices: list[Column], flag: str | None = None,
    flag_out: str = "flag_rank", of: DataFrame | None = None,
) -> DataFrame:
    """1-based position of every row within its key, and among the rows with ``flag`` set.

    Every key is cut into ``slices`` (leading parts of the order): rows are numbered
    inside their slice and shifted by the rows of the slices before it, so no
    task ever sorts the whole key.

    of: rows by key, each of which gets the numbered rows of its key beside it, as by a join on the
    keys afterwards. It comes with the shifts, so the numbered rows do not travel again for it.
    """
    flagged = F.col(flag).cast("long") if flag else F.lit(0).cast("long")
    names = [f"_slice{i}" for i in range(len(slices))]
    sliced = df.select("*", *[s.alias(n) for s, n in zip(slices, names)])
    cells = sliced.groupBy(*keys, *names).agg(F.count("*").alias("_n"), F.sum(flagged).alias("_f"))
    before = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = cells.select(
        *keys, *names, F.coalesce(F.sum("_n").over(before), zero).alias("_before"), F.coalesce(F.sum("_f").over(before), zero).alias("_fbefore")
    )
    if of is not None:
        offsets = offsets.join(of, keys)
    inside = W.partitionBy(*keys, *names).orderBy(*order)
    # Numbered before the join, where ``of`` may repeat a key.
    numbers = {"_no": F.row_number().over(inside)}
    added = {out: (F.col("_no") + F.col("_before")).cast("long")}
    if flag:
        numbers["_fno"] = F.sum(flagged).over(inside.rowsBetween(W.unboundedPreceding, 0))
        added[flag_out] = F.when(F.col(flag), F.col("_fno") + F.col("_fbefore"))
    return sliced.withColumns(numbers).join(offsets, [*keys, *names]).withColumns(added).drop(*names, *numbers, "_before", "_fbefore")


def _ordered_code(value: Column) -> Column:
    """A fraction's bits as a whole number of the same order (and back: the function undoes itself)."""
    return F.when(value < 0, value.bitwiseXOR(F.lit(2**63 - 1))).otherwise(value)


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exact interpolated median of a numeric column, by radix selection.

    Rows become value counts, and those a tree of histograms by leading digits of 16 bits. From
    the top, each level tells the digit in which the two middle places lie, and only the counts
    below that digit are looked at next. A key's rows, however many values they have, are
    spread by key and value; no task sorts more than the 65,536 digits below one prefix.

    Nulls do not count; a key without values has no row; null keys are a key.
    """
    kind = df.schema[value].dataType
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    whole = isinstance(kind, IntegralType)
    names = [f"_k{i}" for i in range(len(keys))]
    bits = F.col(value).cast("long") if whole else F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(value).cast("double")).cast("long")
    counts = counts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], bits.alias("_v"), "_n")
    levels = [counts if whole else counts.withColumn("_v", _ordered_code(F.col("_v")))]
    digits = {"byte": 1, "tinyint": 1, "short": 1, "smallint": 1, "integer": 2, "int": 2}.get(kind.typeName(), 4)
    for _ in range(digits - 1):
        levels.append(levels[-1].groupBy(*names, F.shiftright("_v", 16).alias("_v")).agg(F.sum("_n").alias("_n")))

    def upto(group: list[str]) -> Column:
        return F.sum("_n").over(W.partitionBy(*group).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))

    here = (F.col("_place") <= F.col("_upto")) & (F.col("_place") > F.col("_upto") - F.col("_n"))
    inside = F.col("_place") - F.col("_upto") + F.col("_n")
    total = F.sum("_n").over(W.partitionBy(*names))
    top = levels.pop().withColumns({"_upto": upto(names), "_total": total})
    middle = F.expr("array((_total + 1) div 2, _total div 2 + 1)")
    found = top.select("*", F.posexplode(middle).alias("_end", "_place")).filter(here).select(*names, "_end", "_v", inside.alias("_place"))
    while levels:
        above = found.select(*[F.col(k).alias(f"{k}_of") for k in names], "_end", F.col("_v").alias("_prefix"), "_place")
        same = F.shiftright("_v", 16) == F.col("_prefix")
        for k in names:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
        below = levels.pop().join(above, same).withColumn("_upto", upto([*names, "_end"]))
        found = below.filter(here).select(*names, "_end", "_v", inside.alias("_place"))
    if not whole:
        found = found.withColumn("_v", _ordered_code(F.col("_v")))
        found = found.withColumn("_v", F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), F.col("_v")).cast("double"))
    middles = found.groupBy(*names).agg(F.avg(F.col("_v").cast("double")).alias(out))
    return middles.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], out)

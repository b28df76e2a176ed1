"""Line dedup: repeated runs of lines by prefix doubling over line-ID sequences.

All texts are sequences of line IDs. Round k names every position by the 2**k lines that
start there: positions with equal names are an interval of the suffix array whose longest
common prefix is at least 2**k lines. Round k + 1 joins each position's name with the one
2**k lines further and names the pairs, so log2(length) rounds sort suffixes by any length.
A position whose name nobody shares leaves the work at once, because no longer run from
there can be shared either. Names are exact: the first position (by id and line) of the
interval.

Runs of ``min_lines`` lines decide, and shorter ones of at least ``min_words`` words: of an
interval the first position stays, and the lines of every later copy go. Lengths between two
powers of two are two stretches that overlap. Overlapping and adjacent copies together are the
maximal repeated runs: a longer run is covered by its stretches of ``min_lines`` lines, so
rounds beyond ``min_lines`` would split intervals further but delete nothing more.

Defined cases: a null text is empty, a text of one empty line; lines are compared byte by
byte; runs of empty lines only are left; rows with the same id and text are one document,
and with the same id and other text follow each other by a hash of the text; extra
columns are kept and never clash with work columns; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.sources import checkpointed

DOCUMENT = ["doc_id", "version"]


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("version"), text.alias("text"))


def line_positions(docs: DataFrame) -> DataFrame:
    """``doc_id, version, line, h1, h2``: every line of every text as a 128-bit ID."""
    lines = _documents(docs).select(*DOCUMENT, F.posexplode(F.split("text", "\n")).alias("line", "words"))
    return lines.select(
        *DOCUMENT,
        "line",
        F.xxhash64("words").alias("h1"),
        F.xxhash64("words", F.lit("second")).alias("h2"),
        F.regexp_count("words", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words"),
        (F.trim("words") != "").alias("filled"),
    )


def _named(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Positions whose keys another position shares, with the first of these as name."""
    place = F.struct(*DOCUMENT, "line")
    intervals = (
        positions.groupBy(*keys)
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first < last")
        .drop("last")
    )
    return positions.join(intervals, keys).select(*DOCUMENT, "line", "n_words", "filled", F.col("first").alias("name"))


def _pairs(names: DataFrame, further: int, overlap: bool = False) -> DataFrame:
    """Each position's name with the name that is so many lines further.

    overlap: the stretches share lines, so words are those of the first lines and all of the second.
    """
    ahead = names.select(
        *DOCUMENT, (F.col("line") - further).alias("line"), F.col("name").alias("name_ahead"), F.col("n_words").alias("words_ahead"),
        F.col("filled").alias("filled_ahead"),
    )
    n_words = F.col("n_words") + F.col("words_ahead")
    if overlap:
        n_words = F.lit(None).cast("int")
    return names.join(ahead, [*DOCUMENT, "line"]).select(
        *DOCUMENT, "line", "name", "name_ahead", n_words.alias("n_words"), (F.col("filled") | F.col("filled_ahead")).alias("filled")
    )


def repeated_windows(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """``doc_id, version, line, length, filled, name`` of every window of lines that occurs twice
    and is min_lines long, or shorter with min_words words or more."""
    lines = line_positions(docs)
    # Counts first, on two numbers per line; then only repeated lines are dealt and named.
    shared = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = lines.join(shared, ["h1", "h2"], "left_semi").dropDuplicates([*DOCUMENT, "line"])
    single = checkpointed(_named(repeated, ["h1", "h2"]))
    doubled, found, length = single, [], 1
    for size in range(1, min_lines + 1):
        if size == 2 * length:
            doubled, length = checkpointed(_named(_pairs(doubled, length), ["name", "name_ahead"])), size
        names = doubled
        if size > length:  # two stretches that overlap
            names = checkpointed(_named(_pairs(doubled, size - length, overlap=True), ["name", "name_ahead"]))
            if size < min_lines:  # words of the lines, for the sum over the window
                words = single.select(*DOCUMENT, F.explode(F.sequence(F.col("line") - (size - 1), "line")).alias("line"), F.col("n_words").alias("own"))
                words = words.groupBy(*DOCUMENT, "line").agg(F.sum("own").alias("n_words"))
                names = names.drop("n_words").join(words, [*DOCUMENT, "line"])
        if size < min_lines:
            names = names.where(F.col("n_words") >= min_words)
        found.append(names.select(*DOCUMENT, "line", F.lit(size).alias("length"), "filled", "name"))
    return reduce(DataFrame.unionByName, found)


def removed_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """``doc_id, version, line`` of every line that a later copy covers."""
    place = F.struct(*DOCUMENT, "line")
    later = repeated_windows(docs, min_lines, min_words).where(F.col("filled") & (F.col("name") < place))
    return later.select(
        *DOCUMENT, F.explode(F.sequence(F.col("line"), F.col("line") + F.col("length") - 1)).alias("line")
    ).distinct()


def repeated_runs(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """``doc_id, start, n_lines``: the maximal runs of lines that go."""
    order = Window.partitionBy(*DOCUMENT).orderBy("line")
    runs = removed_lines(docs, min_lines, min_words).withColumn("run", F.col("line") - F.row_number().over(order))
    return runs.groupBy(*DOCUMENT, "run").agg(F.min("line").alias("start"), F.count("*").alias("n_lines")).drop("run", "version")


def remove_repeats(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """docs with ``text`` without the lines that repeat, and ``n_lines``, ``n_removed``."""
    gone = removed_lines(docs, min_lines, min_words).groupBy(*DOCUMENT).agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.struct(*DOCUMENT).alias("_document"), "gone")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    document = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"))
    # The text leaves in one column of its own, so that no other column's name matters.
    rows = docs.select(F.struct("*").alias("_row"), document.alias("_document"), F.split(text, "\n").alias("_lines"))
    joined = rows.join(gone, "_document", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    last = F.size("_lines") - 1
    kept = F.transform(F.array_except(F.sequence(F.lit(0), last), "gone"), lambda i: F.get("_lines", i))
    others = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return joined.select(
        *others,
        F.array_join(kept, "\n").alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
    )

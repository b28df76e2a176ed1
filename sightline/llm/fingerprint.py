"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is the multiset of its units: paragraphs, and inside a paragraph its sentences.
Each unit is hashed to a wide vector, and the fingerprint is the sum of these vectors,
every lane modulo a power of two:

* ``LANES`` lanes modulo 2**32 that decide equality,
* ``SIGNS`` lanes of +1 or -1 modulo 2**16 that measure likeness,
* the number of units modulo 2**32.

The sum does not depend on the order of units, and units are inserted or deleted by adding
or subtracting their vectors (`combine`). The squared distance of the sign lanes of two
fingerprints, divided by their number, estimates how many units differ; with the counts it
gives the share of common units (`likeness`), whose error falls with ``SIGNS``.

Everything is built of column expressions. Defined cases: a null text is empty and has no
units (all lanes 0); empty units count nothing; equal texts have equal fingerprints;
documents with the same id follow each other by text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, SIGNS = 16, 128
_UNIT_END = r"\n+|(?<=[.!?]) +"


def units(text: Column) -> Column:
    """Paragraphs of a text, long ones cut at the ends of their sentences."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _UNIT_END), lambda u: u != "")


def vectors(rows: DataFrame, keys: list[str], unit: str = "unit") -> DataFrame:
    """keys and ``vector array<long>`` per key, from one row per unit (null: no unit)."""
    wide = [f"w{i}" for i in range(LANES // 2)]
    signs = [f"b{i}" for i in range(SIGNS // 64)]
    some = F.col(unit).isNotNull()
    hashed = rows.select(
        *keys, some.alias("some"), *[F.when(some, F.xxhash64(F.col(unit), F.lit(h))).alias(h) for h in wide + signs]
    )
    sums = []
    for h in wide:
        sums += [F.sum(F.col(h).bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]
    # Two bits of a sign hash are counted in one sum, 32 binary digits apart.
    pair = F.lit((1 << 32) + 1)
    for h in signs:
        sums += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(pair)) for i in range(32)]
    sums.append(F.count(F.when(F.col("some"), 1)))
    summed = hashed.groupBy(*keys).agg(*[F.coalesce(c, F.lit(0)).alias(f"s{i}") for i, c in enumerate(sums)])
    count = F.col(f"s{len(sums) - 1}")
    lanes = [F.col(f"s{i}") for i in range(LANES)]
    for i in range(LANES, len(sums) - 1):
        ones = (F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{i}", 32))
        lanes += [2 * n - count for n in ones]
    lanes.append(count)
    return summed.select(*keys, F.array(*[F.pmod(x, F.lit(_modulus(i))) for i, x in enumerate(lanes)]).alias("vector"))


def _modulus(lane: int) -> int:
    return 1 << 16 if LANES <= lane < LANES + SIGNS else 1 << 32


def combine(vector: Column, other: Column, sign: int = 1) -> Column:
    """The fingerprint with the units of another one inserted (sign 1) or deleted (-1)."""
    return F.transform(
        F.arrays_zip(vector.alias("a"), other.alias("b")),
        lambda x, i: F.pmod(
            x["a"] + sign * x["b"],
            F.when((i >= LANES) & (i < LANES + SIGNS), F.lit(1 << 16).cast("long")).otherwise(F.lit(1 << 32)),
        ),
    )


def written(vector: Column) -> Column:
    """The fingerprint as hexadecimal digits."""
    return F.array_join(
        F.transform(vector, lambda x, i: F.lower(F.lpad(F.hex(x), F.when((i >= LANES) & (i < LANES + SIGNS), 4).otherwise(8), "0"))), ""
    )


def likeness(vector: Column, other: Column) -> Column:
    """Estimated share of common units, 0 to 1: twice the common ones over all units."""
    half = 1 << 15
    square = F.aggregate(
        F.zip_with(
            F.slice(vector, LANES + 1, SIGNS),
            F.slice(other, LANES + 1, SIGNS),
            lambda a, b: F.pmod(a - b + half, F.lit(1 << 16)) - half,
        ),
        F.lit(0).cast("long"),
        lambda acc, d: acc + d * d,
    )
    both = (F.element_at(vector, -1) + F.element_at(other, -1)).cast("double")
    share = F.when(both > 0, 1 - square / SIGNS / both).otherwise(0.0)
    return F.when(vector == other, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row of docs (``doc_id, text``); equal rows give one row."""
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.explode_outer(units(F.col("text"))).alias("unit"))
    return vectors(rows, ["doc_id", "sha"]).select("doc_id", written(F.col("vector")).alias("fingerprint"))


def with_next(docs: DataFrame, rows_per_block: int = 2000, n_ranges: int = 200) -> DataFrame:
    """Every row with the text of the row after it by ``doc_id, text`` (the last: the first).

    Ids are dealt to ranges between approximate quantiles (at most n_ranges) and evenly to
    blocks of about rows_per_block inside a range. Inside a block the next row is a window
    function; a block's last row takes the first row of the next block, found the same way
    inside the range, and between ranges. Adds ``block, place, next_text``.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shares = [i / n_ranges for i in range(n_ranges + 1)]
    facts = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", shares, 10 * n_ranges).alias("ids")).first()
    starts = sorted(set(facts["ids"] or [0]))
    per_range = max(1, facts["n"] // (len(starts) * rows_per_block))
    start = lambda i: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in starts]), i)
    bounds = F.array(*[F.lit(int(x)).cast("long") for x in starts])
    upto = F.greatest(F.lit(1), F.size(F.filter(bounds, lambda x: x <= F.col("doc_id"))))
    width = F.when(F.col("range") < len(starts), start(F.least(F.col("range") + 1, F.lit(len(starts)))) - start(F.col("range")))
    inside = F.floor((F.col("doc_id") - start(F.col("range"))) / F.greatest(F.coalesce(width, F.lit(1)), F.lit(1)) * per_range)
    dealt = (
        docs.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(upto).cast("int"))
        .withColumn("block", F.when(F.col("range") == 0, 0).otherwise(F.least(F.greatest(inside, F.lit(0)), F.lit(per_range - 1))))
        .withColumn("block", (F.col("range") * per_range + F.coalesce("block", F.lit(0))).cast("long"))
    )
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    numbered = dealt.select(
        "block", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("inside_text")
    )
    firsts = dealt.groupBy("range", "block").agg(F.min(F.struct("doc_id", "text"))["text"].alias("first_text"))
    by_range = Window.partitionBy("range").orderBy("block")
    ranges = firsts.groupBy("range").agg(F.min(F.struct("block", "first_text"))["first_text"].alias("range_text"))
    over_ranges = Window.orderBy("range")  # one row per range, at most n_ranges + 2
    ranges = ranges.select(
        "range",
        F.coalesce(F.lead("range_text").over(over_ranges), F.first("range_text").over(over_ranges)).alias("after_range"),
    )
    blocks = (
        firsts.select("range", "block", F.lead("first_text").over(by_range).alias("after_block"))
        .join(ranges, "range")
        .select("block", F.coalesce("after_block", "after_range").alias("after_block"))
    )
    return numbered.join(blocks, "block").select(
        "block", "place", "doc_id", "text", F.coalesce("inside_text", "after_block").alias("next_text")
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last half of a text replaced by as many code points of another one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text, and likeness to that and to the next text.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    rows = with_next(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    facts = F.struct(F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    which = F.array(
        F.struct(F.lit(0).alias("of"), units(F.col("text")).alias("units")),
        F.struct(F.lit(1).alias("of"), units(F.col("edited")).alias("units")),
        F.struct(F.lit(2).alias("of"), units(F.col("next_text")).alias("units")),
    )
    exploded = rows.select("block", "place", "doc_id", facts.alias("facts"), F.explode(which).alias("which")).select(
        "block", "place", "doc_id", "facts", "which.of", F.explode_outer("which.units").alias("unit")
    )
    summed = vectors(exploded, ["block", "place", "doc_id", "facts", "of"])
    each = summed.groupBy("block", "place", "doc_id", "facts").agg(
        *[F.max(F.when(F.col("of") == i, F.col("vector"))).alias(name) for i, name in enumerate(("own", "edited", "following"))]
    )
    return each.select(
        "doc_id",
        "facts.n_chars",
        "facts.edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )

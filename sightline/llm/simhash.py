"""SimHash near-dedup by the generalised pigeonhole principle.

Every text has a 64-bit fingerprint: a bit is set if it is set in over half of the hashes of
its word shingles. Fingerprints that differ in at most ``distance`` bits link; the result is
the components of all links, without emitting the pairs of a group of copies.

1. Equal fingerprints are one row with the number of their documents.
2. The bits are cut into parts, correlated ones together: from the counts of every bit and
   pair of bits over all fingerprints. If thresholds t of m parts add up to ``distance - m + 1``,
   two linked fingerprints differ in at most t bits of some part. Dynamic programming gives
   each part its own t (-1: never probed) by the rows probed and the estimated candidates,
   also from the counts; the number of parts is the cheapest one. Any choice finds all links.
3. Stars: the commonest fingerprint of a part's value leads those near it, a few times over
   what is left.
4. Each star asks for the values of its members and those within t bits (probes); stars that
   meet are compared by their leaders. Members decide where leaders are too far apart to
   link and near enough that members might, if their stars are not in one component yet; a
   member needs one partner in the other star, since that star is connected.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and link
like any other; fewer words than a shingle are one shingle; rows with the same id are rows of
their own; a null id never names a component unless all of its rows have none (null); other
columns are ignored; an empty table gives no rows. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb, exp, lgamma
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import words
from sightline.llm.links import components
from sightline.llm.sources import checkpointed

BITS = 64
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PROBE_COST = 4  # a probe is a row that moves, a candidate one comparison
MOST_PARTS = 8


def fingerprints_of(texts: list[bytes], shingle: int = 4) -> np.ndarray:
    """The fingerprint of each text as an unsigned number."""
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        found = text.translate(LOWER).split()  # at bytes 0x20 and 0x09-0x0D
        n = len(found)
        spaced = b" ".join(found)
        end = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=n) + 1) - 1
        start = np.concatenate(([0], end[:-1] + 1))[: max(0, n - shingle + 1)] if n > shingle else np.zeros(min(n, 1), dtype=np.int64)
        end = end[shingle - 1 :] if n > shingle else end[-1:]
        hashes += [digest(spaced[x:y], SEED) for x, y in zip(start.tolist(), end.tolist())]
        counts.append(len(start))
    n = np.array(counts, dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * set_ > n[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, print`` of every row; the print is the fingerprint's bits as a long."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            found = fingerprints_of(texts, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, print long")


class Part(NamedTuple):
    """Bits that are probed together, and how many of them a probe may turn (-1: no probes)."""

    bits: list[int]
    threshold: int

    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        return [_signed(sum(1 << b for b in some)) for k in range(self.threshold + 1) for some in combinations(self.bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and how many have bits i and j set (i and i: bit i), over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            own = np.ascontiguousarray(batch.column("print").to_numpy())
            set_ = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += set_.T @ set_
            n += len(own)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        columns = [np.append(i, -1), np.append(j, -1), np.append(both.ravel(), n).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "n"])

    found = prints.select("print").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    told = {(r["i"], r["j"]): r["n"] for r in found.collect()}  # BITS * BITS + 1 numbers
    return told.get((-1, -1), 0), np.array([[told.get((i, j), 0) for j in range(BITS)] for i in range(BITS)], dtype=float)


def correlated_parts(n: int, both: np.ndarray, n_parts: int) -> list[list[int]]:
    """The bits in parts of about equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, parts = list(range(BITS)), []
    for k in range(n_parts):
        size = BITS // n_parts + (k < BITS % n_parts)
        part = [max(left, key=lambda b: (related[b, left].sum(), -b))]
        while len(part) < size:
            part.append(max((b for b in left if b not in part), key=lambda b: (related[b, part].sum(), -b)))
        left = [b for b in left if b not in part]
        parts.append(sorted(part))
    return parts


def near_shares(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0, 1, ... most of the bits.

    Mean and variance of the number of differing bits follow from the counts of all
    fingerprints; a beta-binomial distribution with these two stands for the rest.
    """
    p = np.diag(both)[bits] / max(n, 1)
    p11 = both[np.ix_(bits, bits)] / max(n, 1)
    p10 = p[:, None] - p11
    together = 2 * (p11 * (1 - p[:, None] - p[None, :] + p11) + p10 * p10.T)
    alone = 2 * p * (1 - p)
    np.fill_diagonal(together, alone)
    width, mean = len(bits), float(alone.sum())
    variance = float((together - np.outer(alone, alone)).sum())
    rate = min(max(mean / width, 1e-9), 1 - 1e-9)
    extra = (variance / (width * rate * (1 - rate)) - 1) / max(width - 1, 1)
    a, b = (x * (1 / min(max(extra, 1e-6), 0.9) - 1) for x in (rate, 1 - rate))
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    share = [comb(width, k) * exp(beta(k + a, width - k + b) - beta(a, b)) for k in range(min(most, width) + 1)]
    return np.cumsum(share + [0.0] * (most + 1 - len(share))).tolist()


def allocated(n: int, both: np.ndarray, parts: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """The cheapest thresholds of the parts that add up to distance - parts + 1, and their cost."""
    goal, n = distance - len(parts) + 1, max(n, 1)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        shares = near_shares(n, both, bits, distance)
        cost = {-1: 0.0}
        for t in range(distance + 1):
            cost[t] = n * PROBE_COST * sum(comb(len(bits), k) for k in range(t + 1)) + n * n * shares[t]
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, given) in best.items():
            for t, more in cost.items():
                entry = (so_far + more, [*given, t])
                step[used + t] = min(step.get(used + t, entry), entry)
        best = step
    return best[goal]


def planned_parts(n: int, both: np.ndarray, distance: int) -> list[Part]:
    """The parts that are probed, for the cheapest number of parts."""
    plans = []
    for n_parts in range(1, MOST_PARTS + 1):
        parts = correlated_parts(n, both, n_parts)
        cost, thresholds = allocated(n, both, parts, distance)
        plans.append((cost, n_parts, [Part(b, t) for b, t in zip(parts, thresholds) if t >= 0]))
    return min(plans, key=lambda plan: plan[:2])[2]


def _apart(one: str, two: str) -> Column:
    return F.bit_count(F.col(one).bitwiseXOR(F.col(two)))


def _indexed(rows: DataFrame, parts: list[Part], probed: bool = False) -> DataFrame:
    """Each row once per part with ``part, value``; probed: once per value that its probes ask for."""
    made = []
    for k, part in enumerate(parts):
        flips = F.array(*[F.lit(f) for f in (part.flips() if probed else [0])]).cast("array<long>")
        turned = rows.withColumn("_flip", F.explode(flips))
        value = F.col("print").bitwiseXOR(F.col("_flip")).bitwiseAND(F.lit(part.mask()))
        made.append(turned.withColumns({"part": F.lit(k), "value": value}).drop("_flip"))
    return reduce(DataFrame.unionByName, made)


def _stars(prints: DataFrame, parts: list[Part], distance: int, rounds: int) -> DataFrame:
    """``print, star, far`` of fingerprints that a commoner one leads (far: bits between them)."""
    left, found = prints.select("print", "n"), None
    for _ in range(rounds):
        index = _indexed(left, parts)
        leads = index.groupBy("part", "value").agg(F.max(F.struct("n", "print")).alias("lead"), F.min("print").alias("a"), F.max("print").alias("b"))
        leads = leads.where("a < b").select("part", "value", F.col("lead.print").alias("star"), F.col("lead.n").alias("star_n"))
        near = index.join(leads, ["part", "value"]).where((F.col("print") != F.col("star")) & (_apart("print", "star") <= distance))
        led = checkpointed(near.groupBy("print").agg(F.max(F.struct("star_n", "star")).alias("lead")).select("print", "lead.star"))
        # A leader that is led itself leads nobody in this round.
        led = led.join(led.select(F.col("print").alias("star")), "star", "left_anti")
        led = checkpointed(led.select("print", "star", _apart("print", "star").alias("far")))
        found = led if found is None else found.unionByName(led)
        gone = led.select("print").union(led.select(F.col("star").alias("print"))).distinct()
        left = checkpointed(left.join(gone, "print", "left_anti"))
    return found


def _meetings(members: DataFrame, parts: list[Part], distance: int) -> DataFrame:
    """Stars whose members ``print, star, radius`` might link, each pair once per value of a part in which they meet.

    Each star asks for a value once and holds it once, however many of its members do.
    """
    by_star = ["part", "value", "star", "radius"]
    asks = _indexed(members, parts, probed=True).select(*by_star).distinct().withColumnsRenamed({"star": "a", "radius": "r1"})
    holds = _indexed(members, parts).select(*by_star).distinct().withColumnsRenamed({"star": "b", "radius": "r2"})
    near = _apart("a", "b") <= distance + F.col("r1") + F.col("r2")
    return asks.join(holds, ["part", "value"]).where((F.col("a") < F.col("b")) & near)


def linked(prints: DataFrame, parts: list[Part], distance: int, rounds: int = 3) -> DataFrame:
    """``a, b`` links whose components are those of all links between the rows of ``print, n``."""
    led = checkpointed(_stars(prints, parts, distance, rounds))
    radii = led.groupBy("star").agg(F.max("far").alias("radius"))
    members = prints.select("print").join(led, "print", "left")
    members = members.select("print", F.coalesce("star", "print").alias("star"))
    members = checkpointed(members.join(radii, "star", "left").withColumn("radius", F.coalesce("radius", F.lit(0))))

    meet = _meetings(members, parts, distance)
    meet = checkpointed(meet.select("a", "b", "r2", _apart("a", "b").alias("far")).distinct())
    sure = led.select(F.col("print").alias("a"), F.col("star").alias("b")).union(meet.where(F.col("far") <= distance).select("a", "b"))
    sure = checkpointed(sure)

    # Members decide between stars that are not in one component yet.
    now = components(sure)
    open_ = meet.where(F.col("far") > distance)
    for side in ("a", "b"):
        own = now.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        open_ = open_.join(own, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    open_ = open_.where("c_a <> c_b").select("a", "b", "r2")
    first = members.select(F.col("star").alias("a"), F.col("print").alias("x")).join(open_, "a")
    first = first.where(_apart("x", "b") <= distance + F.col("r2"))
    second = members.select(F.col("star").alias("b"), F.col("print").alias("y"))
    near = (first["b"] == second["b"]) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)
    return sure.union(first.join(second, near, "left_semi").select("a", "b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of docs (``doc_id, text``)."""
    facts = checkpointed(fingerprints(docs, shingle))
    prints = checkpointed(facts.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    n, both = bit_counts(prints)
    joined = components(linked(prints, planned_parts(n, both, distance), distance))
    named = prints.join(joined.withColumnRenamed("node", "print"), "print", "left")
    named = checkpointed(named.select("print", "first", F.coalesce("component", "print").alias("component")))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    told = named.join(names, "component").select("print", "component_id")
    shown = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return facts.join(told, "print").select("doc_id", shown, "component_id")

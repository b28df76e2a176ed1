"""Vector code compression: four-byte codes by product quantisation with memoised grid cells.

Vectors become integers (floor of 1024 times each component) and are cut into four equal
parts. Each part has a codebook of up to 256 entries that starts as the parts of the smallest
ids and moves to the floored means of the parts assigned to its entries, four times.

Assignment: the grid cell of a part (``cell`` wide in every component) is hashed. For a cell,
the entries that may be nearest somewhere in its box are kept in a memo: an entry is dominated
if its least distance to the box is over another one's greatest distance. Only the entries that
are left are evaluated exactly, with ties to the lower index. Least and greatest distances of a
box are sums over its components, looked up in a table per component and coordinate. A memo
holds ``MEMO`` cells at most and starts anew when full, so its memory is bounded.

Per round a task sends one sum per entry and component, whatever its rows are, and the
codebooks (at most 4 * 256 entries) go out with the next round.

Defined cases: vectors that are null, or hold a null or non-finite component, are dropped; so are
vectors that are not of the commonest length that four divides (ties: the longer), as they
cannot be cut into the same parts; components beyond ``LARGEST`` count as ``LARGEST``, so that
sums fit; rows with the same id are coded each, and the smallest of their vectors stands for
the id in the first codebook; a null id is coded, but never in the first codebook; with fewer
ids than 256 the codebook is smaller, and with none there are no rows; null labels are one
label; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.sources import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
CELL = 64
LARGEST = float(1 << 14)
MEMO = 1 << 16
CHUNK = 512
TASK_VALUES = 1 << 19  # components that a task codes


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v`` of the rows that are coded; v: integer components."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = lambda x: F.least(F.greatest(x.cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") % PARTS == 0)).where(whole)
    lengths = usable.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max(F.struct("n", "length")).alias("most"), F.sum(F.col("n") * F.col("length")).alias("n")).first()
    if most["most"] is None:
        return vectors.select(F.col("vec_id").cast("long"), "label", F.array().cast("array<int>").alias("v")).where(F.lit(False))
    v = F.transform("embedding", lambda x: F.floor(SCALE * bounded(x)).cast("int")).alias("v")
    rows = usable.where(F.size("embedding") == most["most"]["length"]).select(F.col("vec_id").cast("long"), "label", v)
    return stored(rows.repartition(1 + most["n"] // TASK_VALUES), "vectors")


def first_entries(kept: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks to start from: ``[part, entry, component]``."""
    ids = kept.where("vec_id IS NOT NULL").select("vec_id")
    low, high = ids.agg(F.min("vec_id"), F.max("vec_id")).first()
    if low is None:
        return np.zeros((PARTS, 0, 0), dtype=np.int64)
    # Grow the range of ids until enough lie in it: the filter reaches the files, and few rows are sorted.
    width = entries
    while low + width <= high and ids.where(F.col("vec_id") < low + width).agg(F.count_distinct("vec_id")).first()[0] < entries:
        width *= 16
    near = kept.where(F.col("vec_id") < low + width) if low + width <= high else kept.where("vec_id IS NOT NULL")
    chosen = near.select("vec_id").distinct().orderBy("vec_id").limit(entries)
    rows = kept.join(F.broadcast(chosen), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).collect()  # at most entries rows
    found = np.array([r["v"] for r in sorted(rows, key=lambda r: r["vec_id"])], dtype=np.int64)
    return np.stack(np.split(found, PARTS, axis=1))


class Cells:
    """Nearest entries of one codebook, by memoised grid cells."""

    def __init__(self, book: np.ndarray, cell: int = CELL):
        self.book, self.cell, self.memo = book, cell, {}

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        """Which entries may be the nearest to a point of each cell's box."""
        least = np.zeros((len(cells), len(self.book)), dtype=np.int64)
        greatest = np.zeros_like(least)
        for place in range(cells.shape[1]):
            coordinate, of = np.unique(cells[:, place], return_inverse=True)
            low = (coordinate * self.cell)[:, None] - self.book[None, :, place]
            high = low + self.cell - 1
            least += (np.maximum(np.maximum(low, -high), 0) ** 2)[of]
            greatest += (np.maximum(np.abs(low), np.abs(high)) ** 2)[of]
        return least <= greatest.min(axis=1, keepdims=True)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """The memo's entries of distinct cells, filled where they are missing."""
        names = [c.tobytes() for c in cells]
        missing = [i for i, name in enumerate(names) if name not in self.memo]
        if missing:
            if len(self.memo) + len(missing) > MEMO:
                self.memo = {}
                missing = list(range(len(names)))
            for i, bits in zip(missing, np.packbits(self._undominated(cells[missing]), axis=1)):
                self.memo[names[i]] = bits
        return np.unpackbits(np.stack([self.memo[name] for name in names]), axis=1, count=len(self.book)).astype(bool)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance to it, of each point."""
        entry, distance = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
        if not points.shape[1]:
            return entry, distance
        for at in range(0, len(points), CHUNK):
            some = points[at : at + CHUNK]
            cells, of = np.unique(some // self.cell, axis=0, return_inverse=True)
            point, index = np.nonzero(self.candidates(cells)[of.ravel()])
            gap = some[point] - self.book[index]
            far = np.einsum("ij,ij->i", gap, gap)
            starts = np.searchsorted(point, np.arange(len(some)))
            best = np.minimum.reduceat(far, starts)
            hits = np.flatnonzero(far == best[point])
            first = hits[np.searchsorted(point[hits], np.arange(len(some)))]
            entry[at : at + CHUNK], distance[at : at + CHUNK] = index[first], best
        return entry, distance


def _parts_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    v = batch.column("v")
    values = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(values.reshape(len(v), len(values) // max(len(v), 1)), PARTS, axis=1)


def moved(kept: DataFrame, books: np.ndarray, cell: int = CELL) -> np.ndarray:
    """The codebooks after one round: floored means of what is assigned to each entry."""
    n_parts, n_entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_parts, n_entries, width + 1), dtype=np.int64)  # the last place counts
        cells = [Cells(book, cell) for book in books]
        for batch in batches:
            if batch.num_rows:
                for part, points in enumerate(_parts_of(batch)):
                    entry, _ = cells[part].nearest(points)
                    np.add.at(sums[part, :, :width], entry, points)
                    sums[part, :, width] += np.bincount(entry, minlength=n_entries)
        part, entry = np.nonzero(sums[:, :, width])
        place = np.tile(np.arange(width + 1), len(part))
        columns = [np.repeat(part, width + 1), np.repeat(entry, width + 1), place, sums[part, entry].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "total"])

    sent = kept.select("v").mapInArrow(add, "part long, entry long, place long, total long")
    totals = np.zeros((n_parts, n_entries, width + 1), dtype=np.int64)
    for row in sent.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():  # the codebooks' size
        totals[row["part"], row["entry"], row["place"]] = row["total"]
    n = totals[:, :, width:]
    return np.where(n > 0, totals[:, :, :width] // np.maximum(n, 1), books)


def learned(kept: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> np.ndarray:
    """The final codebooks ``[part, entry, component]``."""
    books = first_entries(kept, entries)
    for _ in range(rounds if books.size else 0):
        books = moved(kept, books, cell)
    return books


def coded(kept: DataFrame, books: np.ndarray, cell: int = CELL) -> DataFrame:
    """``vec_id, label, code, error`` of every kept vector."""
    label = kept.schema["label"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book, cell) for book in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            entries, far = zip(*(cells[part].nearest(points) for part, points in enumerate(_parts_of(batch))))
            codes = [bytes(row).hex() for row in np.stack(entries, axis=1).astype(np.uint8)]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(codes), pa.array(np.sum(far, axis=0))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    if not books.shape[1]:  # no id to start from
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False))
    return kept.mapInArrow(read, f"vec_id long, label {label}, code string, error long")


def digest(books: np.ndarray) -> str:
    """Of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every kept row of vectors (``vec_id, embedding, label``), and the codebooks."""
    kept = kept_vectors(vectors)
    books = learned(kept, entries, rounds, cell)
    return coded(kept, books, cell), books


def with_label_errors(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: errors also summed over each label."""
    codes = stored(codes, "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

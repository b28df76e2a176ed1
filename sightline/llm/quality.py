"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Overlapping heuristic labellers vote bad, good or nothing on every document. Two questions
are estimated, each from its own labellers: whether the text's form is junk, and whether
its tone is abusive. Expectation-maximisation over the counts of vote patterns of all
documents gives each labeller's accuracy on each kind of bad text and each pattern's
posterior; a document is bad if either answer is yes. The posteriors of a bounded sample train a logistic scorer
over hashed words and votes, which scores every whole text.

Bounds (parameters): ``lexicon_rows`` labelled rows teach the abusive words, and
``train_rows`` documents train the scorer; both are taken by the hash of their id. Votes,
pattern counts and scores cover all rows.

Defined cases: a null text is empty; an empty text gets no vote and is kept; repeated rows
count and are scored each; an empty table gives no rows; an empty labels table only
teaches nothing; null labels are no vote; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sightline.llm import words
from sightline.llm.sources import checkpointed

# Words of abuse that start the lexicon.
ABUSE = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "clown", "pathetic",
    "worthless", "disgusting", "filthy", "vermin", "imbecile", "retard", "bastard", "bitch", "asshole", "hate",
)
FORM = ("symbols", "capitals", "repetition", "separators", "shouting", "label_quality")
TONE = ("abuse", "learned_abuse", "label_toxic")
BAD, NONE, GOOD = -1, 0, 1
N_WEIGHTS = 1 << 18

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#$%&*|<>{}[]~^=@\\_`"]] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LETTER = words.LETTER.astype(np.int64)


def word_hashes(some: list[str]) -> np.ndarray:
    """Hashes of words as ``words.of_texts(..., lower=True)`` gives them."""
    return words.of_texts(pa.array(list(some), pa.string()), lower=True).hash


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _vote(value: np.ndarray, enough: np.ndarray, bad: float, good: float) -> np.ndarray:
    """Bad from ``bad`` on, good up to ``good``; nothing between or where the text is too short."""
    return np.where(enough & (value >= bad), BAD, np.where(enough & (value <= good), GOOD, NONE))


def labeller_votes(w: words.Words, abuse: np.ndarray, learned: np.ndarray) -> dict[str, np.ndarray]:
    """Votes of the labellers that read texts; w: words without punctuation at their ends."""
    n = len(w.offsets) - 1
    sums = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[w.data])))[w.offsets])
    per_row = lambda mask: np.bincount(w.row[mask], minlength=n)
    n_words = np.bincount(w.row, minlength=n)
    some, several = n_words >= 1, n_words >= 5
    repeats = np.zeros(len(w.row), dtype=bool)
    repeats[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    first = w.data[w.start] if len(w.start) else np.zeros(0, dtype=np.uint8)
    separator = (w.end - w.start == 1) & (_LETTER[first] == 0) & ~((first >= 48) & (first <= 57))
    bangs = np.diff(np.concatenate(([0], np.cumsum(w.data == 33)))[w.offsets])
    found = np.isin(w.hash, abuse)
    found_learned = np.isin(w.hash, learned)
    return {
        "symbols": _vote(_share(sums(_SYMBOL), np.diff(w.offsets)), some, 0.10, 0.03),
        "capitals": _vote(_share(sums(_UPPER), sums(_LETTER)), several, 0.5, 0.2),
        "repetition": _vote(_share(per_row(repeats), n_words), several, 0.25, 0.1),
        "separators": _vote(_share(per_row(separator), n_words), several, 0.2, 0.05),
        "shouting": _vote(_share(bangs, n_words), several, 0.5, 0.1),
        "abuse": np.where(per_row(found) > 0, BAD, np.where(some, GOOD, NONE)),
        "learned_abuse": np.where(per_row(found_learned) > 0, BAD, np.where(some, GOOD, NONE)),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of "bad" per vote pattern, P(vote | class) per labeller, and how bad each class is.

    patterns: one row per distinct pattern, votes -1, 0, 1; the last labeller is the given
    labels, the others read texts. counts: documents of each pattern.

    Labellers are specialists, so bad texts come in kinds: the latent classes are "clean" and
    one kind for each labeller, which starts with the patterns that it calls bad. Kinds that
    two labellers find overlap and share their documents. A class is as bad as its
    labelled members, which discounts a careless labeller; without any it counts as bad.
    """
    n_kinds = patterns.shape[1] - 1
    called = (patterns[:, :-1] == BAD).astype(float)
    some = called.sum(axis=1, keepdims=True)
    share = np.where(some > 0, called / np.maximum(some, 1), 1 / n_kinds)
    clean = np.where(some[:, 0] > 0, 0.02, np.where(patterns[:, -1] == BAD, 0.5, 0.98))
    belongs = np.column_stack([clean, share * (1 - clean)[:, None]])
    total = counts.sum()
    votes = np.stack([patterns == v for v in (BAD, NONE, GOOD)], axis=2).astype(float)
    for _ in range(rounds):
        weight = belongs * counts[:, None]
        prior = (weight.sum(axis=0) + 0.1) / (total + 0.1 * (n_kinds + 1))
        given = np.einsum("pc,pjv->cjv", weight, votes) + 0.05
        given[np.arange(1, n_kinds + 1), np.arange(n_kinds), 0] += 1.0  # a kind is what its labeller finds
        said = given[:, :, [0, 2]] / given[:, :, [0, 2]].sum(axis=2, keepdims=True)
        # A labeller that abstains says nothing about the class.
        log = np.log(prior) + np.einsum("pjv,cjv->pc", votes[:, :, [0, 2]], np.log(said))
        belongs = np.exp(log - log.max(axis=1, keepdims=True))
        belongs /= belongs.sum(axis=1, keepdims=True)
    weight = belongs * counts[:, None]
    labelled = np.stack([(weight * votes[:, -1, v : v + 1]).sum(axis=0) for v in (0, 2)])
    badness = (labelled[0] + 2.0) / (labelled.sum(axis=0) + 2.0)
    badness[0] = labelled[0, 0] / (labelled[:, 0].sum() + 2.0)
    return belongs @ badness, given / given.sum(axis=2, keepdims=True), badness


def _features(w: words.Words, votes: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, weight index and value of every feature: distinct words of each text, and votes."""
    n = len(w.offsets) - 1
    slot = (w.hash & np.uint64(N_WEIGHTS - 1)).astype(np.int64)
    key = np.unique(w.row.astype(np.int64) * N_WEIGHTS + slot)
    row, slot = key // N_WEIGHTS, key % N_WEIGHTS
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
    rows, slots, values = [row], [slot], [value]
    for name in sorted(votes):
        for vote in (BAD, GOOD):
            hit = np.flatnonzero(votes[name] == vote)
            at = int(word_hashes([f"vote:{name}:{vote}"])[0] & np.uint64(N_WEIGHTS - 1))
            rows.append(hit)
            slots.append(np.full(len(hit), at))
            values.append(np.ones(len(hit)))
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(values)


def train_scorer(
    row: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 200, shrink: float = 3e-4
):
    """Logistic regression by AdaGrad on whole batches; weights and bias.

    shrink pulls weights to 0, so that words of a few documents decide nothing.
    """
    weights, bias = np.zeros(N_WEIGHTS), 0.0
    squares, bias_square = np.full(N_WEIGHTS, 1e-6), 1e-6
    n = len(target)
    for _ in range(rounds if n else 0):
        z = np.bincount(row, weights[slot] * value, minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        gradient = np.bincount(slot, error[row] * value, minlength=N_WEIGHTS) + shrink * weights
        squares += gradient**2
        bias_square += error.sum() ** 2
        weights -= 0.3 * gradient / np.sqrt(squares)
        bias -= 0.3 * error.sum() / np.sqrt(bias_square)
    return weights, bias


def learn_abuse(docs: DataFrame, labels: DataFrame, rows: int) -> np.ndarray:
    """Hashes of words that occur in toxic labelled documents and hardly in others.

    Occurrences count once per word before, so copies of a text add nothing. A word needs
    so many toxic contexts that chance would pick none of the sample's words: with a share
    p of toxic documents and V words, n contexts where V * p ** n < 0.01. This bound alone ends the list; the sample of at most ``rows``
    documents limits it.
    """
    sample = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word with the word before it, once per slice, and whether only toxic texts hold the pair."""
        for batch in words.slices(batches, "text"):
            w = words.stripped(words.of_texts(batch.column("text")))
            before = np.zeros(len(w.hash), dtype=np.uint64)
            before[1:] = np.where(w.row[1:] == w.row[:-1], w.hash[:-1], np.uint64(0))
            context = words.mix(w.hash * np.uint64(3) + before)
            toxic = batch.column("toxic").to_numpy()[w.row]
            order = np.lexsort((toxic, context))
            first = np.ones(len(order), dtype=bool)
            first[1:] = context[order][1:] != context[order][:-1]
            kept = order[first]
            arrays = [pa.array(w.hash[kept].view(np.int64)), pa.array(context[kept].view(np.int64)), pa.array(toxic[kept], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "context", "toxic"])

    seen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")  # at most ``rows`` small rows
    contexts = seen.mapInArrow(pairs, "word long, context long, toxic int").groupBy("word", "context").agg(F.min("toxic").alias("toxic"))
    counted = checkpointed(
        contexts.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).where("bad >= 0.95 * all OR bad = 0")
    )
    share = sample.agg(F.avg("toxic")).first()[0] or 0.0
    vocabulary = counted.count()
    if not 0 < share < 1 or not vocabulary:
        return np.zeros(0, dtype=np.uint64)
    least = max(3, int(np.ceil(np.log(0.01 / vocabulary) / np.log(share))))
    telling = counted.where(F.col("bad") >= least)
    return np.sort(np.array([r["word"] for r in telling.collect()], dtype=np.int64).view(np.uint64))


class Model(NamedTuple):
    """What scoring needs: hashes of the abusive words, weights of the scorer and its bias."""

    abuse: np.ndarray
    learned: np.ndarray
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, lexicon_rows: int = 20_000, train_rows: int = 8_000) -> Model:
    """Estimate the labellers and train the scorer on docs (``doc_id, text``).

    labels: ``doc_id, quality, toxic`` of some documents; they vote as labellers. The training
    sample holds an id once (with the text of the least hash), whatever the number of its rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_hash", F.xxhash64("text"))
    labels = labels.select("doc_id", "quality", "toxic")
    abuse = word_hashes(list(ABUSE))
    learned = learn_abuse(docs, labels, lexicon_rows)
    names = FORM[:-1] + TONE[:-1]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            votes = labeller_votes(words.stripped(words.of_texts(batch.column("text"))), abuse, learned)
            arrays = [pa.array(votes[name], pa.int8()) for name in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *arrays], ["doc_id", "text_hash", *names])

    read = docs.mapInArrow(vote, "doc_id long, text_hash long, " + ", ".join(f"{name} tinyint" for name in names))
    given = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    as_vote = lambda bad, good: F.when(bad, BAD).when(good, GOOD).otherwise(NONE).cast("tinyint")
    voted = read.join(given, "doc_id", "left").select(
        "doc_id",
        "text_hash",
        *names,
        as_vote(F.col("quality") == 0, F.col("quality") == 1).alias("label_quality"),
        as_vote(F.col("toxic") == 1, F.col("toxic") == 0).alias("label_toxic"),
    )
    voted = checkpointed(voted)  # a few bytes per document; the texts are read once for it
    # At most 3 ** 9 patterns, whatever the number of documents.
    counted = voted.groupBy(*FORM, *TONE).count().collect()
    counted.sort(key=lambda r: [r[name] for name in FORM + TONE])
    table = np.array([[r[name] for name in FORM + TONE] for r in counted], dtype=int).reshape(len(counted), len(FORM + TONE))
    counts = np.array([r["count"] for r in counted], dtype=float)
    clean = np.ones(len(counted))
    for group in (FORM, TONE):
        columns = [(FORM + TONE).index(name) for name in group]
        if len(counted):
            clean *= 1 - estimate(table[:, columns], counts)[0]
    posterior = {tuple(p): 1 - c for p, c in zip(table.tolist(), clean)}

    chosen = {
        (r["doc_id"], r["text_hash"]): posterior[tuple(r[name] for name in FORM + TONE)]
        for r in _lowest(voted.where("doc_id IS NOT NULL"), train_rows, int(counts.sum()))
    }
    weights, bias = _fit(docs, chosen, abuse, learned)
    return Model(abuse, learned, weights.astype(np.float32), float(bias))


def bad_probability(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability that each text is junk or abusive; an empty one's is 0."""
    w = words.stripped(words.of_texts(texts))
    row, slot, value = _features(w, labeller_votes(w, model.abuse, model.learned))
    z = np.bincount(row, model.weights[slot] * value, minlength=len(texts)) + model.bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.round(np.where(np.diff(w.of_row()) == 0, 0.0, p), 6)


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``doc_id, p_bad, keep`` of every row of docs (``doc_id, text``); bounds: those of `fit`."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))  # N_WEIGHTS floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            p = bad_probability(batch.column("text"), model.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p < 0.5)], ["doc_id", "p_bad", "keep"])

    return docs.mapInArrow(score, "doc_id long, p_bad double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of docs, whatever their columns, whose text is neither junk nor abusive."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            yield batch.filter(pa.array(bad_probability(batch.column("text"), model.value) < 0.5))

    return docs.mapInArrow(kept, docs.schema)


def _lowest(voted: DataFrame, bound: int, total: int) -> list[Row]:
    """One row of each of the ``bound`` ids with the least hashes.

    Rows above a hash that four times the bound are expected below are left out before
    anything moves; where repeated ids leave too few, the rest is read as well.
    """
    key = F.xxhash64("doc_id")
    below = min(2**63 - 1, -(2**63) + 4 * bound * 2**64 // max(total, 1))
    for rows in (voted.where(key <= below), voted):
        once = rows.groupBy("doc_id").agg(F.min(F.struct("text_hash", *FORM, *TONE)).alias("r")).select("doc_id", "r.*")
        found = once.orderBy(key, "doc_id").limit(bound).collect()
        if len(found) == bound or below == 2**63 - 1:
            break
    return found


def _fit(docs: DataFrame, chosen: dict[tuple[int, int], float], abuse: np.ndarray, learned: np.ndarray):
    """Scorer of the chosen documents (a bounded number), from features made on the executors."""
    ids = docs.sparkSession.createDataFrame(list(chosen), "doc_id long, text_hash long")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            w = words.stripped(words.of_texts(batch.column("text")))
            row, slot, value = _features(w, labeller_votes(w, abuse, learned))
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(len(batch) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order], t)) for x, t in ((slot, pa.int32()), (value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "slots", "vals"])

    rows = (
        docs.join(F.broadcast(ids), ["doc_id", "text_hash"])
        .dropDuplicates(["doc_id"])
        .select("doc_id", "text")
        .mapInArrow(featured, "doc_id long, slots array<int>, vals array<float>")
        .toArrow()
        .sort_by("doc_id")
    )
    slots, vals = rows["slots"].combine_chunks(), rows["vals"].combine_chunks()
    row = np.repeat(np.arange(len(rows)), np.diff(slots.offsets.to_numpy())) if len(rows) else np.zeros(0, dtype=int)
    wanted = {i: clean for (i, _), clean in chosen.items()}
    target = np.array([wanted[i] for i in rows["doc_id"].to_pylist()])
    return train_scorer(row, slots.flatten().to_numpy(), vals.flatten().to_numpy().astype(float), target)

"""Substring dedup: windows of words that an earlier document holds already.

Reference passages and their automata come in shards, and every document is streamed
through the automata of the shards that can match it:

1. A window of ``size`` words has an anchor, its sub-run of ``gram`` words with the least hash;
   equal windows have equal anchors. Windows around one anchor are a passage. Anchors
   that only one document holds end there.
2. Equal passages are one passage, kept with the smallest id that holds it. These are the
   references; shards take them by anchor, so a window's references are in one shard.
3. Where an anchor has different passages, the shard builds a suffix automaton over their
   words, every state with the smallest id that holds its words, and each passage is
   streamed through it; the matching statistics of ``size`` words and more give the
   smallest id of every window. Where it has one passage, that passage's id is the answer.
4. A hot anchor, around which the blocks together hold more than ``hot_passages`` different
   passages (a shared header meets every document's own words), gets no automaton: each block
   cuts its passages there into windows and sends each window once, with its smallest id,
   to the shard of the window. So one key is one entry per block again.
5. Words of windows whose smallest id is smaller than the document's own go.

An automaton is bounded by ``hot_passages`` passages, never by the number of documents, and
it goes only to where passages of its shard are; sending all shards to all tasks would read
the corpus once per shard.

Defined cases: null and empty texts have no words; rows with the same id are not earlier
than each other; a null id counts as larger than any other; texts shorter than a window
stay; white space in kept texts becomes one space; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm import exchange, words

U, I = np.uint64, np.int64
HOT_PASSAGES = 64
HOT = U(0)  # in place of a passage: the anchor is hot


class Passages:
    """Passages of a slice of texts: arrays by passage, in order."""

    def __init__(self, raw: words.Words, size: int, gram: int):
        n = len(raw.hash) - size + 1
        if n <= 0:
            self.first = self.last = self.row = np.zeros(0, dtype=I)
            self.anchor = self.content = np.zeros(0, dtype=U)
            return
        grams = words.windows(raw.hash, gram)
        least, at = grams[:n].copy(), np.zeros(n, dtype=I)
        for i in range(1, size - gram + 1):
            other = grams[i : i + n]
            less = other < least
            least[less], at[less] = other[less], i
        start = np.flatnonzero(raw.row[:n] == raw.row[size - 1 :])
        place = start + at[start]
        new = np.ones(len(place), dtype=bool)
        new[1:] = place[1:] != place[:-1]
        begin = np.flatnonzero(new)
        self.first = start[begin]
        self.last = start[np.append(begin[1:], len(place)) - 1] if len(place) else self.first
        place = place[begin]
        self.row = raw.row[self.first]
        self.anchor = grams[place]
        self.content = words.stretches(raw.hash, self.first, self.last + size, place - self.first)


class Automaton:
    """Suffix automaton of several word sequences; each state knows the smallest id it occurs with."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.low = [exchange.NO_ID]

    def _state(self, length: int, follow: dict, link: int, low: int) -> int:
        self.length.append(length)
        self.next.append(follow)
        self.link.append(link)
        self.low.append(low)
        return len(self.length) - 1

    def add(self, sequence: list, doc: int) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word, doc)

    def _extend(self, last: int, word, doc: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            self.low[known] = min(self.low[known], doc)
            return known
        new = -1 if known is not None else self._state(self.length[last] + 1, {}, 0, doc)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            target = q
        else:
            target = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], exchange.NO_ID)
            self.link[q] = target
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = target
                p = self.link[p]
        if new < 0:  # the sequence so far is known, as a part of a longer one
            self.low[target] = min(self.low[target], doc)
            return target
        self.link[new] = target
        return new

    def finish(self) -> None:
        """Hand the smallest ids down to shorter stretches of words."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if self.low[state] < self.low[up]:
                self.low[up] = self.low[state]

    def statistics(self, sequence: list, size: int) -> list[int]:
        """Smallest id of every stretch of ``size`` words; NO_ID where it does not occur."""
        state, matched, found = 0, 0, []
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while self.length[self.link[state]] >= size if state else False:
                state = self.link[state]
                matched = self.length[state]
            if i >= size - 1:
                found.append(self.low[state] if matched >= size else exchange.NO_ID)
        return found


ANCHORS = {"key": U, "low": I, "high": I, "n": np.uint8}
SHARED = {"key": U, "hot": np.uint8}
CONTENTS = {"key": U, "content": U, "low": I}
ASKED = {"key": U, "content": U}
ANSWERS = {"key": U, "content": U, "low": I, "n": np.int32}


def _sorted_groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and where each group of equal keys begins in it."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, np.zeros(0, dtype=I)
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for key in keys:
        in_order = key[order]
        new[1:] |= in_order[1:] != in_order[:-1]
    return order, np.flatnonzero(new)


def _joined(key: np.ndarray, content: np.ndarray) -> np.ndarray:
    return words.mix(key * U(3) + content)


def removed_words(docs: DataFrame, size: int = 13, gram: int = 6, hot_passages: int = HOT_PASSAGES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row of docs (``doc_id, text``)."""
    read, _, n_shards = exchange.blocks(docs)

    def slices_of(table: pa.Table):
        """ids, words and passages of a block, a slice at a time."""
        for batch in words.slices(exchange.batches(table), "text"):
            raw = words.of_texts(batch.column("text"))
            yield batch, exchange.ids(batch), raw, Passages(raw, size, gram)

    def windows_around(hot: np.ndarray, raw: words.Words, found: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word and passage of every window around hot anchors."""
        some = np.flatnonzero(_within(found.anchor, hot))
        if not len(some):
            return np.zeros(0, dtype=U), np.zeros(0, dtype=I), some
        n = found.last[some] - found.first[some] + 1
        passage = np.repeat(some, n)
        first = found.first[passage] + np.arange(len(passage)) - np.repeat(np.cumsum(n) - n, n)
        return words.windows(raw.hash, size)[first], first, passage

    def anchors(table: pa.Table) -> pa.Table:
        keys, contents_, docs_ = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=U)], [np.zeros(0, dtype=I)]
        for _, own, _, found in slices_of(table):
            keys.append(found.anchor)
            contents_.append(found.content)
            docs_.append(own[found.row])
        key, passage, doc = np.concatenate(keys), np.concatenate(contents_), np.concatenate(docs_)
        order, begin = _sorted_groups(key)
        key, passage, doc = key[order], passage[order], doc[order]
        n = _different(passage, begin)
        low = np.minimum.reduceat(doc, begin) if len(begin) else doc
        high = np.maximum.reduceat(doc, begin) if len(begin) else doc
        key = key[begin]
        block = table.column("block")[0].as_py()
        columns = {"key": key, "low": low, "high": high, "n": np.minimum(n, 255).astype(np.uint8)}
        return exchange.dealt(block, exchange.shard_of(key, n_shards), columns, n_shards)

    def shared(table: pa.Table) -> pa.Table:
        got, counts = exchange.gathered(table, ANCHORS)
        order, begin = _sorted_groups(got["key"])
        group = np.zeros(len(order), dtype=I)
        group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        low, high = np.minimum.reduceat(got["low"][order], begin), np.maximum.reduceat(got["high"][order], begin)
        kept = (low < high)[group]
        hot = np.add.reduceat(got["n"][order].astype(I), begin) > min(hot_passages, 254)  # counts end at 255
        return exchange.answered(table, counts, kept, {"key": got["key"], "hot": hot[group].astype(np.uint8)})

    def contents(read_table: pa.Table, shared_table: pa.Table) -> pa.Table:
        if not read_table.num_rows or not shared_table.num_rows:
            return exchange.empty(CONTENTS)
        got, _ = exchange.gathered(shared_table, SHARED)
        wanted, hot = (np.sort(got["key"][got["hot"] == is_hot]) for is_hot in (0, 1))
        parts = [(hot, np.full(len(hot), HOT), np.full(len(hot), exchange.NO_ID))]
        for _, own, raw, found in slices_of(read_table):
            hit = _within(found.anchor, wanted)
            parts.append((found.anchor[hit], found.content[hit], own[found.row[hit]]))
            window, _, passage = windows_around(hot, raw, found)
            parts.append((window, found.anchor[passage], own[found.row[passage]]))
        key, content, doc = (np.concatenate(x) for x in zip(*parts))
        order, begin = _sorted_groups(key, content)
        low = np.minimum.reduceat(doc[order], begin) if len(begin) else doc[:0]
        key, content = key[order][begin], content[order][begin]
        columns = {"key": key, "content": content, "low": low}
        block = read_table.column("block")[0].as_py()
        return exchange.dealt(block, exchange.shard_of(key, n_shards), columns, n_shards)

    def ambiguous(table: pa.Table) -> pa.Table:
        """Ask the block of each first holder for the words of passages whose anchor has several."""
        got, counts = exchange.gathered(table, CONTENTS)
        several, first, _ = _references(got)
        return exchange.answered(table, counts, several & first, {"key": got["key"], "content": got["content"]})

    def passages(read_table: pa.Table, asked_table: pa.Table) -> pa.Table:
        if not read_table.num_rows or not asked_table.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "content": pa.array([], pa.int64()), "text": pa.array([], pa.binary())})
        asked, _ = exchange.gathered(asked_table, ASKED)
        wanted = np.sort(_joined(asked["key"], asked["content"]))
        seen: set[int] = set()
        keys, texts = [], []
        for _, _, raw, found in slices_of(read_table):
            joined = _joined(found.anchor, found.content)
            for i in np.flatnonzero(_within(joined, wanted)).tolist():
                if (name := int(joined[i])) not in seen:
                    seen.add(name)
                    keys.append((found.anchor[i], found.content[i]))
                    texts.append(raw.data[raw.start[found.first[i]] : raw.end[found.last[i] + size - 1]].tobytes())
        key, content = (np.array([k[i] for k in keys], dtype=U) for i in (0, 1))
        shard = exchange.shard_of(key, n_shards)
        return pa.table({"shard": shard, "key": key.view(I), "content": content.view(I), "text": pa.array(texts, pa.binary())})

    def answers(content_table: pa.Table, passage_table: pa.Table) -> pa.Table:
        if not content_table.num_rows:
            return exchange.empty(ANSWERS)
        got, counts = exchange.gathered(content_table, CONTENTS)
        _, _, low = _references(got)
        name = _joined(got["key"], got["content"])
        decided, sizes, lows = _window_lows(passage_table, name, low, size)
        # Entries of passages that an automaton decided get an id per window, others one.
        at = np.minimum(np.searchsorted(decided, name), max(len(decided) - 1, 0))
        many = decided[at] == name if len(decided) else np.zeros(len(name), dtype=bool)
        n = np.ones(len(name), dtype=np.int32)
        n[many] = sizes[at[many]]
        start = np.cumsum(n, dtype=I) - n
        every = np.empty(int(n.sum()), dtype=I)
        every[start[~many]] = low[~many]
        inside = np.arange(int(n[many].sum())) - np.repeat(np.cumsum(n[many], dtype=I) - n[many], n[many])
        source = np.cumsum(sizes, dtype=I) - sizes
        every[np.repeat(start[many], n[many]) + inside] = lows[np.repeat(source[at[many]], n[many]) + inside]
        ends = np.concatenate(([0], np.cumsum(counts)))
        bounds = np.concatenate((start, [len(every)]))[ends]
        own = [slice(a, b) for a, b in zip(ends, ends[1:])]
        made = {c: content_table.column(c) for c in ("block", "shard")}
        for column, values in (("key", got["key"]), ("content", got["content"])):
            made[column] = pa.array([values[part].tobytes() for part in own], pa.binary())
        made["low"] = pa.array([every[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
        made["n"] = pa.array([n[part].tobytes() for part in own], pa.binary())
        return pa.table(made)

    def finished(read_table: pa.Table, answer_table: pa.Table) -> pa.Table:
        got, _ = exchange.gathered(answer_table, {"n": np.int32}) if answer_table.num_rows else ({"n": np.zeros(0, dtype=np.int32)}, None)
        asked = {c: exchange.gathered(answer_table, {c: ANSWERS[c]})[0][c] for c in ("key", "content", "low")}
        hot = np.sort(asked["key"][asked["content"] == HOT])
        name = _joined(asked["key"], asked["content"])
        order = np.argsort(name, kind="stable")
        name, n = name[order], got["n"][order]
        start = (np.cumsum(got["n"], dtype=I) - got["n"])[order]
        lows = asked["low"]
        out: list[tuple] = []
        for batch, own, raw, found in slices_of(read_table):
            cover = np.zeros(len(raw.row) + 1, dtype=np.int32)
            joined = _joined(found.anchor, found.content)
            hit = np.flatnonzero(_within(joined, name))
            at = np.searchsorted(name, joined[hit])
            one = n[at] == 1
            doc = own[found.row[hit]]
            whole = one & (lows[start[at]] < doc) if len(at) else one
            np.add.at(cover, found.first[hit[whole]], 1)
            np.add.at(cover, found.last[hit[whole]] + size, -1)
            for i, a, d in zip(hit[~one].tolist(), at[~one].tolist(), doc[~one].tolist()):
                late = np.flatnonzero(lows[start[a] : start[a] + n[a]] < d) + found.first[i]
                np.add.at(cover, late, 1)
                np.add.at(cover, late + size, -1)
            window, first, passage = windows_around(hot, raw, found)
            at = np.searchsorted(name, _joined(window, found.anchor[passage]))
            late = first[lows[start[at]] < own[found.row[passage]]]
            np.add.at(cover, late, 1)
            np.add.at(cover, late + size, -1)
            gone = np.cumsum(cover[:-1]) > 0
            bounds = raw.of_row()
            for i in range(len(own)):
                a, b = int(bounds[i]), int(bounds[i + 1])
                held = raw.data[raw.offsets[i] : raw.offsets[i + 1]].tobytes().split()
                lost = int(gone[a:b].sum())
                if lost:
                    held = itertools.compress(held, (~gone[a:b]).tolist())
                kept = b" ".join(held)
                out.append((b - a, lost, hashlib.sha256(kept).hexdigest(), kept.decode()))
        columns = list(zip(*out)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_words", "n_removed", "kept_sha256", "kept"]
        return pa.table({"doc_id": read_table.column("doc_id"), **{k: pa.array(c, t) for k, c, t in zip(names, columns, kinds)}})

    by_block = read.groupBy("block")
    held = by_block.applyInArrow(anchors, exchange.schema(ANCHORS))
    common = held.groupBy("shard").applyInArrow(shared, exchange.schema(SHARED))
    content = by_block.cogroup(common.groupBy("block")).applyInArrow(contents, exchange.schema(CONTENTS))
    questions = content.groupBy("shard").applyInArrow(ambiguous, exchange.schema(ASKED))
    texts = by_block.cogroup(questions.groupBy("block")).applyInArrow(passages, "shard long, key long, content long, text binary")
    replies = content.groupBy("shard").cogroup(texts.groupBy("shard")).applyInArrow(answers, exchange.schema(ANSWERS))
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(
        finished, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )


def _different(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many different values each group has."""
    sizes = np.diff(np.append(begin, len(values)))
    group, many = np.repeat(np.arange(len(begin)), sizes), np.repeat(sizes > 1, sizes)
    order, first = _sorted_groups(group[many], values[many])
    return np.maximum(np.bincount(group[many][order][first], minlength=len(begin)), 1)


def _within(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each value is among the wanted ones (sorted)."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _references(got: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per entry: its anchor has several passages; the entry is its passage's first; smallest id of the passage."""
    order, begin = _sorted_groups(got["key"], got["content"])
    sizes = np.diff(np.append(begin, len(order)))
    low = np.zeros(len(order), dtype=I)
    least = np.minimum.reduceat(got["low"][order], begin) if len(begin) else got["low"]
    low[order] = np.repeat(least, sizes)
    key = got["key"][order][begin]
    per_key = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))) if len(key) else np.zeros(0, dtype=I)
    several = np.zeros(len(order), dtype=bool)
    several[order] = np.repeat(np.repeat(per_key, per_key) > 1, sizes)
    return several, got["low"] == low, low


def _window_lows(passages: pa.Table, name: np.ndarray, low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the passages (ascending), how many windows each has, and each window's smallest id.

    name, low: of all entries, to find the smallest id of each passage. Passages around
    different anchors share no window, so each anchor has its own automaton, which is
    dropped when its passages have been streamed.
    """
    if not passages.num_rows:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=I)
    key, content = (passages.column(c).to_numpy().view(U) for c in ("key", "content"))
    own = _joined(key, content)
    order = np.argsort(name, kind="stable")
    holder = low[order][np.searchsorted(name[order], own)].tolist()
    texts = passages.column("text")
    by_key = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], key[by_key][1:] != key[by_key][:-1])))
    found: list[np.ndarray] = [np.zeros(0, dtype=I)] * len(own)
    for some in np.split(by_key, begin[1:]):
        sequences = [(int(i), texts[int(i)].as_py().split()) for i in some]
        automaton = Automaton()
        for i, sequence in sequences:
            automaton.add(sequence, holder[i])
        automaton.finish()
        for i, sequence in sequences:
            found[i] = np.array(automaton.statistics(sequence, size), dtype=I)
    order = np.argsort(own, kind="stable").tolist()
    sizes = np.array([len(found[i]) for i in order], dtype=np.int32)
    return own[order], sizes, np.concatenate([found[i] for i in order])

"""N-gram Jaccard join with set-relation skipping.

Finds every link between shingle sets (intersection of at least ``percent`` of the union)
and returns the components, without testing all pairs of a group of copies.

1. Equal sets are one set, named by its smallest document.
2. A set whose shingles below a fixed hash bound are mostly its own cannot have a partner
   and leaves the join (exact: at most ``percent`` of the set can be missing elsewhere).
3. The rest is indexed: shingles in ascending document frequency, of each set the first
   ones that any partner must share (prefix). Index lists are cut into blocks by set size,
   blocks of incompatible size are skipped, and inside a list entries whose position
   leaves too few shingles, or whose parity bits differ too much, are skipped.
4. Answers from related sets: each set is compared with the leader of its lists first. Sets
   linked to a leader form its star. Jaccard distance is a metric, so the computed answer
   of one star's leader against another's decides for all members unless it falls near the
   bound: only then members meet, skipped again by their distances to the two leaders, and
   only if they are not in one component already.

Defined cases: null and empty texts have an empty set and link with nothing; texts shorter
than a shingle are one shingle; rows with the same id are one document that links as any
of its texts does; a null id has itself as component unless it equals other texts; other
columns are ignored. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import exchange, words
from sightline.llm.links import components
from sightline.llm.sources import checkpointed

U, I = np.uint64, np.int64
BITS = 256
LOW = U(1 << 62)  # hashes below are a quarter of all
LOW_COUNTS = {"key": np.uint32, "n": np.uint8}
COUNTS = {"key": np.uint32, "n": np.int32}
LEVELS = {"key": np.uint32, "level": np.uint8}


def shingle_sets(raw: words.Words, shingle: int) -> list[np.ndarray]:
    """The distinct shingles' hashes of each text, ascending."""
    bounds = raw.of_row()
    hashes = words.windows(raw.hash, shingle)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= shingle:
            sets.append(np.unique(hashes[a : b - shingle + 1]))
        elif b > a:  # the whole sequence
            sets.append(words.windows(raw.hash[a:b], b - a) ^ U(b - a))
        else:
            sets.append(hashes[:0])
    return sets


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums over the set, which say whether sets are equal."""
    one = int(words.mix(shingles).sum(dtype=U)) if len(shingles) else 0
    two = int(words.mix(shingles ^ U(0x5851F42D4C957F2D)).sum(dtype=U)) if len(shingles) else 0
    return one - (1 << 64) * (one >> 63), two - (1 << 64) * (two >> 63)


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n, d1, d2, n_low`` of every row: size and digest of its set, and hashes below LOW."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            sets = shingle_sets(words.of_texts(batch.column("text"), lower=True), shingle)
            rows = [(len(s), *digest(s), int(np.searchsorted(s, LOW))) for s in sets]
            columns = list(zip(*rows)) or [[]] * 4
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n", "d1", "d2", "n_low"])

    return docs.mapInArrow(read, "doc_id long, n long, d1 long, d2 long, n_low long")


def shared_low(read: DataFrame, shingle: int, n_shards: int) -> DataFrame:
    """``doc_id, shared``: how many of a text's hashes below LOW other texts have too.

    read: ``doc_id, text, block``. A block sends each of its hashes once, with whether it has
    it twice, and is told which ones others have: a shingle of all documents is one entry per block.
    """

    def low_sets(table: pa.Table) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for batch in words.slices(exchange.batches(table), "text"):
            sets = shingle_sets(words.of_texts(batch.column("text"), lower=True), shingle)
            yield exchange.ids(batch), [s[: np.searchsorted(s, LOW)] for s in sets]

    def counted(table: pa.Table) -> pa.Table:
        sets = [s for _, found in low_sets(table) for s in found]
        key, n = np.unique(np.concatenate([*sets, np.zeros(0, dtype=U)]), return_counts=True)
        columns = {"key": key.astype(np.uint32), "n": np.minimum(n, 2).astype(np.uint8)}
        return exchange.dealt(table.column("block")[0].as_py(), exchange.shard_of(key, n_shards), columns, n_shards)

    def shared(table: pa.Table) -> pa.Table:
        got, counts = exchange.gathered(table, LOW_COUNTS)
        _, at = np.unique(got["key"], return_inverse=True)
        return exchange.answered(table, counts, np.bincount(at, got["n"])[at] > 1, {"key": got["key"]})

    def add(table: pa.Table, told: pa.Table) -> pa.Table:
        docs_, found = [np.zeros(0, dtype=I)], [np.zeros(0)]
        if table.num_rows and told.num_rows:
            got, counts = exchange.gathered(told, {"key": np.uint32})
            shard = np.repeat(told.column("shard").to_numpy(), counts)
            known = np.unique((shard.astype(U) << U(32)) | got["key"].astype(U))
            for own, sets in low_sets(table):
                key = np.concatenate([*sets, np.zeros(0, dtype=U)])
                name = (exchange.shard_of(key, n_shards).astype(U) << U(32)) | (key & U(0xFFFFFFFF))
                hit = known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name
                row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                docs_.append(own)
                found.append(np.bincount(row, hit, minlength=len(sets)))
        doc, at = np.unique(np.concatenate(docs_), return_inverse=True)
        return pa.table({"doc_id": doc, "shared": np.bincount(at, np.concatenate(found), minlength=len(doc)).astype(I)})

    by_block = read.groupBy("block")
    sent = by_block.applyInArrow(counted, exchange.schema(LOW_COUNTS))
    told = sent.groupBy("shard").applyInArrow(shared, exchange.schema({"key": np.uint32}))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(add, "doc_id long, shared long")


def indexed(read: DataFrame, asked: DataFrame, n_shards: int, shingle: int, percent: int) -> DataFrame:
    """``node, n, shingles, bits, tokens, places`` of the asked sets that share a prefix shingle.

    read: ``doc_id, text, block``; asked: ``block, doc_id, d1`` of the sets in the join.
    tokens: the prefix shingles that some other set has, places: their positions in the set
    by ascending document frequency (ties by hash).
    """

    def sets_of(table: pa.Table, wanted: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        names = set(zip(wanted.column("doc_id").to_pylist(), wanted.column("d1").to_pylist()))
        own = pa.array([i for i, _ in names], pa.int64())
        table = table.filter(pc.is_in(table.column("doc_id"), value_set=own))
        for batch in words.slices(exchange.batches(table), "text"):
            for doc, shingles in zip(batch.column("doc_id").to_pylist(), shingle_sets(words.of_texts(batch.column("text"), lower=True), shingle)):
                name = (doc, digest(shingles)[0])
                if name in names:
                    names.discard(name)  # a repeated row adds nothing
                    yield doc, shingles

    def counted(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not table.num_rows or not wanted.num_rows:
            return exchange.empty(COUNTS)
        sets = [s for _, s in sets_of(table, wanted)]
        key, n = np.unique(np.concatenate([*sets, np.zeros(0, dtype=U)]), return_counts=True)
        columns = {"key": key.astype(np.uint32), "n": n.astype(np.int32)}
        return exchange.dealt(table.column("block")[0].as_py(), exchange.shard_of(key, n_shards), columns, n_shards)

    def levels(table: pa.Table) -> pa.Table:
        got, counts = exchange.gathered(table, {"key": np.uint32})
        n, _ = exchange.gathered(table, {"n": np.int32})
        _, at = np.unique(got["key"], return_inverse=True)
        total = np.bincount(at, n["n"])[at]
        level = np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
        return exchange.answered(table, counts, total > 1, {"key": got["key"], "level": level})

    def prefixes(table: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        wanted = told.filter(pc.is_valid(told.column("doc_id")))
        if table.num_rows and wanted.num_rows:
            answers = told.filter(pc.is_valid(told.column("shard")))
            shard = np.zeros(0, dtype=I)
            got, counts = exchange.gathered(answers, {"key": np.uint32})
            level, _ = exchange.gathered(answers, {"level": np.uint8})
            shard = np.repeat(answers.column("shard").to_numpy(), counts)
            known = (shard.astype(U) << U(32)) | got["key"].astype(U)
            order = np.argsort(known)
            known, level = known[order], level["level"][order]
            for doc, shingles in sets_of(table, wanted):
                name = (exchange.shard_of(shingles, n_shards).astype(U) << U(32)) | (shingles & U(0xFFFFFFFF))
                at = np.minimum(np.searchsorted(known, name), max(len(known) - 1, 0))
                rank = np.where(known[at] == name, level[at], 0) if len(known) else np.zeros(len(name), dtype=np.uint8)
                n = len(shingles)
                prefix = np.lexsort((shingles, rank))[: n - _share(n, percent) + 1]
                place = np.flatnonzero(rank[prefix] > 0)
                if len(place):
                    rows.append((doc, n, shingles.view(I), parity_bits(shingles), shingles[prefix[place]].view(I), place.astype(np.int32)))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["node", "n", "shingles", "bits", "tokens", "places"]
        return pa.table({name: pa.array(c, k) for name, c, k in zip(names, columns, kinds)})

    by_block = read.groupBy("block")
    counts = by_block.cogroup(asked.groupBy("block")).applyInArrow(counted, exchange.schema(COUNTS))
    told = counts.groupBy("shard").applyInArrow(levels, exchange.schema(LEVELS))
    told = told.unionByName(asked, allowMissingColumns=True)
    return by_block.cogroup(told.groupBy("block")).applyInArrow(
        prefixes, "node long, n long, shingles array<long>, bits array<long>, tokens array<long>, places array<int>"
    )


def parity_bits(shingles: np.ndarray) -> list[int]:
    """BITS bits, each the parity of the number of shingles that fall on it, as long values.

    Every shingle that two sets do not share turns one bit, so the sets differ in at least
    as many shingles as their bits differ.
    """
    odd = np.bincount(((shingles >> U(3)) % U(BITS)).astype(I), minlength=BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(I).tolist()


def _bits_differ(one: str, two: str) -> Column:
    return sum(F.bit_count(F.col(f"{one}{i}").bitwiseXOR(F.col(f"{two}{i}"))) for i in range(BITS // 64))


def _share(n: int, percent: int) -> int:
    """Least intersection of a set of n with any partner."""
    return -(-percent * n // 100)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common, union`` of pairs of nodes, from their whole sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    together = F.size("of_a") + F.size("of_b") - common
    return pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("common"), together.alias("union"))


def _linked(percent: int) -> Column:
    return 100 * F.col("common") >= percent * F.col("union")


def _possible(percent: int, n1: Column, n2: Column, rest1: Column, rest2: Column) -> Column:
    """Whether sets of these sizes, with so many shingles from the common one on, can link."""
    least = F.lit(percent) * (n1 + n2) / (100 + percent) - 1e-6
    return F.least(rest1, rest2) >= least


def similar_components(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of docs (``doc_id, text``)."""
    read, n_blocks, n_shards = exchange.blocks(docs)
    texts = read.select("doc_id", "text")
    facts = checkpointed(described(texts, shingle))
    same = facts.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.max("n_low").alias("n_low"))
    same = checkpointed(same)
    # Exact pre-filter: a partner has all but n - share(n) of the set's shingles.
    missing = F.col("n") - F.ceil(F.col("n") * percent / 100)
    likely = (
        same.join(shared_low(read, shingle, n_shards).withColumnRenamed("doc_id", "node"), "node", "left")
        .where((F.col("n_low") - F.coalesce("shared", F.lit(0)) <= missing) & F.col("node").isNotNull())
        .select(F.pmod(F.xxhash64("node"), F.lit(n_blocks)).alias("block"), F.col("node").alias("doc_id"), "d1")
    )
    sets = checkpointed(indexed(read, checkpointed(likely), n_shards, shingle, percent))
    links = checkpointed(_links(sets, percent))
    joined = components(links)
    named = same.join(joined, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component_id"))
    return facts.join(named, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` links whose components are those of all links between the sets."""
    bound = 1 - percent / 100
    words_of_bits = range(BITS // 64)
    bits = sets.select("node", "n", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in words_of_bits])
    posted = sets.select(
        "node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("entry")
    ).select("node", "n", F.col("entry.tokens").alias("token"), (F.col("n") - F.col("entry.places")).alias("rest"))
    posted = checkpointed(posted)

    # Each set against the leader that most of its lists have.
    lists = posted.groupBy("token").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last"))
    lists = lists.where("lead.node < last").select("token", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"))
    sized = (F.col("n") * 100 >= percent * F.col("lead_n")) & (F.col("lead_n") * 100 >= percent * F.col("n"))
    first = (
        posted.join(lists, "token")
        .where((F.col("node") != F.col("lead")) & sized)
        .groupBy("node", "lead")
        .count()
        .groupBy("node")
        .agg(F.max(F.struct("count", (-F.col("lead")).alias("less"))).alias("most"))
        .select(F.col("node").alias("a"), (-F.col("most.less")).alias("b"))
    )
    answers = checkpointed(verified(first, sets).where(_linked(percent)))
    led = answers.select(F.col("a").alias("node"))
    members = answers.join(led.withColumnRenamed("node", "b"), "b", "left_anti").select(
        F.col("a").alias("node"), F.col("b").alias("star"), (1 - F.col("common") / F.col("union")).alias("far")
    )
    starred = checkpointed(
        posted.join(members, "node", "left").select(
            "token", "node", "n", "rest", F.coalesce("star", "node").alias("star"), F.coalesce("far", F.lit(0.0)).alias("far")
        )
    )

    # Stars that share a list, by blocks of set size; a block meets itself and the next one.
    block = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)))
    posts = starred.withColumn("size_block", block).groupBy("token", "size_block", "star").agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("rest").alias("rest")
    )
    # Leaders' bits bound their distance before any set is read; members are within their star's radius.
    radii = members.groupBy("star").agg(F.max("far").alias("radius"))
    leaders = bits.withColumnsRenamed({"node": "star", "n": "lead_n"}).join(radii, "star", "left")
    posts = posts.join(leaders.withColumn("radius", F.coalesce("radius", F.lit(0.0))), "star")
    one = posts.select(
        *[F.col(f"b{i}").alias(f"p{i}") for i in words_of_bits], F.col("lead_n").alias("l1"), F.col("radius").alias("r1"),
        "token", F.explode(F.array(F.col("size_block"), F.col("size_block") + 1)).alias("size_block"), F.col("size_block").alias("block1"),
        F.col("star").alias("s1"), F.col("least_n").alias("n1"), F.col("most_n").alias("m1"), F.col("rest").alias("rest1"),
    )
    two = posts.select(
        *[F.col(f"b{i}").alias(f"q{i}") for i in words_of_bits], F.col("lead_n").alias("l2"), F.col("radius").alias("r2"),
        "token", "size_block", F.col("star").alias("s2"), F.col("least_n").alias("n2"), F.col("most_n").alias("m2"), F.col("rest").alias("rest2"),
    )
    least = F.greatest(F.lit(0.0), percent / 100 - F.col("r1") - F.col("r2"))  # similarity of the leaders of linked members
    apart = (F.col("l1") + F.col("l2")) * (1 - least) / (1 + least) + 1e-6
    meet = (
        (one["token"] == two["token"])
        & (one["size_block"] == two["size_block"])
        & (F.col("s1") != F.col("s2"))
        & ((F.col("block1") < two["size_block"]) | (F.col("s1") < F.col("s2")))
        & (100 * F.col("m2") >= percent * F.col("n1"))
        & (100 * F.col("m1") >= percent * F.col("n2"))
        & _possible(percent, F.col("n1"), F.col("n2"), F.col("rest1"), F.col("rest2"))
        & (_bits_differ("p", "q") <= apart)
    )
    stars = one.join(two, meet).select(F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b")).distinct()
    distances = verified(stars, sets).withColumn("far", 1 - F.col("common") / F.col("union"))
    known = leaders.select(
        "star", F.coalesce("radius", F.lit(0.0)).alias("r"), F.col("lead_n").alias("l"), *[F.col(f"b{i}").alias(f"q{i}") for i in words_of_bits]
    )
    distances = checkpointed(
        distances.join(known.select(F.col("star").alias("a"), F.col("r").alias("r1")), "a")
        .join(known.withColumnsRenamed({"star": "b", "r": "r2", "l": "l2"}), "b")
        .withColumn("radii", F.col("r1") + F.col("r2"))
        .where(_linked(percent) | ((F.col("radii") > 0) & (F.col("far") <= bound + F.col("radii") + 1e-9)))
    )
    sure = checkpointed(answers.select("a", "b").union(distances.where(_linked(percent)).select("a", "b")))

    # Near the bound the members decide, where their stars are not in one component yet.
    open_ = distances.where(~_linked(percent))
    now = components(sure)
    for side in ("a", "b"):
        own = now.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        open_ = open_.join(own, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    open_ = open_.where("c_a <> c_b").select(
        F.col("a").alias("s1"), F.col("b").alias("s2"), F.col("far").alias("between"), F.col("r2"), F.col("l2"), *[f"q{i}" for i in words_of_bits]
    )
    open_ = checkpointed(open_)
    # A member meets the other star only if the star's leader, which its members are near, is near enough itself.
    nodes = bits.join(members, "node", "left").select(
        "node", "n", F.coalesce("star", "node").alias("star"), F.coalesce("far", F.lit(0.0)).alias("far"), *[f"b{i}" for i in words_of_bits]
    )
    own_bits = lambda name: [F.col(f"b{i}").alias(f"{name}{i}") for i in words_of_bits]
    first = nodes.select(F.col("node").alias("x"), F.col("n").alias("n1"), F.col("star").alias("s1"), F.col("far").alias("far1"), *own_bits("p"))
    least = F.greatest(F.lit(0.0), percent / 100 - F.col("r2"))
    reach = (
        (F.col("between") - F.col("far1") - F.col("r2") <= bound + 1e-9)
        & (_bits_differ("p", "q") <= (F.col("n1") + F.col("l2")) * (1 - least) / (1 + least) + 1e-6)
    )
    asks = first.join(open_.withColumnRenamed("s1", "star1"), (F.col("s1") == F.col("star1")) & reach).drop(*[f"q{i}" for i in words_of_bits])
    tokens = lambda node, rest: posted.select("token", F.col("node").alias(node), F.col("rest").alias(rest))
    left = asks.join(tokens("x", "rest1"), "x")
    second = nodes.select(F.col("node").alias("y"), F.col("n").alias("n2"), F.col("star").alias("s2"), F.col("far").alias("far2"), *own_bits("q"))
    right = second.join(open_.select("s2").distinct(), "s2", "left_semi").join(tokens("y", "rest2"), "y")
    near = (
        (F.col("between") - F.col("far1") - F.col("far2") <= bound + 1e-9)
        & (100 * F.col("n2") >= percent * F.col("n1"))
        & (100 * F.col("n1") >= percent * F.col("n2"))
        & _possible(percent, F.col("n1"), F.col("n2"), F.col("rest1"), F.col("rest2"))
        & (_bits_differ("p", "q") <= (F.col("n1") + F.col("n2")) * (100 - percent) / (100 + percent) + 1e-6)
    )
    last = left.join(right, ["token", "s2"]).where(near).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    return sure.union(verified(last, sets).where(_linked(percent)).select("a", "b"))

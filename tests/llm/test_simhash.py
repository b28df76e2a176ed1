import random
import re

import numpy as np
import pytest
import xxhash

from sightline.llm import catalog, simhash


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, distance):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i, own in enumerate(ids):
        groups.setdefault(find(i), []).append(own)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def check(df, rows, distance=4):
    prints = [brute_print(t) for _, t in rows]
    want = zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute_components([i for i, _ in rows], prints, distance))
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=order) == sorted(want, key=order)


def test_cases_as_brute_force(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "a b c d"), (7, "É b c d"), (8, "é b c d"), (9, long), (10, long + " x"),
        (11, "same id"), (11, "same id"), (11, "other text"), (None, "no id"), (None, "no id"), (None, "é b c d"), (12, "a b c\u0085d e f"),
    ]
    check(simhash.near_duplicates(docs_of(rows)), rows)
    assert simhash.near_duplicates(docs_of([])).count() == 0
    check(simhash.near_duplicates(docs_of([(1, None)])), [(1, None)])


def test_query(spark, sf, text_of):
    check(catalog.QUERIES["op12_simhash_near_dedup"](spark, sf), sorted(text_of.items()))


def clouds(seed, distance):
    """Fingerprints around centres, in chains, and near the bound; few bits, so that much is near."""
    pick = random.Random(seed)
    turned = lambda p, k: p ^ sum(1 << b for b in pick.sample(range(64), k))
    prints = [pick.getrandbits(64) for _ in range(40)]
    for centre in prints[:3]:
        prints += [turned(centre, pick.randint(1, 12)) for _ in range(120)]
    for centre in prints[3:20]:
        prints += [turned(centre, k) for k in range(distance - 1, distance + 3)]
    chain = [prints[0]]
    for _ in range(20):
        chain.append(turned(chain[-1], distance))
    return prints + chain + prints[:5] * 3


def parts_of(spark, prints, distance, n_parts=None):
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long").groupBy("print").count().withColumnRenamed("count", "n")
    n, both = simhash.bit_counts(df)
    if n_parts is None:
        return df, simhash.planned_parts(n, both, distance)
    bits = simhash.correlated_parts(n, both, n_parts)
    return df, [simhash.Part(b, t) for b, t in zip(bits, simhash.allocated(n, both, bits, distance)[1]) if t >= 0]


@pytest.mark.parametrize("distance, n_parts, rounds", [(4, None, 3), (4, 2, 1), (4, 4, 2), (4, 7, 1), (2, 3, 2)])
def test_links_no_pair_is_lost(spark, distance, n_parts, rounds):
    prints = clouds(distance * 10 + (n_parts or 0), distance)
    df, parts = parts_of(spark, prints, distance, n_parts)
    found = simhash.components(simhash.linked(df, parts, distance, rounds)).collect()
    of = {r["node"]: r["component"] for r in found}
    signed = [simhash._signed(p) for p in prints]
    assert [of.get(p, p) for p in signed] == brute_components(signed, prints, distance)


def test_thresholds_are_the_cheapest_and_cover(spark):
    prints = clouds(3, 4)
    df, _ = parts_of(spark, prints, 4)
    n, both = simhash.bit_counts(df)
    set_ = np.array([[p >> b & 1 for b in range(64)] for p in set(prints)])
    assert n == len(set(prints)) and (both == set_.T @ set_).all()
    bits = simhash.correlated_parts(n, both, 3)
    assert sorted(b for part in bits for b in part) == list(range(64))
    cost, thresholds = simhash.allocated(n, both, bits, 4)
    assert sum(thresholds) == 4 - 3 + 1
    price = lambda part, t: 0 if t < 0 else simhash.PROBE_COST * n * sum(simhash.comb(len(part), k) for k in range(t + 1)) + n * n * simhash.near_shares(n, both, part, 4)[t]
    every = [(sum(map(price, bits, ts)), list(ts)) for ts in np.ndindex(6, 6, 6) for ts in [[t - 1 for t in ts]] if sum(ts) == 2]
    assert abs(cost - min(every)[0]) < 1e-6 * cost


def test_correlated_bits_share_a_part():
    pick = np.random.default_rng(0)
    set_ = pick.integers(0, 2, (4000, 64))
    for a, b in ((0, 40), (0, 63), (17, 50)):
        set_[:, b] = np.where(pick.random(4000) < 0.95, set_[:, a], set_[:, b])
    parts = simhash.correlated_parts(4000, (set_.T @ set_).astype(float), 4)
    home = {b: k for k, part in enumerate(parts) for b in part}
    assert home[0] == home[40] == home[63] and home[17] == home[50]


def test_stars_meet_once_per_value(spark):
    """Two near stars of 50 members with the same low bits: the members' probes are not multiplied."""
    rows = [(simhash._signed(star ^ (k << 40)), simhash._signed(star), 4) for star in (0b1, 0b11) for k in range(50)]
    members = spark.createDataFrame(rows, "print long, star long, radius int")
    parts = [simhash.Part(list(range(32)), 1), simhash.Part(list(range(32, 64)), 1)]
    met = simhash._meetings(members, parts, 4).select("part", "value", "a", "b")
    assert {(r.a, r.b) for r in met.collect()} == {(1, 3)}
    assert met.count() == met.distinct().count() and met.where("part = 0").count() == 1

import random

import numpy as np
import xxhash

from foldwise.llm import simhash
from foldwise.llm.components import connected_components


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def close(values, radius):
    return [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= radius]


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(2, n // 40))]
    out = set()
    while len(out) < n:
        value = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            value ^= 1 << rng.randrange(64)
        out.add(value)
    return sorted(out)


def test_fingerprint_is_the_plain_one(awkward):
    for text in [*awkward, "one two three four five six ONE two three four"]:
        if len(text or "") < 20_000:
            assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_tree_finds_exactly_what_is_in_reach():
    values = clustered(500, 1)
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        assert sorted(tree.values[i] for i in tree.within(v, 4)) == [w for w in values if (v ^ w).bit_count() <= 4]


def test_masks_meet_every_close_pair():
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks(6, 2)]
    assert len(masks) == 15
    for a, b in close(clustered(400, 2), 4):
        assert any((a ^ b) & m == 0 for m in masks)


def test_links_connect_like_all_pairs(spark):
    values = clustered(900, 3)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    expected = components(close(values, 4), values)
    for size in (4096, 3):
        links = simhash.fingerprint_links(nodes, 4, 6, tree_size=size).collect()
        pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        assert components(pairs, values) == expected


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (60, 59)]
    pairs += [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(200)]
    found = connected_components(spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint"), "a", "b").collect()
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    assert {r.node: r.component for r in found} == components(pairs, linked) and len(found) == len(linked)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_near_duplicates_of_writeups(spark, writeups, awkward):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(900)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    rows = list(enumerate(awkward))
    for n, text in enumerate(base):
        for copy in range(4):
            split = text.split()
            split[rng.randrange(300)] = "changed"
            rows.append((100 + 10 * n + copy, " ".join(split) if copy else text))
    rows += [(100, base[0]), (None, base[0]), (None, "only without an id, and nowhere else in this table")]
    out = simhash.near_duplicates(writeups(rows)).collect()
    prints = {t: plain_fingerprint(t) if len(t or "") < 20_000 else simhash.fingerprint(t) for _, t in rows}
    groups = components(close(sorted(set(prints.values())), 4), set(prints.values()))
    first = {}
    for i, t in rows:
        if i is not None:
            first[groups[prints[t]]] = min(i, first.get(groups[prints[t]], i))
    expected = sorted((str(i), prints[t], str(first.get(groups[prints[t]]))) for i, t in rows)
    assert sorted((str(r.entry_id), r.fingerprint & (1 << 64) - 1, str(r.component_id)) for r in out) == expected
    assert simhash.near_duplicates(writeups([])).count() == 0
    text_ids = simhash.near_duplicates(writeups([("S6E9-02", "a b c d e"), ("S6E9-01", "A b c d e")], "string")).collect()
    assert {r.component_id for r in text_ids} == {"S6E9-01"}
    assert np.array_equal(sorted(len(str(r.entry_id)) for r in text_ids), [7, 7])

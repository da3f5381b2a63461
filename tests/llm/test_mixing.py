import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest

from foldwise.llm import mixing

LEVELS = ("season", "episode", "source")


def share_out(budget, children):
    """Water filling in exact fractions: ``{name: (capacity, weight)}`` to real-valued budgets."""
    out, left, open_ = {}, Fraction(budget), dict(children)
    while open_:
        total = sum(w for _, w in open_.values())
        full = {n: c for n, (c, w) in open_.items() if c * total <= left * w}
        if not full:
            return out | {n: left * w / total for n, (_, w) in open_.items()}
        for n, c in full.items():
            out[n] = Fraction(c)
            left -= c
            del open_[n]
    return out


def plain_budgets(leaves, weights, total, epochs):
    weight = lambda path: weights.get("/".join(path), 1)
    usable = {p: h * epochs for p, h in leaves.items() if h and all(weight(p[: k + 1]) > 0 for k in range(3))}
    out = {(): Fraction(total)}
    for depth in range(3):
        groups = defaultdict(dict)
        for p, c in usable.items():
            node = p[: depth + 1]
            groups[node[:-1]][node] = (groups[node[:-1]].get(node, (0, 0))[0] + c, weight(node))
        for parent, children in groups.items():
            out |= share_out(out[parent], children)
    return {p: out.get(p, Fraction(0)) for p in leaves}


def pool_rows():
    rows, n = [], 0
    for season, episodes in {"6": {"1": {"train": 90, "orig": 4}, "9": {"train": 30}}, "5": {"12": {"train": 8, "orig": 2, None: 3}}}.items():
        for episode, sources in episodes.items():
            for source, count in sources.items():
                for k in range(count):
                    rows.append((n, season, episode, source, 3 + (n * 7) % 11))
                    n += 1
    return rows


def make(spark, rows):
    schema = "entry_id bigint, season string, episode string, source string, n_tokens bigint, budget string, weight string"
    return spark.createDataFrame([(*r, "x", None) for r in rows], schema)


WEIGHTS = [("6", 1), ("5", 3), ("6/1", 2), ("6/1/orig", 9)]


@pytest.mark.parametrize("total,epochs", [(400, 1), (400, 3), (50, 1), (5000, 2), (1, 1)])
def test_budgets_shortages_and_prefixes(spark, total, epochs):
    rows = pool_rows()
    weights = spark.createDataFrame(WEIGHTS, "node string, weight bigint")
    drawn = mixing.mix(make(spark, rows), weights, total, max_epochs=epochs, seed=5, levels=LEVELS).collect()
    have = defaultdict(int)
    for _, *leaf, t in rows:
        have[tuple(x or "NULL" for x in leaf)] += t
    expected = plain_budgets(have, dict(WEIGHTS), total, epochs)
    taken = defaultdict(int)
    for r in drawn:
        taken[r.season, r.episode, r.source] += r.taken
    assert sum(taken.values()) == min(total, epochs * sum(have.values()))
    for leaf, budget in expected.items():
        assert abs(taken[leaf] - budget) < 3
    for leaf in have:
        budget = taken[leaf]
        docs = [(i, t) for i, *path, t in rows if tuple(x or "NULL" for x in path) == leaf]
        whole, rest = divmod(budget, have[leaf])
        order = sorted(docs, key=lambda d: (hashlib.md5(f"5:{whole}:{d[0]}".encode()).hexdigest(), d))
        want = [(i, e, t) for e in range(whole) for i, t in docs]
        for i, t in order:
            if rest > 0:
                want.append((i, whole, min(t, rest)))
                rest -= t
        got = [(r.entry_id, r.epoch, r.taken) for r in drawn if (r.season, r.episode, r.source) == leaf]
        assert sorted(got) == sorted(want)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [(n, "6", "1", "orig", 1) for n in range(10)] + [(n, "6", "1", "train", 1) for n in range(10, 1000)]
    rows += [(n, "5", "2", "train", 1) for n in range(1000, 2000)]
    weights = spark.createDataFrame([("6", 1)], "node string, weight bigint")
    drawn = mixing.mix(make(spark, rows), weights, 1000, levels=LEVELS).groupBy("season", "source").sum("taken").collect()
    assert {tuple(r) for r in drawn} == {("6", "orig", 10), ("6", "train", 490), ("5", "train", 500)}


def test_weight_zero_nulls_repeats_and_empty(spark):
    rows = [(1, "6", "1", "a", 5), (1, "6", "1", "a", 5), (None, "6", "1", "a", 5), (2, None, None, None, None), (3, "6", "1", "b", -4), (4, "6", "2", "c", 0)]
    weights = spark.createDataFrame([("5", 1)], "node string, weight bigint")
    drawn = mixing.mix(make(spark, rows), weights, share=(1, 1), levels=LEVELS).collect()
    assert sorted((str(r.entry_id), r.taken) for r in drawn) == [("1", 5), ("1", 5), ("None", 5)]
    nothing = spark.createDataFrame([("6", 0)], "node string, weight bigint")
    assert mixing.mix(make(spark, rows), nothing, 10, levels=LEVELS).count() == 0
    assert mixing.mix(make(spark, []), weights, levels=LEVELS).count() == 0
    assert mixing.mix(make(spark, rows), weights, 0, levels=LEVELS).count() == 0


def test_words(spark, awkward):
    texts = spark.createDataFrame([(n, t) for n, t in enumerate(awkward)], "n int, t string")
    for r in texts.select("n", mixing.words_in(texts.t).alias("w")).collect():
        assert r.w == len((awkward[r.n] or "").encode().split())

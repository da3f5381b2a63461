import random

import duckdb
import numpy as np
import pytest
from test_simhash import components

import corpus_pipeline
from foldwise.llm import near_copies


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))) if words else frozenset()


def brute_pairs(sets):
    """All pairs of distinct sets with Jaccard similarity of 0.8 or more."""
    by_size = sorted(sets, key=len)
    return [
        (a, b) for i, a in enumerate(by_size) for b in by_size[i + 1 :]
        if 5 * len(a) >= 4 * len(b) and 9 * len(a & b) >= 4 * (len(a) + len(b))
    ]


def survivors(rows):
    """Smallest id of each group of ``(id, text)`` rows; groups by brute force."""
    sets = {s: n for n, s in enumerate({plain_set(t) for _, t in rows})}
    groups = components([(sets[a], sets[b]) for a, b in brute_pairs([s for s in sets if s])], set(sets.values()))
    first = {}
    for i, t in rows:
        group = groups[sets[plain_set(t)]]
        first[group] = min(i, first.get(group, i))
    return sorted(first.values())


def edited(rng, base, changes):
    words = base.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    """Copies with 1 to 10 changed words of 200: similarities on both sides of 0.8, most of them over 4 SimHash bits apart."""
    rng = random.Random(4)
    bases = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=200)) for _ in range(40)]
    rows = [(i, b) for i, b in enumerate(bases)]
    rows += [(1000 + 100 * n + k, edited(rng, b, k)) for n, b in enumerate(bases) for k in range(1, 11)]
    return rows + [(9000, None), (9001, " "), (9002, "few words"), (9003, "Few  words"), (9004, bases[0])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


@pytest.mark.parametrize("size", [512, 4])
def test_links_are_those_of_brute_force(spark, monkeypatch, size):
    rows = near_rows()
    found = near_copies.near_copies
    monkeypatch.setattr(near_copies, "near_copies", lambda *a, **k: found(*a, **k, group_size=size))
    out = corpus_pipeline.keep_one_of_near_copies(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == survivors(rows)


def test_recall_on_the_given_documents(spark):
    """Every pair of similarity 0.8 or more on the given tables ends in one group."""
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()
    out = corpus_pipeline.keep_one_of_near_copies(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == survivors(rows)


def test_pieces_find_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[4 * (k % 7) :], rng.integers(0, 1 << 63, k % 12).astype(np.uint64)))) for k in range(30)]
    close = [(i, j) for i in range(30) for j in range(i) if len(c := np.intersect1d(sets[i], sets[j])) * 9 >= 4 * (len(sets[i]) + len(sets[j]))]
    assert 0 < len(close) < 435
    links = near_copies.similar_links(sets, [0] * 30)
    assert components(links, set(range(30))) == components(close, set(range(30)))
    across = near_copies.similar_links(sets, [1 + k % 2 for k in range(30)])
    assert components(across, set(range(30))) == components([p for p in close if sum(p) % 2], set(range(30)))


def test_rows_that_share_an_id_but_not_a_text_stay(spark):
    rng = random.Random(8)
    copied, lone = (" ".join(rng.choices([f"w{i}" for i in range(900)], k=200)) for _ in range(2))
    rows = [(1, copied), (2, edited(rng, copied, 1)), (2, lone), (2, lone), (3, copied)]
    out = corpus_pipeline.keep_one_of_near_copies(spark, frame(spark, rows), "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, copied), (2, lone)]


def test_linked_fingerprints_alone_propose_a_pair(spark, monkeypatch):
    """Without any shared MinHash band, near copies still meet through the BK-trees over their fingerprints."""
    words = [f"w{i}" for i in range(400)]
    changed = [*words[:-1], "other"]
    far = [f"x{i}" for i in range(400)]
    records = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(far))], "doc_id bigint, text string")
    own = near_copies.bands
    monkeypatch.setattr(near_copies, "bands", lambda s: bytes(a ^ b for a, b in zip(own(s), near_copies.set_name(s) * 12)))
    rows, groups = near_copies.near_copies(records, "doc_id", "text")
    linked = rows.join(groups, "node").collect()
    assert sorted(r.entry_id for r in linked) == [1, 2] and len({r.component for r in linked}) == 1

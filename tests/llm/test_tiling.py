import random

from foldwise.llm import tiling


def greedy(item, text, shortest):
    """Greedy string tiling by comparing everything with everything."""
    taken_item, taken_text, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                k = 0
                while (
                    a + k < len(item) and b + k < len(text) and item[a + k] == text[b + k]
                    and a + k not in taken_item and b + k not in taken_text
                ):
                    k += 1
                if k > best[0]:
                    best = (k, a, b)
        k, a, b = best
        if k < shortest:
            return tiles
        taken_item |= set(range(a, a + k))
        taken_text |= set(range(b, b + k))
        tiles.append((a, b, k))


def test_tiles_equal_exhaustive_greedy_tiling():
    rng = random.Random(1)
    for _ in range(150):
        item = [rng.randint(1, 6) for _ in range(rng.randint(1, 24))]
        text = [rng.randint(1, 6) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5:
            cut = rng.randrange(len(item))
            text += item[cut:] + [0] + item[:cut]
        shortest = rng.randint(1, 4)
        found = tiling.tile(item, text, shortest)
        assert sorted(k for *_, k in found) == sorted(k for *_, k in greedy(item, text, shortest))
        assert all(item[a : a + k] == text[b : b + k] for a, b, k in found)


def items_and_records(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    items = [(n, " ".join(rng.choices(words, k=rng.randint(25, 60)))) for n in range(20)]
    items += [(20, "two words"), (21, None), (22, ""), (23, items[0][1])]
    records = []
    for n in range(80):
        text = rng.choices(words, k=rng.randint(0, 200))
        kind = n % 4
        if kind:
            split = items[n % 20][1].split()
            if kind == 2:  # moved halves
                split = split[len(split) // 2 :] + ["between"] + split[: len(split) // 2]
            if kind == 3:  # only half of it
                split = split[: len(split) // 2]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," for w in split]
        records.append((n, " ".join(text)))
    return items, records


def plain_leaks(items, records, threshold=0.8):
    """Tiling of whole texts without seeds; only items with too few tokens in the text at all are skipped."""
    out = []
    for i, text in records:
        words = [w.decode() for w in tiling.tokens((text or "").encode())]
        known = set(words)
        for item_id, item_text in items:
            item = [w.decode() for w in tiling.tokens((item_text or "").encode())]
            if item and sum(w in known for w in item) >= threshold * len(item):
                numbers = {w: n for n, w in enumerate(dict.fromkeys([*item, *words]))}
                tiles = tiling.tile([numbers[w] for w in item], [numbers[w] for w in words], min(3, len(item)))
                covered = sum(k for *_, k in tiles) / len(item)
                if covered >= threshold:
                    out.append((str(i), item_id, round(covered, 9)))
    return sorted(out)


def test_phrases_in_any_order_and_place(spark, writeups):
    """Four-token phrases in another order, and short tiles far from the rest, count like any other."""
    words = [f"q{i}" for i in range(40)]
    phrases = [words[k : k + 4] for k in range(0, 40, 4)]
    moved = " ".join(w for k in (3, 7, 0, 9, 5, 2, 8, 1, 6, 4) for w in phrases[k])
    far = " ".join([*words[:24], *(["filler"] * 500), *words[24:28], *(["filler"] * 700), *words[28:32]])
    shorter = " ".join([*words[:24], *(["filler"] * 500), *words[24:26], *(["filler"] * 700), *words[30:32]])
    some = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, body string")
    found = {r.entry_id: r.coverage for r in tiling.leaks(writeups([(1, moved), (2, far), (3, shorter)]), some).collect()}
    assert found == {1: 1.0, 2: 0.8}
    assert plain_leaks([(1, " ".join(words))], [(1, moved), (2, far), (3, shorter)]) == [("1", 1, 1.0), ("2", 1, 0.8)]


def test_random_phrases_equal_tiling_without_seeds(spark, writeups):
    rng = random.Random(11)
    items = [(n, " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(2, 40)))) for n in range(12)]
    records = []
    for n in range(60):
        parts = []
        for _ in range(rng.randint(1, 30)):
            words = items[n % 12][1].split()
            at, size = rng.randrange(len(words)), rng.randint(1, 9)
            parts += words[at : at + size] + rng.choices([f"w{k}" for k in range(60)], k=rng.randint(0, 3))
        records.append((n, " ".join(parts)))
    benchmark = spark.createDataFrame(items, "item_id bigint, body string")
    out = tiling.leaks(writeups(records), benchmark).collect()
    assert sorted((str(r.entry_id), r.item_id, round(r.coverage, 9)) for r in out) == plain_leaks(items, records)


def test_leaks_equal_brute_force_in_any_blocks(spark, writeups, awkward):
    items, records = items_and_records()
    records = records[:40] + [(200 + n, t) for n, t in enumerate(awkward) if len(t or "") < 20_000]
    records += [records[1], (None, items[3][1]), (300, "it has two words, TWO words")]
    benchmark = spark.createDataFrame(items, "item_id bigint, body string")
    expected = plain_leaks(items, records)
    assert {r[0] for r in expected} > {"1", "2", "None", "300"} and not any(r[0] in ("0", "3", "4") for r in expected)
    for block in (1 << 20, 300):
        out = tiling.leaks(writeups(records), benchmark, block_bytes=block).collect()
        assert sorted((str(r.entry_id), r.item_id, round(r.coverage, 9)) for r in out) == expected
    kept = tiling.remove_leaks(writeups(records), benchmark, block_bytes=300)
    gone = {r[0] for r in expected}
    assert sorted(str(r.entry_id) for r in kept.collect()) == sorted(str(i) for i, _ in records if str(i) not in gone)
    assert kept.columns == writeups(records).columns


def test_empty_sides(spark, writeups):
    none = spark.createDataFrame([], "item_id bigint, body string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, body string")
    assert tiling.leaks(writeups([(1, "a b c d e f")]), none).count() == 0
    assert tiling.leaks(writeups([]), some).count() == 0
    assert tiling.remove_leaks(writeups([(1, "a")]), none).count() == 1
    assert tiling.leaks(writeups([("S6E9-01", "x A b c d E f y")], "string"), some).first().coverage == 1.0


def test_very_long_text_is_read_to_its_end(spark, writeups):
    some = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30)))], "item_id bigint, body string")
    text = "filler words " * 60_000 + " ".join(f"q{i}" for i in range(30))
    assert tiling.leaks(writeups([(1, text)]), some).count() == 1

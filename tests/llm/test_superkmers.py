import random

from foldwise.llm import superkmers


def plain(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((str(i), len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return sorted(out)


def repeating(seed, n=120, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [" ".join(rng.choices(words, k=rng.randint(10, 40))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages))
        texts.append("\n".join(parts))
    return texts + texts[:10]


def run(writeups, rows, **options):
    out = superkmers.remove_repeats(writeups(rows), **options).collect()
    return sorted((str(r.entry_id), r.n_words, r.n_removed, r.kept) for r in out)


def test_equal_to_all_windows(writeups):
    rows = list(enumerate(repeating(1)))
    random.Random(3).shuffle(rows)
    assert run(writeups, rows) == plain(rows, 13)
    few = list(enumerate(repeating(2, 60, 3)))
    assert run(writeups, few, window=6, mer=2) == plain(few, 6)


def test_full_buckets_are_dealt_out_by_window(writeups):
    rows = list(enumerate(repeating(4, 60, 4)))
    assert run(writeups, rows, window=5, mer=2, bucket_bytes=100) == plain(rows, 5)


def test_small_blocks_settle_less_but_agree(writeups, monkeypatch):
    monkeypatch.setattr(superkmers, "LOCAL_BYTES", 200)
    rows = list(enumerate(repeating(5)))
    assert run(writeups, rows) == plain(rows, 13)


def test_awkward_rows(writeups, awkward):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [*enumerate(awkward), (40, passage), (40, passage), (40, passage + " more"), (41, passage), (None, passage), (None, None)]
    rows.append((20, "lorem ipsum " * 10))
    found = run(writeups, rows)
    assert found == plain(rows, 13)
    assert sum(r[2] == 20 for r in found) == 1 + 1  # row 41, and the late copy of the lorem text
    assert run(writeups, []) == []
    names = [("S6E9-02", passage), ("S6E9-01", "intro " + passage)]
    out = superkmers.remove_repeats(writeups(names, "string")).collect()
    assert {r.entry_id: r.n_removed for r in out} == {"S6E9-01": 0, "S6E9-02": 20}


def test_windows_of_a_bucket_share_its_minimiser():
    packer = superkmers.Packer(13, 5)
    words = repeating(6)[0].encode().split() * 3
    buckets = packer.buckets(words)
    cut = packer.cut(words, buckets.view("int64"))
    assert sum(n for _, _, n, _ in cut) == len(words) - 12
    for bucket, first, n, packed in cut:
        assert packed == b" ".join(words[first : first + n + 12])
        assert set(packer.buckets(packed.split()).view("int64").tolist()) == {bucket}

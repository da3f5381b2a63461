import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from foldwise.llm import token_files
from foldwise.llm.registry import TOKENIZER

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain():
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return token_files.WordEncoder(TOKENIZER, known=50)


PIECES = [
    " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "word", "Word,", "it's", "don't.", "éclair", "naïve!", "ß", "ǆ", "漢字", "😀", "x1", "1",
    "...", "'s", "<|endoftext|>", "ª", "Ǆ.", "ſt", "-", "a.b", "“quoted”", "ɐ",
]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=12))
def test_pieces_encode_like_the_whole_text(encoder, plain, parts):
    for joint in "", " ":
        text = joint.join(parts)
        assert np.frombuffer(encoder.encode(text), encoder.type).tolist() == plain(text)


def test_awkward_texts_encode_like_the_library(encoder, plain, awkward):
    for text in awkward:
        assert np.frombuffer(encoder.encode(text or ""), encoder.type).tolist() == plain(text)


def test_round_trip_places_and_checksums(spark, writeups, awkward, plain):
    rows = [*enumerate(awkward), (3, "again"), (3, "again"), (None, "no id"), *[(100 + n, f"fold {n} auc 0.{n}") for n in range(300)]]
    out = token_files.token_round_trip(writeups(rows), TOKENIZER, length=64).collect()
    out.sort(key=lambda r: r.start)
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert len(out) == len(expected)
    start = 0
    for got, (entry_id, text) in zip(out, expected):
        ids = np.array([*plain(text), 2], "<u4")
        assert (got.entry_id, got.start, got.n_tokens) == (entry_id, start, len(ids))
        assert bytes(got.ids) == ids.tobytes() and zlib.crc32(got.ids) == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_files_give_sequences_without_copying(spark, writeups, plain, tmp_path):
    texts = [f"entry {n} " + "token files " * n for n in range(80)]
    manifest = token_files.write_token_files(writeups(list(enumerate(texts))), str(tmp_path / "out"), TOKENIZER, length=16)
    whole = [i for t in texts for i in [*plain(t), 2]]
    rows = sorted(manifest.collect(), key=lambda r: r.shard)
    assert sum(r.n_tokens for r in rows) == len(whole) and sum(r.n_entries for r in rows) == 80
    for r in rows:
        reader = token_files.open_tokens(r.path)
        stored = whole[r.start : r.start + r.n_tokens]
        n = -(-len(stored) // 16)
        for at in [n - 1, 0, n // 2]:
            ids, mask = token_files.sequence(reader, at)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            assert ids[mask].tolist() == stored[at * 16 : at * 16 + 16] and (mask.all() or at == n - 1)
        assert reader.schema.field("ids").type.list_size == 16


def test_empty_table_and_text_ids(spark, writeups):
    assert token_files.token_round_trip(writeups([]), TOKENIZER).count() == 0
    out = token_files.token_round_trip(writeups([("S6E9-02", "b"), ("S6E9-01", None)], "string"), TOKENIZER)
    assert [(r.entry_id, r.start, r.n_tokens) for r in out.orderBy("start").collect()] == [("S6E9-01", 0, 1), ("S6E9-02", 1, 2)]


def test_rows_come_in_bounded_batches(spark, writeups, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_SEQUENCES", 2)
    rows = [(n, f"w{n} " * (n % 9)) for n in range(200)]
    out = token_files.token_round_trip(writeups(rows), TOKENIZER, length=8)
    assert out.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()[0] == out.agg(
        F.max(F.col("start") + F.col("n_tokens"))
    ).first()[0]


def test_marks_and_line_breaks_around_words():
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(TOKENIZER), token_files.WordEncoder(TOKENIZER, known=40)
    rng = random.Random(6)
    parts = ["word", "Ünï", "it's", "'s", "...", "$$$", "!?", "a1", "12", "\n", "\n\n", "\t", "-", "'", "", "x\r", "漢字", " ", "é.", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n", ".\n", ", "]) for _ in range(rng.randrange(1, 9)))
        assert np.frombuffer(coder.encode(text), coder.type).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_what_a_reader_holds_does_not_grow_with_its_file(spark, writeups, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "READ_ROWS", 40)
    monkeypatch.setattr(token_files, "READ_IDS", 100)
    texts = ["long " * 300 if n % 50 == 7 else f"entry {n} " * (n % 5) for n in range(400)]
    manifest = token_files.write_token_files(writeups(list(enumerate(texts))).coalesce(1), str(tmp_path / "out"), TOKENIZER, length=16)
    found = []
    for row in sorted(manifest.collect(), key=lambda r: r.start):
        for batch in token_files.read_records(row.path, row.entries_path, row.start):
            assert batch.num_rows <= 40 and (batch.num_rows == 1 or sum(batch.column(2).to_pylist()) <= 100)
            assert batch.column(3).buffers()[2].size <= 4 * sum(batch.column(2).to_pylist()) + 64
            found += batch.to_pylist()
    start = 0
    for n, (got, text) in enumerate(zip(found, texts, strict=True)):
        ids = np.array([*plain(text), 2], "<u4")
        assert (got["entry_id"], got["start"], got["n_tokens"], got["ids"]) == (n, start, len(ids), ids.tobytes())
        start += len(ids)

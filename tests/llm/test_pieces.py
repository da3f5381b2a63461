import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings, strategies as st

from foldwise.llm import pieces, registry
from foldwise.llm.inputs import PIECES, TOKENIZER

FOLDER = "/root/testdata/sf0.001"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
CODER = pieces.PieceEncoder(PIECES)
ids_of = lambda data: np.frombuffer(data, "<i4").tolist()


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.one_of(st.text(max_size=60), st.text("ab the▁ \n=-x", max_size=80), st.text(" ▁a", max_size=60)))
def test_equal_to_the_library(text):
    found = ids_of(CODER.encode([text])[0])
    assert found == LIBRARY.encode(text)
    assert CODER.decode(found) == LIBRARY.decode(found)


@pytest.mark.parametrize("text", [" " * 20_000, "x" * 20_000, "ab" * 9_000, "=" * 17_001, "a ▁ b", "\x00", "<s></s><0x41>", "\U0001F600" * 500])
def test_long_runs(text):
    assert ids_of(CODER.encode([text])[0]) == LIBRARY.encode(text)


def test_memory_of_words_turns_over():
    small = pieces.PieceEncoder(PIECES, generation=5)
    texts = [f"word{k} other{k % 3} {k}" for k in range(60)]
    assert [ids_of(b) for k in range(0, 60, 7) for b in small.encode(texts[k : k + 7])] == [LIBRARY.encode(t) for t in texts]
    assert len(small.young) < 60


def test_rank_by_rank_merging_equals_rounds():
    """The slow way, forced for every word, gives the same symbols."""

    class Slow(pieces.PieceEncoder):
        def _unsafe(self, symbols, word, merged, best, places):
            return np.unique(word[places])

    texts = ["lorem ipsum dolor", "aaaa bbbb    aaab", "Ünïcödé ändert nichts", "\n\n\n--==--"]
    assert [ids_of(b) for b in Slow(PIECES).encode(texts)] == [LIBRARY.encode(t) for t in texts]


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.PieceEncoder(TOKENIZER)


def test_writeups(spark, writeups, awkward):
    rows = [*enumerate(awkward), (3, "again"), (3, "again"), (None, "no id")]
    out = pieces.piece_round_trip(writeups(rows), PIECES).collect()
    expected = [(i, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or "")) if t else "") for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.entry_id, r.ids, r.decoded) for r in out], key=key) == sorted(expected, key=key)
    assert pieces.piece_round_trip(writeups([]), PIECES).count() == 0


def test_query(spark):
    import duckdb

    texts = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    expected = set()
    for i, t in texts:
        ids = LIBRARY.encode(t or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.add((i, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    out = registry.op12_sentencepiece(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in out.collect()} == expected

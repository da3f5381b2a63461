"""SentencePiece BPE encoding by vectorised merge rounds over flat symbol arrays, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldwise.llm.columns import id_type, pair

SPACE = "▁"
#: Kinds of pieces in a model file: fixed values of the format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NO_RANK = np.int32(2**31 - 1)
#: Characters of new words that are merged at once, and of texts that are answered at once.
BLOCK_CHARS = 1 << 20
#: Words up to this length are remembered; a generation of the memory holds so many.
WORD_CHARS, GENERATION = 48, 200_000
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceEncoder:
    """Ids of whole texts under a SentencePiece BPE model file, equal to the library's.

    A text becomes flat arrays of symbols. No piece has a space mark after another character, so words (a run of marks and what
    follows) never share a merge. A round takes the best pair of every word at once and merges its places from the left;
    places are compacted and finished words leave, until no pair remains. Merging all places of a pair in one round is the
    library's order as long as no merge makes an equal or better pair; words where one does are merged one place at a time for
    that rank. Characters without a piece fall back to bytes. Distinct words are merged once and remembered in two generations.

    Models with another normaliser than the identity, user-defined or unused pieces, without byte fallback or not of the BPE
    kind are refused with ValueError.
    """

    def __init__(self, path: str, generation: int = GENERATION):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = not spec.precompiled_charsmap and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        if not plain or model.trainer_spec.model_type != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds:
            raise ValueError(f"{path} is no byte-fallback BPE model without normalisation")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.library = SentencePieceProcessor(model_file=path)
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            raise ValueError(f"{path} has pieces across words")
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self._tables(ids, np.array([p.score for p in model.pieces]))
        self.generation = generation
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _tables(self, ids: dict[str, int], scores: np.ndarray) -> None:
        """Sorted pair keys with merged symbol and rank; symbols from ``self.lone`` on are characters without a piece."""
        self.lone = len(scores)
        symbols = dict(ids)
        for piece in ids:
            for c in piece:
                symbols.setdefault(c, self.lone + len(symbols))
        self.width = 1 + max(symbols.values())
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = rank[self.merged].astype(np.int32)
        letters = sorted((ord(s), i) for s, i in symbols.items() if len(s) == 1)
        self.bare = {i: ord(s) for s, i in symbols.items() if i >= self.lone}
        self.points, self.of_point = np.array([p for p, _ in letters], np.uint32), np.array([i for _, i in letters], np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs of symbols; ``NO_RANK`` where there is none. Negative symbols are bare characters."""
        keys = left.astype(np.int64) * self.width + right
        keys[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], NO_RANK), np.where(hit, self.merged[at], -1)

    def _one_by_one(self, symbols: list[int], rank: int) -> list[int]:
        """Merges pairs of this rank leftmost first, until none is left or a better pair has come up."""
        index = self._index()
        look = lambda a, b: index.get(a * self.width + b, (NO_RANK, -1)) if a >= 0 and b >= 0 else (NO_RANK, -1)
        done, rest = [], symbols[::-1]
        while rest:
            now = rest.pop()
            while True:
                before = look(done[-1], now) if done else (NO_RANK, -1)
                after = look(now, rest[-1]) if rest else (NO_RANK, -1)
                if min(before[0], after[0]) < rank:
                    return [*done, now, *rest[::-1]]
                if before[0] == rank:
                    done.pop()
                    now = before[1]
                elif after[0] == rank:
                    rest.pop()
                    now = after[1]
                else:
                    break
            done.append(now)
        return done

    def _index(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_known_pairs"):
            self._known_pairs = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.merged.tolist())))
        return self._known_pairs

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers; words are not empty."""
        sizes = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.of_point[at], -1 - points.astype(np.int64))
        word = np.repeat(np.arange(len(words)), sizes)
        out: list[bytes] = [b""] * len(words)
        ranks, merged = np.full(len(symbols), NO_RANK), np.full(len(symbols), -1, np.int64)
        self._neighbours(symbols, word, ranks, merged, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            over = best == NO_RANK
            self._finish(out, symbols, word, starts[over], lengths[over])
            keep = np.repeat(~over, lengths)
            symbols, word, ranks, merged = symbols[keep], word[keep], ranks[keep], merged[keep]
            best = np.repeat(best[~over], lengths[~over])
            if not len(symbols):
                break
            found = np.flatnonzero(ranks == best)
            run = np.concatenate(([True], np.diff(found) != 1))
            offset = np.arange(len(found)) - np.maximum.accumulate(np.where(run, np.arange(len(found)), 0))
            places = found[offset % 2 == 0]
            slow = self._unsafe(symbols, word, merged, best, places)
            if len(slow):
                places = places[~np.isin(word[places], slow)]
            joined = symbols.copy()
            joined[places] = merged[places]
            stay = np.ones(len(symbols), bool)
            stay[places + 1] = False
            for w in slow.tolist():
                inside = np.flatnonzero(word == w)
                left = self._one_by_one(symbols[inside].tolist(), int(best[inside[0]]))
                joined[inside[: len(left)]] = left
                stay[inside[len(left) :]] = False
            touched = np.zeros(len(symbols), bool)
            touched[places] = touched[places - 1] = True
            for w in slow.tolist():
                touched[word == w] = True
            symbols, word, touched = joined[stay], word[stay], touched[stay]
            ranks, merged = ranks[stay], merged[stay]
            self._neighbours(symbols, word, ranks, merged, np.flatnonzero(touched))
        return out

    def _neighbours(self, symbols: np.ndarray, word: np.ndarray, ranks: np.ndarray, merged: np.ndarray, at: np.ndarray) -> None:
        """Writes rank and merged symbol of the places ``at`` and the symbols after them in the same word."""
        ranks[at] = NO_RANK
        at = at[at < len(symbols) - 1]
        at = at[word[at] == word[at + 1]]
        ranks[at], merged[at] = self._pairs(symbols[at], symbols[at + 1])

    def _unsafe(self, symbols: np.ndarray, word: np.ndarray, merged: np.ndarray, best: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Words where a merge before the last one makes a pair that would come before the next place."""
        early = np.flatnonzero(word[places[1:]] == word[places[:-1]])
        if not len(early):
            return early
        chosen = places[early]
        new, own, limit = merged[chosen], word[chosen], best[chosen]
        follows = np.minimum(chosen + 2, len(symbols) - 1)
        after = self._pairs(new, np.where((chosen + 2 < len(symbols)) & (word[follows] == own), symbols[follows], -1))[0]
        joined = symbols.copy()
        joined[places] = merged[places]
        joined[places + 1] = merged[places]
        ahead = np.maximum(chosen - 1, 0)
        before = self._pairs(np.where((chosen > 0) & (word[ahead] == own), joined[ahead], -1), new)[0]
        return np.unique(own[np.minimum(before, after) <= limit])

    def _finish(self, out: list[bytes], symbols: np.ndarray, word: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Writes the ids of finished words: pieces as they are, characters without a piece as bytes."""
        if not len(starts):
            return
        data = symbols.astype("<i4").tobytes()
        bare = np.concatenate(([0], np.cumsum((symbols < 0) | (symbols >= self.lone))))
        bare = bare[starts + lengths] - bare[starts]
        for w, a, n, odd in zip(word[starts].tolist(), starts.tolist(), lengths.tolist(), bare.tolist()):
            out[w] = self._with_bytes(symbols[a : a + n].tolist()) if odd else data[4 * a : 4 * (a + n)]

    def _with_bytes(self, symbols: list[int]) -> bytes:
        ids: list[int] = []
        for s in symbols:
            ids += [s] if 0 <= s < self.lone else [self.bytes[b] for b in chr(-1 - s if s < 0 else self.bare[s]).encode()]
        return np.array(ids, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [_WORD.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        found: dict[str, bytes] = {}
        new: list[str] = []
        for words in split:
            for w in words:
                if w not in found:
                    ids = self.young.get(w) or self.old.get(w)
                    if ids is None:
                        new.append(w)
                    found[w] = ids
        at = 0
        while at < len(new):
            stop, size = at, 0
            while stop < len(new) and (stop == at or size + len(new[stop]) <= BLOCK_CHARS):
                size += len(new[stop])
                stop += 1
            found.update(zip(new[at:stop], self.merge_words(new[at:stop])))
            at = stop
        if len(self.young) + len(found) > self.generation:
            self.old, self.young = self.young, {}
        self.young.update((w, ids) for w, ids in found.items() if len(w) <= WORD_CHARS)
        get = found.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


#: One encoder per worker process and model file, so its memory of words outlives a task.
ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = PieceEncoder(path)
    return ENCODERS[path]


def text_blocks(texts: pa.Array, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """``(start, texts)`` slices of a column of about so many characters each, NULL as empty."""
    start, held, size = 0, [], 0
    for value in texts:
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= chars:
            yield start, held
            start, held, size = start + len(held), [], 0
    if held:
        yield start, held


def piece_round_trip(records: DataFrame, model: str, id: str = "entry_id", body: str = "body") -> DataFrame:
    """``(entry_id, ids, decoded)``: ids of every whole writeup under the BPE model file ``model``, without begin or end ids, and
    what they decode to.

    A map over the rows: nothing is shuffled, a row stays with its id, rows that share one stay apart. A NULL or empty text has
    no ids and decodes to an empty one; further columns are ignored; no rows give no rows. Tasks answer blocks of about
    ``BLOCK_CHARS`` characters, a longer text alone.
    """
    source = pair(records, id, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            for start, texts in text_blocks(batch.column(1)):
                found = [np.frombuffer(b, "<i4") for b in coder.encode(texts)]
                ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                decoded = pa.array([coder.decode(f.tolist()) for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), ids, decoded], ["entry_id", "ids", "decoded"])

    return source.mapInArrow(run, f"entry_id {id_type(source)}, ids array<int>, decoded string")

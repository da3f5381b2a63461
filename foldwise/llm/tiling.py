"""Benchmark passages in records, found by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldwise.llm.columns import id_type, pair, quoted

#: A-Z becomes a-z; other ASCII bytes that are neither letter nor digit become spaces.
TOKENS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
BASE = 1_000_003
MASK = (1 << 64) - 1


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TOKENS).split()


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all runs of ``length`` values."""
    count = len(values) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(length):
        out = out * np.uint64(BASE) + values[j : j + count].astype(np.uint64)
    return out


def _free_runs(marked: list[bool], length: int) -> Iterator[int]:
    run = 0
    for at, taken in enumerate(marked):
        run = 0 if taken else run + 1
        if run >= length:
            yield at - length + 1


def _hashes(values: list[int], marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """``(start, hash)`` of every unmarked run; the hash rolls from one start to the next."""
    top = pow(BASE, length - 1, 1 << 64)
    last, h = None, 0
    for at in _free_runs(marked, length):
        if last is not None and at == last + 1:
            h = ((h - values[last] * top) * BASE + values[at + length - 1]) & MASK
        else:
            h = 0
            for v in values[at : at + length]:
                h = (h * BASE + v) & MASK
        last = at
        yield at, h


def tile(item: list[int], text: list[int], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(item start, text start, length)``: again and again the longest unmarked common runs, down to
    ``shortest`` tokens; neither side is covered twice.

    Running Karp-Rabin: scan at a search length, mark the longest matches found, scan again; without a match the length is
    halved, at last to ``shortest``. Ties go to the earlier place in the item, then in the text.
    """
    marked_item, marked_text = [False] * len(item), [False] * len(text)
    tiles, length = [], max(shortest, min(len(item), len(text)))
    while not all(marked_item):
        table = defaultdict(list)
        for at, h in _hashes(text, marked_text, length):
            table[h].append(at)
        matches = []
        for a, h in _hashes(item, marked_item, length):
            for b in table.get(h, ()):
                k = 0
                while (
                    a + k < len(item) and b + k < len(text) and item[a + k] == text[b + k]
                    and not marked_item[a + k] and not marked_text[b + k]
                ):
                    k += 1
                if k >= length:
                    matches.append((k, a, b))
        if not matches:
            if length == shortest:
                break
            length = max(shortest, length // 2)
            continue
        longest = max(matches)[0]
        for k, a, b in matches:
            if k == longest and not any(marked_item[a : a + k]) and not any(marked_text[b : b + k]):
                marked_item[a : a + k] = marked_text[b : b + k] = [True] * k
                tiles.append((a, b, k))
    return tiles


class Bench:
    """A block of benchmark items: token numbers, and the items and places of every run of ``shortest`` tokens (of a shorter item:
    of the whole item). A tile consists of such runs, so they are all that a text has to be searched for."""

    def __init__(self, items: list[tuple[object, bytes]], shortest: int):
        self.shortest, self.numbers = shortest, {}
        self.ids, self.runs = [], []
        rows = [(i, tokens(text)) for i, text in items]
        for i, words in rows:
            if words:
                self.ids.append(i)
                self.runs.append([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words])
        self.lengths = np.array([len(r) for r in self.runs], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        seeds = defaultdict(list)
        for n, run in enumerate(self.runs):
            size = min(shortest, len(run))
            hashes = rolling(np.array(run, np.uint64), size)
            seeds[size].append((hashes, np.arange(len(hashes)) + self.first[n]))
        self.tables = {}
        for size, parts in sorted(seeds.items()):
            hashes, places = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            found, starts = np.unique(hashes[order], return_index=True)
            self.tables[size] = found, np.append(starts, len(order)), places[order]

    def candidates(self, numbers: np.ndarray, threshold: float) -> dict[int, np.ndarray]:
        """Items whose tokens lie in runs of the text to at least ``threshold``, and a mask of the text's places in such a run.

        No tile can hold another token of the item, so the share is an upper bound of the coverage and nothing is lost.
        """
        shared, met = [], {}
        for size, (hashes, starts, places) in self.tables.items():
            rolled = rolling(numbers, size)
            if not len(rolled):
                continue
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            where = np.flatnonzero(hashes[at] == rolled)
            met[size] = where, at[where]
            shared += [(size, places[starts[s] : starts[s + 1]]) for s in np.unique(at[where]).tolist()]
        if not shared:
            return {}
        item_places = np.concatenate([(p[:, None] + np.arange(size)).ravel() for size, p in shared])
        touched = np.unique(item_places)
        share = np.bincount(np.searchsorted(self.first, touched, "right") - 1, minlength=len(self.runs))
        chosen = np.flatnonzero(share >= threshold * self.lengths - 1e-9)
        out = {}
        for n in chosen.tolist():
            mask = np.zeros(len(numbers), bool)
            size = min(self.shortest, int(self.lengths[n]))
            hashes = self.tables[size][0]
            own = np.unique(np.searchsorted(hashes, rolling(np.array(self.runs[n], np.uint64), size)))
            where, seeds = met[size]
            own_starts = where[np.isin(seeds, own)]
            for k in range(size):
                mask[own_starts + k] = True
            out[n] = mask
        return out

    def covered(self, text: bytes | None, threshold: float) -> Iterator[tuple[object, float, int]]:
        """``(item id, coverage, tiles)`` of the items that a text covers to at least ``threshold``."""
        get = self.numbers.get
        numbers = np.array([get(w, 0) for w in tokens(text)], np.uint64)
        for n, mask in self.candidates(numbers, threshold).items():
            item = self.runs[n]
            tiles = tile(item, _within(numbers, mask), min(self.shortest, len(item)))
            coverage = sum(k for _, _, k in tiles) / len(item)
            if coverage >= threshold:
                yield self.ids[n], coverage, len(tiles)


def _within(numbers: np.ndarray, mask: np.ndarray) -> list[int]:
    """The masked places in order; every gap between them becomes one token that matches nothing."""
    kept = np.where(mask, numbers, 0)
    first = mask | np.concatenate(([False], mask[:-1]))
    return kept[first].tolist()


#: Bytes of benchmark text that one pass over the records carries to every task.
BLOCK_BYTES = 16 << 20


def item_blocks(benchmark: DataFrame, id: str, body: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark in id order, in blocks of bounded size; the driver never holds more than one."""
    rows = benchmark.select(quoted(id).alias("item_id"), quoted(body).cast("binary").alias("body"))
    rows = rows.filter(F.col("item_id").isNotNull() & F.col("body").isNotNull()).orderBy("item_id", "body")
    block, size = [], 0
    for item_id, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, bytes(text)))
        size += len(text)
    if block:
        yield block


def leaks(
    records: DataFrame,
    benchmark: DataFrame,
    id: str = "entry_id",
    body: str = "body",
    item_id: str = "item_id",
    item_body: str = "body",
    shortest: int = 3,
    threshold: float = 0.8,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(entry_id, item_id, coverage, n_tiles, contaminated)``: each record and benchmark item whose tiles cover at least
    ``threshold`` of the item's tokens.

    ``records`` are parsed writeup entries or any rows with an id and a text. Tokens are runs of letters and digits,
    lower-cased in ASCII. Tiles of at least ``shortest`` tokens (shorter items: their whole run) are laid greedily over the whole text,
    so moved sentences and phrases count wherever they stand. An item is left out before that only if the runs of ``shortest``
    tokens that it shares with the text hold less than ``threshold`` of it, which no tiling can exceed. The benchmark is a stated query set: it goes to the tasks in blocks of at most ``block_bytes``, one pass over the records each, and texts
    are never shuffled. NULL or wordless texts and items match nothing; repeated rows and ids each give their own rows (of
    items that share an id, each one).
    """
    source = pair(records, id, body).withColumn("body", F.col("body").cast("binary"))
    item_ids = benchmark.select(quoted(item_id).alias("item_id"))
    item_type = to_arrow_schema(item_ids.schema).field(0).type
    schema = f"entry_id {id_type(source)}, item_id {id_type(item_ids, 'item_id')}, coverage double, n_tiles int, contaminated boolean"

    def against(block: list[tuple]) -> DataFrame:
        shipped = source.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Bench(shipped.value, shortest)
            for batch in batches:
                rows = [
                    (at, *found)
                    for at, text in enumerate(batch.column(1).to_pylist())
                    for found in bench.covered(text, threshold)
                ]
                columns = list(zip(*rows)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], item_type),
                        pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()),
                        pa.array([True] * len(rows), pa.bool_()),
                    ],
                    ["entry_id", "item_id", "coverage", "n_tiles", "contaminated"],
                )

        return source.mapInArrow(run, schema)

    found = [against(block) for block in item_blocks(benchmark, item_id, item_body, block_bytes)]
    out = found[0] if found else source.sparkSession.createDataFrame([], schema)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_leaks(
    records: DataFrame, benchmark: DataFrame, body: str = "body", item_id: str = "item_id", item_body: str = "body",
    shortest: int = 3, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``records``, all columns, without those that ``leaks`` reports; nothing is shuffled."""
    at, out = records.columns.index(body), records

    def without(rows: DataFrame, block: list[tuple]) -> DataFrame:
        shipped = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Bench(shipped.value, shortest)
            for batch in batches:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                clean = [next(bench.covered(t, threshold), None) is None for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    for block in item_blocks(benchmark, item_id, item_body, block_bytes):
        out = without(out, block)
    return out

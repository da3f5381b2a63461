"""Passages repeated across records, found by super-k-mer partitioning of word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldwise.llm.columns import id_type, pair

#: Text bytes whose packed strings are compared in the mapper before they travel.
LOCAL_BYTES = 8 << 20
#: Bytes of distinct packed strings that one bucket may hold in memory; the windows of a fuller bucket travel singly.
BUCKET_BYTES = 32 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def minimisers(hashes: np.ndarray, window: int, mer: int) -> np.ndarray:
    """Per window of ``window`` words the smallest mixed hash of its ``mer``-word runs."""
    n = len(hashes) - mer + 1
    runs = hashes[:n].copy()
    for j in range(1, mer):
        runs = _mix(runs) + hashes[j : j + n]
    runs = _mix(runs)
    count = len(hashes) - window + 1
    low = runs[:count].copy()
    for j in range(1, window - mer + 1):
        np.minimum(low, runs[j : j + count], out=low)
    return low


class Packer:
    """Cuts a text into super-k-mers: runs of windows with one minimiser, each as one packed string."""

    def __init__(self, window: int, mer: int, cache: int = 200_000):
        self.window, self.mer, self.cache = window, mer, cache
        self.known: dict[bytes, int] = {}

    def buckets(self, words: list[bytes]) -> np.ndarray:
        """The bucket of every window."""
        if len(words) < self.window:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.cache:
            known.clear()
        known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(known))
        return minimisers(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), self.window, self.mer)

    def cut(self, words: list[bytes], wanted: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        """``(bucket, first window, windows, packed words)`` in text order, of the wanted buckets."""
        buckets = self.buckets(words).view(np.int64)
        if not len(buckets):
            return []
        starts = np.concatenate(([0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1))
        stops = np.append(starts[1:], len(buckets))
        chosen = np.isin(buckets[starts], wanted)
        starts, stops = starts[chosen], stops[chosen]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        joined = b" ".join(words)
        spans = zip(
            buckets[starts].tolist(), starts.tolist(), (stops - starts).tolist(),
            begins[starts].tolist(), ends[stops + self.window - 2].tolist(),
        )
        return [(bucket, first, n, joined[a:b]) for bucket, first, n, a, b in spans]


def shared_runs(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs ordered by key: the first position of each run of equal keys, and whether a run holds two different rows."""
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return starts, np.minimum.reduceat(rows, starts) != np.maximum.reduceat(rows, starts)


def _windows(packed: bytes, window: int) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


class Bucket:
    """One bucket: sorts the windows of its distinct packed strings and reports what an earlier record holds."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self._clear(None)

    def _clear(self, key: object) -> None:
        self.key, self.packed, self.first, self.held, self.bytes, self.alone = key, None, None, [], 0, False

    def add(self, key: int, packed: bytes, owner: object, row: int, first: int, n: int) -> Iterator[tuple]:
        """Rows arrive ordered by bucket, packed string and owner."""
        if key != self.key:
            yield from self.close()
            self._clear(key)
        if packed != self.packed:
            self.packed, self.first = packed, owner
            self.bytes += len(packed)
        elif owner != self.first:
            yield owner, row, first, first + n - 1 + self.window, None
            return
        if not self.alone and self.bytes > self.limit:
            for held in self.held:
                yield from self._singly(*held)
            self.held, self.alone = [], True
        if self.alone:
            yield from self._singly(packed, owner, row, first)
        else:
            self.held.append((packed, owner, row, first))

    def _singly(self, packed: bytes, owner: object, row: int, first: int) -> Iterator[tuple]:
        for i, w in enumerate(_windows(packed, self.window)):
            yield owner, row, first + i, first + i + self.window, w

    def close(self) -> Iterator[tuple]:
        if len(self.held) < 2 or all(h[1] == self.held[0][1] for h in self.held):
            return
        windows = sorted(
            (w, owner, row, first + i)
            for packed, owner, row, first in self.held
            for i, w in enumerate(_windows(packed, self.window))
        )
        seen, earliest, later = None, None, []
        for w, owner, row, at in windows:
            if w != seen:
                seen, earliest = w, owner
            elif owner != earliest:
                later.append((owner, row, at))
        later.sort()
        start, last = 0, None
        for owner, row, at in later:
            if last != (owner, row, at - 1):
                if last:
                    yield *last[:2], start, last[2] + self.window, None
                start = at
            last = (owner, row, at)
        if last:
            yield *last[:2], start, last[2] + self.window, None


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _frame(held, schema)
            held = []
    yield _frame(held, schema)


def _arrow(kind: DataFrame, *fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([to_arrow_schema(kind.select("entry_id").schema).field(0), *[pa.field(n, t) for n, t in fields]])


def shared_buckets(texts: DataFrame, window: int, mer: int) -> DataFrame:
    """``(row, buckets array)``: of each row of ``(row, entry_id, body)`` the buckets that another row also has.

    Only numbers travel. A mapper block settles what its own rows share and sends each bucket on once.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, mer)

        def block(found: list[np.ndarray], rows: list[int]) -> pa.RecordBatch:
            keys = np.concatenate([*found, np.zeros(0, np.int64)])
            owner = np.repeat(np.array(rows, np.int64), [len(f) for f in found])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            if len(keys):
                starts, shared = shared_runs(keys, owner)
                every = np.repeat(shared, np.diff(np.append(starts, len(keys))))
                settled = np.concatenate([np.ones(every.sum(), bool), np.zeros(len(starts), bool)])
                keys = np.concatenate([keys[every], keys[starts]])
                owner = np.concatenate([owner[every], owner[starts]])
            else:
                settled = np.zeros(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owner), pa.array(settled)], ["bucket", "row", "settled"])

        for batch in batches:
            found, rows, size = [], [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                found.append(np.unique(packer.buckets(text.split())).view(np.int64))
                rows.append(row)
                size += len(text)
                if size > LOCAL_BYTES:
                    yield block(found, rows)
                    found, rows, size = [], [], 0
            yield block(found, rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            if len(keys):
                starts, shared = shared_runs(keys, rows)
                every = np.repeat(shared, np.diff(np.append(starts, len(keys))))
                keys, rows = keys[every], rows[every]
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(keys)], ["row", "bucket"])

        for batch in batches:
            new_keys, new_rows, settled = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            settled = settled.astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(new_rows[settled]), pa.array(new_keys[settled])], ["row", "bucket"])
            keys = np.concatenate([keys, new_keys[~settled]])
            rows = np.concatenate([rows, new_rows[~settled]])
            if len(keys):
                open_from = int(np.searchsorted(keys, keys[-1]))
                yield out(keys[:open_from], rows[:open_from])
                keys, rows = keys[open_from:], rows[open_from:]
        yield out(keys, rows)

    spread_out = texts.mapInArrow(spread, "bucket bigint, row bigint, settled boolean")
    met = spread_out.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "row bigint, bucket bigint")
    return met.groupBy("row").agg(F.collect_set("bucket").alias("buckets"))


def repeated_spans(texts: DataFrame, window: int = 13, mer: int = 4, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(row, entry_id, start, stop)``: word spans covered by a window that also starts in a record with a smaller id.

    ``texts`` has ``(row, entry_id, body)``: a number that tells rows of one id apart, the id, and the text in UTF-8. A window can
    only repeat inside a bucket that two rows share, so the super-k-mers of those buckets alone are packed and sent. Of
    equal packed strings a mapper block sends the one of the smallest id and reports the others itself: a passage held by
    a third of all records arrives once per block. A task reads its buckets one after another in order (bucket, string,
    id), and sorts the windows of the distinct strings, never expanding copies. The windows of a bucket with more than
    ``bucket_bytes`` of distinct strings (a frequent word run) are dealt out again, each by its whole text.
    """
    kind = id_type(texts)
    sent = (("row", pa.int64()), ("bucket", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("packed", pa.binary()))
    spans = (("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("piece", pa.binary()))
    sent_schema, span_schema = _arrow(texts, *sent), _arrow(texts, *spans)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, mer)

        def rows(block: list[tuple]) -> Iterator[tuple]:
            smallest: dict[bytes, object] = {}
            for owner, _, cut in block:
                for _, _, _, packed in cut:
                    if smallest.setdefault(packed, owner) > owner:
                        smallest[packed] = owner
            for owner, row, cut in block:
                for bucket, first, n, packed in cut:
                    yield owner, row, bucket, first, n, packed if smallest[packed] == owner else None

        for batch in batches:
            block, size = [], 0
            for row, owner, text, buckets in zip(*(c.to_pylist() for c in batch.columns)):
                block.append((owner, row, packer.cut(text.split(), np.array(buckets, np.int64))))
                size += len(text)
                if size > LOCAL_BYTES:
                    yield from _batched(rows(block), sent_schema)
                    block, size = [], 0
            yield from _batched(rows(block), sent_schema)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            bucket = Bucket(window, bucket_bytes)
            for batch in batches:
                for owner, row, key, first, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                    if packed is None:
                        yield owner, row, first, first + n - 1 + window, None
                    else:
                        yield from bucket.add(key, packed, owner, row, first, n)
            yield from bucket.close()

        yield from _batched(rows(), span_schema)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            seen, earliest = None, None
            for batch in batches:
                for owner, row, start, stop, piece in zip(*(c.to_pylist() for c in batch.columns)):
                    if piece is None:
                        yield owner, row, start, stop
                    elif piece != seen:
                        seen, earliest = piece, owner
                    elif owner != earliest:
                        yield owner, row, start, stop

        yield from _batched(rows(), pa.schema(list(span_schema)[:4]))

    known = texts.join(shared_buckets(texts, window, mer), "row").select("row", "entry_id", "body", "buckets")
    packed = known.mapInArrow(pack, f"entry_id {kind}, row bigint, bucket bigint, first int, n int, packed binary")
    # What a mapper has settled needs no meeting place.
    place = F.when(F.col("packed").isNull(), F.xxhash64("row", "first")).otherwise(F.col("bucket"))
    dealt = packed.withColumn("bucket", place).repartition("bucket").sortWithinPartitions("bucket", "packed", "entry_id")
    found = dealt.mapInArrow(sort, f"entry_id {kind}, row bigint, start int, stop int, piece binary")
    place = F.when(F.col("piece").isNull(), F.xxhash64("row", "start")).otherwise(F.xxhash64("piece"))
    again = found.repartition(place).sortWithinPartitions("piece", "entry_id")
    return again.mapInArrow(single, f"entry_id {kind}, row bigint, start int, stop int")


def remove_repeats(
    records: DataFrame, id: str = "entry_id", body: str = "body", window: int = 13, mer: int = 4,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``(entry_id, n_words, n_removed, kept)``: each record's text without the words of ``repeated_spans``, the rest joined by
    single spaces.

    ``records`` are parsed writeup entries or any rows with an id and a text. Words are runs without ASCII white space.
    Windows are judged on the texts as given. A NULL text has no words and an empty ``kept``; repeated rows each get a row,
    and rows that share an id never remove from each other; a NULL id neither loses words nor counts as earlier.
    """
    if not 0 < mer <= window:
        raise ValueError("mer must be between 1 and window")
    source = pair(records, id, body).filter(F.col("entry_id").isNotNull() & F.col("body").isNotNull())
    texts = source.select(F.xxhash64("entry_id", "body").alias("row"), "entry_id", F.col("body").cast("binary").alias("body"))
    kind = id_type(texts)
    spans = repeated_spans(texts, window, mer, bucket_bytes)
    cuts = spans.groupBy("row").agg(F.collect_set(F.struct("entry_id", "start", "stop")).alias("cuts"))
    # The same exchange of the texts serves this join and the one inside repeated_spans.
    joined = texts.join(cuts, "row", "left").select("entry_id", "body", "cuts.entry_id", "cuts.start", "cuts.stop")
    joined = joined.toDF("entry_id", "body", "owners", "starts", "stops")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for id, text, owners, starts, stops in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or b"").split()
                totals.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    own = [o == id for o in owners]
                    np.add.at(edge, np.array(starts)[own], 1)
                    np.add.at(edge, np.array(stops)[own], -1)
                    words = [w for w, c in zip(words, np.cumsum(edge).tolist()) if not c]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["entry_id", "n_words", "n_removed", "kept"],
            )

    schema = f"entry_id {kind}, n_words bigint, n_removed bigint, kept string"
    empty = pair(records, id, body).filter(F.col("entry_id").isNull() | F.col("body").isNull())
    whole = empty.select("entry_id", F.col("body").cast("binary").alias("body"), *[
        F.lit(None).cast(t).alias(n) for n, t in (("owners", f"array<{kind}>"), ("starts", "array<int>"), ("stops", "array<int>"))
    ])
    return joined.mapInArrow(strip, schema).unionByName(whole.mapInArrow(strip, schema))

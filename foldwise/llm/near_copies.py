"""Near copies by exact similarity of shingle sets; linked SimHash fingerprints and MinHash bands propose what is compared."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.kernels.store import materialize
from foldwise.llm.columns import id_type, pair
from foldwise.llm.components import connected_components
from foldwise.llm.simhash import fingerprint, fingerprint_links

SEED = 42
#: Two sets of similarity s share a band with probability 1 - (1 - s^4)^24: all but 3 in a million pairs at 0.8.
BANDS, DEPTH, KEY = 24, 4, 8
_RANDOM = np.random.default_rng(SEED)
FLIPS = _RANDOM.integers(0, 1 << 64, (BANDS * DEPTH, 1), np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, (BANDS * DEPTH, 1), np.uint64) | np.uint64(1)
#: Shingles that meet all hash functions at once: bounds the memory of one very long text.
CHUNK = 2048
#: Whole texts that travel to a worker at once.
BATCH_ROWS = 500
#: Sets compared in one task; a fuller group is compared band by band, a fuller band piece by piece.
GROUP_SIZE = 512


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of the distinct ``width``-word shingles, ascending; words and A-Z as in ``simhash.fingerprint``.

    A shorter text is one shingle; a text without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, size = xxhash.xxh64_intdigest, min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def set_name(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the set: copies meet under one name before any comparison."""
    return xxhash.xxh128_digest(shingles.tobytes(), SEED)


def bands(shingles: np.ndarray) -> bytes:
    """One key of ``KEY`` bytes per band of MinHash values, joined; none for the empty set."""
    if not len(shingles):
        return b""
    least = np.full(BANDS * DEPTH, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, ((shingles[at : at + CHUNK] ^ FLIPS) * FACTORS).min(axis=1), out=least)
    return b"".join([xxhash.xxh64_digest(least[DEPTH * i : DEPTH * (i + 1)].tobytes(), i) for i in range(BANDS)])


def similar_links(sets: list[np.ndarray], sides: list[int], share: tuple[int, int] = (4, 5)) -> list[tuple[int, int]]:
    """Places of sets whose Jaccard similarity is at least ``share``: enough links to connect all such pairs.

    Every pair of side 0 is compared; sets of side 1 meet those of side 2 only.
    """
    sizes = np.array([len(s) for s in sets])
    if not len(sets) or not sizes.all():
        raise ValueError("empty sets have no similarity")
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    side, place, parent = np.array(sides), np.arange(len(sets)), list(range(len(sets)))
    held, links = np.zeros(codes.max() + 1, bool), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
        if side[i] == 2:
            continue
        held[codes[start : start + size]] = True
        common = np.add.reduceat(held[codes], starts, dtype=np.int64)
        held[codes[start : start + size]] = False
        close = (share[0] + share[1]) * common >= share[0] * (sizes + size)
        close &= (side == 2) if side[i] == 1 else (side == 0) & (place > i)
        for j in np.flatnonzero(close).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((i, j))
    return links


def _linked(shards: DataFrame, group_size: int) -> DataFrame:
    """``(a, b)``: verified links inside each shard of ``(shard, node, shingles)``."""
    full = shards.groupBy("shard").count().filter(F.col("count") > group_size)
    full = materialize(full.select("shard", F.ceil(F.col("count") / group_size).cast("int").alias("pieces")))
    cut = shards.join(full, "shard", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("pieces")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    dealt = cut.select(F.xxhash64("shard", low, high).alias("tree"), side.alias("side"), "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def links() -> pa.RecordBatch:
            found = similar_links([np.frombuffer(s, np.uint64) for _, _, s in held], [k for k, _, _ in held]) if len(held) > 1 else []
            ends = [[held[pair[k]][1] for pair in found] for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(e, pa.binary()) for e in ends], ["a", "b"])

        for batch in batches:
            for tree, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if tree != last:
                    yield links()
                    last, held = tree, []
                held.append(row)
        yield links()

    return dealt.repartition("tree").sortWithinPartitions("tree").mapInArrow(run, "a binary, b binary")


def fingerprint_groups(nodes: DataFrame) -> DataFrame:
    """``(band, node, text_key)``: nodes whose SimHash fingerprints are linked, through BK-trees as in ``simhash``, meet in one band."""
    linked = connected_components(fingerprint_links(nodes.select("fingerprint").distinct()), "a", "b")
    groups = materialize(linked.select(F.col("node").alias("fingerprint"), "component"))
    named = nodes.join(groups, "fingerprint", "left")
    group = F.xxhash64(F.coalesce("component", "fingerprint"), F.lit(BANDS))
    return named.select(F.concat(F.lit(b"f"), F.unhex(F.lpad(F.hex(group), 16, "0"))).alias("band"), "node", "text_key")


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Batches of so many rows for the jobs run inside: whole texts make the usual 10,000 rows large on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_copies(records: DataFrame, id: str, body: str, width: int = 5, group_size: int = GROUP_SIZE) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)`` of writeups, or of any texts with an id: ``(entry_id, text_key, node)`` per record, and
    ``(node, component)`` of the linked sets.

    ``node`` names the set of the ``width``-word shingles of a text. Two sets are linked if their Jaccard similarity is at
    least 0.8, counted on the sets themselves; ``component`` is the smallest node reachable through links, and a set without
    links is in no row of ``groups``. Sets are proposed by two sketches: fingerprints of four-word shingles that BK-trees link at 4 or
    fewer differing bits (one more band), and MinHash bands, which also reach pairs whose fingerprints are farther apart. Sets are
    compared if a chain of shared bands connects them and that chain has at most ``group_size`` sets, else if they share a band.
    So a pair is missed only if its fingerprints are not linked and all ``BANDS`` MinHash bands differ. Texts travel
    only for sets that share a band; equal sets are one row before any band is dealt out. ``text_key`` is ``xxhash64`` of the
    text, an empty one for NULL. NULL and blank texts share the empty set; no rows give no rows.
    """
    key = F.xxhash64(F.coalesce("body", F.lit("")))
    source = pair(records, id, body).withColumn("text_key", key)
    spark = records.sparkSession

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys, prints = [], [], np.empty(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                shingles = shingle_set(text.as_py(), width)
                names.append(set_name(shingles))
                keys.append(bands(shingles))
                prints[i] = fingerprint(text.as_py())
            columns = [pa.array(names, pa.binary()), pa.array(keys, pa.binary()), pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["entry_id", "text_key", "node", "bands", "fingerprint"])

    with small_batches(spark):
        rows = materialize(source.mapInArrow(sketch, f"entry_id {id_type(source)}, text_key bigint, node binary, bands binary, fingerprint bigint"))
    first = [F.first("bands").alias("bands"), F.min("fingerprint").alias("fingerprint")]
    nodes = rows.groupBy("node").agg(F.min("text_key").alias("text_key"), *first)
    nodes = materialize(nodes.filter(F.length("bands") > 0))
    places = F.array(*[F.substring("bands", 1 + KEY * i, KEY) for i in range(BANDS)])
    in_band = nodes.select(F.explode(places).alias("band"), "node", "text_key").unionByName(fingerprint_groups(nodes))
    name = F.xxhash64("node")
    shared = in_band.groupBy("band").agg(F.min(name).alias("low"), F.max(name).alias("high"))
    shared = materialize(shared.filter(F.col("low") < F.col("high")).select("band"))
    members = materialize(in_band.join(shared, "band"))
    heads = members.groupBy("band").agg(F.min("node").alias("head"))
    chains = materialize(connected_components(members.join(heads, "band"), "node", "head"))
    small = chains.groupBy("component").count().filter(F.col("count") <= group_size).select("component")
    small = materialize(chains.join(small, "component").select("node", F.xxhash64("component", F.lit(1)).alias("chain")))
    shards = members.join(small, "node", "left").select(F.coalesce("chain", F.xxhash64("band", F.lit(2))).alias("shard"), "node").distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            columns = [pa.array([set_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    wanted = materialize(members.groupBy("node").agg(F.min("text_key").alias("text_key")).select("text_key").distinct())
    sets = source.join(wanted, "text_key", "left_semi").select("body").mapInArrow(whole, "node binary, shingles binary")
    with small_batches(spark):
        sets = materialize(sets.dropDuplicates(["node"]))
    links = _linked(materialize(shards).join(sets, "node"), group_size)
    return rows.select("entry_id", "text_key", "node"), connected_components(links, "a", "b")

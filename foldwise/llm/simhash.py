"""Near-duplicate records by SimHash fingerprints, linked through BK-trees per shard."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from foldwise.kernels.scan import join_on
from foldwise.kernels.store import materialize
from foldwise.llm.columns import id_type, pair
from foldwise.llm.components import connected_components

SEED = 42
#: Shingles whose bits are added up at once: bounds the memory of one very long text.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the ``width``-word shingles of a text, A-Z lower-cased; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])]
        octets = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(starts)).tobytes(), "big")


def fingerprints(records: DataFrame, id: str = "entry_id", body: str = "body", width: int = 4) -> DataFrame:
    """``(entry_id, fingerprint)``, the 64 bits as a signed bigint, one row per record."""
    source = pair(records, id, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["entry_id", "fingerprint"])

    return source.mapInArrow(run, f"entry_id {id_type(source)}, fingerprint bigint")


class BKTree:
    """Burkhard-Keller tree of 64-bit values: a child hangs on its parent by their integer Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        while new:
            distance = (self.values[at] ^ value).bit_count()
            if distance == 0:
                return
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = new
                break
            at = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most ``radius`` bits away; only edges that can lead there are followed."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            if children:
                open_nodes += [below for edge, below in children.items() if -radius <= edge - distance <= radius]
        return found


def spanning_links(nodes: list[int], probes: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius: among ``nodes``, or between ``probes`` and ``nodes``.

    Only links that join two groups not yet joined are kept, so a dense group of n gives n - 1 of them.
    """
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for group, grows in ((nodes, True), (probes or [], False)):
        for value in group:
            if probes is None or not grows:
                for at in tree.within(value, radius):
                    a, b = root(value), root(tree.values[at])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        links.append((value, tree.values[at]))
            if grows:
                tree.add(value)
    return links


def block_masks(blocks: int, equal: int) -> list[int]:
    """Masks of every choice of ``equal`` of ``blocks`` about equal bit blocks, as signed 64-bit integers."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(part, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


#: Fingerprints in one tree; a fuller shard becomes trees of this size, each probed by the others of its shard.
TREE_SIZE = 4096


def fingerprint_links(nodes: DataFrame, radius: int = 4, blocks: int = 6, tree_size: int = TREE_SIZE) -> DataFrame:
    """``(a, b)``: links that connect all distinct fingerprints at most ``radius`` bits apart.

    Two such fingerprints agree in at least ``blocks - radius`` of ``blocks`` bit blocks. Each choice of that many blocks is
    a table, and its values are shards: whatever links meets in some shard. A shard is a BK-tree built, probed and dropped
    in one task. Six blocks give 15 keys of 21 bits per fingerprint, enough for about 30 million fingerprints at a mean
    shard of 15; seven (35 keys of 27 bits) reach 2 thousand million, eight (70 keys of 32 bits) go beyond. The result does
    not depend on the choice. Shards over ``tree_size`` are cut by a hash into pieces, and every pair of pieces is a task of
    its own with at most twice that many rows.
    """
    if not 0 <= radius < blocks:
        raise ValueError("blocks must exceed radius")
    masks = block_masks(blocks, blocks - radius)
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fingerprint").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])
    shards = nodes.select("fingerprint", F.explode(keys).alias("shard"))
    full = shards.groupBy("shard").count().filter(F.col("count") > tree_size)
    full = materialize(full.select("shard", F.ceil(F.col("count") / tree_size).cast("int").alias("pieces")))
    if full.isEmpty():
        dealt = shards.select(F.col("shard").alias("tree"), F.lit(0).alias("side"), "fingerprint")
    else:
        cut = join_on(shards, full, ["shard"]).withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        own = F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("pieces")).cast("int")
        cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        tree = F.when(F.col("pieces") == 1, F.col("shard")).otherwise(F.xxhash64("shard", low, high))
        side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
        dealt = cut.select(tree.alias("tree"), side.alias("side"), "fingerprint")

    def link(tree: list[int], side: list[int]) -> list[tuple[int, int]]:
        if any(side):
            first = [x for x, s in zip(tree, side) if s == 1]
            return spanning_links(first, [x for x, s in zip(tree, side) if s == 2], radius) + spanning_links(
                [x for x, s in zip(tree, side) if s == 0], None, radius
            )
        if len(tree) == 2:
            return [(tree[0], tree[1])] if 0 < (tree[0] ^ tree[1]).bit_count() <= radius else []
        return spanning_links(tree, None, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column(0).to_numpy()
            sides, prints = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(trees[1:] != trees[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(trees)]
            links: list[tuple[int, int]] = []
            for a, b in zip(bounds, bounds[1:]):
                if a == 0 and trees[0] == last:
                    held[0].extend(prints[a:b].tolist())
                    held[1].extend(sides[a:b].tolist())
                else:
                    if len(held[0]) > 1:
                        links += link(*held)
                    held = (prints[a:b].tolist(), sides[a:b].tolist()) if b - a > 1 or b == len(trees) else ([], [])
            last = trees[-1]
            yield packed(links)
        if len(held[0]) > 1:
            yield packed(link(*held))

    def packed(links: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return dealt.repartition("tree").sortWithinPartitions("tree").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    records: DataFrame, id: str = "entry_id", body: str = "body", radius: int = 4, blocks: int = 6, width: int = 4
) -> DataFrame:
    """``(entry_id, fingerprint, component_id)``: one row per record, with the smallest id reachable through links of
    fingerprints that differ in at most ``radius`` bits.

    ``records`` are parsed writeup entries or any rows with an id and a text. Copies meet in one fingerprint before any
    comparison, so only distinct fingerprints are linked; of those, only spanning links leave a tree. NULL, empty and
    wordless texts have fingerprint 0 and link like others. Repeated rows each get a row. A NULL id takes part in links but
    never names a component while its component has another id.
    """
    prints = materialize(fingerprints(records, id, body, width))
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min("entry_id").alias("first_id")))
    linked = connected_components(fingerprint_links(nodes.select("fingerprint"), radius, blocks), "a", "b")
    member = linked.withColumnRenamed("node", "fingerprint").join(nodes, "fingerprint")
    smallest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = member.join(smallest, "component").select("fingerprint", "component_id")
    groups = nodes.join(named, "fingerprint", "left")
    # Stored, so that both sides of the last join are plain exchanges, whose hot fingerprints adaptive execution splits.
    groups = materialize(groups.select("fingerprint", F.coalesce("component_id", "first_id").alias("component_id")))
    return prints.join(groups, "fingerprint").select("entry_id", "fingerprint", "component_id")

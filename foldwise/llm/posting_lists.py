"""Nearest rows of a feature table by balanced posting lists under an in-memory graph of centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from foldwise.kernels.store import materialize
from foldwise.llm.columns import id_type, quoted

#: Rows that the centroids are fitted on at most, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
#: Rows that a list holds on average before replicas, and lists at most: bounds what is broadcast.
LIST_ROWS = 256
MAX_LISTS = 4096
#: Rows of one list that one group holds; fuller lists are cut by a hash.
GROUP_ROWS = 4096


def balanced_centroids(points: np.ndarray, lists: int, rounds: int = 4) -> np.ndarray:
    """Means of ``lists`` cells of equal size: the largest cell is halved again and again, at the median between the two
    centres that two-means finds in it."""
    cells = [np.arange(len(points))]
    while len(cells) < min(lists, len(points)):
        cells.sort(key=len)
        cell = cells.pop()
        rows = points[cell]
        spread = rows - rows.mean(axis=0)
        left = rows[np.argmax((spread**2).sum(axis=1))]
        right = rows[np.argmax(((rows - left) ** 2).sum(axis=1))]
        for _ in range(rounds):
            side = rows @ (left - right)
            order = np.argsort(-side, kind="stable")
            half = len(order) // 2
            left, right = rows[order[:half]].mean(axis=0), rows[order[half:]].mean(axis=0)
        cells += [cell[order[:half]], cell[order[half:]]]
    return np.array([points[c].mean(axis=0) for c in cells])


#: From this ratio on a query that is still short reads all lists.
WIDEST, ALL_LISTS = 8.0, float("inf")


@dataclass
class CentroidGraph:
    """Centroids and, for each, its nearest others: the graph that searches walk."""

    centroids: np.ndarray
    edges: np.ndarray

    @classmethod
    def over(cls, centroids: np.ndarray, degree: int = 24) -> CentroidGraph:
        n = len(centroids)
        near = np.zeros((n, min(degree, max(1, n - 1))), np.int64)
        for at in range(0, n, 512):
            block = ((centroids[at : at + 512, None, :] - centroids[None, :, :]) ** 2).sum(axis=2) if n <= 1024 else (
                (centroids[at : at + 512] ** 2).sum(axis=1)[:, None] - 2 * centroids[at : at + 512] @ centroids.T
                + (centroids**2).sum(axis=1)[None, :]
            )
            block[np.arange(len(block)), np.arange(at, at + len(block))] = np.inf if n > 1 else 0.0
            near[at : at + 512] = np.argsort(block, axis=1, kind="stable")[:, : near.shape[1]]
        # A ring through all nodes keeps the graph in one piece.
        ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1)
        return cls(centroids, np.concatenate([near, ring], axis=1))

    def search(self, queries: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances from each query to the centroids that a best-first walk meets, infinite elsewhere.

        All queries walk in step. A walk ends when every node that it met within ``ratio`` times the least distance, and at
        least its ``least`` nearest ones, has been left through all its edges.
        """
        n, rows = len(self.centroids), np.arange(len(queries))
        met = np.full((len(queries), n), np.inf)
        ahead = np.full((len(queries), n), np.inf)
        squares = (self.centroids**2).sum(axis=1)
        own = (queries**2).sum(axis=1)
        entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))
        start = np.sqrt(np.maximum(own[:, None] - 2 * queries @ self.centroids[entries].T + squares[entries], 0))
        met[:, entries] = ahead[:, entries] = start
        best, steps = start.min(axis=1), np.zeros(len(queries), np.int64)
        active = rows
        while len(active):
            at = ahead[active].argmin(axis=1)
            distance = ahead[active, at]
            go = np.isfinite(distance) & ((distance <= ratio * best[active]) | (steps[active] < least))
            active, at = active[go], at[go]
            if not len(active):
                break
            ahead[active, at] = np.inf
            steps[active] += 1
            to = self.edges[at]
            dots = np.einsum("qd,qed->qe", queries[active], self.centroids[to])
            away = np.sqrt(np.maximum(own[active][:, None] - 2 * dots + squares[to], 0))
            new = ~np.isfinite(met[active[:, None], to])
            r, c = np.nonzero(new)
            met[active[r], to[r, c]] = away[r, c]
            ahead[active[r], to[r, c]] = away[r, c]
            best[active] = np.minimum(best[active], away.min(axis=1))
        return met

    def lists(self, queries: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """``(query, list)`` pairs: the lists whose centroids are within ``ratio`` times the least distance."""
        pairs = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(queries), 512):
            met = self.search(queries[at : at + 512], ratio, least)
            r, c = np.nonzero(met <= ratio * met.min(axis=1, keepdims=True) + 1e-12)
            pairs.append(np.stack([r + at, c]))
        return tuple(np.concatenate(pairs, axis=1))


def usable(vectors: DataFrame, id: str, features: str) -> DataFrame:
    """``(entry_id, features)`` without ids or vectors that are NULL, empty, zero or hold a NULL, NaN or infinite component."""
    rows = vectors.select(quoted(id).alias("entry_id"), quoted(features).cast("array<double>").alias("features"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(
        F.col("entry_id").isNotNull() & F.exists("features", lambda x: x != 0.0) & ~F.exists("features", bad)
    )


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def nearest(query_id: list, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple]:
    """``(query, id, distance)`` of the ``k`` nearest rows of one group, ties to smaller ids, the query's own id left out."""
    for at in range(len(queries)):
        distance = np.sqrt(((rows - queries[at]) ** 2).sum(axis=1))
        distance[ids == query_id[at]] = np.inf
        edge = np.partition(distance, k - 1)[k - 1] if k < len(distance) else np.inf
        near = np.flatnonzero((distance <= edge) & np.isfinite(distance))
        near = near[np.lexsort((ids[near], distance[near]))][:k]
        for i in near.tolist():
            yield query_id[at], ids[i], float(distance[i])


def nearest_rows(
    vectors: DataFrame,
    queries: DataFrame,
    id: str = "id",
    features: str = "features",
    k: int = 10,
    boundary: float = 1.01,
    replicas: int = 2,
    ratio: float = 1.15,
    list_rows: int = LIST_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(query_id, rank, entry_id, distance)``: the ``k`` nearest rows found for every query, by Euclidean distance.

    ``vectors`` are the rows of a feature table, an id and an array of numbers; ``queries`` rows of the same form. Centroids of
    equal-sized cells are fitted on at most ``sample_rows`` rows; every row is indexed. A row goes to the list of its nearest
    centroid and, near a boundary, to up to ``replicas`` lists within ``boundary`` times that distance. A query reads all lists
    within ``ratio`` times its nearest centroid's distance: the ratio alone prunes. Queries that met fewer than ``k`` rows search
    again at twice the ratio, and so on up to all lists, so an answer is short only if there are no more candidates. Both walk the centroid graph, whose size
    is bounded by ``MAX_LISTS``. A list over ``group_rows`` rows (a vector that many rows share) is cut by a hash into groups that
    a query visits one by one. Distances are of the vectors as given, in double precision; ties go to the smaller id.

    NULL ids, and vectors that are NULL, empty, zero or hold NULL or non-finite components, take no part, nor does one whose
    length differs from the most frequent one of the sample. Rows that share an id count once, at their nearest. Fewer
    candidates than ``k`` give fewer ranks; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id, features)
    asked = usable(queries, id, features)
    kind = id_type(rows)
    out_schema = f"query_id {kind}, rank int, entry_id {kind}, distance double"
    total = rows.count()
    draw = F.pmod(F.xxhash64("entry_id"), F.lit(2**31))
    few = rows.filter(draw < int(min(1.0, 1.2 * sample_rows / max(total, 1)) * 2**31))
    sample = few.orderBy(draw, F.xxhash64("entry_id"), "entry_id").limit(sample_rows).select("features").toArrow()
    lengths = np.array([len(v) for v in sample.column(0)], np.int64)
    if not len(lengths):
        return spark.createDataFrame([], out_schema)
    size = int(np.bincount(lengths).argmax())
    chosen = sample.filter(pa.array(lengths == size)).column(0).combine_chunks()
    points = _matrix(chosen, size)
    rows, asked = (d.filter(F.size("features") == size) for d in (rows, asked))
    lists = int(np.clip(total // list_rows, 1, min(MAX_LISTS, len(points))))
    graph = CentroidGraph.over(balanced_centroids(points, lists))
    shared = spark.sparkContext.broadcast(graph)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = shared.value
        for batch in batches:
            data = _matrix(batch.column(1), size)
            row, at = walk.lists(data, boundary, 4)
            away = ((data[row] - walk.centroids[at]) ** 2).sum(axis=1)
            order = np.lexsort((at, away, row))
            row, at = row[order], at[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, at = row[place < replicas], at[place < replicas]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                ["list", "entry_id", "features"],
            )

    posted = materialize(rows.mapInArrow(post, f"list int, entry_id {kind}, features array<double>"))
    sizes = posted.groupBy("list").count().collect()
    pieces = {r["list"]: -(-r["count"] // group_rows) for r in sizes}

    def ask(batches: Iterator[pa.RecordBatch], ratio: float) -> Iterator[pa.RecordBatch]:
        walk = shared.value
        count = np.array([pieces.get(n, 0) for n in range(len(walk.centroids))])
        for batch in batches:
            if ratio == ALL_LISTS:
                row, at = (x.ravel() for x in np.indices((batch.num_rows, len(count))))
            else:
                row, at = walk.lists(_matrix(batch.column(1), size), ratio, 4)
            times = count[at]
            piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, at = np.repeat(row, times), np.repeat(at, times)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at, pa.int32()), pa.array(piece, pa.int32()), batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                ],
                ["list", "piece", "entry_id", "features"],
            )

    cut = {n: p for n, p in pieces.items() if p > 1}
    of = F.lit(1)
    if cut:
        of = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]), F.col("list")), F.lit(1))
    held = posted.select("list", F.pmod(F.xxhash64("entry_id"), of).cast("int").alias("piece"), "entry_id", "features", F.lit(False).alias("asks"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, held_rows = None, [], []

        def answer(part: pa.RecordBatch) -> Iterator[tuple]:
            if held_rows:
                all_ids, all_rows = np.concatenate(ids), np.concatenate(held_rows)
                ids[:], held_rows[:] = [all_ids], [all_rows]
                yield from nearest(part.column(2).to_pylist(), _matrix(part.column(3), size), all_ids, all_rows, k)

        for batch in batches:
            if not batch.num_rows:
                continue
            lists_, piece, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
            change = (lists_[1:] != lists_[:-1]) | (piece[1:] != piece[:-1]) | (asks[1:] != asks[:-1])
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            found = []
            for a, b in zip(bounds, bounds[1:]):
                part = batch.slice(a, b - a)
                if (lists_[a], piece[a]) != group:
                    group = (lists_[a], piece[a])
                    ids, held_rows = [], []
                if asks[a]:
                    found += answer(part)
                else:
                    ids.append(part.column(2).to_numpy(zero_copy_only=False))
                    held_rows.append(_matrix(part.column(3), size))
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(2).type), pa.array(columns[1], batch.schema.field(2).type), pa.array(columns[2], pa.float64())],
                ["query_id", "entry_id", "distance"],
            )

    def found_by(some: DataFrame, ratio: float) -> DataFrame:
        probes = some.mapInArrow(lambda b: ask(b, ratio), f"list int, piece int, entry_id {kind}, features array<double>")
        both = held.unionByName(probes.withColumn("asks", F.lit(True)))
        both = both.repartition("list", "piece").sortWithinPartitions("list", "piece", "asks")
        near = both.mapInArrow(compare, f"query_id {kind}, entry_id {kind}, distance double")
        return materialize(near.groupBy("query_id", "entry_id").agg(F.min("distance").alias("distance")))

    reach = ratio if total > k + 1 else ALL_LISTS
    near = found_by(asked, reach)
    while reach != ALL_LISTS:
        full = near.groupBy(F.col("query_id").alias("full")).count().filter(F.col("count") >= k)
        short = materialize(asked.join(full, F.col("entry_id") == F.col("full"), "left_anti"))
        if short.isEmpty():
            break
        reach = reach * 2 if reach < WIDEST else ALL_LISTS
        near = near.unionByName(found_by(short, reach)).groupBy("query_id", "entry_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "entry_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "entry_id", "distance")

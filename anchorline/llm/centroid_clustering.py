"""Clustering of vectors around centroids over a vector-approximation file.

Components become integers, so that sums, distances and ties are exact.  The file holds, for
each vector, one small cell number per dimension and the vector itself.  The cells of a
dimension are ranges of its integers between the least and the greatest of all vectors; inner
cuts lie halfway between quantiles of a bounded sample and equal steps, as cells should be narrow where vectors are
but not so wide elsewhere that they decide nothing.

To assign vectors, tables give for every dimension, cell and centroid the least and the
greatest squared difference that the cell allows, less the difference to the centroids' middle, which is the
same for all centroids and would only widen them.  Summed over a vector's cells they are an interval for its
distance to each centroid.  Only where intervals overlap is the full vector fetched and
measured.  Centroid sums are carried from round to round: a vector that stays where it was adds nothing, so it is not
fetched either, and no state is written between rounds, as where it was follows from the centroids before.

A fetch decodes the vector from the row that holds its cells.  Looking vectors up
in another table by their ids would shuffle more than it spares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.common import written

#: Integers beyond this could make a distance that is no 64-bit integer.
LARGEST = 1 << 27
#: Rows looked at together in a task.
ROWS = 8192


def _integers(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors (``size`` finite components), and their integers."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(good)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)   # nulls become nan
    finite = np.isfinite(values).all(1)
    scaled = np.floor(values[finite] * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component times {scale} is over {LARGEST}; its distances do not fit 64 bits")
    return good[finite], scaled.astype(np.int64)


def _extent(size: int, scale: int):
    """Per task: vectors (position -1) and the least and greatest integer of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = 0, np.full(size, LARGEST), np.full(size, -LARGEST)
        for batch in batches:
            _, x = _integers(batch.column(1), size, scale)
            if len(x):
                count, low, high = count + len(x), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, size), pa.int32()), pa.array(np.r_[count, low], pa.int64()),
                 pa.array(np.r_[count, high], pa.int64())], names=["position", "low", "high"])
    return run


class Cells:
    """Ranges of integers per dimension; ``low`` and ``high`` are dimensions by cells, ends included."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int):
        n = 1 << bits
        steps = np.arange(1, n) / n
        cuts = np.floor(low[:, None] + (high - low)[:, None] * steps).astype(np.int64)
        if len(sample):
            cuts = (cuts + np.quantile(sample, steps, axis=0, method="lower").T.astype(np.int64)) // 2
        self.cuts = np.ascontiguousarray(cuts)
        self.low = np.concatenate([low[:, None], cuts], axis=1)
        self.high = np.concatenate([cuts - 1, high[:, None]], axis=1)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, x[:, d], side="right") for d, cuts in enumerate(self.cuts)],
                        axis=1).astype(np.uint8)


class Assignment:
    """Nearest centroid of vectors, by intervals from their cells where these decide it."""

    def __init__(self, cells: Cells, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        q = self.centroids.T[:, None, :]
        middle = q.mean(2, keepdims=True).astype(np.int64)
        # (x - q)^2 - (x - middle)^2 is linear in x, so a cell's ends bound it
        ends = [(x[:, :, None] - q) ** 2 - (x[:, :, None] - middle) ** 2 for x in (cells.low, cells.high)]
        #: dimensions x cells x (bounds from below, bounds from above)
        self.bounds = np.concatenate([np.minimum(*ends), np.maximum(*ends)], axis=2)
        # of equal centroids the first takes all ties; the others never win
        self.own = np.array([i for i, c in enumerate(centroids) if centroids.index(c) == i])

    def by_cells(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid that the intervals leave, and whether they leave only one."""
        total = np.zeros((len(cells), self.bounds.shape[2]), np.int64)
        for d, table in enumerate(self.bounds):
            total += table[cells[:, d]]
        k = len(self.centroids)
        low, high = total[:, self.own], total[:, k + self.own]
        best = high.argmin(1)
        limit = np.take_along_axis(high, best[:, None], 1)
        order = np.arange(len(self.own))[None, :]
        beaten = (limit < low) | (limit == low) & (best[:, None] < order) | (best[:, None] == order)
        return self.own[best], beaten.all(1)

    def exact(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid, the smaller number at ties, and the squared distance."""
        distances = np.stack([((x - q) ** 2).sum(1) for q in self.centroids], axis=1)
        best = distances.argmin(1)
        return best, distances[np.arange(len(x)), best]


def _file(size: int, scale: int, cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, x = _integers(part.column(1), size, scale)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), _binary(cells.of(x)), _binary(x.astype("<i4"))],
                    names=["vec_id", "cells", "vector"])
    return run


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


class _Rows:
    """Cells of a batch, and vectors of those rows that are asked for."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        self.size = size
        self.vectors = batch.column(2)
        raw = batch.column(1)
        flat = b"".join(raw.to_pylist())
        self.cells = np.frombuffer(flat, np.uint8).reshape(batch.num_rows, size)

    def fetch(self, rows: np.ndarray) -> np.ndarray:
        flat = b"".join(self.vectors.take(pa.array(rows)).to_pylist())
        return np.frombuffer(flat, "<i4").reshape(len(rows), self.size).astype(np.int64)


def _moves(size: int, before: Assignment | None, now: Assignment):
    """What each cluster gains over its members under ``before``: vectors and their sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now.centroids)
        count, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = _Rows(batch.slice(at, ROWS), size)
                to, sure = now.by_cells(rows.cells)
                if before is None:
                    wanted = np.arange(len(to))
                else:
                    was, known = before.by_cells(rows.cells)
                    wanted = np.flatnonzero(~sure | ~known | (was != to))
                x = rows.fetch(wanted)
                open_ = np.flatnonzero(~sure[wanted])
                to[wanted[open_]] = now.exact(x[open_])[0]
                if before is not None:
                    open_ = np.flatnonzero(~known[wanted])
                    was[wanted[open_]] = before.exact(x[open_])[0]
                for sign, groups in ((1, to), (-1, was)) if before is not None else ((1, to),):
                    for c in range(k):
                        mine = groups[wanted] == c
                        count[c] += sign * int(mine.sum())
                        sums[c] += sign * x[mine].sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k), pa.int32()), pa.array(count),
             pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * size), pa.array(sums.ravel()))],
            names=["cluster", "gained", "sums"])
    return run


def _distances(size: int, now: Assignment):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = _Rows(part, size)
                to, sure = now.by_cells(rows.cells)
                x = rows.fetch(np.arange(part.num_rows))
                distance = ((x - now.centroids[to]) ** 2).sum(1)
                open_ = np.flatnonzero(~sure)
                to[open_], distance[open_] = now.exact(x[open_])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(to, pa.int32()), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])
    return run


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024,
                    seed: int = 3, bits: int = 8, sample: int = 10_000) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid.

    Components become ``floor(scale * x)``.  The first centroids are the ``clusters`` vectors with the smallest
    SHA-256 of ``seed:vec_id``.  Each of ``rounds`` rounds assigns every vector to the nearest centroid (ties: the smaller
    number), then moves every centroid that has vectors to the floor of their mean; then vectors are
    assigned once more.  Distances are squared and over integers.  ``bits`` (1 to 8) sets the cells of a dimension,
    ``sample`` about how many vectors place their cuts; both change only how many vectors are fetched.

    Left out: rows without vec_id, and vectors that are null, of another size, or hold null or non-finite components.
    Repeated rows are vectors of their own.  With fewer vectors than ``clusters`` each is a centroid; an
    empty table gives no rows.  Other columns are not read.  Components of over 2^27 / ``scale`` are an error, as
    a sum out of range is in Spark.  Jobs run while the query is built; the driver sees a
    row per dimension and cluster, and the bounded sample.
    """
    if not 1 <= bits <= 8:
        raise ValueError("bits must be 1 to 8")
    schema = "vec_id long, cells binary, vector binary"
    spark = vectors.sparkSession
    rows = (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
            .where("vec_id IS NOT NULL AND embedding IS NOT NULL"))
    extent = {r["position"]: r for r in rows.mapInArrow(_extent(size, scale), "position int, low long, high long")
              .groupBy("position").agg(F.sum(F.when(F.col("position") < 0, F.col("low"))).alias("n"),
                                       F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    if not extent:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string, centroid array<long>")
    part = int((1 << 20) * min(1.0, sample / extent[-1]["n"])) + 1
    some = (rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < part).select("vec_id", "embedding")
            .limit(2 * sample).toArrow()["embedding"].combine_chunks())
    cells = Cells(_integers(some, size, scale)[1], *[np.array([extent[d][c] for d in range(size)]) for c in ("low", "high")], bits)
    file = written(rows.mapInArrow(_file(size, scale, cells), schema))

    first = (file.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("draw"), "vector")
             .orderBy("draw", "vector").limit(clusters).collect())
    centroids = [np.frombuffer(r["vector"], "<i4").tolist() for r in first]
    k = len(centroids)
    count, sums, before = [0] * k, [[0] * size for _ in range(k)], None
    exact = F.sum(F.col("sum").cast("decimal(20,0)")).alias("sum")
    for _ in range(rounds):
        now = Assignment(cells, centroids)
        gains = file.mapInArrow(_moves(size, before, now), "cluster int, gained long, sums array<long>")
        for r in (gains.select("cluster", "gained", F.posexplode("sums").alias("position", "sum"))
                  .groupBy("cluster", "position").agg(F.sum("gained").alias("gained"), exact).collect()):
            sums[r["cluster"]][r["position"]] += int(r["sum"])
            if r["position"] == 0:
                count[r["cluster"]] += r["gained"]
        moved = [[s // n for s in total] if n else c for c, n, total in zip(centroids, count, sums)]
        if moved == centroids:
            break       # every further round would find the same
        centroids, before = moved, now
    out = written(file.mapInArrow(_distances(size, Assignment(cells, centroids)), "vec_id long, cluster int, distance long"))
    totals = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster")
              .agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    of_cluster = spark.createDataFrame(
        [(c, totals.get(c, 0), sum(totals.values()), hashlib.sha256(",".join(map(str, q)).encode()).hexdigest(), q)
         for c, q in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return out.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", *of_cluster.columns[1:])

"""Near-duplicate vectors by random-hyperplane signatures, checked by exact cosine.

Each vector gets one signature per table, the signs of its products with that table's
random hyperplanes; vectors with equal signatures in a table share a bucket.  Two
vectors at an angle a agree in one bit with probability 1 - a / pi, so the number of tables
follows from the bits and the recall asked for at the threshold itself; closer
pairs are found with more certainty.

Buckets are compared in square tiles of bounded size, so a bucket of any size is many
tasks' work and none is cut.  A pair counts in the first table that brings it together.
Tiles give out link counts and one edge per vector to its tile's component, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.common import connected_components, one_row_per_id, written

#: Vectors along one side of a tile, on average.
TILE = 256


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables that bring a pair at the threshold together with probability ``recall``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _sign(tables: int, bits: int):
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                if size not in planes:
                    planes[size] = np.random.default_rng([size, 11]).standard_normal((size, tables * bits))
                signs = (_unit(_matrix(part.column(2))) @ planes[size] > 0).reshape(-1, tables, bits)
                signatures = (signs * weights).sum(2).astype(np.int32)
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * tables
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(signatures.ravel()))],
                    names=["rep", "copies", "vector", "signatures"])
    return run


def _links_of_tile(rows: pa.RecordBatch, threshold: float):
    """(rep, links, label) of the vectors of one tile that have links in it."""
    table = rows.column("table")[0].as_py()
    reps = rows.column("rep").to_numpy(zero_copy_only=False)
    copies = rows.column("copies").to_numpy(zero_copy_only=False)
    block = rows.column("block").to_numpy(zero_copy_only=False)
    vectors = _unit(_matrix(rows.column("vector")))
    left, right = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
    linked = vectors[a] @ vectors[b].T >= threshold
    linked &= reps[a][:, None] != reps[b][None, :]
    if table and linked.any():
        signatures = rows.column("signatures").flatten().to_numpy(zero_copy_only=False).reshape(len(reps), -1)
        for x, y in zip(*(part.tolist() for part in np.nonzero(linked))):
            if (signatures[a[x], :table] == signatures[b[y], :table]).any():
                linked[x, y] = False
    if not linked.any():
        return None
    links = np.zeros(len(reps), np.int64)
    links[a] += linked @ copies[b]
    if left != right:
        links[b] += linked.T @ copies[a]
    label = reps.copy()
    while True:     # the least rep reachable within the tile
        before = label.copy()
        label[a] = np.minimum(label[a], np.where(linked, label[b][None, :], np.iinfo(np.int64).max).min(1))
        label[b] = np.minimum(label[b], np.where(linked, label[a][:, None], np.iinfo(np.int64).max).min(0))
        if (label == before).all():
            break
    some = links > 0
    return reps[some], links[some], label[some]


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(tiles):
            done = [x for x in (_links_of_tile(t, threshold) for t in tiles if t.num_rows > 1) if x is not None]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done)],
                                                 names=["rep", "links", "label"])
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([*held, batch]) if held else batch
            keys = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
            yield from found(rows.slice(x, y - x) for x, y in zip(cuts[:-1], cuts[1:]))
            held = [rows.slice(cuts[-1])]   # its tile may go on in the next batch
        yield from found(held)
    return run


def bits_for(vectors: int) -> int:
    """Bits of a signature: 14, and from 2^18 different vectors on so many that unrelated ones share a bucket with about 16."""
    return min(30, max(14, math.ceil(math.log2(max(vectors, 1))) - 4))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, bits: int | None = None,
                           recall: float = 0.999) -> DataFrame:
    """One row per vec_id: vec_id, n_links, component_id, kept.

    ``vectors`` holds vec_id and embedding (array of numbers).  Vectors are linked if their
    cosine in double precision is at least ``threshold``; a pair exactly at it is found with
    probability ``recall``, a pair below it never counts.  ``n_links`` counts the other vectors
    linked directly, ``component_id`` is the least vec_id reachable over links.  ``bits`` follows from the number of
    different vectors (``bits_for``), and the number of tables from ``bits``.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of
    different lengths, are not linked.  Equal vectors are compared once and counted
    as often as they occur.  Rows without a vec_id are left out; of rows that share
    one, the least embedding counts.  Other columns are not read; an empty table gives an empty result.
    """
    base = one_row_per_id(vectors, "vec_id", "embedding").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = (F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("vector", lambda x: x != 0))
    base = base.withColumn("vector", F.when(sound, F.col("vector")))
    classes = written(base.where("vector is not null").groupBy("vector")
                      .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    if bits is None:
        bits = bits_for(classes.count())
    tables = tables_for(threshold, bits, recall)
    signed = written(classes.select("rep", "copies", "vector").mapInArrow(
        _sign(tables, bits), "rep long, copies long, vector array<double>, signatures array<int>"))
    members = signed.select("rep", F.size("vector").alias("length"),
                            F.posexplode("signatures").alias("table", "signature"))
    members = members.select("rep", "table", F.xxhash64("length", "table", "signature").alias("bucket"))
    shared = (members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")))
    dealt = members.join(shared, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = (dealt.select("rep", "table", "bucket", "block", other)
             .select("rep", "table", "bucket", "block", F.least("block", "other").alias("i"),
                     F.greatest("block", "other").alias("j")))
    found = written(tiles.join(signed, "rep").repartition("bucket", "i", "j")
                    .sortWithinPartitions("bucket", "i", "j")
                    .mapInArrow(_links(threshold), "rep long, links long, label long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b")).distinct()
    roots = connected_components(edges)
    classes = (classes.select("vector", "rep", "copies").join(links, "rep", "left")
               .join(roots.select(F.col("node").alias("rep"), "component"), "rep", "left"))
    out = base.join(classes, "vector", "left")
    return out.select(
        "vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))

"""Helpers shared by the operators: written steps, one row per id, components."""

from __future__ import annotations

import sys
import types
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from anchorline.session import written

_WORKER = "_anchorline_worker_state"


def worker_state(key: tuple, build):
    """What ``build()`` gave for ``key``, kept for the life of a Python worker.

    Functions travel by value, so their module globals are new in every task;
    tables that are dear to build live in a module of their own instead.
    """
    kept = sys.modules.setdefault(_WORKER, types.ModuleType(_WORKER))
    found = kept.__dict__.get(key[0])
    if found is None or found[0] != key:
        found = (key, build())
        kept.__dict__[key[0]] = found
    return found[1]


def one_row_per_id(df: DataFrame, key: str, value: str, others: Sequence[str] = ()) -> DataFrame:
    """(key, value, *others) with one row per key: of rows that share a key, the least.

    Rows are ordered by value, then by the other columns.  Rows without a key are left
    out, as nothing can be said about them by key.  Repeated keys are looked for among
    the keys alone; only if there are any do the other columns meet a shuffle.
    """
    columns = [key, value, *others]
    base = df.select(*[F.col(f"`{c}`") for c in columns]).where(F.col(key).isNotNull())
    repeated = base.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    if repeated.isEmpty():
        return base
    row = F.min(F.struct(*[F.col(f"`{c}`") for c in columns[1:]])).alias("_row")
    again = (base.join(repeated, key, "left_semi").groupBy(key).agg(row)
             .select(key, *[F.col("_row").getField(c).alias(c) for c in columns[1:]]))
    return base.join(repeated, key, "left_anti").unionByName(again)


#: Tasks that the copies of one text are spread over.
SALTS = 8


def first_copies(docs: DataFrame) -> DataFrame:
    """doc_id and first_id, the least doc_id with the same text; nulls are like empty texts.

    Only texts that occur more than once are looked up, by rows dealt out over ``SALTS`` copies of
    the look-up, so a text that a third of all rows share is not one task's work.
    """
    text = F.coalesce("text", F.lit(""))
    key = ["text_key", "size"]
    marked = docs.select("doc_id", F.md5(text).alias("text_key"), F.octet_length(text).alias("size"))
    least = marked.groupBy(*key).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    met = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(
        least.select(*key, "first_id", salts), [*key, "salt"], "left")
    return met.select("doc_id", F.coalesce("first_id", "doc_id").alias("first_id"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``edges`` (a, b).

    Alternating large-star and small-star rounds: every node is tied to the least
    node it can see until nothing changes, O(log n) rounds on the chains met in
    practice.  Each star is a partial minimum joined back to the edges, so a node
    with very many edges is split like any skewed join.  Edges stay distributed;
    only two sums per round reach the driver.
    """
    now = written(edges.where("a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = written(small, instead_of=now)
        seen = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == before:
            return written(now.select(F.col("a").alias("node"), F.col("b").alias("component"))
                           .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
                           .groupBy("node").agg(F.min("component").alias("component")), instead_of=now)
        before = seen

"""Line dedup: later copies of repeated line runs are deleted, found in a suffix array.

The corpus is one sequence of line ids per document.  Prefix doubling sorts all suffixes of
these sequences: at depth 1 suffixes rank by their first line; from depth k the pair of ranks
at a position and k lines on gives the ranks at depth 2k.  A rank is the number of
smaller suffixes, so the suffixes that share their first k lines are the interval of the
suffix array that starts there: the longest-common-prefix interval of depth k.  Only
intervals of two or more are sorted on, until a doubling splits none of them or, for the dedup, the
depth that makes a run is reached: a longer repeated run is a stretch of positions whose suffixes are
all in such intervals, so deeper ranks could not change where it begins and ends.

Everything is distributed: ranks are running counts over range-partitioned distinct
pairs, so a line that a third of the corpus holds is one counted row where ranks are made.  Documents with
an earlier exact copy do not enter; they are later copies as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from anchorline.llm.common import first_copies, one_row_per_id, written


_WORD = re.compile("[^\x20\x09-\x0d]+")


def _numbered(text: str) -> Column:
    """(number, line) of the lines that are not blank."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                        lambda line, i: F.struct(i.alias("number"), line.alias("line")))
    return F.filter(lines, lambda x: F.translate(x["line"], " \t\r\x0b\x0c", "") != "")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rank, second, n) of one sorted partition, with the sum of n before each."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(2).to_numpy(zero_copy_only=False)
        upto = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(upto - n), pa.array(np.full(len(n), part, np.int32))],
            names=["rank", "second", "n", "before", "part"])
        total = int(upto[-1]) if len(n) else total


def _smaller(counts: DataFrame) -> DataFrame:
    """(rank, second, n, before): ``before`` sums n over all smaller (rank, second).

    Keys are sorted within ranges; only one total per range comes to the driver.
    """
    ranged = written(counts.select("rank", "second", "n").repartitionByRange("rank", "second")
                     .sortWithinPartitions("rank", "second")
                     .mapInArrow(_running, "rank long, second long, n long, before long, part int"))
    totals = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    sums = np.cumsum([0, *[n for _, n in totals]], dtype=np.int64)[:-1]
    # as an Arrow table: plain rows would go through Python workers of their own kind, which stay beside the others
    offsets = counts.sparkSession.createDataFrame(pa.table(
        {"part": pa.array([part for part, _ in totals], pa.int32()), "offset": pa.array(sums, pa.int64())}))
    return (ranged.join(F.broadcast(offsets), "part")   # one row per partition
            .select("rank", "second", "n", (F.col("before") + F.col("offset")).alias("before")))


def _later(members: DataFrame) -> DataFrame:
    """Members (doc_id, pos, rank) of an interval that are not its first in document order."""
    first = members.groupBy("rank").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    return members.join(first, "rank").where(F.struct("doc_id", "pos") > F.col("first")).select("doc_id", "pos")


class SuffixArray:
    """``depths``: for depth 1, 2, 4, ... the suffixes (doc_id, pos, left, rank, n) in intervals of two or more.

    ``ranks`` holds (doc_id, pos, rank) of all suffixes when no interval splits any more.
    """

    def __init__(self, lines: DataFrame, until: int | None = None):
        """``lines``: (doc_id, pos, left, key): pos counts from 0, left from there to the document's end.

        With ``until`` sorting ends at the first depth of so many lines; ``ranks`` are of that depth then.
        """
        counts = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        ordered = _smaller(counts.select(F.col("key").alias("rank"), F.lit(0).cast("long").alias("second"), "n"))
        ordered = ordered.select(F.col("rank").alias("key"), F.col("before").alias("rank"), "n")
        fresh = written(lines.join(ordered, "key").select("doc_id", "pos", "left", "rank", "n"))
        self.depths: dict[int, DataFrame] = {}
        settled = fresh.where("n = 1").select("doc_id", "pos", "rank")
        depth = 1
        while True:
            self.depths[depth] = open_ = fresh.where("n > 1")
            self.ranks = settled.unionByName(open_.select("doc_id", "pos", "rank"))
            if until is not None and depth >= until or open_.isEmpty():
                return
            ahead = self.ranks.select("doc_id", (F.col("pos") - depth).alias("pos"), F.col("rank").alias("second"))
            pairs = written(open_.drop("n").join(ahead, ["doc_id", "pos"], "left")
                            .select("doc_id", "pos", "left", "rank", F.coalesce("second", F.lit(-1)).alias("second")))
            named = _smaller(pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("n")))
            base = named.groupBy("rank").agg(F.min("before").alias("base"), F.count(F.lit(1)).alias("parts"))
            named = written(named.join(base, "rank").select(
                "rank", "second", "n", "parts", (F.col("rank") + F.col("before") - F.col("base")).alias("new")))
            if named.where("parts > 1").isEmpty():
                return
            fresh = written(pairs.join(named, ["rank", "second"])
                            .select("doc_id", "pos", "left", F.col("new").alias("rank"), "n"))
            settled = settled.unionByName(fresh.where("n = 1").select("doc_id", "pos", "rank"))
            depth *= 2

    def interval(self, depth: int) -> DataFrame:
        """(doc_id, pos, rank) of the suffixes that share their first ``depth`` lines with another.

        A suffix of fewer lines is in none.  Depths between powers of two are two overlapping
        windows.
        """
        half = 1
        while half * 2 <= depth:
            half *= 2
        if half not in self.depths:     # nothing split after the last depth: its intervals are the deeper ones too
            half = max(self.depths)
        deep = self.depths[half].where(F.col("left") >= half).select("doc_id", "pos", "rank")
        found, reach = deep, half
        while reach < depth:
            step = min(half, depth - reach)
            ahead = deep.select("doc_id", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
            found = (found.join(ahead, ["doc_id", "pos"])
                     .select("doc_id", "pos", F.xxhash64("rank", "next").alias("rank")))
            reach += step
        return found


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def _runs(starts, length: int) -> list[tuple[int, int]]:
    """The longest runs that windows of ``length`` lines from ``starts`` on make up: (first, last + 1)."""
    runs: list[tuple[int, int]] = []
    for at in sorted(starts):
        if runs and at <= runs[-1][1]:
            runs[-1] = runs[-1][0], at + length
        else:
            runs.append((at, at + length))
    return runs


#: Rows whose texts a task holds as strings at a time.
ROWS = 256


def _cut(min_lines: int, min_words: int | None, names: list[str]):
    """Rows (*names, _starts, _singles, _whole) with the text cut, and n_lines and n_removed in place of the marks."""
    text_at, many = names.index("text"), len(names)

    def cut_one(text, at, alone, copy) -> tuple[str | None, int, int]:
        lines = (text or "").split("\n")
        solid = [i for i, line in enumerate(lines) if line.strip(" \t\r\x0b\x0c")]
        gone: set[int] = set()
        if copy and len(solid) >= min_lines:
            gone.update(solid)
        elif copy and min_words is not None:
            gone.update(i for i in solid if len(_WORD.findall(lines[i])) >= min_words)
        for first, end in _runs(at, min_lines) if at is not None else ():
            gone.update(solid[first:end])
        for i in alone if alone is not None else ():
            gone.add(solid[i])
        return (text if not gone else "\n".join([x for i, x in enumerate(lines) if i not in gone])), len(solid), len(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                marks = [part.column(k).to_pylist() for k in (text_at, many, many + 1, many + 2)]
                out = [cut_one(*row) for row in zip(*marks)]
                columns = part.columns[:many]
                columns[text_at] = pa.array([x[0] for x in out], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
                    names=[*names, "n_lines", "n_removed"])
    return run


def remove_repeated_lines(docs: DataFrame, min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """``docs`` with later copies of line runs deleted from text, and n_lines, n_removed.

    A line is deleted if it lies in a run of ``min_lines`` or more consecutive lines that also starts
    earlier (smaller doc_id, or same document and earlier line).  With ``min_words`` a single line of so
    many words or more is a run by itself, as long paragraphs are; words are runs of characters other than
    space and \\x09-\\x0D.  Runs are judged on
    the input and do not cross documents.  Blank lines are no lines here: they neither
    count nor break a run, and stay.  Lines are compared by a 64-bit hash of their exact
    text.  n_lines counts lines, n_removed deleted ones.

    A null text stays null and an empty one empty; both have no lines.  Rows without a doc_id
    are left out; of rows that share one, the least by text counts.  Other columns
    are carried along, but for columns named n_lines or n_removed, which are replaced.
    An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    base = one_row_per_id(docs, "doc_id", "text", others)
    copies = written(first_copies(base))
    firsts = copies.where("doc_id = first_id").select("doc_id")
    lines = base.select("doc_id", _numbered("text").alias("lines")).select(
        "doc_id", F.size("lines").alias("size"), F.posexplode("lines").alias("pos", "x"))
    enough = [] if min_words is None else [(_words(F.col("x.line")) >= min_words).alias("enough")]
    lines = written(lines.select("doc_id", "pos", (F.col("size") - F.col("pos")).alias("left"),
                                 F.xxhash64("x.line").alias("key"), *enough).join(firsts, "doc_id"))
    later = _later(SuffixArray(lines.drop("enough"), min_lines).interval(min_lines))
    marks = later.groupBy("doc_id").agg(F.collect_list("pos").alias("_starts"))
    if min_words is None:
        marks = marks.withColumn("_singles", F.lit(None).cast("array<int>"))
    else:
        single = _later(lines.where("enough").select("doc_id", "pos", F.col("key").alias("rank")))
        marks = marks.join(single.groupBy("doc_id").agg(F.collect_list("pos").alias("_singles")), "doc_id", "full")
    whole = copies.where("doc_id <> first_id").select("doc_id", F.lit(True).alias("_whole"))
    marks = marks.join(whole, "doc_id", "full")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = base.join(marks, "doc_id", "left").select(
        *[F.col(f"`{c}`") for c in names], "_starts", "_singles", F.coalesce("_whole", F.lit(False)).alias("_whole"))
    schema = T.StructType([*rows.schema.fields[:len(names)], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.mapInArrow(_cut(min_lines, min_words, names), schema)

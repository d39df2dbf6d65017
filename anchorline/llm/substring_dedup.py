"""Substring dedup: word windows that occur earlier in the corpus are cut out.

Level-wise doubling.  A window of ``words`` words can only repeat if the shorter
windows in it do, so the levels ``seed``, 2 ``seed``, ... ``words`` each look only
at what the level before left over:

* the lowest level does not shuffle every window but one per neighbourhood: of the
  seed windows inside a full-length window the one with the least hash stands for
  it.  Equal full-length windows choose the same one, so no repeat is lost, and
  about 2 in (words - seed + 2) positions are shuffled;
* positions whose class has one member only are dropped, the rest are extended to
  twice the length inside the full windows they stand for, until the full length
  is reached or nothing survives.

At the full length the first occurrence (least doc_id, then least start) of every
window is kept and the words under all later ones are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from anchorline.llm.common import first_copies, one_row_per_id, written
from anchorline.llm.words import Words, text_slices, window_hashes, windows_inside

_SPOTS = "key long, doc_id long, start int, hot boolean"
#: A seed window that occurs more often makes the windows on it hot: these are ranked in parts.
HOT, SALTS = 1_000, 64


def _anchors(w: Words, words: int, seed: int):
    """For each full-length window inside a text: its start, and where its least seed window is."""
    hashes = w.hashes()
    n = len(hashes) - words + 1
    if n <= 0:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = window_hashes(hashes, seed)
    span = words - seed + 1
    least = np.lib.stride_tricks.sliding_window_view(seeds, span).argmin(1) + np.arange(n)
    starts = np.flatnonzero(windows_inside(w.first, words, n))
    return hashes, starts, least[starts], seeds


def _spots(keys, doc_ids, starts, hot) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(doc_ids), pa.array(starts.astype(np.int32)), pa.array(hot)],
        names=["key", "doc_id", "start", "hot"])


def _seed_spots(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, offsets, data in text_slices(batch.column(1)):
                w = Words(offsets, data)
                _, _, least, seeds = _anchors(w, words, seed)
                chosen = np.unique(least)
                text = np.searchsorted(w.first, chosen, side="right") - 1
                if len(chosen):
                    yield _spots(seeds[chosen], ids[row + text], chosen - w.first[text], np.zeros(len(chosen), bool))
    return run


def _flags(lists: pa.Array, first: np.ndarray, n: int) -> np.ndarray:
    """Which words of a slice are listed, by their place in their text."""
    out = np.zeros(n + 1, bool)
    counts = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    out[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(first[:-1], counts)] = True
    return out


def _part(starts: np.ndarray, least: np.ndarray, words: int, length: int) -> np.ndarray:
    """Where the ``length`` words that stand for a full window begin: at its seed window, or
    as far before that as they need to stay inside."""
    return starts + np.minimum(least - starts, words - length)


def _grown_spots(words: int, seed: int, before: int, length: int):
    """Parts of ``length`` words of full windows whose part of ``before`` words survived."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, offsets, data in text_slices(batch.column(1)):
                w = Words(offsets, data)
                hashes, starts, least, _ = _anchors(w, words, seed)
                n_texts = len(offsets) - 1
                alive, hot = (_flags(batch.column(c).slice(row, n_texts), w.first, len(hashes)) for c in (2, 3))
                old = _part(starts, least, words, before)
                keep = np.flatnonzero(alive[old])
                if not len(keep):
                    continue
                at, where = np.unique(_part(starts[keep], least[keep], words, length), return_index=True)
                by = old[keep][where]
                text = np.searchsorted(w.first, at, side="right") - 1
                yield _spots(window_hashes(hashes, length)[at], ids[row + text], at - w.first[text], hot[by])
    return run


def _survivors(spots: DataFrame) -> DataFrame:
    """Spots whose key occurs more than once, one row per document: (doc_id, live, hot)."""
    again = spots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "n")
    return (spots.drop("hot").join(again, "key").groupBy("doc_id")
            .agg(F.collect_list("start").alias("live"), F.collect_list(F.when(F.col("n") > HOT, F.col("start"))).alias("hot")))


def _later(spots: DataFrame) -> DataFrame:
    """Spots whose key occurs earlier too.

    Hot keys are dealt over ``SALTS`` parts: all but a part's first are later ones for
    certain, and the parts' firsts are ranked again.
    """
    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "start"))
        return rows.withColumn("turn", turn)

    cold = ranked(spots.where("not hot"), "key")
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS))
    hot = ranked(spots.where("hot").withColumn("salt", salt), "key", "salt")
    firsts = ranked(hot.where("turn = 1").drop("turn"), "key")
    later = [x.where("turn > 1").select("doc_id", "start") for x in (cold, hot, firsts)]
    return later[0].unionByName(later[1]).unionByName(later[2])


def repeated_windows(docs: DataFrame, copies: DataFrame, words: int = 20, seed: int = 10) -> DataFrame:
    """(doc_id, starts): word starts of windows of ``words`` words that also start earlier.

    ``docs`` holds (doc_id long, text string) with one row per doc_id, ``copies``
    (doc_id, first_id) the least doc_id with the same text.  ``words`` must be ``seed``
    times a power of two.  Texts equal to an earlier document's are not listed: each of
    their windows starts earlier.
    """
    length = seed
    while length < words:
        length *= 2
    if length != words or seed < 1:
        raise ValueError("words must be seed times a power of two")
    firsts = copies.where("doc_id = first_id").select("doc_id")
    spots = docs.mapInArrow(_seed_spots(words, seed), _SPOTS)
    length = seed
    while length < words:
        before, length = length, 2 * length
        live = _survivors(spots).join(firsts, "doc_id")
        spots = docs.join(live, "doc_id").select("doc_id", "text", "live", "hot").mapInArrow(
            _grown_spots(words, seed, before, length), _SPOTS)
    return _later(spots).groupBy("doc_id").agg(F.collect_list("start").alias("starts"))


def _cut(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_text", pa.large_string()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            whole = batch.column(3).to_numpy(zero_copy_only=False)
            starts_all = batch.column(2)
            for row, offsets, data in text_slices(batch.column(1)):
                w = Words(offsets, data)
                n_texts = len(offsets) - 1
                lists = starts_all.slice(row, n_texts)
                counts = np.nan_to_num(np.asarray(
                    lists.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
                at = (lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                      + np.repeat(w.first[:-1], counts))
                change = np.zeros(len(w.starts) + words + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + words, -1)
                gone = np.cumsum(change)[:len(w.starts)] > 0
                sizes = np.diff(w.first)
                copy = whole[row:row + n_texts] & (sizes >= words)
                gone |= np.repeat(copy, sizes)
                raw = data.tobytes()
                kept, removed = [], []
                starts, ends = w.starts.tolist(), w.ends.tolist()
                for i in range(n_texts):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    cut = gone[a:b]
                    removed.append(int(cut.sum()))
                    kept.append(b" ".join([raw[starts[j]:ends[j]] for j in (np.flatnonzero(~cut) + a).tolist()])
                                if removed[-1] else b" ".join(raw[offsets[i]:offsets[i + 1]].split()))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, n_texts), pa.array(sizes.astype(np.int64)), pa.array(removed, pa.int64()),
                    pa.array([k.decode() for k in kept], pa.large_string()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept])], schema=schema)
    return run


def remove_repeated_windows(docs: DataFrame, words: int = 20, seed: int = 10) -> DataFrame:
    """One row per doc_id: doc_id, n_words, n_removed, kept_text, kept_sha256.

    Every word under a window of ``words`` words that also starts earlier (smaller
    doc_id, or same document and earlier start) is removed; windows are judged on the
    input.  Kept words are joined by one space.

    Words are runs of characters other than space and \\x09-\\x0D.  Null and empty texts
    have no words; texts of fewer than ``words`` words lose none.  Rows without a doc_id
    are left out; of rows that share one, the row with the least text counts.  Other
    columns of ``docs`` are not read.  An empty table gives an empty result.
    """
    docs = one_row_per_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    copies = written(first_copies(docs))
    whole = copies.where("doc_id <> first_id").select("doc_id", F.lit(True).alias("whole"))
    marks = (repeated_windows(docs, copies, words, seed).join(whole, "doc_id", "full")
             .select("doc_id", "starts", F.coalesce("whole", F.lit(False)).alias("whole")))
    joined = (docs.join(marks, "doc_id", "left")
              .select("doc_id", "text", "starts", F.coalesce("whole", F.lit(False)).alias("whole")))
    return joined.mapInArrow(_cut(words), "doc_id long, n_words long, n_removed long, "
                                          "kept_text string, kept_sha256 string")

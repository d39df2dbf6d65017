"""Packing of documents into token sequences of one length by large-item matching and best fit.

Pieces over a third of a sequence are large: no three fit together, so they are matched in pairs.  From the
longest down, each takes the longest large piece that still fits beside it; as whatever fits beside a
longer one fits beside a shorter one too, no other matching has more pairs.  Smaller pieces, the longest
first, go where the least room is left that holds them, or open a new sequence.

All of this depends on lengths alone, of which there are no more than tokens in a sequence.  So only the count
of each length reaches the driver, and the plan treats equal pieces and equal gaps together: a segment says
where pieces number r, r + 1, .. of a length go.  The number of segments is bounded by the length of
a sequence, however many documents there are.  Pieces are numbered within their length in parts of
bounded size, so a length that a third of all pieces share is many tasks' work, and look up their place.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from anchorline.llm.common import worker_state, written
from anchorline.llm.words import text_slices

#: Pieces of one length that one task numbers, but no more than so many parts of a length.
ROWS_PER_PART, PARTS = 1_000, 10_000
#: A worker forgets the chunks it has met beyond these.
CHUNKS_KEPT, BYTES_KEPT = 500_000, 16 << 20


#: Bytes as white space (0), letter (1), digit (2), sign (3), or anything else (4).
_KIND = np.full(256, 4, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
for _b in range(33, 127):
    _KIND[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 3
#: Whether words end between bytes of two ASCII kinds, whatever stands around them.
_CUT = np.zeros((5, 5), bool)
_CUT[1, 2:4] = _CUT[2, 1:4] = _CUT[3, 1:3] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _chunks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the chunks of consecutive texts, the first chunk of each text, the chunks' bytes.

    A chunk's tokens do not depend on what stands around it.  Chunks end at white space, and between ASCII letters,
    single digits and runs of signs; next to other characters, which may combine or be of any kind, only white
    space ends one.  An apostrophe on its own stays with the letters behind it.  Letters are
    lower-cased, except where a string of a special token may stand.
    """
    kind = _KIND[data]
    inside = kind > 0
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    first[1:] |= ~inside[:-1]
    if data.tobytes().find(b"<|") < 0:
        data = _LOWER[data]
        cut = _CUT[kind[:-1], kind[1:]]
        alone = (data[:-1] == 39) & (kind[1:] == 1)
        alone[1:] &= kind[:-2] != 3
        first[1:] |= cut & ~alone
    starts = np.flatnonzero(first & inside)
    size = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=size[1:])
    edges = np.r_[size[starts], size[-1]]
    return edges, np.searchsorted(starts, offsets, side="left"), data[inside]


class ChunkCoder:
    """Token ids of texts by the tokenizers library, each distinct chunk of a text encoded once.

    For vocabularies that split text as ``word_bpe_49k.json`` does: into runs of letters, single digits, runs of signs
    and contractions, lower-cased, white space dropped.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes = 0
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)       # where a chunk's ids end; chunk i begins at ends[i]

    def _learn(self, chunks: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks))))
        self.bytes += sum(map(len, chunks))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def _numbers(self, chunks: list[bytes]) -> np.ndarray:
        new = [c for c in chunks if c not in self.number]
        # words of Latin letters are one split each: encoded as one text, told apart by its word numbers
        words = [c for c in new if c.isalpha() or (t := c.decode().lower()).isalpha() and max(t) < "\u0250"]
        if words:
            coded = self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False)
            counts = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(words))
            if len(counts) == len(words):
                self._learn(words, np.array(coded.ids, np.uint32), counts)
        new = [c for c in new if c not in self.number]
        if new:
            found = [x.ids for x in self.tokenizer.encode_batch([c.decode() for c in new], add_special_tokens=False)]
            self._learn(new, np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64))
        return np.array([self.number[c] for c in chunks], np.int64)

    def code(self, offsets: np.ndarray, data: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, each followed by ``last``, and where each text begins."""
        if len(self.number) > CHUNKS_KEPT or self.bytes > BYTES_KEPT:
            self._forget()
        texts = len(offsets) - 1
        edges, first, data = _chunks(offsets, data)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [
            None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        of = self._numbers(chunks.dictionary.to_pylist())[chunks.indices.to_numpy(zero_copy_only=False)]
        begins, counts = self.ends[of], self.ends[of + 1] - self.ends[of]
        text = np.repeat(np.arange(texts), np.diff(first))
        before = np.zeros(len(of) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        step = np.arange(before[-1])
        out = np.full(before[-1] + texts, last, np.uint32)
        out[step + np.repeat(text, counts)] = self.ids[np.repeat(begins - before[:-1], counts) + step]
        return out, before[first] + np.arange(texts + 1)


def _pieces(path: str, capacity: int, last: int, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state(("chunk coder", path), lambda: ChunkCoder(path))
        for batch in batches:
            for row, offsets, data in text_slices(batch.column(1)):
                tokens, edges = coder.code(offsets, data, last)
                tokens = tokens.astype("<u4", copy=False)
                sizes = np.diff(edges)
                many = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                raw = [tokens[a:a + n].tobytes() for a, n in zip((edges[of] + start).tolist(), length.tolist())]
                columns = {"doc_id": batch.column(0).take(pa.array(row + of)), "piece": pa.array(piece, pa.int32()),
                           "start": pa.array(start), "length": pa.array(length),
                           "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64())}
                if ids:
                    columns["ids"] = pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


class Plan:
    """Where pieces go, from the count of each length.

    ``segments`` are rows (length, rank, sequence, per_sequence, offset): pieces of ``length`` numbered
    from ``rank`` until the next segment of that length fill sequences from ``sequence`` on, ``per_sequence`` to each,
    from ``offset`` on.  ``sequences`` counts all.
    """

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.segments: list[tuple[int, int, int, int, int]] = []
        self._left = dict(counts)
        self._placed = dict.fromkeys(counts, 0)
        self._gaps: list[int] = []      # sorted
        self._rooms: dict[int, list[tuple[int, int]]] = {}     # gap -> (first sequence, how many)
        large = sorted(n for n in counts if 3 * n > capacity)
        self._match(large)
        for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
            self._fit(n)

    def _open(self, many: int) -> int:
        self.sequences += many
        return self.sequences - many

    def _room(self, first: int, many: int, gap: int) -> None:
        if many and gap:
            if gap not in self._rooms:
                insort(self._gaps, gap)
                self._rooms[gap] = []
            self._rooms[gap].append((first, many))

    def _put(self, length: int, many: int, first: int, each: int, offset: int) -> None:
        self.segments.append((length, self._placed[length], first, each, offset))
        self._placed[length] += many
        self._left[length] -= many

    def _match(self, lengths: list[int]) -> None:
        free = list(lengths)
        while free:
            a = free[-1]
            many = self._left[a]
            at = bisect_right(free, min(a, self.capacity - a)) - 1
            if at >= 0 and free[at] == a and many == 1:
                at -= 1
            if at < 0:
                first = self._open(many)
                self._put(a, many, first, 1, 0)
                self._room(first, many, self.capacity - a)
            elif free[at] == a:
                first = self._open(many // 2)
                self._put(a, many // 2 * 2, first, 2, 0)
                self._room(first, many // 2, self.capacity - 2 * a)
            else:
                b = free[at]
                many = min(many, self._left[b])
                first = self._open(many)
                self._put(a, many, first, 1, 0)
                self._put(b, many, first, 1, a)
                self._room(first, many, self.capacity - a - b)
                if not self._left[b]:
                    del free[at]
            if not self._left[a]:
                free.pop()

    def _fit(self, n: int) -> None:
        while self._left[n]:
            at = bisect_left(self._gaps, n)
            if at < len(self._gaps):
                gap = self._gaps[at]
                first, many = self._rooms[gap].pop()
                if not self._rooms[gap]:
                    del self._rooms[gap], self._gaps[at]
            else:
                gap = self.capacity
                many = -(-self._left[n] // (gap // n))
                first = self._open(many)
            each = gap // n
            full = min(many, self._left[n] // each)
            rest = min(self._left[n] - full * each, each) if full < many else 0
            if full:
                self._put(n, full * each, first, each, self.capacity - gap)
                self._room(first, full, gap - each * n)
            if rest:
                self._put(n, rest, first + full, rest, self.capacity - gap)
                self._room(first + full, 1, gap - rest * n)
            used = full + (rest > 0)
            self._room(first + used, many - used, gap)


def _look_up(segments: np.ndarray):
    """Sequence and offset from length and rank; ``segments`` sorted by both."""
    top = 1 << 40
    keys = segments[:, 0] * top + segments[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * top + rank, side="right") - 1
            _, base, sequence, each, offset = segments[at].T
            step = rank - base
            columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            columns |= {"sequence_id": pa.array(sequence + step // each), "offset": pa.array(offset + step % each * length)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (a written table with ``length`` from 1 to ``capacity`` and a ``row`` number of its own each)
    with sequence_id and offset in place of ``row``.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(counts, capacity)
    parts = spark.createDataFrame([(n, min(-(-c // ROWS_PER_PART), PARTS)) for n, c in counts.items()], "length long, parts long")
    spread = (pieces.join(F.broadcast(parts), "length")      # a row per length, at most ``capacity``
              .withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (spread.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
               .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("row"))
    ranked = (spread.withColumn("inside", inside).join(offsets, ["length", "part"])
              .withColumn("rank", F.col("earlier") + F.col("inside") - 1).drop("part", "inside", "earlier", "row"))
    segments = np.array(sorted(plan.segments), np.int64).reshape(-1, 5)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_look_up(segments), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, last: int = 0, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset.

    A document is its token ids by the tokenizers file at ``path`` (whose words never span white space), without added
    tokens, then ``last``.  Documents of over ``capacity`` tokens are cut into pieces of that many, the last may be
    shorter; no other is cut.  Every sequence is filled from offset 0 without gaps by whole pieces.  ``ids`` adds
    the pieces' ids as little-endian unsigned 32-bit integers (see ``sequences``).

    Null texts count as empty: one piece holding ``last`` alone.  Repeated rows and rows without doc_id are
    packed like any others; an empty table gives no rows.  Other columns are not read.  Jobs run while the query is built;
    the driver sees one count per length.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                     .mapInArrow(_pieces(path, capacity, last, ids), schema)
                     .withColumn("row", F.monotonically_increasing_id()))
    if not ids:
        return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    placed = place(pieces.select("length", "row", F.col("row").alias("of")), capacity).drop("length")
    return pieces.join(placed, F.col("row") == F.col("of")).drop("row", "of")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from packed pieces that carry their ids; a group is one sequence."""
    inside = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside.alias("parts")).select(
        "sequence_id", "length", F.unhex(F.array_join(F.col("parts.ids"), "")).alias("ids"))

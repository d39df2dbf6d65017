"""Near-duplicate documents by a chosen-path set similarity join.

Each document is the set of its word shingles, embedded as ``COORDINATES`` minwise
values.  A tree node is a set of documents that agree on the coordinates on its path:

* the root of each tree branches on two coordinates of its own, a deeper node on 1/threshold
  coordinates on average, by a hash of its path, out of those that only this tree
  has for this level.  A pair at the threshold keeps one common child on average, a closer
  pair more, others die out;
* a node is compared exhaustively once little is left to compare in it: documents
  already linked to each other need no comparison, so what counts is how many
  documents lie outside its largest class.  Sketches of one byte a coordinate are compared in
  tiles; a tile gives the few pairs that may reach the threshold or, where most may, all its texts, whose
  common shingles are counted by matrix products;
* every node first compares its members with one hub, which joins large groups
  of near copies without comparing all pairs of them;
* no two trees or levels share a coordinate, so a pair at the threshold is missed with probability
  (1 - p)^trees, with p the chance that it meets in a leaf of one tree (``trees_for``).  The deeper
  the largest node has to be split, the smaller p; documents in large nodes get as many further
  trees as the recall asked for needs at that depth.

Pairs whose sizes or the sketch's minwise values rule the threshold out (by five standard
deviations) are left aside; all others are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from anchorline.llm.common import connected_components, one_row_per_id, written
from anchorline.session import discard
from anchorline.llm.words import PACKED, Words, mix, pack, powers, text_slices, unpack, window_hashes, windows_inside

COORDINATES = 64
#: Trees that all documents enter; their roots also name the hubs.
TREES = 6
#: A node is compared exhaustively if at most so many documents lie outside its largest class.
OUTSIDE = 2048
#: Documents a hub is compared with in one task step.
BLOCK = 64
#: Members of a node's largest class in one tile, beside all that lie outside it.
TILE = 512
#: Shingles on one side of a block of texts.
SHINGLES = 1 << 21
#: Members of a large node's main class that those outside it are held against in one turn.
HUBS = 8


def _sets(offsets, data, k: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; a shorter text is one shingle."""
    w = Words(offsets, data)
    hashes = w.hashes(lower=True)
    shingles = window_hashes(hashes, k)
    ok = windows_inside(w.first, k, len(shingles))
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(shingles[a:b - k + 1][ok[a:b - k + 1]]))
        elif b > a:
            out.append(mix(np.array([window_hashes(hashes[a:b], b - a)[0] + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers(n: int = COORDINATES, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _children(percent: int) -> tuple[int, float]:
    """Coordinates that a node always branches on, and the chance of one more."""
    return 100 // percent, 100 / percent - 100 // percent


def depth_for(outside: int, percent: int) -> int:
    """Levels until ``outside`` documents, each less similar than the threshold, are ``OUTSIDE`` on average."""
    if outside <= OUTSIDE:
        return 0
    return COORDINATES if percent >= 100 else min(COORDINATES, math.ceil(math.log(outside / OUTSIDE) / math.log(100 / percent)))


def trees_for(percent: int, recall: float, depth: int) -> int:
    """Trees after which a pair at the threshold has met in a leaf, ``depth`` levels below a root, with probability ``recall``."""
    always, chance = _children(percent)
    s, met = percent / 100, 1.0
    for _ in range(depth):
        met = 1 - (1 - s * met) ** always * (1 - chance * s * met)
    missed = (1 - s * met) ** 2     # by the two coordinates of one root
    return 1 if missed <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(missed)))


def _sketch(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key_a", pa.int64()),
                        ("key_b", pa.int64()), ("mins", pa.binary()), ("low", pa.binary())])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in text_slices(batch.column(1)):
                sets = _sets(offsets, data, k)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                full = np.flatnonzero(sizes)
                at = (np.cumsum(sizes) - sizes)[full]
                mins = _mins(sets)
                keys = np.zeros((2, len(sets)), np.uint64)
                if len(full):
                    within = np.arange(len(flat)) - np.repeat(at, sizes[full])
                    for j, base in enumerate((0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)):
                        keys[j, full] = np.add.reduceat(flat * powers(base, int(sizes.max()))[within], at)
                raw, low = mins.tobytes(), mins.astype(np.uint8).tobytes()
                step = 4 * COORDINATES
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(sets)), pa.array(sizes),
                    pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                    pa.array([raw[i * step:(i + 1) * step] for i in range(len(sets))], pa.binary()),
                    pa.array([low[i * COORDINATES:(i + 1) * COORDINATES] for i in range(len(sets))], pa.binary())],
                    schema=schema)
    return run


def _agreeing(least: int):
    """Rows (a, b, mins_a, mins_b) whose minwise values agree ``least`` times, as (a, b, agree)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
            agree = (x == y).sum(1).astype(np.int32)
            enough = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).filter(enough) for i in (0, 1)], pa.array(agree).filter(enough)],
                                             names=["a", "b", "agree"])
    return run


def _mins(sets: list[np.ndarray], odds: np.ndarray | None = None) -> np.ndarray:
    odds = _multipliers() if odds is None else odds
    out = np.zeros((len(sets), len(odds)), np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat, at = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
        for c, odd in enumerate(odds):
            out[full, c] = np.minimum.reduceat(flat * odd, at) >> np.uint64(32)
    return out


def _fresh(k: int, first: int, depth: int, each: int):
    """Minwise values of packed texts, none of them one of the sketch's: ``first`` for roots (level -1), ``each`` a level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = _multipliers(first + depth * each, 11)
        cuts = [0, *range(first, first + depth * each + 1, each)]
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = unpack(part.column(1).to_pylist(), part.column(2).to_pylist())
                mins = _mins([_sets(np.array([0, len(t)]), np.frombuffer(t, np.uint8), k)[0] for t in texts], odds)
                for level, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), -1):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([m[a:b].tobytes() for m in mins], pa.binary()),
                         pa.array(np.full(len(mins), level, np.int32))], names=["doc", "fresh", "level"])
    return run


def _least_agreeing(percent: int) -> int:
    """Coordinates that a pair at the threshold agrees on but for five standard deviations."""
    expected = COORDINATES * percent / 100
    return int(expected - 5 * (expected * (1 - percent / 100)) ** 0.5)


def _common(sets: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each (rows, columns) of document numbers, how many shingles each row shares with each column.

    Only shingles that several documents hold count, a slice of them at a time in a 0/1 matrix.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = often[column] > 1
    of, column = of[kept], (np.cumsum(often > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = [np.zeros((len(a), len(b)), np.float32) for a, b in pairs]
    wide = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        part = slice(*np.searchsorted(column, [at, at + wide]))
        held = np.zeros((len(sets), wide), np.float32)
        held[of[part], column[part] - at] = 1
        for total, (a, b) in zip(out, pairs):
            total += held[a] @ held[b].T
    return out


def _joined(n: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least document number reachable within a block over (rows, columns, linked)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for a, b, linked in found:
            if linked.any():
                label[a] = np.minimum(label[a], np.where(linked, label[b][None, :], n).min(1))
                label[b] = np.minimum(label[b], np.where(linked, label[a][:, None], n).min(0))
        if (label == before).all():
            return label


def _compare(k: int, percent: int):
    """Links of one block: its left documents against its right ones, and in a block that
    says so against each other.  Documents of one class are not compared.  Few pairs are looked at one by
    one, leaving out classes that grow together here; many at once, and give one link per document."""
    def run(block: pa.Table) -> pa.Table:
        texts = unpack(block["size"].to_pylist(), block["packed"].to_pylist())
        docs, labels = block["doc"].to_numpy(), block["label"].to_numpy()
        side, among = block["side"].to_numpy(), block["among"][0].as_py()
        sets = [_sets(np.array([0, len(t)]), np.frombuffer(t, np.uint8), k)[0] for t in texts]
        size = np.array([len(s) for s in sets], np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        grids = [g for g in ((left, right), *([(left, left)] if among else [])) if len(g[0]) and len(g[1])]
        asked = [(labels[a][:, None] != labels[b][None, :])
                 & (100 * np.minimum(size[a][:, None], size[b][None, :]) >= percent * np.maximum(size[a][:, None], size[b][None, :]))
                 for a, b in grids]
        asked = [np.triu(ask) if a is b else ask for (a, b), ask in zip(grids, asked)]
        if sum(int(x.sum()) for x in asked) > 16 * len(docs):
            found = [(a, b, ask & (100 * n >= percent * (size[a][:, None] + size[b][None, :] - n)))
                     for (a, b), ask, n in zip(grids, asked, _common(sets, grids))]
            label = _joined(len(docs), found)
            some = np.flatnonzero(label != np.arange(len(docs)))
            return pa.table({"a": pa.array(docs[some], pa.int64()), "b": pa.array(docs[label[some]], pa.int64())})
        root = {label: label for label in labels.tolist()}

        def find(label):
            while root[label] != label:
                root[label] = label = root[root[label]]
            return label
        linked = []
        for (x, y), ask in zip(grids, asked):
            for i, j in zip(*np.nonzero(ask)):
                i, j = int(x[i]), int(y[j])
                a, b = find(int(labels[i])), find(int(labels[j]))
                if a != b:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (size[i] + size[j] - common):
                        root[a] = b
                        linked.append((int(docs[i]), int(docs[j])))
        return pa.table({"a": pa.array([x for x, _ in linked], pa.int64()), "b": pa.array([y for _, y in linked], pa.int64())})
    return run


_TILE = "block long, doc long, other long, side int, label long, among boolean"


def _tile(percent: int):
    """One tile of sketches: pairs (doc, other), or blocks of texts where more than four pairs a document may be linked."""
    def chunks(rows: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        part = (np.cumsum(n[rows]) - 1) // SHINGLES
        return [rows[part == x] for x in np.unique(part)]

    def run(tile: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(tile["low"].to_pylist()), np.uint8).reshape(tile.num_rows, -1)
        doc, n, label, apart = (tile[c].to_numpy() for c in ("doc", "n", "label", "apart"))
        left, right, among = np.flatnonzero(apart), np.flatnonzero(~apart), tile["among"][0].as_py()
        may = np.zeros((len(doc), len(doc)), bool) if among else np.zeros((len(left), len(doc)), bool)
        place = np.arange(len(doc)) if among else np.searchsorted(left, np.arange(len(doc)))
        against = np.arange(len(doc)) if among else right
        for at in range(0, len(left), 64):
            a = left[at:at + 64]
            agree = (low[a][:, None, :] == low[against][None, :, :]).sum(2)
            may[np.ix_(place[a], against)] = (
                (agree >= _least_agreeing(percent)) & (label[a][:, None] != label[against][None, :])
                & (100 * np.minimum(n[a][:, None], n[against][None, :]) >= percent * np.maximum(n[a][:, None], n[against][None, :])))
        x, y = np.nonzero(may[place[left]])
        x = left[x]
        once = ~apart[y] | (x < y)
        x, y = x[once], y[once]
        if len(x) <= 4 * len(doc):
            none = pa.nulls(len(x), pa.int64())
            return pa.table([none, pa.array(np.minimum(doc[x], doc[y])), pa.array(np.maximum(doc[x], doc[y])),
                             none.cast(pa.int32()), none, none.cast(pa.bool_())],
                            names=["block", "doc", "other", "side", "label", "among"])
        hit = np.zeros(len(doc), bool)
        hit[x] = hit[y] = True
        lefts, rights = (chunks(s[hit[s]], n) for s in (left, right))
        if len(lefts) <= 1 and len(rights) <= 1:
            blocks = [(lefts[0], rights[0] if rights else right[:0], among)]
        else:
            blocks = [(a, b, False) for a in lefts for b in rights]
            if among:
                blocks += [(a, b if i != j else a[:0], i == j) for i, a in enumerate(lefts) for j, b in enumerate(lefts) if i <= j]
        out = []
        for i, (a, b, inside) in enumerate(blocks):
            rows = np.r_[a, b]
            name = mix(np.array([tile["block"][0].as_py()], np.int64).view(np.uint64) + np.uint64(i)).view(np.int64)[0]
            out.append(pa.table({"block": np.full(len(rows), name), "doc": doc[rows], "other": pa.nulls(len(rows), pa.int64()),
                                 "side": np.r_[np.zeros(len(a), np.int32), np.ones(len(b), np.int32)], "label": label[rows],
                                 "among": np.full(len(rows), inside)}))
        return pa.concat_tables(out)
    return run


def _star_blocks(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as blocks of a hub and about ``BLOCK`` partners."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK))
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(per, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), blocks)).alias("block"))
    none = F.lit(False).alias("among")
    right = dealt.select("block", F.col("b").alias("doc"), F.lit(1).alias("side"), F.col("b").alias("label"), none)
    left = dealt.select("block", F.col("a").alias("doc"), F.lit(0).alias("side"), F.col("a").alias("label"), none)
    return right.unionByName(left.distinct())


def _confirmed(blocks: DataFrame, packed: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) within blocks, on the full sets; a block is all that a task step holds.

    Texts meet the blocks in a sort-merge join at every size of input.
    """
    return (blocks.hint("merge").join(packed, "doc").groupBy("block")
            .applyInArrow(_compare(k, percent), "a long, b long"))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("doc"))
    named = labels.select(F.col("node").alias("doc"), F.col("component").alias("label"))
    return rows.join(named, "doc", "left").withColumn("label", F.coalesce("label", "doc"))


def _with_mins(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``agree``, without those that cannot reach the threshold."""
    side = lambda x: sketches.select(
        F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("mins").alias(f"mins_{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            # a filter on a column of its own would have Spark work it out twice, in two Python workers a task
            .select("a", "b", "mins_a", "mins_b").mapInArrow(_agreeing(_least_agreeing(percent)), "a long, b long, agree int"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (node, doc, n, label) of nodes with several classes, with the node's size, its largest
    class (main) and how many documents lie outside it."""
    counts = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
    state = (counts.groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("top"))
             .where("size > top.c").select("node", "size", (F.col("size") - F.col("top.c")).alias("outside"),
                                           F.col("top.label").alias("main")))
    return rows.join(state, "node")


def _closest(pairs: DataFrame, n: int) -> DataFrame:
    """Of pairs (a, b, agree) the ``n`` that agree most for each b."""
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("agree"), "a"))
    return pairs.withColumn("place", place).where(F.col("place") <= n).select("a", "b")


def _gathering(nodes: DataFrame, labels: DataFrame | None, sketches: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b): documents outside the main class of a large node with the closest of a few of its members."""
    wide = _mixed(_labelled(nodes.select("node", "doc", "n"), labels)).where(F.col("outside") > OUTSIDE)
    wide = written(wide)
    inside = F.col("label") == F.col("main")
    x = wide.where(~inside).select("node", F.col("doc").alias("b"), F.col("n").alias("nb"))
    few = F.pmod(F.xxhash64("node", "doc", F.lit(turn)), F.ceil((F.col("size") - F.col("outside")) / HUBS)) == 0
    hubs = wide.where(inside & few).select("node", F.col("doc").alias("a"), F.col("n").alias("na"))
    pairs = (x.join(hubs, "node").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
             .select("a", "b").distinct())
    return written(_closest(_with_mins(pairs, sketches, percent), 3))


def _forest(nodes: DataFrame, labels: DataFrame | None, packed: DataFrame, k: int, percent: int,
            recall: float) -> tuple[DataFrame, DataFrame | None, int]:
    """``nodes`` with the further trees' roots, fresh minwise values (doc, fresh, level) of the documents in large
    nodes, and the depth.

    A pair of which one document is in no large node has been left to leaves by all its roots.
    """
    nodes = nodes.select("node", "tree", "doc", "n")
    wide = written(_mixed(_labelled(nodes, labels)).where(F.col("outside") > OUTSIDE).select("doc", "n", "outside"))
    largest = wide.agg(F.max("outside")).first()[0]
    if largest is None:
        return nodes, None, 0
    depth = depth_for(largest, percent)
    trees = max(TREES, trees_for(percent, recall, depth))
    first, (always, _) = 2 * (trees - TREES), _children(percent)
    docs = wide.select("doc", "n").distinct()
    each = trees * (always + 1)
    # merged, as a broadcast would have texts packed and read by two Python workers a task
    fresh = written(docs.select("doc").hint("merge").join(packed, "doc").select("doc", "size", "packed").mapInArrow(
        _fresh(k, first, depth, each), "doc long, fresh binary, level int"), partition_by=["level"])
    if trees == TREES:
        return nodes, fresh, depth
    roots = F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(2 * (t - TREES) + i).alias("c"))
                      for t in range(TREES, trees) for i in (0, 1)])
    more = docs.join(fresh.where("level = -1"), "doc").select("doc", "n", "fresh", F.explode(roots).alias("r")).select(
        F.xxhash64(F.lit("further"), "r.tree", "r.c", F.expr("substring(fresh, 4 * r.c + 1, 4)")).alias("node"),
        F.col("r.tree").alias("tree"), "doc", "n")
    return nodes.unionByName(written(more)), fresh, depth


def _leaves(nodes: DataFrame, fresh: DataFrame | None, depth: int, labels: DataFrame | None,
            low: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What is left to compare in the trees: pairs (a, b) of documents that tiny leaves hold, and what
    tiles of the other leaves give (columns of ``_TILE``).

    A leaf is a node with at most ``OUTSIDE`` documents outside its largest class.  Each of these is compared
    with all others there: the class is dealt into tiles of about ``TILE``,
    and those outside go to every tile, so rows stay in proportion to the leaf.
    Other nodes branch; one that is still large after ``depth`` levels is compared as it is.  A level's
    rows go once the next one stands.
    """
    pairs, tiles, mixed = [], [], None
    always, chance = _children(percent)
    rows = _labelled(nodes.select("node", "tree", "doc", "n"), labels)
    for level in range(depth + 1):
        mixed = written(_mixed(rows), instead_of=mixed)
        leaf = mixed if level == depth else mixed.where(F.col("outside") <= OUTSIDE)
        tiny = F.col("outside") * F.col("size") <= 4 * BLOCK
        x = leaf.where(tiny & (F.col("label") != F.col("main"))).select(
            "node", F.col("doc").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"))
        y = leaf.where(tiny).select("node", F.col("doc").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"))
        pairs.append(written(x.join(y, "node").where("lx <> ly")
                             .where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
                             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
        parts = F.ceil((F.col("size") - F.col("outside")) / TILE).cast("int")
        apart = F.col("label") != F.col("main")
        own = F.when(apart, F.sequence(F.lit(0), parts - 1)).otherwise(
            F.array(F.pmod(F.xxhash64("doc"), parts).cast("int")))
        dealt = (leaf.where(~tiny).join(low, "doc")
                 .select("node", "doc", "n", "label", "low", apart.alias("apart"), F.explode(own).alias("part"))
                 .select(F.xxhash64("node", "part").alias("block"), "doc", "n", "label", "low", "apart",
                         (F.col("part") == 0).alias("among")))
        tiles.append(written(dealt.groupBy("block").applyInArrow(_tile(percent), _TILE)))
        wide = mixed.where(F.col("outside") > OUTSIDE)
        if level == depth or wide.isEmpty():
            break
        one_more = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(1000)) < round(1000 * chance)
        own = lambda i: (F.col("tree") * (always + 1) + i).cast("int")
        chosen = F.array(*[own(i) for i in range(always)], F.when(one_more, own(always)))
        rows = (wide.select("node", "tree", "doc", "n", "label", F.explode(F.array_compact(chosen)).alias("c"))
                .join(fresh.where(F.col("level") == level).select("doc", "fresh"), "doc")
                .select(F.xxhash64("node", "c", F.expr("substring(fresh, 4 * c + 1, 4)")).alias("node"),
                        "tree", "doc", "n", "label"))
    discard(mixed)
    return reduce(DataFrame.unionByName, pairs).distinct(), reduce(DataFrame.unionByName, tiles)


def near_duplicate_classes(docs: DataFrame, shingle: int = 5, percent: int = 80, recall: float = 0.999) -> DataFrame:
    """One row per doc_id: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their
    distinct ``shingle``-word shingles (A-Z as a-z; words are runs of characters other
    than space and \\x09-\\x0D).  A text of fewer words is one shingle; null, empty and
    blank texts have no shingle and are linked with nothing.  ``component_id`` is the
    least doc_id reachable over links, ``kept`` says that it is the document itself.
    A link at exactly the threshold is found with probability ``recall`` at least, closer ones more surely.

    Texts with equal sets are one class whatever their number; only one of each class
    enters the trees.  Rows without a doc_id are left out; of rows that share one, the
    row with the least text counts.  Other columns of ``docs`` are not read; an empty
    table gives an empty result.
    """
    docs = one_row_per_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    sketches = written(docs.mapInArrow(
        _sketch(shingle), "doc_id long, n_shingles long, key_a long, key_b long, mins binary, low binary"))
    key = ["n_shingles", "key_a", "key_b"]
    classes = (sketches.where("n_shingles > 0").groupBy(*key)
               .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    one = written(sketches.join(classes, key).where("doc_id = first_id")
                  .select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "mins", "low"))
    roots = F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(c).alias("c"))
                      for t in range(TREES) for c in (2 * t, 2 * t + 1)])
    nodes = one.select("doc", "n", "mins", F.explode(roots).alias("r")).select(
        F.xxhash64("r.tree", "r.c", F.expr("substring(mins, 4 * r.c + 1, 4)")).alias("node"),
        F.col("r.tree").alias("tree"), "doc", "n")
    hubs = (nodes.groupBy("node").agg(F.min(F.struct(F.xxhash64("tree", "doc"), F.col("doc").alias("doc"),
                                                     F.col("n").alias("n"))).alias("hub"),
                                      F.count(F.lit(1)).alias("size"))
            .where("size > 1").select("node", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n")))
    nodes = written(nodes.join(hubs, "node"))
    stars = (nodes.where("hub <> doc")
             .where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
             .select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct())
    stars = written(_with_mins(stars, one, percent))
    packed = docs.mapInArrow(pack, PACKED).withColumnRenamed("doc_id", "doc")
    # each document with its two closest hubs; what that leaves apart is compared further down
    tried = written(_closest(stars, 2))
    links = written(_confirmed(_star_blocks(tried), packed, shingle, percent))
    labels = None if links.isEmpty() else connected_components(links)
    turn, known = 0, tried
    while True:     # large nodes join their main class as long as that takes in half of those outside
        turn += 1
        near = _gathering(nodes, labels, one, percent, turn).join(known, ["a", "b"], "left_anti")
        if near.isEmpty():
            break
        known = known.unionByName(near)
        found = written(_confirmed(_star_blocks(near), packed, shingle, percent))
        joined, asked = found.select("b").distinct().count(), near.select("b").distinct().count()
        if joined:
            links = links.unionByName(found)
            labels = connected_components(links)
        if 2 * joined < asked:
            break
    known = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs, tiles = _leaves(*_forest(nodes, labels, packed, shingle, percent, recall), labels,
                           one.select("doc", "low"), percent)
    close = tiles.where("block IS NULL").select(F.col("doc").alias("a"), F.col("other").alias("b"))
    pairs = _with_mins(pairs.join(known, ["a", "b"], "left_anti"), one, percent).select("a", "b")
    pairs = written(pairs.unionByName(close.join(known, ["a", "b"], "left_anti")).distinct())
    rest = written(_star_blocks(pairs).unionByName(
        tiles.where("block IS NOT NULL").select("block", "doc", "side", "label", "among")))
    if not rest.isEmpty():
        more = written(_confirmed(rest, packed, shingle, percent))
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))
    member = (sketches.join(classes.select(*key, "first_id"), key, "left")
              .select("doc_id", "n_shingles", F.coalesce("first_id", "doc_id").alias("first_id")))
    if labels is None:
        out = member.withColumn("component_id", F.col("first_id"))
    else:
        out = (member.join(labels.select(F.col("node").alias("first_id"), "component"), "first_id", "left")
               .withColumn("component_id", F.coalesce("component", "first_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      (F.col("doc_id") == F.col("component_id")).alias("kept"))

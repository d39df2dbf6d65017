"""Packing, centroid clustering and source divergence against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.llm import best_fit_packing, centroid_clustering, source_divergence
from anchorline.llm.queries import QUERIES
from tests.llm.test_text import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")


# --- packing -----------------------------------------------------------------

def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_pieces(rows, capacity):
    encode = library().encode
    out = []
    for i, text in rows:
        ids = np.array(encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out += [(i, n, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()))
                for n, a in enumerate(range(0, len(ids), capacity))]
    return out


def brute_sequences(lengths, capacity):
    """How many sequences item by item: large ones matched, then best fit, longest first."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    rooms = []
    while large:
        a = large.pop(0)
        fits = [n for n in large if n <= capacity - a]
        if fits:
            large.remove(fits[0])
        rooms.append(capacity - a - (fits[0] if fits else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        least = min((r for r in rooms if r >= n), default=None)
        if least is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(least)] = least - n
    return len(rooms)


def assert_packed(rows, capacity):
    """Every sequence is filled from 0 without gaps; returns the number of sequences."""
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing_against_brute_force(docs, monkeypatch, capacity):
    monkeypatch.setattr(best_fit_packing, "ROWS_PER_PART", 5)
    rows = list(enumerate(ODD)) + [(100 + i, "word " * (i * 7 % 90)) for i in range(200)] + [(None, "x y"), (3, "a"), (3, "a")]
    rows.append((500, "very long text " * 40_000))
    out = best_fit_packing.pack_documents(docs(rows, length="clash", row=1), public_tokenizers.path("word_bpe_49k.json"), capacity).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=key)
    want = sorted(brute_pieces(rows, capacity), key=key)
    assert got == want
    assert assert_packed(out, capacity) == brute_sequences([w[3] for w in want], capacity)


def test_plans_of_random_lengths():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        capacity = int(rng.choice([1, 2, 3, 10, 100, 999]))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 300)).tolist() + [int(rng.integers(1, capacity + 1))] * int(rng.integers(0, 400))
        plan = best_fit_packing.Plan(collections.Counter(lengths), capacity)
        assert plan.sequences == brute_sequences(lengths, capacity) >= math.ceil(sum(lengths) / capacity)
        held = collections.Counter()
        segments = sorted(plan.segments)
        for n, many in collections.Counter(lengths).items():
            mine = [s for s in segments if s[0] == n]
            ends = [s[1] for s in mine[1:]] + [many]
            for (_, rank, first, each, offset), end in zip(mine, ends):
                for j in range(end - rank):
                    held[first + j // each] += n
        assert max(held.values()) <= capacity and len(held) == plan.sequences


def test_segments_do_not_grow_with_the_documents():
    rng = np.random.default_rng(0)
    few = collections.Counter(rng.integers(1, 2049, 20_000).tolist())
    many = {n: c * 1_000_003 for n, c in few.items()}
    plan = best_fit_packing.Plan(many, 2048)
    assert len(plan.segments) < 30_000
    total = sum(n * c for n, c in many.items())
    assert plan.sequences <= 1.01 * total / 2048


def test_packing_of_the_table_and_its_sequences(spark):
    root = "/root/testdata/sf0.01"
    rows = QUERIES["op13_best_fit_packing"](spark, root).collect()
    docs = spark.read.parquet(f"{root}/documents.parquet")
    want = brute_pieces([(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    tokens = sum(w[3] for w in want)
    assert assert_packed(rows, 2048) == brute_sequences([w[3] for w in want], 2048) <= math.ceil(tokens / 2048) + 2
    packed = best_fit_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)
    whole = best_fit_packing.sequences(packed).collect()
    assert sum(r["length"] for r in whole) == tokens and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    crc = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in rows}
    ids = {r["sequence_id"]: r["ids"] for r in whole}
    for r in packed.select("doc_id", "piece", "sequence_id", "offset", "length").limit(300).collect():
        part = bytes(ids[r["sequence_id"]])[4 * r["offset"]:4 * (r["offset"] + r["length"])]
        assert zlib.crc32(part) == crc[r["doc_id"], r["piece"]]


def test_packing_edges(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert best_fit_packing.pack_documents(docs([]), path).count() == 0
    with pytest.raises(ValueError):
        best_fit_packing.pack_documents(docs([]), path, capacity=0)
    r = best_fit_packing.pack_documents(docs([(1, None)]), path).collect()
    assert [(x["doc_id"], x["piece"], x["start"], x["length"], x["sequence_id"], x["offset"]) for x in r] == [(1, 0, 0, 1, 0, 0)]


# --- clustering --------------------------------------------------------------

def brute_clusters(rows, k=8, rounds=10, size=64, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if i is not None and v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(),
                                                          np.array(r[1], "<i4").tobytes()))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, q)), c) for c, q in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (_, own) in zip(kept, found) if own == c]
            if mine:
                centroids[c] = [sum(column) // len(mine) for column in zip(*mine)]
    found = assign()
    inertia = [sum(d for d, own in found if own == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, q)).encode()).hexdigest() for q in centroids]
    return sorted((i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, found))


def result(df):
    return sorted((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def vector_rows(size):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(6):
        middle = rng.normal(size=size)
        rows += [(100 * g + i, (middle + rng.normal(size=size) * 0.2).tolist()) for i in range(40)]
    rows += [(700 + i, rows[0][1]) for i in range(120)] + [rows[0], rows[0], (rows[1][0], rows[2][1])]     # one vector holds a third
    rows += [(900, None), (901, []), (902, [1.0] * (size - 1)), (903, [float("nan")] + [0.0] * (size - 1)), (904, [None] + [0.0] * (size - 1)),
             (905, [float("inf")] * size), (906, [0.0] * size), (907, [-1e-9] * size), (None, [1.0] * size), (908, [500.0] + [0.0] * (size - 1))]
    return rows


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_clusters_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(centroid_clustering, "ROWS", 50)
    rows = vector_rows(12)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                               "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    out = centroid_clustering.cluster_vectors(df, size=12, bits=bits, sample=100)
    assert result(out) == brute_clusters(rows, size=12)
    assert all(hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest() == r["centroid_sha256"] for r in out.collect())


def test_clusters_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroid_clustering.cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    assert centroid_clustering.cluster_vectors(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    few = [(i, [float(i % 2)] * 64) for i in range(3)] + [(5, [0.0] * 64)]      # equal centroids: the first takes all
    assert result(centroid_clustering.cluster_vectors(spark.createDataFrame(few, schema))) == brute_clusters(few)
    with pytest.raises(Exception, match="64 bits"):
        centroid_clustering.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], schema))
    with pytest.raises(ValueError):
        centroid_clustering.cluster_vectors(spark.createDataFrame(few, schema), bits=9)


def test_intervals_hold_and_decide():
    """What the cells leave as the only centroid is the nearest one, and for separate clusters they decide most."""
    rng = np.random.default_rng(4)
    middles = rng.integers(-2000, 2000, (8, 64))
    x = (middles[rng.integers(0, 8, 4000)] + rng.integers(-300, 300, (4000, 64))).astype(np.int64)
    cells = centroid_clustering.Cells(x[:500], x.min(0), x.max(0), 4)
    now = centroid_clustering.Assignment(cells, [m.tolist() for m in middles] + [middles[0].tolist()])
    at = cells.of(x)
    low, high = np.take_along_axis(cells.low.T, at.astype(int), 0), np.take_along_axis(cells.high.T, at.astype(int), 0)
    assert ((low <= x) & (x <= high)).all()
    found, sure = now.by_cells(at)
    exact, distance = now.exact(x)
    assert (found[sure] == exact[sure]).all() and sure.mean() > 0.95
    assert (distance == ((x - middles[exact]) ** 2).sum(1)).all()


# --- divergence --------------------------------------------------------------

def brute_divergence(rows, least=3, top=200):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
             for lang, source, text in rows]
    out = []
    for lang in {t[0] for t in texts}:
        own = [t for t in texts if t[0] == lang]
        held = collections.Counter(w for t in own for w in set(t[2]))
        kept = [w for w, n in held.items() if n >= least]
        counts = {s: collections.Counter(w for t in own if t[1] == s for w in t[2]) for s in {t[1] for t in own}}
        whole = collections.Counter(w for t in own for w in t[2])

        def shares(c):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 1000000000 * (c[w] + 1) // total for w in kept}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = [(-sum(gap(p[s][w], p[o][w]) for w in kept), o.encode()) for o in counts if o != s]
            words = [(-gap(p[s][w], q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out += [(lang, s, part, item.decode(), -value, n) for n, (value, item) in enumerate(items, 1)]
    return sorted(out)


def divergence_rows():
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("der", "Ha", "Zé", "mot", "x") for b in "abcdefghij"]
    rows = [(str(rng.choice(["en", "de", "fr"])), f"s{rng.integers(0, 6)}",
             " ".join(rng.choice(words, rng.integers(0, 40))) + "  1,2_3; --") for _ in range(150)]
    rows += [("en", "s0", "hot hot Hot " * 50)] * 80       # a source with a third of the rows, repeated
    rows += [("en", "empty", None), ("en", "void", "123 !!"), ("solo", "one", "a a b"), ("solo", "one", "a b"), ("solo", "one", "a b c"),
             (None, None, "été Été"), (None, "s1", "été"), ("", "s2", "été été ß"), ("none", "a", "q"), ("none", "b", "r"),
             ("en", "Ä", "dera"), ("de", None, "dera " * 30_000)]
    return rows


@pytest.mark.parametrize("least,top,block", [(3, 200, 20_000), (2, 4, 7)])
def test_divergence_against_brute_force(spark, monkeypatch, least, top, block):
    monkeypatch.setattr(source_divergence, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(source_divergence, "TEXT_BYTES", 3000)
    rows = divergence_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, term string").repartition(4)
    out = source_divergence.divergence(df, min_docs=least, top=top)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in out.collect()) == brute_divergence(rows, least, top)


def test_divergence_edges(spark):
    schema = "lang string, source string, text string"
    assert source_divergence.divergence(spark.createDataFrame([], schema)).count() == 0
    got = source_divergence.divergence(spark.createDataFrame([(None, "a", None), ("", "b", "x")], schema)).collect()
    assert sorted((r["source"], r["item"], r["value"], r["rank"]) for r in got) == [("a", "b", 0, 1), ("b", "a", 0, 1)]


def test_shares_are_exact_for_large_counts(spark):
    big = spark.createDataFrame([(10 ** 13, 3 * 10 ** 13 + 7)], "n long, total long")
    p = big.select(source_divergence._share(F.col("n"), F.col("total"))).first()[0]
    assert p == 1 + 10 ** 9 * (10 ** 13 + 1) // (3 * 10 ** 13 + 7)

"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from anchorline.llm import embedding_dedup
from tests.llm import brute


def answer(rows):
    good = {i: np.array(v, float) for i, v in rows
            if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    ids = sorted(good)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                links.append((a, b))
    comp = brute.components([i for i, _ in rows], links)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i]) for i, _ in rows}


def vectors():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)]
    for g in range(5):
        base = rng.normal(size=16)
        rows += [(100 + 40 * g + i, (base + rng.normal(size=16) * 0.12 * (1 + g % 2)).tolist()) for i in range(40)]
    rows += [(900 + i, rows[0][1]) for i in range(30)] + [(950, [2 * x for x in rows[0][1]])]
    rows += [(960, None), (961, []), (962, [0.0] * 16), (963, [float("nan")] * 16), (964, [float("inf")] + [1.0] * 15),
             (965, [None] + [1.0] * 15), (966, [1.0, 0.0]), (967, [1.0, 0.01]), (968, [1e300] * 16), (969, [-1e300] * 16)]
    return rows


@pytest.mark.parametrize("tile", [256, 7])
def test_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, bucket string")
    out = embedding_dedup.near_duplicate_vectors(df, bits=6)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    assert got == answer(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.collect())


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"])
                 for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1, 1), (2, 1, 1)]


def test_recall_sets_the_tables():
    n = embedding_dedup.tables_for(0.95, 14, 0.999)
    agree = (1 - math.acos(0.95) / math.pi) ** 14
    assert 1 - (1 - agree) ** n >= 0.999 > 1 - (1 - agree) ** (n - 1)


def test_bits_follow_the_vectors():
    assert [embedding_dedup.bits_for(n) for n in (0, 1, 10_000, 1 << 18, 1 << 20, 1 << 30, 1 << 40)] == [14, 14, 14, 14, 16, 26, 30]

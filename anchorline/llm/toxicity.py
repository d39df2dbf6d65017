"""Toxicity by a chain of linear classifiers.

Categories are predicted in order; each model is a logistic regression that sees, beside
the text's features, the probabilities of the categories before it.  While training these
come from models that have not seen the row (out of fold), as they will for new texts.

Features are whether a word, one of its beginnings of four to six bytes, or a run of signs occurs; each category
keeps those that speak for it most clearly (chi-squared), few enough to travel to every task.
Models are fitted on a bounded sample of the labelled rows; all texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.common import written
from anchorline.llm.words import LETTERS, NOT_SPACE, Words, text_slices

BEGINNINGS = (None, 4, 5, 6)
#: Bytes of text whose features a task holds at a time.
SLICE_BYTES = 1 << 19
SIGNS = NOT_SPACE & ~LETTERS & ~np.isin(np.arange(256), list(b"0123456789"))


def _features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of a slice and the text number of each."""
    w = Words(offsets, data, LETTERS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    found, of = [], []
    for n in BEGINNINGS:
        some = slice(None) if n is None else np.flatnonzero(w.ends - w.starts > n)
        found.append((w.hashes(lower=True, bytes_=n) + np.uint64(n or 0))[some])
        of.append(text[some])
    signs = Words(offsets, data, SIGNS)
    found.append(signs.hashes())
    of.append(np.repeat(np.arange(len(offsets) - 1), np.diff(signs.first)))
    return np.concatenate(found), np.concatenate(of)


def _distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is text, with their distinct feature hashes in its place, a slice of text at a time."""
    for batch in batches:
        for row, offsets, data in text_slices(batch.column(batch.num_columns - 1), SLICE_BYTES):
            found, of = _features(offsets, data)
            order = np.lexsort((found, of))
            found, of = found[order], of[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
            found, of = found[new], of[new]
            edges = np.searchsorted(of, np.arange(len(offsets))).astype(np.int32)
            part = batch.slice(row, len(offsets) - 1)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*batch.schema.names[:-1], "features"])


def _fit(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression by Newton steps; the last column of ``x`` is ones."""
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    weights = np.zeros(x.shape[1])
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    weights[-1] = np.log(rate / (1 - rate))

    def value(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (ridge * w ** 2).sum() / 2)
    loss = value(weights)
    while True:
        p = 1 / (1 + np.exp(-(x @ weights)))
        spread = np.maximum(p * (1 - p), 1e-6).astype(x.dtype)
        hessian = (x.T @ (x * spread[:, None])).astype(float)
        hessian[np.diag_indices_from(hessian)] += ridge
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * weights)
        while (now := value(weights + step)) > loss and np.abs(step).max() > 1e-9:
            step = step / 2
        if loss - now <= 1e-7 * (1 + abs(loss)):
            return weights
        weights, loss = weights + step, now


def _logit(z: np.ndarray) -> np.ndarray:
    return np.clip(z, -8, 8)


class Chain:
    """Feature hashes (sorted) and, per category, weights of features, earlier categories and bias."""

    def __init__(self, categories: Sequence[str], features: np.ndarray):
        self.categories, self.features = list(categories), features
        self.models: list[np.ndarray] = []

    def fit(self, x: np.ndarray, own: np.ndarray, labels: np.ndarray, fold: np.ndarray, penalty: float) -> Chain:
        """``x`` rows by features, true or false, ``own`` categories by features: which ones a category's model sees."""
        earlier = np.zeros((len(x), 0), np.float32)
        for k in range(len(self.categories)):
            y = labels[:, k].astype(float)
            seen = np.empty((len(x), own[k].sum() + k + 1), np.float32)     # the one matrix of numbers that is held
            seen[:, :own[k].sum()] = x[:, own[k]]
            seen[:, own[k].sum():-1] = earlier
            seen[:, -1] = 1
            fitted = _fit(seen, y, penalty)
            weights = np.zeros(x.shape[1] + k + 1)
            weights[np.flatnonzero(np.r_[own[k], np.ones(k + 1, bool)])] = fitted
            self.models.append(weights)
            if k + 1 < len(self.categories):
                out_of_fold = np.zeros(len(y))
                for f in np.unique(fold):
                    rest, left_out = fold != f, fold == f
                    without = _fit(seen[rest], y[rest], penalty) if rest.any() else fitted
                    out_of_fold[left_out] = seen[left_out, :-1] @ without[:-1] + without[-1]
                earlier = np.concatenate([earlier, _logit(out_of_fold)[:, None].astype(np.float32)], axis=1)
        return self

    def probabilities(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """One row per text of a slice, one column per category; zeros if nothing was learnt."""
        texts = len(offsets) - 1
        out = np.zeros((texts, len(self.categories)))
        if not self.models:
            return out
        n = len(self.features)
        found, of = _features(offsets, data)
        at = np.minimum(np.searchsorted(self.features, found), max(n - 1, 0))
        hit = np.flatnonzero(self.features[at] == found) if n else np.zeros(0, np.int64)
        pairs = np.unique(of[hit] * max(n, 1) + at[hit])
        earlier = np.zeros((texts, 0))
        for k, weights in enumerate(self.models):
            z = np.bincount(pairs // max(n, 1), weights[pairs % max(n, 1)], texts) if len(pairs) else np.zeros(texts)
            z = z + earlier @ weights[n:-1] + weights[-1]
            out[:, k] = 1 / (1 + np.exp(-z))
            earlier = np.concatenate([earlier, _logit(z)[:, None]], axis=1)
        return out


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str],
          sample: int = 20_000, features: int = 512, evidence: float = 10.0, least: int = 3, folds: int = 5, penalty: float = 0.1) -> Chain:
    """A chain fitted on at most about ``sample`` labelled rows, chosen by a hash of doc_id.

    ``labels`` holds doc_id and 0/1 columns named by ``categories``.  Rows with a null label or doc_id
    are not used; of rows that share a doc_id or a text the largest labels count, and of equal texts one is used.  Each category
    sees at most ``features`` features, each in ``least`` rows and with a chi-squared of at least ``evidence``.  Without usable rows
    the chain gives probability 0.
    """
    usable = labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ("doc_id", *categories)))
    n = usable.count()
    part = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1))))
    chosen = written(part.select("doc_id", *categories).limit(2 * sample)   # the bound on what is broadcast
                     .groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in categories]))
    same = F.md5(F.coalesce("text", F.lit(""))).alias("same")
    # one row per distinct text, found without shuffling texts
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), same).join(F.broadcast(chosen), "doc_id")
    single = written(found.groupBy("same").agg(F.min("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in categories]))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), same, "text")
             .join(F.broadcast(single), ["doc_id", "same"]).select("doc_id", "same", *categories, "text"))
    fields = ", ".join(f"`{c}` int" for c in categories)
    rows = written(texts.mapInArrow(_distinct_features, f"doc_id long, same string, {fields}, features array<long>"))
    if rows.count() > single.count():       # a row of docs that is there more than once
        rows = written(rows.dropDuplicates(["same"]), instead_of=rows)
    total, *positive = rows.agg(F.count(F.lit(1)), *[F.sum(c) for c in categories]).first()
    if not total:
        return Chain(categories, np.zeros(0, np.uint64))
    counts = written(rows.select(F.explode("features").alias("feature"), *categories).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).where(F.col("n") >= least))
    clear = []
    for c, p in zip(categories, positive):
        ahead = F.col(c) * F.lit(float(total)) - F.col("n") * F.lit(float(p))
        spread = F.col("n") * (total - F.col("n")) * F.lit(float(max(p * (total - p), 1)))
        signal = F.when((ahead > 0) & (spread > 0), ahead * ahead / spread * total)
        best = (counts.select("feature", signal.alias("signal")).where(F.col("signal") >= evidence)
                .orderBy(F.desc("signal"), "feature").limit(features).toArrow()["feature"])
        clear.append(best.to_numpy().astype(np.int64).view(np.uint64))
    kept = np.unique(np.concatenate(clear))
    own = np.stack([np.isin(kept, c) for c in clear])
    wanted = F.array(*[F.lit(int(x)) for x in kept.view(np.int64)]).cast("array<bigint>")
    few = rows.select("doc_id", *categories, F.array_intersect("features", wanted).alias("features")
                      ).orderBy("doc_id").toArrow()
    lists = few["features"].combine_chunks()
    x = np.zeros((few.num_rows, len(kept)), bool)
    of = np.repeat(np.arange(few.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    x[of, np.searchsorted(kept, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))] = True
    y = np.stack([few[c].to_numpy() for c in categories], axis=1)
    return Chain(categories, kept).fit(x, own, y, np.arange(few.num_rows) % folds, penalty)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with p_<category> for every category of the chain.

    Row by row: null and empty texts have no features and get the chain's base rate.  Columns
    of ``docs`` with the same names as new ones are replaced, all others are carried along.
    """
    @F.arrow_udf("array<double>")
    def probabilities(texts: pa.Array) -> pa.Array:
        out = [chain.probabilities(offsets, data) for _, offsets, data in text_slices(texts, SLICE_BYTES)]
        flat = np.concatenate(out).ravel() if out else np.zeros(0)
        many = len(chain.categories)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * many), pa.array(flat))
    names = [f"p_{c}" for c in chain.categories]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    scored = docs.select(*kept, probabilities("text").alias("_p"))
    return scored.select(*kept, *[F.col("_p")[i].alias(name) for i, name in enumerate(names)])

"""Scoring by a log-bilinear neural language model trained with noise-contrastive estimation.

Tokens are words (A-Z as a-z) and one end per text.  The model predicts a class from the two
tokens before it.  Classes follow the counted vocabulary: of V distinct words about 2 V^(1/3), the most frequent, are
classes of their own, and as many classes share all others: words are ordered by their last two bytes,
and this order is cut into classes of equal counts, so that what a word's ending says of its language and kind stays.
The context's representation is the sum of its
classes' vectors, each scaled per position; a class scores by its product with that plus a bias.

* Word counts come from all training texts; a word is known by a 64-bit hash.
* Training is a fixed number of rounds, each over the texts that a hash of doc_id gives it.  In a round another hash deals
  them out to shards of about ``SHARD`` tokens; every shard goes on from the same model in numpy, by
  distinct (context, class) counts with samples of the class frequencies as noise, and the models
  are averaged by tokens.  How the table is split into partitions changes nothing.
* Scoring takes one matrix product per block of distinct contexts, which gives the normaliser over
  all classes.  A word of a shared class takes its share of the class by counts, (c + 0.1) /
  (sum + 0.1 (distinct + 1)), so probabilities sum to one over all words, seen or not.

Counts of the ``HEAD_WORDS`` most frequent words travel to the tasks, a bounded table; counts of
all others are joined by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.common import one_row_per_id, written
from anchorline.llm.words import PACKED, Words, pack, text_slices, unpack

HEAD_WORDS, SUFFIXES = 65_536, 65_536
WIDTH, NOISE, STEP, RATE = 32, 64, 512, 0.1
#: Rounds of fitting and averaging, and about how many tokens a shard has in one of them.
ROUNDS, SHARD = 4, 2_000_000
#: Bytes of text per step, which bounds the contexts held at a time.
SLICE = 4 << 20
_LOWER = np.arange(256)
_LOWER[65:91] += 32
END = np.uint64(0x454E44)   # stands for the end of a text among the hashes of words
SMOOTHING = 0.1


def _tokens(offsets: np.ndarray, data: np.ndarray):
    """Hash, last two bytes and text number of every token of a slice, an end after each text."""
    w = Words(offsets, data)
    n, texts = len(w.starts), len(offsets) - 1
    sizes = np.diff(w.first)
    at = np.arange(n) + np.repeat(np.arange(texts), sizes)
    hashes = np.full(n + texts, END, np.uint64)
    hashes[at] = w.hashes(lower=True)
    suffix = np.zeros(n + texts, np.int64)
    before = np.where(w.ends - w.starts > 1, _LOWER[data[np.maximum(w.ends - 2, 0)]], 0)
    suffix[at] = _LOWER[data[w.ends - 1]] * 256 + before
    return hashes, suffix, np.repeat(np.arange(texts), sizes + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: list[tuple[np.ndarray, ...]] = []
        for _, offsets, data in text_slices(batch.column(1), SLICE):
            hashes, suffix, _ = _tokens(offsets, data)
            words, first, n = np.unique(hashes, return_index=True, return_counts=True)
            seen.append((words, suffix[first], n))
        if seen:
            words, suffix, n = (np.concatenate(c) for c in zip(*seen))
            distinct, first, back = np.unique(words, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array(suffix[first].astype(np.int32)),
                 pa.array(np.bincount(back, n, len(distinct)).astype(np.int64))], names=["word", "suffix", "n"])


class Classes:
    """Classes of words and what their counts say; small enough to travel to every task."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, suffixes: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        """``head``: hashes of frequent words, most frequent first, with their counts and suffixes.

        ``words`` and ``tokens`` are, by suffix, how many distinct words and tokens there are.
        """
        wanted = int(np.ceil(2 * max(words.sum(), 1) ** (1 / 3)))
        mine = min(wanted, len(head))
        self.words, self.size = mine, mine + wanted
        order = np.argsort(head)
        self.head, self.counts = head[order], counts[order]
        self.own = np.where(order < mine, order, -1)    # a head word's own class, if it has one
        words = words - np.bincount(suffixes[:mine], minlength=SUFFIXES)
        tokens = tokens - np.bincount(suffixes[:mine], counts[:mine], SUFFIXES)
        upto = np.cumsum(tokens)
        middle = (upto - tokens / 2) / max(upto[-1], 1)
        self.of_suffix = mine + np.minimum((middle * wanted).astype(np.int64), wanted - 1)
        totals = np.zeros(self.size)
        totals[:mine] = counts[:mine]
        totals += np.bincount(self.of_suffix, tokens, self.size)
        distinct = np.bincount(self.of_suffix, words, self.size)
        self.share = (totals + SMOOTHING) / (totals + SMOOTHING).sum()
        self.norm = np.where(np.arange(self.size) < mine, 0.0, np.log10(totals + SMOOTHING * (distinct + 1)))
        end = np.searchsorted(self.head, END)
        own = int(self.own[end]) if end < len(head) and self.head[end] == END else -1
        self.end = own if own >= 0 else int(self.of_suffix[0])

    def look_up(self, hashes: np.ndarray, suffix: np.ndarray):
        """Class of each token, its count, and whether the count is known here."""
        shared = self.of_suffix[suffix]
        if not len(self.head):
            none = np.zeros(len(hashes), bool)
            return shared, none.astype(np.int64), none
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        known = self.head[at] == hashes
        own = np.where(known, self.own[at], -1)
        return np.where(own >= 0, own, shared), np.where(known, self.counts[at], 0), known

    def contexts(self, classes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """The two classes before each token as one number; before a text there are ends."""
        one = np.full(len(classes), self.end)
        two = one.copy()
        one[1:] = np.where(texts[1:] == texts[:-1], classes[:-1], self.end)
        two[2:] = np.where(texts[2:] == texts[:-2], classes[:-2], self.end)
        return two * self.size + one


class LogBilinear:
    """vectors of context classes, of predicted classes with biases, and scales per position."""

    def __init__(self, share: np.ndarray):
        rng = np.random.default_rng(3)
        self.size = len(share)
        self.seen = rng.normal(0, 0.1, (self.size, WIDTH)).astype(np.float32)
        self.said = rng.normal(0, 0.1, (self.size, WIDTH)).astype(np.float32)
        self.bias = np.log(share).astype(np.float32)
        self.scale = np.ones((2, WIDTH), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.seen, self.said, self.bias[:, None], self.scale]

    def represent(self, contexts: np.ndarray) -> np.ndarray:
        return self.scale[0] * self.seen[contexts % self.size] + self.scale[1] * self.seen[contexts // self.size]


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by class."""
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    out = np.zeros((size, values.shape[1]), np.float32)
    out[sorted_[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps over weighted (context, class) counts."""

    def __init__(self, share: np.ndarray, state: np.ndarray | None = None, seed: int = 5):
        """``state``: what ``rows`` of another trainer gave, to go on from."""
        self.model = LogBilinear(share)
        self.heaps = [np.full_like(p, 1e-3) for p in self.model.parameters()]
        if state is not None:
            flat, at = state.astype(np.float32).ravel(), 0
            for p in self.model.parameters() + self.heaps:
                p[:] = flat[at:at + p.size].reshape(p.shape)
                at += p.size
        self.cdf = np.cumsum(share)
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def rows(self) -> np.ndarray:
        """All parameters and step sizes as rows of WIDTH numbers."""
        flat = np.concatenate([p.ravel() for p in self.model.parameters() + self.heaps])
        return np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)

    def fit(self, contexts: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> None:
        order = self.rng.permutation(len(counts))
        for at in range(0, len(order), STEP):
            part = order[at:at + STEP]
            self._step(contexts[part], classes[part], counts[part].astype(np.float32))

    def _step(self, contexts, classes, counts) -> None:
        m = self.model
        weight = counts / counts.sum()
        noise = np.searchsorted(self.cdf, self.rng.random(NOISE) * self.cdf[-1]).clip(0, m.size - 1)
        one, two = contexts % m.size, contexts // m.size
        seen_one, seen_two = m.seen[one], m.seen[two]
        here = m.scale[0] * seen_one + m.scale[1] * seen_two
        said = m.said[classes]
        real = (here * said).sum(1) + m.bias[classes] - self.log_noise[classes]
        fake = here @ m.said[noise].T + m.bias[noise] - self.log_noise[noise]
        pull = -weight / (1 + np.exp(np.clip(real, -30, 30)))
        push = weight[:, None] / (1 + np.exp(np.clip(-fake, -30, 30)))
        to_here = pull[:, None] * said + push @ m.said[noise]
        change = _sums(np.r_[classes, noise], np.concatenate([
            np.concatenate([pull[:, None] * here, pull[:, None]], axis=1),
            np.concatenate([push.T @ here, push.sum(0)[:, None]], axis=1)]), m.size)
        seen = _sums(np.r_[one, two], np.concatenate([m.scale[0] * to_here, m.scale[1] * to_here]), m.size)
        scale = np.stack([(to_here * seen_one).sum(0), (to_here * seen_two).sum(0)])
        for p, heap, g in zip(m.parameters(), self.heaps, (seen, change[:, :WIDTH], change[:, WIDTH:], scale)):
            heap += g * g
            p -= RATE * g / np.sqrt(heap)


def _train_shard(known: Classes, state: np.ndarray | None):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc_id", "ascending")])
        trainer, tokens = Trainer(known.share, state, 5 + shard["shard"][0].as_py()), 0
        sizes = shard["size"].to_numpy()
        at = 0
        while at < len(sizes):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE, side="right")) + at)
            texts = unpack(sizes[at:upto].tolist(), shard["packed"].slice(at, upto - at).to_pylist())
            hashes, suffix, of = _tokens(np.r_[0, np.cumsum(sizes[at:upto])], np.frombuffer(b"".join(texts), np.uint8))
            classes, _, _ = known.look_up(hashes, suffix)
            pairs, n = np.unique(known.contexts(classes, of) * known.size + classes, return_counts=True)
            trainer.fit(pairs // known.size, pairs % known.size, n)
            tokens += len(hashes)
            at = upto
        rows = trainer.rows()
        return pa.table({"row": pa.array(np.arange(len(rows), dtype=np.int32)), "tokens": pa.array(np.full(len(rows), float(tokens))),
                         "vector": pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), WIDTH).cast(pa.list_(pa.float32()))})
    return run


def _log10_probabilities(model: LogBilinear, contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(contexts, return_inverse=True)
    here = model.represent(distinct)
    norm = np.empty(len(distinct), np.float32)
    for at in range(0, len(distinct), 4096):
        scores = here[at:at + 4096] @ model.said.T
        scores += model.bias
        top = scores.max(1, keepdims=True)
        scores -= top
        np.exp(scores, out=scores)
        norm[at:at + 4096] = np.log(scores.sum(1)) + top[:, 0]
    out = np.empty(len(contexts))
    for at in range(0, len(contexts), 1 << 17):
        part = slice(at, at + (1 << 17))
        out[part] = (np.einsum("ij,ij->i", here[back[part]], model.said[classes[part]])
                     + model.bias[classes[part]] - norm[back[part]])
    return out / np.log(10)


def _score(known: Classes, state: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trainer(known.share, state).model
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, offsets, data in text_slices(batch.column(1), SLICE):
                hashes, suffix, texts = _tokens(offsets, data)
                n_texts = len(offsets) - 1
                classes, counts, found = known.look_up(hashes, suffix)
                model_part = _log10_probabilities(model, known.contexts(classes, texts), classes)
                shared = classes >= known.words
                share = np.where(found, np.log10(counts + SMOOTHING), 0.0)
                model_part += np.where(shared, share - known.norm[classes], 0.0)
                total = lambda x: np.bincount(texts, x, n_texts)
                # words whose counts are not here: (text, word) with how often
                rare = np.flatnonzero(~found)
                order = rare[np.lexsort((hashes[rare], texts[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (texts[order][1:] != texts[order][:-1])
                starts = np.flatnonzero(new)
                often = np.diff(np.r_[starts, len(order)]).astype(np.int32)
                cuts = np.searchsorted(texts[order][starts], np.arange(n_texts + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row:row + n_texts]), pa.array(np.bincount(texts, minlength=n_texts)),
                     pa.array(total(found.astype(float)).astype(np.int64)),
                     pa.array(total(share)), pa.array(total(model_part)),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[order][starts].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(often))],
                    names=["doc_id", "n_tokens", "n_known", "share", "score", "rare", "often"])
    return run


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words, ``HEAD_WORDS`` at most, their counts and suffixes; ties fall together."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = sorted(((r["level"], r["words"]) for r in
                     counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    room, least = HEAD_WORDS, None
    for at, words in levels:    # a few hundred levels whatever the corpus
        if words > room:
            break
        room, least = room - words, at
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(level >= least).select("word", "n", "suffix").toArrow()
    words = rows["word"].to_numpy().astype(np.int64).view(np.uint64)
    n = rows["n"].to_numpy().astype(np.int64)
    order = np.lexsort((words, -n))
    return words[order], n[order], rows["suffix"].to_numpy().astype(np.int64)[order]


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per doc_id: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id as text) mod 10 is 0 are held out; all others train.  ``base_score`` sums
    log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens, with c the token's count, N all and V the distinct
    training tokens; ``n_known`` counts tokens with c > 0, ``train_tokens`` is N.  ``score`` is
    the model's log10 probability of the text and its end.

    Null and empty texts are an end alone.  Rows without a doc_id are left out; of rows
    that share one, the row with the least text counts.  Other columns are not read.  If no
    text trains, every count is 0 and the model is uniform over its classes.
    """
    base = one_row_per_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    train = base.where(remainder != 0)
    counts = written(train.mapInArrow(_count, "word long, suffix int, n long")
                     .groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n")))
    words, tokens = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for r in counts.groupBy("suffix").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect():
        words[r["suffix"]], tokens[r["suffix"]] = r["words"], r["tokens"]       # a row per suffix
    n_all, distinct = int(tokens.sum()), int(words.sum())
    known = Classes(*_head(counts), words, tokens)

    shards, state = max(1, round(n_all / (ROUNDS * SHARD))), None
    weighted = [F.sum(F.col("vector")[i] * F.col("tokens")) / F.sum("tokens") for i in range(WIDTH)]
    for turn in range(ROUNDS):
        texts = (train.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(ROUNDS)) == turn).mapInArrow(pack, PACKED)
                 .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(shards))))
        fitted = (texts.groupBy("shard").applyInArrow(_train_shard(known, state), "row int, tokens double, vector array<float>")
                  .groupBy("row").agg(F.array(*weighted).alias("vector")).orderBy("row").toArrow())   # one model
        if fitted.num_rows:
            state = np.array(fitted["vector"].to_pylist())

    scored = written(base.mapInArrow(
        _score(known, state), "doc_id long, n_tokens long, n_known long, share double, score double, "
                             "rare array<long>, often array<int>"))
    rare = scored.select("doc_id", F.explode(F.arrays_zip("rare", "often")).alias("x")).select(
        "doc_id", F.col("x.rare").alias("word"), F.col("x.often").alias("often"))
    rare = rare.join(counts.select("word", "n"), "word", "left").groupBy("doc_id").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("often")).otherwise(0)).alias("more_known"),
        F.sum(F.col("often") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("more"))
    out = scored.drop("rare", "often").join(rare, "doc_id", "left")
    more = F.coalesce("more", F.lit(0.0))
    norm = float(np.log10(n_all + SMOOTHING * (distinct + 1)))
    return out.select(
        "doc_id", (remainder == 0).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("share") + more - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("score") + more).alias("score"))

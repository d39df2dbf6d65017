"""Exact token counts at every prefix of a text by dynamic programming over prefixes.

Every prefix of a word has one byte-pair encoding, and it ends in the one token that
fits behind the encoding of the shorter prefix.  So one pass over a word gives the last
token and the token count of all its prefixes: at each byte the tokens that end there
are tried, shortest first, until one is compatible with the last token before it.  Two
tokens are compatible if no merge would have joined their touching parts before
they were complete, which depends on these two only and is remembered.

The counts are kept as one step (difference to the byte before) per byte, so the
count at any byte is a running sum, and truncation or budget questions need no
encoding.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from anchorline.llm.common import worker_state
from anchorline.llm.vocabulary import Merges, byte_symbols

#: Words whose steps a worker remembers, and pairs of tokens; both are emptied when full.
WORDS_KEPT, PAIRS_KEPT = 600_000, 1_000_000
#: Fixed value: how this kind of vocabulary splits text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixCounter(dict):
    """word -> its steps as int16 bytes, filled as words are met."""

    def __init__(self, path: str):
        import regex
        super().__init__()
        self.merges = Merges(path)
        back = {c: b for b, c in enumerate(byte_symbols())}
        self.tokens = {bytes(back[c] for c in token): i for token, i in self.merges.ids.items()
                       if all(c in back for c in token)}
        # -1 for what is no token but ends one
        self.endings = {token[k:]: -1 for token in self.tokens for k in range(len(token))} | self.tokens
        self.pairs: dict[int, bool] = {}    # by first token << 20 | second
        self.words = regex.compile(SPLIT)
        self.specials = {s: np.array([1] + [0] * (len(s.encode()) - 1), "<i2").tobytes()
                         for s in self.merges.specials}
        self.split = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
                                    + ")") if self.specials else None)

    def compatible(self, u: int, t: int) -> bool:
        """Whether token ``t`` may follow token ``u``."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        known = self.pairs[u << 20 | t] = self._compatible(u, t)
        return known

    def _compatible(self, u: int, t: int) -> bool:
        m = self.merges
        before_u = len(m.rank)
        while u is not None:
            part, before_t = t, len(m.rank)
            while part is not None:
                rank = m.rank.get((u, part))
                if rank is not None and rank < before_u and rank <= before_t:
                    return False
                before_t, part = m.made.get(part), m.left.get(part)
            before_u, u = m.made.get(u), m.right.get(u)
        return True

    def counts(self, word: bytes) -> list[int]:
        """Token counts of all prefixes, the empty one first."""
        endings, known = self.endings, self.pairs.get
        last, count = [0], [0]
        for end in range(1, len(word) + 1):
            start = end - 1
            while True:
                t = endings[word[start:end]]
                if t >= 0:
                    if not start:
                        break
                    fits = known(last[start] << 20 | t)
                    if fits or fits is None and self.compatible(last[start], t):
                        break
                start -= 1
            last.append(t)
            count.append(count[start] + 1)
        return count

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        count = self.counts(word.encode())
        steps = self[word] = array("h", map(sub, count[1:], count)).tobytes()
        return steps

    def steps(self, text: str) -> bytes:
        """The steps of a whole text; special tokens' strings count one token each."""
        if self.split is None:
            return b"".join(map(self.__getitem__, self.words.findall(text)))
        parts = self.split.split(text)
        if len(parts) == 1:
            return b"".join(map(self.__getitem__, self.words.findall(text)))
        return b"".join(self.specials[p] if p in self.specials
                        else b"".join(map(self.__getitem__, self.words.findall(p))) for p in parts)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(("prefix counter", path), lambda: PrefixCounter(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                steps = [counter.steps(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) // 2 for s in steps], pa.int64()),
                    pa.array([int(np.frombuffer(s, "<i2").sum(dtype=np.int64)) for s in steps], pa.int64()),
                    pa.array(steps, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "prefix_steps"])
    return run


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, prefix_steps.

    ``path`` is a byte-level BPE file of the tokenizers library, readable on every
    worker.  ``prefix_steps`` holds a little-endian int16 per UTF-8 byte; the sum of the
    first k is the number of tokens of the first k bytes, with the text split into
    words (and special tokens, which count from their first byte) as a whole.  The sum of all is
    ``n_tokens``, the library's count without added tokens.

    Null texts count as empty: no bytes, no tokens.  Repeated rows and null ids are
    counted row by row.  Other columns of ``docs`` are not read.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _count(path), "doc_id long, n_bytes long, n_tokens long, prefix_steps binary")


def tokens_at(steps: Column | str, n_bytes: Column | str) -> Column:
    """Tokens of the first ``n_bytes`` bytes (of all, if there are fewer)."""
    @F.pandas_udf(T.LongType())
    def count(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(x, "<i2")[:max(0, k)].sum(dtype=np.int64)) for x, k in zip(s, n)])
    return count(steps, n_bytes)


def longest_prefix(steps: Column | str, budget: Column | str) -> Column:
    """Bytes of the longest prefix of at most ``budget`` tokens."""
    @F.pandas_udf(T.LongType())
    def length(s: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x, k in zip(s, n):
            fits = np.flatnonzero(np.cumsum(np.frombuffer(x, "<i2"), dtype=np.int64) <= k)
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(out)
    return length(steps, budget)

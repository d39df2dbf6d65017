"""Byte-pair encoding as a deterministic automaton over tokens.

The automaton starts with one state that every symbol leads back to.  Each merge (u, v),
in order, adds a gadget: the state that u leads to is copied without its arc for v, u
leads to the copy from now on, and the merged token gets an arc wherever u had one,
to where v leads.  What the finished automaton reads are exactly the encodings, and
as only one of them spells a given word, encoding is a walk: at each position
reached, the arcs whose labels continue the word lead on.  Decoding writes out the
labels of the arcs.

A copied state differs from its original in one arc, so it is stored as that one
removal and a link to the original, and arcs are resolved through the links when
they are first asked for: 49,000 merges stay 49,000 small records instead of 49,000 rows of
49,000 arcs.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.common import worker_state
from anchorline.llm.vocabulary import Merges, byte_symbols

#: Words and arcs a worker remembers; both are emptied when full.
WORDS_KEPT, ARCS_KEPT = 500_000, 1_000_000
#: Fixed value: how this kind of vocabulary splits lower-cased text; white space is dropped.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Automaton:
    """Token automaton of a merge table; state 0 is the start and accepts everything first."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.target = dict.fromkeys(merges.ids.values(), 0)  # where a token's arcs lead, from any state
        self.owner, self.born = [-1], [-1]      # of a copy: the token led to it, the merge it was made for
        self.start: dict[int, int] = {}         # token -> the state it led to before its first gadget
        self.cut: dict[tuple[int, int], int] = {}   # (owner, token whose arc its copies lack) -> since which merge
        self.arcs: dict[int, int] = {}          # resolved: by state << 20 | token
        for (u, v), order in merges.rank.items():
            self._gadget(u, v, order)
        self.labels = {i: label for label, i in merges.ids.items()}
        self.labels |= {i: label for label, i in merges.specials.items()}
        # -1 for what is no token but begins one
        self.beginnings = {label[:k]: -1 for label in merges.ids for k in range(1, len(label) + 1)} | merges.ids

    def _gadget(self, u: int, v: int, order: int) -> None:
        made = self.merges.token[u, v]
        if self.merges.made[made] == order:
            self.target[made] = self.target[v]  # for u = v: the state before it is copied
        self.start.setdefault(u, self.target[u])
        self.owner.append(u)
        self.born.append(order)
        self.cut[u, v] = order
        self.target[u] = len(self.owner) - 1

    def arc(self, state: int, token: int) -> int:
        """The state that ``token`` leads to from ``state``, -1 if there is no such arc."""
        if len(self.arcs) >= ARCS_KEPT:
            self.arcs.clear()
        known = self.arcs[state << 20 | token] = self._arc(state, token)
        return known

    def _arc(self, state: int, token: int) -> int:
        made, left, cut = self.merges.made, self.merges.left, self.cut
        while state:
            owner, born = self.owner[state], self.born[state]
            # a merged token got its arc where its left part had one when it was made
            part, until = token, born
            while part is not None:
                since = cut.get((owner, part))
                if since is not None and since <= born and since <= until:
                    return -1
                until, part = made.get(part, -1), left.get(part)
            state = self.start[owner]
        return self.target[token]

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-split word, written in byte symbols."""
        n, tokens, arcs, suffix = len(word), self.beginnings.get, self.arcs.get, self.merges.suffix
        state: list[int] = [0] + [-1] * n
        by: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for i in range(n):
            here = state[i]
            if here < 0:
                continue
            for j in range(i + 1, n):
                token = tokens(word[i:j])
                if token is None:
                    break
                if token >= 0 and state[j] < 0:
                    to = arcs(here << 20 | token)
                    if to is None:
                        to = self.arc(here, token)
                    if to >= 0:
                        state[j], by[j] = to, (i, token)
            else:
                if state[n] < 0:    # the last symbol of a word carries the word end
                    token = tokens(word[i:] + suffix, -1)
                    if token >= 0:
                        state[n], by[n] = self.arc(here, token), (i, token)
        out, at = [], n
        while at:
            at, token = by[at]
            out.append(token)
        return out[::-1]

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join([self.labels[i] for i in ids])


class WordCoder(dict):
    """word -> its ids as little-endian uint32 bytes, filled as words are met.

    Labels are looked up by text, not kept by word: of rare words a worker holds no more than the ids.
    """

    def __init__(self, path: str):
        import regex
        super().__init__()
        merges = Merges(path)
        self.automaton = Automaton(merges)
        self.symbols = byte_symbols()
        self.words = regex.compile(SPLIT)
        self.specials = {s: np.array([i], "<u4").tobytes() for s, i in merges.specials.items()}
        self.split = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
                                    + ")") if self.specials else None)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = array("I", self.automaton.encode("".join([self.symbols[b] for b in word.encode()]))).tobytes()
        return found

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("\u03a3", "\u03c3")  # lower case goes by character, without a final form
        return [self[w] for w in self.words.findall(text.lower())]

    def code(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of a whole text."""
        parts = self.split.split(text) if self.split is not None else [text]
        if len(parts) == 1:
            found = self._plain(text)
        else:
            found = [x for p in parts for x in ([self.specials[p]] if p in self.specials else self._plain(p))]
        ids = b"".join(found)
        return ids, self.automaton.decode(array("I", ids))


def _code(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state(("word coder", path), lambda: WordCoder(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = [coder.code(t) if t else (b"", "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(c[0]) // 4 for c in coded], pa.int64()),
                    pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.large_string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])
    return run


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids, decoded.

    ``path`` is a BPE file of the tokenizers library with word ends, lower case and white
    space dropped, readable on every worker.  ``ids`` are little-endian unsigned 32-bit integers, without
    added tokens; strings of special tokens in a text become their tokens.  ``decoded`` is
    what the library decodes from them: the labels with a space between.

    Null texts count as empty: no ids, empty text.  Repeated rows and null ids are coded row by
    row.  Other columns of ``docs`` are not read.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _code(path), "doc_id long, n_tokens long, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded text."""
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

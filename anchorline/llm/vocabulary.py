"""Merge tables of public tokenizer files, read inside tasks from a path given by the caller."""

from __future__ import annotations

import json


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """Ids by token, and for each token id the merge that makes it.

    ``rank[u, v]`` is the order of a merge and ``token[u, v]`` what it makes; ``made`` maps a
    token to the order of its merge, ``left`` and ``right`` to its parts; single symbols have none.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[int, int], int] = {}
        self.token: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for order, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            u, v = self.ids[a], self.ids[b]
            t = self.ids[(a[:-len(self.suffix)] if self.suffix and a.endswith(self.suffix) else a) + b]
            self.rank[u, v], self.token[u, v] = order, t
            if t not in self.made:
                self.made[t], self.left[t], self.right[t] = order, u, v

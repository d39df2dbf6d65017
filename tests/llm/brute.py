"""Plain Python answers the operators are held against; small inputs only."""

import hashlib
import re

SPACE = re.compile("[^\x20\x09-\x0d]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACE.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def substring_dedup(docs, n=20):
    """{doc_id: (n_words, n_removed, kept sha)}"""
    first, out = set(), {}
    for doc_id in sorted(docs):
        w = words(docs[doc_id])
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            window = tuple(w[i:i + n])
            if window in first:
                gone[i:i + n] = [True] * n
            first.add(window)
        kept = [x for x, g in zip(w, gone) if not g]
        out[doc_id] = (len(w), sum(gone), sha(" ".join(kept)))
    return out


def shingles(text, k):
    w = words((text or "").translate(ASCII_LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def near_duplicates(docs, k=4, percent=80):
    """{doc_id: (n_shingles, component)} from all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = {}
    for who in holders.values():
        for i, a in enumerate(who):
            for b in who[i + 1:]:
                common[a, b] = common.get((a, b), 0) + 1
    links = [(a, b) for (a, b), c in common.items()
             if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    comp = components(docs, links)
    return {i: (len(sets[i]), comp[i]) for i in docs}


def decontamination(docs, items, n=10):
    """{doc_id: (n_words, n_hit, n_items, items sha)}"""
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def split(text):
        return pattern.findall((text or "").translate(ASCII_LOWER))
    windows = {}
    for item_id, text in items:
        w = split(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(str(item_id))
    lengths = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs.items():
        w = split(text)
        hit, found = [False] * len(w), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                who = windows.get(tuple(w[i:i + k]))
                if who:
                    hit[i:i + k] = [True] * k
                    found |= who
        out[doc_id] = (len(w), sum(hit), len(found), sha(",".join(sorted(found))))
    return out

"""Substring, line and near-duplicate operators against plain Python."""

import random

import pyarrow as pa
import pytest

from anchorline.llm import line_dedup, minhash_join, substring_dedup
from tests.llm import brute

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def sentence(seed, n, vocabulary=WORDS):
    r = random.Random(seed)
    return " ".join(f"{r.choice(vocabulary)}{r.randrange(400)}" for _ in range(n))


def corpus():
    base, passage = sentence(1, 300), sentence(2, 60)
    rows = [(i, sentence(100 + i, 20 + 7 * i)) for i in range(20)]
    rows += [(100 + i, base) for i in range(30)]                                    # exact copies
    for i in range(60):                                                             # near copies, each different
        w = base.split()
        for j in random.Random(i).sample(range(300), 1 + i % 4):
            w[j] = f"changed{i}x{j}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{sentence(500 + i, 30)}\n{passage}\t{sentence(600 + i, 25)}") for i in range(40)]
    rows += [(400, None), (401, ""), (402, " \t\n "), (403, "one two"), (404, "One TWO"), (405, "one two"),
             (406, "x"), (407, "Été été nbsp \x0b vt \x1c fs"), (408, "rep " * 200), (409, "rep " * 50),
             (410, "a" * 70_000), (411, sentence(9, 9000))]
    return rows


def test_substring_against_brute_force(docs):
    rows = corpus()
    out = substring_dedup.remove_repeated_windows(docs(rows, n_words="clash", key=1, start=2), words=20, seed=10)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
    assert got == brute.substring_dedup(dict(rows))
    assert all(brute.sha(r["kept_text"]) == r["kept_sha256"] for r in out.collect())


@pytest.mark.parametrize("hot,words,seed", [(3, 20, 10), (3, 20, 5), (1000, 8, 1)])
def test_substring_hot_windows_and_levels(docs, monkeypatch, hot, words, seed):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = corpus()
    out = substring_dedup.remove_repeated_windows(docs(rows), words=words, seed=seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
    assert got == brute.substring_dedup(dict(rows), words)


def test_substring_edges(docs):
    with pytest.raises(ValueError):
        substring_dedup.remove_repeated_windows(docs([(1, "a")]), words=20, seed=7).collect()
    assert substring_dedup.remove_repeated_windows(docs([])).count() == 0
    same = sentence(3, 50)
    out = substring_dedup.remove_repeated_windows(docs([(1, same), (1, same), (2, same), (None, same), (2, "zz")]))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in out.collect())
    assert got == [(1, 50, 0), (2, 50, 50)]     # of rows with one id the least text counts


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_brute_force(docs, k):
    rows = corpus()
    out = minhash_join.near_duplicate_classes(docs(rows, n=1, node="clash", label=2), shingle=k, percent=80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == brute.near_duplicates(dict(rows), k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_near_duplicates_deep_trees(docs, monkeypatch):
    """Small leaves, so that nodes branch; groups below and around the threshold."""
    monkeypatch.setattr(minhash_join, "OUTSIDE", 1)
    monkeypatch.setattr(minhash_join, "HUBS", 2)
    rows = []
    for g in range(4):
        base = sentence(50 + g, 120).split()
        for i in range(40):
            w = list(base)
            for j in random.Random(1000 * g + i).sample(range(120), 3 + g):
                w[j] = f"c{g}x{i}x{j}"
            rows.append((1000 * g + i, " ".join(w)))
    out = minhash_join.near_duplicate_classes(docs(rows), shingle=4, percent=80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == brute.near_duplicates(dict(rows), 4)


@pytest.mark.parametrize("outside,shingles", [(4, 1 << 21), (None, 1 << 21), (None, 3000)])
def test_near_duplicates_recall_in_a_wide_group(docs, monkeypatch, outside, shingles):
    """Pairs just at the threshold among many documents of similarity 0.4 to 0.6."""
    monkeypatch.setattr(minhash_join, "OUTSIDE", outside or minhash_join.OUTSIDE)
    monkeypatch.setattr(minhash_join, "SHINGLES", shingles)
    base, rows = sentence(77, 400).split(), []
    for i in range(60):
        places = random.Random(i).sample(range(2, 398, 5), 23)      # no shingle holds two changes
        one = list(base)
        for j in places[:12]:
            one[j] = f"a{i}x{j}"
        two = list(one)
        for j in places[12:]:
            two[j] = f"b{i}x{j}"
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    want = brute.near_duplicates(dict(rows), 4)
    assert all(want[i][1] == i - i % 2 for i in want)
    out = minhash_join.near_duplicate_classes(docs(rows), shingle=4, percent=80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == want


@pytest.mark.parametrize("shingles", [1 << 21, 3000])
def test_near_duplicates_of_a_dense_group_that_is_not_linked(docs, monkeypatch, shingles):
    """Most pairs at a similarity of 0.75: too many for sketches to rule out, few links."""
    monkeypatch.setattr(minhash_join, "SHINGLES", shingles)
    monkeypatch.setattr(minhash_join, "TILE", 32)
    base, rows = sentence(78, 300).split(), []
    for i in range(150):
        w = list(base)
        for j in random.Random(i).sample(range(2, 298, 4), 10 + (i % 3 == 0) - 4 * (i % 50 == 0)):
            w[j] = f"d{i}x{j}"
        rows.append((i, " ".join(w)))
    want = brute.near_duplicates(dict(rows), 4)
    assert 1 < len({c for _, c in want.values()})
    out = minhash_join.near_duplicate_classes(docs(rows), shingle=4, percent=80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want


def test_blocks_of_texts_give_the_links_of_all_pairs():
    """The matrix path and the pair path of one block against plain sets."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(x if rng.random() > 0.03 else f"n{rng.random()}" for x in base) for _ in range(60)]
    sets = [set(zip(*[t.split()[k:] for k in range(4)])) for t in texts]
    for n_left, among in ((40, True), (40, False), (1, False)):
        block = pa.table({"doc": list(range(60)), "label": [i if i != 7 else 3 for i in range(60)],
                          "side": [0] * n_left + [1] * (60 - n_left), "among": [among] * 60, "size": [len(t) for t in texts],
                          "packed": [pa.compress(t.encode(), codec="zstd", asbytes=True) for t in texts]})
        got = minhash_join._compare(4, 80)(block).to_pydict()
        links = [(i, j) for i in range(60) for j in range(i) if (j < n_left) and (i >= n_left or among)
                 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and {i, j} != {3, 7}]
        same = [(3, 7)]
        assert brute.components(range(60), list(zip(got["a"], got["b"])) + same) == brute.components(range(60), links + same)


@pytest.mark.parametrize("percent", [80, 50, 90])
def test_trees_for_a_recall(percent):
    """The trees' misses over simulated branching stay within what was asked for."""
    r, s = random.Random(1), percent / 100
    always, chance = minhash_join._children(percent)

    def meets(depth):
        return not depth or any(r.random() < s and meets(depth - 1) for _ in range(always + (r.random() < chance)))
    trees = [minhash_join.trees_for(percent, 0.95, depth) for depth in (0, 4, 12)]
    assert trees == sorted(trees) and trees[0] < trees[2]
    for depth, n in zip((0, 4, 12), trees):
        missed = sum(not any(r.random() < s and meets(depth) for _ in range(2 * n)) for _ in range(1000))
        assert missed <= 75


def test_near_duplicates_edges(docs):
    assert minhash_join.near_duplicate_classes(docs([])).count() == 0
    out = minhash_join.near_duplicate_classes(docs([(5, None), (6, ""), (7, "a b"), (8, "A b"), (None, "a b"), (9, "b a")]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == {5: (0, 5), 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (1, 9)}


def brute_lines(docs, m, words=None):
    """A run is m lines, or (words given) one line of so many words."""
    solid = {i: [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")] for i, t in docs.items()}
    seen, gone = set(), {}
    for i in sorted(docs):
        lines = solid[i]
        marked = set()
        for p in range(len(lines) - m + 1):
            run = tuple(lines[p:p + m])
            if run in seen:
                marked.update(range(p, p + m))
            seen.add(run)
        for p, line in enumerate(lines):
            if words is not None and len(brute.words(line)) >= words:
                if ("alone", line) in seen:
                    marked.add(p)
                seen.add(("alone", line))
        gone[i] = marked
    return {i: ([x for p, x in enumerate(solid[i]) if p not in gone[i]], len(solid[i]), len(gone[i])) for i in docs}


def line_corpus():
    r = random.Random(4)
    pool = [sentence(i, 6) for i in range(15)] + ["License text.", "All rights reserved."]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.7 else f"own {i} {j}" for j in range(r.randrange(1, 30))))
            for i in range(60)]
    whole = "\n".join(pool)
    rows += [(100 + i, whole) for i in range(5)] + [(200, whole + "\n\n  \nmore"), (201, "x\n" + whole), (202, None),
                                                    (203, ""), (204, "\n\n"), (205, pool[0]), (206, pool[0])]
    return rows


@pytest.mark.parametrize("m", [1, 2, 3, 5, 8])
def test_lines_against_brute_force(docs, m):
    rows = line_corpus()
    out = line_dedup.remove_repeated_lines(docs(rows, rank=7, pos="clash", n_lines="old"), min_lines=m)
    want = brute_lines(dict(rows), m)
    for r in out.collect():
        kept = [x for x in (r["text"] or "").split("\n") if x.strip()]
        assert (kept, r["n_lines"], r["n_removed"]) == want[r["doc_id"]], r["doc_id"]
        assert (r["rank"], r["pos"]) == (7, "clash")
    assert out.columns == ["doc_id", "text", "rank", "pos", "n_lines", "n_removed"]


@pytest.mark.parametrize("m", [2, 8])
def test_long_single_lines_are_runs(docs, m):
    """A long line that stands between unique ones, or is a whole document, is cut where it comes again."""
    long, short = sentence(1, 60), sentence(2, 19)
    rows = [(i, f"own {i}\n{long}\n{short}\nmine {i}") for i in range(4)]
    huge = "word " * 300_000
    rows += [(8, huge), (9, f"{huge}\nown"), (10, long), (11, long), (12, short), (13, short), (14, f"{long}\n\n{long}"), (15, None)] + line_corpus()[:30:7]
    rows = [(n, text) for n, (_, text) in enumerate(rows)]
    out = line_dedup.remove_repeated_lines(docs(rows), min_lines=m, min_words=20)
    want = brute_lines(dict(rows), m, 20)
    for r in out.collect():
        assert ([x for x in (r["text"] or "").split("\n") if x.strip()], r["n_lines"], r["n_removed"]) == want[r["doc_id"]], r["doc_id"]
    assert sum(w[2] for w in want.values()) >= 6


def test_suffix_array_is_sorted(spark):
    rows = [(d, p, len(s) - p, ord(c)) for d, s in enumerate(["abababab", "babab", "abc", "ababab"]) for p, c in enumerate(s)]
    found = line_dedup.SuffixArray(spark.createDataFrame(rows, "doc_id long, pos int, left int, key long"))
    suffix = {(d, p): s[p:] for d, s in enumerate(["abababab", "babab", "abc", "ababab"]) for p in range(len(s))}
    got = {(r["doc_id"], r["pos"]): r["rank"] for r in found.ranks.collect()}
    assert got == {at: sum(o < s for o in suffix.values()) for at, s in suffix.items()}


def test_line_edges(docs):
    assert line_dedup.remove_repeated_lines(docs([])).count() == 0
    out = line_dedup.remove_repeated_lines(docs([(1, "a\nb"), (1, "a\nb"), (2, "a\nb\nc"), (None, "a\nb")]))
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect()) == [(1, "a\nb", 0), (2, "c", 2)]

"""What a task keeps in Python workers: one per task, and little per word."""

import re
import sys

import numpy as np
import pytest
from pyspark import SparkContext

import public_tokenizers
from anchorline.llm import bpe_automaton, line_dedup, minhash_join, toxicity
from tests.llm.test_plans import plans_of

PYTHON = re.compile(r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroups\w+|PythonUDTF")


def python_steps_in_stages(plan):
    """The largest number of Python steps on one path between exchanges, by the plan's indented tree."""
    path, most = [], 0      # (depth, steps since the last exchange above)
    for line in re.split(r"== (?:Initial Plan ==|Physical Plan ==\n\n)", plan)[0].split("\n"):
        name = re.match(r"[\s:+*|-]*(?:\(\d+\))?\s*", line).end()
        while path and path[-1][0] >= name:
            path.pop()
        steps = path[-1][1] if path else 0
        steps = 0 if re.match(r"(Broadcast)?Exchange|\w*QueryStage|TableCacheQueryStage", line[name:]) else steps + bool(PYTHON.match(line[name:]))
        path.append((name, steps))
        most = max(most, steps)
    return most


def test_near_duplicates_run_one_python_step_a_stage(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash_join, "OUTSIDE", 1)
    monkeypatch.setattr(minhash_join, "HUBS", 2)
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*common, *(f"v{x}" for x in rng.integers(0, 60, 8))])) for i in range(60)]
    plans = plans_of(spark, lambda: minhash_join.near_duplicate_classes(docs(rows)).collect())
    assert any("MapInArrow" in p for p in plans)
    assert max(map(python_steps_in_stages, plans)) == 1


def test_line_dedup_makes_no_python_rows(docs, monkeypatch):
    given = docs([(1, "a\nb\nc"), (2, "x\na\nb"), (3, "y")])
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("rows through Python workers"))
    out = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(given).collect()}
    assert out == {1: "a\nb\nc", 2: "x", 3: "y"}
    assert line_dedup.remove_repeated_lines(given.limit(0)).count() == 0


def test_word_coder_keeps_ids_only():
    coder = bpe_automaton.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, decoded = coder.code("Hello unbelievable qzxvé hello <|endoftext|> 42")
    assert len(ids) % 4 == 0 and decoded == coder.automaton.decode(np.frombuffer(ids, "<u4").tolist())
    assert "hello" in coder and coder.code("") == (b"", "")
    assert all(type(v) is bytes and sys.getsizeof(v) <= 33 + 4 * len(w.encode()) for w, v in coder.items())


def test_fit_holds_one_matrix_of_numbers(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((500, 30)) < 0.2
    y = np.stack([x[:, 0] | x[:, 1], x[:, 2] & x[:, 3]], axis=1).astype(int)
    seen = []
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda x, *a: seen.append(x) or fit(x, *a))
    own = np.ones((2, 30), bool)
    chain = toxicity.Chain(["a", "b"], np.arange(30, dtype=np.uint64)).fit(x, own, y, np.arange(500) % 5, 0.1)
    assert all(s.dtype == np.float32 and (s[:, -1] == 1).all() for s in seen)
    assert [len(m) for m in chain.models] == [31, 32]
    z = x @ chain.models[0][:30] + chain.models[0][-1]
    assert ((z > 0) == (y[:, 0] == 1)).all()

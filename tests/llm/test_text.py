"""Decontamination, tokenizers, language model, toxicity and page text."""

import collections
import math
import re
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.llm import bpe_automaton, decontamination, html_text, language_model, token_counts, toxicity
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", None, "   ", "a", "The quick brown fox, isn't it? 12345 café ÜBER ΣτελιοΣ İx",
       "<|endoftext|>", "x<|endoftext|> y<|startoftext|>  z <|endoftext|><|endoftext|>", "\n\n \t tabs\r\n\x0b\x0c\x85\xa0 ",
       "中文 日本語 한글 \U0001f600‍\U0001f469 é ﬁ", "a" * 9000, "ha" * 3000, " " * 700, "!?" * 900,
       "'s 't're 've'm 'll'd 'S", "under_score __init__ 3.14 1e-9 ٣٤ Ⅻ ½"]


def test_decontamination_against_brute_force(docs, spark):
    item = "One two, three FOUR five; six seven eight nine ten eleven twelve"
    items = [(1, item), (2, "short item here"), (3, "x"), (4, None), (5, ""), (6, item.lower()), (None, "nothing at all"), (7, "...")]
    rows = [(1, "start " + item + " end"), (2, "one two three four five six seven eight nine ten"),
            (3, "one two three four five six seven eight nine"), (4, "a Short-item_here b x"), (5, None), (6, ""),
            (7, " ".join([item] * 3)), (8, "Été café"), (9, ("pad " * 500 + item + " ") * 20), (10, "xx xé")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    out = decontamination.contamination(docs(rows, key=1, item="clash"), bench)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in out.collect()}
    assert got == brute.decontamination(dict(rows), [x for x in items if x[0] is not None])
    for r in out.collect():
        assert sum(s["length"] for s in r["spans"]) == r["n_hit"] and r["contaminated"] == (r["n_hit"] > 0)
        assert r["n_items"] == len(r["items"])


def test_decontamination_of_the_table(table):
    docs, bench = table("documents", "sf0.01"), table("benchmark", "sf0.01")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"])
           for r in decontamination.contamination(docs, bench).collect()}
    want = brute.decontamination({r["doc_id"]: r["text"] for r in docs.collect()},
                                 [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got == want and sum(w[1] > 0 for w in want.values()) > 0


def test_decontamination_large_sides_are_not_broadcast(docs, spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
        out = decontamination.contamination(docs([(1, "z a b c d e f g h i j z"), (2, "a b")]), bench)
        assert sorted((r["doc_id"], r["n_hit"]) for r in out.collect()) == [(1, 10), (2, 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decontamination_edges(docs, spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_hit"], r["items_sha256"]) for r in decontamination.contamination(docs([(1, "a b")]), empty).collect()] == [(0, brute.sha(""))]
    assert decontamination.contamination(docs([]), empty).count() == 0
    one = spark.createDataFrame([(1, "word")], "item_id long, text string")
    out = decontamination.contamination(docs([(1, "word"), (1, "word"), (None, "word")]), one)
    assert [(r["doc_id"], r["n_hit"]) for r in out.collect()] == [(1, 1)]


def texts(table):
    return ODD + [r["text"] for r in table("documents").collect()]


def test_token_counts_equal_the_library(docs, table):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rows = Tokenizer.from_file(path), list(enumerate(texts(table)))
    out = token_counts.prefix_counts(docs(rows + [(None, "x"), (0, None)], n_tokens=5), path)
    found = [r for r in out.collect() if r["doc_id"] is not None]
    assert len(found) == len(rows) + 1
    for r in found:
        text = dict(rows)[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
        assert len(r["prefix_steps"]) == 2 * r["n_bytes"]


def test_prefix_counts_equal_encoding_each_prefix(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    for word in ["unbelievableness", " antidisestablishmentarianism", "ahahahahahaha", " überstraße", "=====", " 1234567"]:
        ends = [len(word[:k].encode()) for k in range(len(word) + 1)]
        counts = counter.counts(word.encode())
        assert [counts[e] for e in ends] == [len(library.encode(word[:k], add_special_tokens=False).ids) for k in range(len(word) + 1)]
    df = spark.createDataFrame([(1, "Hello wonderful world, again and again")], "doc_id long, text string")
    out = token_counts.prefix_counts(df, path).select(
        token_counts.tokens_at("prefix_steps", F.lit(15)).alias("at"), token_counts.longest_prefix("prefix_steps", F.lit(3)).alias("cut"),
        token_counts.longest_prefix("prefix_steps", F.lit(0)).alias("none")).first()
    assert tuple(out) == (2, 21, 0)


def test_automaton_equals_the_library(docs, table):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library, rows = Tokenizer.from_file(path), list(enumerate(texts(table)))
    out = bpe_automaton.encode_and_decode(docs(rows + [(0, None)], ids="clash"), path)
    found = out.collect()
    assert len(found) == len(rows) + 1
    for r in found:
        ids = library.encode(dict(rows)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe_automaton.encode_and_decode(docs([]), path).count() == 0


def test_language_model(docs, table):
    rows = [(r["doc_id"], r["text"]) for r in table("documents").collect()] + [(9001, None), (9002, ""), (9003, "zzzunseen qqqnever")]
    out = language_model.score_texts(docs(rows + [(None, "x")], word="clash", n=1)).collect()
    tokens = {i: brute.words((t or "").translate(brute.ASCII_LOWER)) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    count = collections.Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    assert len(out) == len(rows)
    for r in out:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), n)
        assert r["n_known"] == sum(count[w] > 0 for w in own) and r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
    kept = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)


def test_language_model_is_normalised():
    rng = np.random.default_rng(0)
    size = 150
    model = language_model.LogBilinear(np.full(size, 1 / size))
    model.seen, model.said = (rng.normal(size=m.shape).astype(np.float32) for m in (model.seen, model.said))
    classes = np.arange(size)
    for context in (0, 5 * size + 7):
        p = language_model._log10_probabilities(model, np.full(len(classes), context), classes)
        assert (10 ** p).sum() == pytest.approx(1, abs=1e-4)


def test_words_of_a_shared_class_have_its_probability():
    rng = np.random.default_rng(1)
    words, n, suffix = rng.choice(1 << 40, 900, replace=False).astype(np.uint64), rng.integers(1, 400, 900), rng.integers(0, 65_536, 900)
    order = np.argsort(-n, kind="stable")
    words, n, suffix = words[order], n[order], suffix[order]
    known = language_model.Classes(words[:300], n[:300], suffix[:300], np.bincount(suffix, minlength=65_536),
                                   np.bincount(suffix, n, 65_536).astype(np.int64))
    assert known.words == 20 and known.size == 40       # follows the 900 distinct words
    classes, counts, _ = known.look_up(words, suffix)
    assert sorted(classes[:20]) == list(range(20)) and (classes[20:] >= 20).all() and (counts[:300] == n[:300]).all()
    mass = np.bincount(classes, n, 40)
    for c in range(20, 40):
        mine = classes == c
        total = ((n[mine] + 0.1).sum() + 0.1) / 10 ** known.norm[c]       # the last tenth is for unseen words
        assert total == pytest.approx(1)
    assert mass[20:].max() < 3 * mass[20:].mean()


def test_language_model_does_not_depend_on_partitions_and_beats_counts(table, monkeypatch):
    docs = table("documents", "sf0.01").select("doc_id", "text")
    monkeypatch.setattr(language_model, "SHARD", 30_000)
    one, many = ({r["doc_id"]: r for r in language_model.score_texts(docs.repartition(n)).collect()} for n in (1, 12))
    assert len(one) == len(many) == 1000
    assert max(abs(r["score"] - many[i]["score"]) / r["n_tokens"] for i, r in one.items()) < 1e-6
    monkeypatch.undo()
    held = [r for r in language_model.score_texts(docs).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] - r["base_score"] for r in held) / tokens > 0.114
    assert sum(r["score"] < r["base_score"] for r in held) <= 0.05 * len(held)


def test_language_model_odd_texts(docs):
    rows = [(1, "a b c"), (1, "a b c"), (1, "a"), (2, "long " * 300_000), (3, "once\x00upon"), (4, None), (5, " \t\n"), (6, "A B c")]
    got = {r["doc_id"]: r for r in language_model.score_texts(docs(rows)).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {1: 2, 2: 300_001, 3: 2, 4: 1, 5: 1, 6: 4}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.values())


def test_language_model_edges(docs):
    assert language_model.score_texts(docs([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = language_model.score_texts(docs([(held, "only held out")])).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"]) == (0, 0, 4) and math.isfinite(r["score"])


def labelled(n=600):
    rows, labels = [], []
    for i in range(n):
        r = np.random.default_rng(i)
        words = [f"w{r.integers(3000)}x" for _ in range(r.integers(3, 200))]
        bad = i % 5 == 0
        if bad:
            words.insert(int(r.integers(len(words))), str(r.choice(["vileword", "nastyword,", "VILEword"])))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0), int(bad)))
    return rows, labels


def test_toxicity_held_out_accuracy(docs, spark):
    rows, labels = labelled()
    known = spark.createDataFrame([x for x in labels if x[0] < 400] + [(1, None, 1), (None, 0, 0)], "doc_id long, junk int, toxic int")
    chain = toxicity.train(docs(rows), known, ["junk", "toxic"])
    out = {r["doc_id"]: r for r in toxicity.score(docs(rows, p_toxic="old", lang="en"), chain).collect()}
    assert all((out[i]["p_toxic"] >= 0.5) == bool(t) for i, _, t in labels if i >= 400)
    assert out[5]["lang"] == "en"


def test_toxicity_edges(docs, spark):
    rows = [(1, None), (2, ""), (3, "x " * 40_000), (3, "x"), (None, "vile")]
    none = spark.createDataFrame([], "doc_id long, junk int, toxic int")
    out = toxicity.score(docs(rows), toxicity.train(docs(rows), none, ["junk", "toxic"])).collect()
    assert len(out) == 5 and all(r["p_toxic"] == 0 for r in out)
    one = spark.createDataFrame([(2, 0, 1), (3, 1, 1)], "doc_id long, junk int, toxic int")
    chain = toxicity.train(docs(rows), one, ["junk", "toxic"])
    assert all(r["p_toxic"] > 0.5 for r in toxicity.score(docs(rows), chain).collect())
    assert toxicity.score(docs([]), chain).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header><h1>Site name</h1><p>Tagline of the site</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><aside><p>Side text that is fairly long, too.</p></aside>
<article><h1>Title &amp; more</h1><p>First   paragraph,\n<b>bold</b> and<br>broken.</p><p>Short.</p>
<div class="ad">Buy now!</div><form><label>Mail</label><input></form><ul><li>one<li>two</ul>
<section class="comments"><p>Reader says hello at length here.</p></section></article>
<div id="comments"><p>Another comment</p></div><footer>&copy; us</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst paragraph, bold and broken.\n\nShort.\n\none\n\ntwo"
    loose = PAGE.replace("article>", "div>").replace("<article", "<div")
    assert "First paragraph, bold and broken.\n\nShort." in html_text.main_text(loose)
    for part in ("Site name", "Home", "cookies", "Side text", "Buy now", "Mail", "hello", "Another", "us"):
        assert part not in html_text.main_text(loose)


def test_page_in_several_parts():
    """All parts of the text are kept: several articles, a heading outside, a split body."""
    long = [f"Paragraph {i} " + "with quite a few words of running text in it, " * 4 + "all kept." for i in range(8)]
    body = ["".join(f"<p>{x}</p>" for x in part) for part in (long[:5], long[5:])]
    menu = '<nav><a href="/">Home</a></nav><aside><p>Side text that is fairly long, too.</p></aside>'
    want = "\n\n".join(long)
    page = "<html><body>{}</body></html>".format
    for rest in ("article", "section"):
        split = f"<article>{body[0]}</article><{rest}>{body[1]}</{rest}>"
        assert html_text.main_text(page(f"{menu}<main>{split}</main>")) == want
        assert html_text.main_text(page(menu + split)) == want
    assert html_text.main_text(page(f"{menu}<main><h1>Title</h1><article>{body[0]}{body[1]}</article></main>")) == "Title\n\n" + want
    assert html_text.main_text(page(f"{menu}<h1>Title</h1><article>{body[0]}{body[1]}</article>")) == "Title\n\n" + want
    last = f"<p>{long[7]}</p>"      # under a tenth of the text stands outside the div
    assert html_text.main_text(page(f"{menu}<div><div>{body[0] * 2}{body[1][:-len(last)]}</div>{last}</div>")) == \
        "\n\n".join(long[:5] * 2 + long[5:])


def test_articles_keep_their_own_text():
    """Names that are no part's name inside an article, formulas, and text of others beside it."""
    text = [f"Paragraph {i} " + "with quite a few words of running text in it, " * 4 + "all kept." for i in range(6)]
    body = "".join(f"<p>{x}</p>" for x in text)
    page = "<html><body><nav><a href='/'>Home</a></nav>{}<footer>us</footer></body></html>".format
    for own, said in (('<h2 id="search">Search engines</h2>', "Search engines"),
                      (f'<section id="related-work"><h2>Related work</h2><p>{text[0]}</p></section>', f"Related work\n\n{text[0]}"),
                      ('<div class="alert"><p>Take care here.</p></div>', "Take care here."),
                      ('<p class="share">The share of each.</p>', "The share of each."),
                      ("<p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "Then x=2 holds.")):
        for outer in ("article", "main"):
            got = html_text.main_text(page(f"<{outer}>{body}{own}<p>{text[1]}</p></{outer}>"))
            assert got == "\n\n".join([*text, said, text[1]]), (own, outer)
    for outer, other in (("article", text[2]), ("main", "".join(text[2:5]))):
        blurb = f'<div class="left"><p>{other}</p></div>'
        for left in (f"{blurb}<{outer}>{body}</{outer}>", f"<{outer}>{body}</{outer}>{blurb}"):
            assert html_text.main_text(page(left)) == "\n\n".join(text)
    inside = f'<div class="newsletter-signup">Join us</div><ul class="share"><li>Post it</li></ul><div class="ad">Buy</div>'
    assert html_text.main_text(page(f"<article>{body}{inside}</article>")) == "\n\n".join(text)


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (2, None, "", 5), (None, "v", "plain &lt;text&gt;", 5), (3, "w", "<![x[ <p>a<p>b", 5),
                                   (3, "w", "<p>" + "long word " * 30_000, 5), (4, "x", "<nav>only menu", 5)],
                                  "page_id long, url string, html string, n_chars int")
    got = [(r["page_id"], r["text"][:20], r["n_chars"]) for r in html_text.extract(pages).collect()]
    assert got[:3] == [(1, "", 0), (2, "", 0), (None, "plain <text>", 12)]
    assert got[4] == (3, "long word long word ", 299_999) and got[5] == (4, "", 0)


def test_pages_of_the_table_against_a_plain_cut(table):
    """Blocks of the one article that each page has, cut out by patterns."""
    pages = table("pages", "sf0.01")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    out = html_text.extract(pages).collect()
    assert len(out) == len(html)
    for r in out:
        article = re.search(r"<article[^>]*>(.*)</article>", html[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h[1-6]|div|ul|li)\b[^>]*>", article)
        plain = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks]
        assert r["text"] == "\n\n".join(b for b in plain if b) and r["n_chars"] == len(r["text"])
    assert html_text.extract(pages.limit(0)).count() == 0

"""How the sources of a language differ in their words, exactly.

Every text becomes a sparse vector of term counts, as a count vectorizer makes it: no hashing, a
term belongs to its language's vocabulary if enough documents hold it, and the vocabulary has no limit.
A vectorizer that keeps the vocabulary on the driver and broadcasts it could not have that, so the
vocabulary stays a table: a task counts the terms of its texts in numbers of its own, sums
the vectors of each source at once, and document frequencies are sums of the same rows.

Terms that a source does not hold all have the same smoothed share, so a sum over the whole vocabulary needs only the
terms that occur.  For two sources it is

* what all terms would give if neither source held any, times the vocabulary,
* what changes where one source holds a term, from its counts of equal shares,
* what changes once more where both hold it, from the terms they share; vocabularies are cut into
  blocks for this, and a block gives one row per pair of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.llm.common import written
from anchorline.llm.words import LETTERS, Words, text_slices

#: Bytes of text whose vectors a task sums before they leave it.
TEXT_BYTES = 8 << 20
#: Counts of (source, term) in a block of one language's vocabulary, on average.
ROWS_PER_BLOCK = 20_000
UNITS = 1_000_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and each one's sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order], first) if len(keys) else v for v in values]


def _group_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs); a row without term names each group."""
    for batch in batches:
        lang, source = (batch.column(c).dictionary_encode() for c in (0, 1))
        wide = max(len(source.dictionary), 1)
        group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
        for row, offsets, data in text_slices(batch.column(2), TEXT_BYTES):
            w = Words(offsets, data, LETTERS)
            lengths = w.ends - w.starts
            edges = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=edges[1:])
            terms = pa.Array.from_buffers(pa.large_string(), len(lengths), [
                None, pa.py_buffer(edges), pa.py_buffer(_LOWER[data[LETTERS[data]]])]).dictionary_encode()
            many = max(len(terms.dictionary), 1)
            of = group[row:row + len(offsets) - 1]
            # the texts' sparse vectors: (text, term) -> count
            cells = np.repeat(np.arange(len(of)), np.diff(w.first)) * many + terms.indices.to_numpy()
            cells, n = _sums(cells, np.ones(len(cells), np.int64))
            # their sums by source: (group, term) -> count, texts
            keys, n, docs = _sums(of[cells // many] * many + cells % many, n, np.ones(len(cells), np.int64))
            seen = np.unique(of)
            groups = np.r_[seen, keys // many]
            none = np.zeros(len(seen), np.int64)
            term = pa.concat_arrays([pa.nulls(len(seen), pa.large_string()), terms.dictionary.take(pa.array(keys % many))])
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(groups // wide)), source.dictionary.take(pa.array(groups % wide)),
                 term, pa.array(np.r_[none, n]), pa.array(np.r_[none, docs])],
                names=["lang", "source", "term", "n", "docs"])


def _share(n: Column, total: Column) -> Column:
    """1 + floor(UNITS * (n + 1) / total), exact; 1 where there is nothing to share."""
    scaled = (F.lit(UNITS).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.when(total > 0, F.call_function("div", scaled, total.cast("decimal(38,0)")) + 1).otherwise(F.lit(1)).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared_terms(table: pa.Table) -> pa.Table:
    """(lang, source, other, value): what terms held by both sources add to the sums of a block."""
    term = table.column("term").combine_chunks().dictionary_encode()
    source = table.column("source").combine_chunks().dictionary_encode()
    t, s = term.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
    p, p0 = table.column("p").to_numpy(), table.column("p0").to_numpy()
    order = np.lexsort((s, t))
    t, s, p, p0 = t[order], s[order], p[order], p0[order]
    first = np.searchsorted(t, np.arange(len(term.dictionary) + 1))
    many = len(source.dictionary)

    def gap(a, b):
        return (a - b) ** 2 // b
    rows = []
    for a in range(many):
        mine = np.flatnonzero(s == a)
        sizes = first[t[mine] + 1] - first[t[mine]]
        left = np.repeat(mine, sizes)
        right = np.repeat(first[t[mine]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        left, right = left[s[right] != a], right[s[right] != a]
        extra = gap(p[left], p[right]) - gap(p[left], p0[right]) - gap(p0[left], p[right]) + gap(p0[left], p0[right])
        others, value = _sums(s[right], extra)
        rows.append((np.full(len(others), a), others, value))
    a, b, value = (np.concatenate(c) for c in zip(*rows))
    return pa.table({"lang": pa.repeat(table.column("lang")[0], len(a)), "source": source.dictionary.take(pa.array(a)),
                     "other": source.dictionary.take(pa.array(b)), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: sources against each other, and a source's own terms.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those that occur in at least
    ``min_docs`` of its rows.  A group is a (lang, source), with or without kept terms.  With ``count`` the term's
    occurrences in the group, N their sum over the V kept terms, its share is p = 1 + floor(10^9 (count + 1) / (N + V)), and two
    shares differ by f = floor((p - q)^2 / q).

    * part ``pair``: item is another source of the lang, q its share, value f summed over all kept terms, all ranks;
    * part ``term``: item is a term the group holds with p > q, the share in the whole lang, value f, the first ``top``.

    Ranks count from 1 by value, descending, then item by its UTF-8 bytes.  Null text, lang and source are empty; repeated rows
    count each; an empty table gives no rows, a lang with a single source no pairs.  Other columns are not read.
    """
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = written(named.mapInArrow(_group_vectors, "lang string, source string, term string, n long, docs long")
                     .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = written(counts.where("term IS NOT NULL").groupBy("lang", "term")
                    .agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
                    .where(F.col("docs") >= min_docs).select("lang", "term", "n_lang"))
    held = written(counts.join(terms, ["lang", "term"]).select("lang", "term", "source", "n", "n_lang"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_held"))
    groups = counts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["v", "total_lang", "total", "n_held"])
    held_by_lang = F.sum("n_held").over(Window.partitionBy("lang"))
    groups = written(groups.withColumn("p0", _share(F.lit(0), F.col("total") + F.col("v")))
                     .withColumn("blocks", F.ceil(held_by_lang / ROWS_PER_BLOCK)))
    shares = held.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total") + F.col("v")))

    q = _share(F.col("n_lang"), F.col("total_lang") + F.col("v"))
    own = (shares.withColumn("q", q).where("p > q")
           .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                   _gap(F.col("p"), F.col("q")).alias("value")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("other")
    neither = (groups.join(other, "lang").where(apart)
               .select("lang", "source", "other", (F.col("v") * _gap(F.col("p0"), F.col("q0"))).alias("value")))
    equal = shares.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("n"))
    one = (equal.join(other, "lang").where(apart).groupBy("lang", "source", "other").agg(
        F.sum(F.col("n") * (_gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q0")))).alias("of"),
        F.sum(F.col("n") * (_gap(F.col("q0"), F.col("p")) - _gap(F.col("q0"), F.col("p0")))).alias("to")))
    sides = F.inline(F.array(F.struct("source", "other", F.col("of").alias("value")),
                             F.struct(F.col("other").alias("source"), F.col("source").alias("other"), F.col("to").alias("value"))))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    both = (shares.select("lang", block, "term", "source", "p", "p0").groupBy("lang", "block")
            .applyInArrow(_shared_terms, "lang string, source string, other string, value long"))
    pairs = (neither.unionByName(one.select("lang", sides)).unionByName(both)
             .groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value"))
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(own)

"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every five consecutive hashes of six words a text keeps the least.  Ten equal words
hold five such hashes, so a document and an item that share ten words share a kept
hash: joining the kept hashes misses no shared span.  Documents without a shared hash are
done; in the others every window of ten words is compared with the items' windows
word for word, and overlapping hits grow into spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.llm.common import one_row_per_id, written

WINDOW, GRAM = 10, 6
#: A joined side of at most so many rows (some tens of MB) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 250_000
#: What counts as a separator once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """``body`` of a value worked out once, not once per element of a lambda in it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _grams(hashes: Column, k: int) -> Column:
    """A hash of the k words at each position; empty if there are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(1)))
    return F.when(F.size(hashes) >= k, F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, k)))
                  ).otherwise(F.array().cast("array<bigint>"))


def _winnow(hashes: Column) -> Column:
    span = WINDOW - GRAM + 1

    def least(grams: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(grams) - (span - 1), F.lit(1)))
        return F.when(F.size(grams) >= span, F.transform(starts, lambda i: F.array_min(F.slice(grams, i, span)))
                      ).otherwise(F.array().cast("array<bigint>"))
    return _let(_grams(hashes, GRAM), least)


def _fingerprints(words: Column, lengths: list[int]) -> Column:
    """Number of words, then the kept hashes and all hashes of the given shorter lengths."""
    def build(hashes: Column) -> Column:
        kept = F.concat(_winnow(hashes), *[_grams(hashes, k) for k in lengths])
        return F.array_prepend(F.array_distinct(kept), F.size(hashes).cast("long"))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), build)


def _windows(words: Column, k: Column | int) -> Column:
    """The k words at each position as text; empty if there are fewer."""
    def build(w: Column) -> Column:
        n = F.size(w) - F.lit(k) + 1
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                          lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
                      ).otherwise(F.array().cast("array<string>"))
    return _let(words, build)


def checked(side: DataFrame) -> DataFrame:
    """``side`` marked for broadcast if it is counted to be small."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per doc_id: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    Words are runs of characters other than ASCII ones that are neither letter nor digit, with A-Z as a-z.
    A window is ten consecutive words of an item, or the whole of an item of one to
    nine words.  ``n_hit`` counts the document's words inside any occurrence of any
    window, ``items`` are the item_ids with such windows, as text in text order, ``items_sha256``
    the digest of their comma-joined list, ``spans`` (start, length) the maximal covered runs.

    Null and empty texts have no words, are never hit and hit nothing.  Rows without a
    doc_id or item_id are left out; of documents that share a doc_id the one with the
    least text counts; rows that share an item_id are one item.  Other columns are not
    read.  With an empty benchmark no document is hit; without documents the result is empty.
    """
    docs = one_row_per_id(docs, "doc_id", "text")
    items = (benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
             .select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
             .where(F.size("words") > 0))
    items = written(items)
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("k")).distinct().collect())
    short = [k for k in lengths if k < WINDOW]

    own = items.select(F.when(F.size("words") >= WINDOW, _fingerprints(F.col("words"), []))
                       .otherwise(F.array(F.size("words").cast("long"),
                                          F.xxhash64(F.transform("words", lambda w: F.xxhash64(w))))).alias("f"))
    tests = written(own.select(F.posexplode("f").alias("at", "key")).where("at > 0").select("key").distinct())
    prints = docs.select("doc_id", F.posexplode(_fingerprints(words_of(F.col("text")), short)).alias("at", "value"))
    found = (prints.withColumn("key", F.when(F.col("at") > 0, F.col("value")))
             .join(checked(tests.withColumn("hit", F.lit(True))), "key", "left")
             .groupBy("doc_id").agg(F.max(F.when(F.col("at") == 0, F.col("value"))).alias("n_words"),
                                    F.max("hit").alias("hit")))
    found = written(found)

    suspects = docs.join(checked(found.where("hit").select("doc_id")), "doc_id", "left_semi")
    suspects = suspects.select("doc_id", words_of(F.col("text")).alias("words"))
    sizes = F.array(*[F.lit(k) for k in lengths]).cast("array<int>")
    windows = (suspects.withColumn("k", F.explode(sizes))
               .select("doc_id", "k", F.posexplode(_windows(F.col("words"), F.col("k"))).alias("start", "window")))
    wanted = items.select("item", F.least(F.size("words"), F.lit(WINDOW)).alias("k"), "words").select(
        "item", "k", F.explode(_windows(F.col("words"), F.col("k"))).alias("window")).distinct()
    hits = windows.join(checked(written(wanted)), ["k", "window"]).select("doc_id", "start", "k", "item")
    per = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "k"))).alias("at"),
                                     F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<struct<start:int,length:int>>")

    def grow(spans: Column, hit: Column) -> Column:
        last = F.element_at(spans, -1)
        end = last["start"] + last["length"]
        joined = F.struct(last["start"].alias("start"),
                          (F.greatest(end, hit["start"] + hit["k"]) - last["start"]).alias("length"))
        fresh = F.struct(hit["start"].alias("start"), hit["k"].alias("length"))
        return F.when((F.size(spans) > 0) & (hit["start"] <= F.coalesce(end, F.lit(-1))),
                      F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(joined))
                      ).otherwise(F.concat(spans, F.array(fresh)))
    per = per.select("doc_id", "items", F.aggregate("at", none, grow).alias("spans"))
    out = found.select("doc_id", "n_words").join(per, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", none).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"), "items", "spans")

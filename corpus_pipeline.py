"""Cleaning of a text corpus in stages, each the next one's input.

Each stage takes (spark, docs, sf_dir) and works on every row it gets.  The first four return
the columns of documents; the last returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.llm import bpe_automaton, decontamination, line_dedup, minhash_join, toxicity
from anchorline.llm.common import one_row_per_id, written


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not reject; it learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("junk", 1 - F.col("quality"))
    chain = toxicity.train(docs, labels, ["junk", "toxic"])
    return _like(docs, toxicity.score(docs, chain).where("p_toxic < 0.5"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs (two lines, or one of 20 words); a document of which no line is left goes.

    ``n_chars``, where there is one, counts the characters left.
    """
    out = line_dedup.remove_repeated_lines(docs, min_lines=2, min_words=20).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _like(docs, out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near copies."""
    classes = minhash_join.near_duplicate_classes(docs, shingle=5, percent=80)
    base = one_row_per_id(docs, "doc_id", "text", [c for c in docs.columns if c not in ("doc_id", "text")])
    return _like(docs, base.join(classes.where("kept").select("doc_id"), "doc_id", "left_semi"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words with a benchmark item (nor hold a shorter item whole)."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = decontamination.checked(written(found.where("contaminated").select("doc_id")))
    base = one_row_per_id(docs, "doc_id", "text", [c for c in docs.columns if c not in ("doc_id", "text")])
    return _like(docs, base.join(hit, "doc_id", "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document, with their digests."""
    import public_tokenizers
    coded = bpe_automaton.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("*", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The classifier and the near-duplicate trees cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs

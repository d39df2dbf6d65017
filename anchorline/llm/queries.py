"""The operators on the driver's tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.llm import (
    best_fit_packing, bpe_automaton, centroid_clustering, decontamination, embedding_dedup, html_text, language_model,
    line_dedup, minhash_join, source_divergence, substring_dedup, token_counts, toxicity)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories for every text, and which texts it rejects."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").withColumn("junk", 1 - F.col("quality"))
    chain = toxicity.train(docs, labels, ["junk", "toxic"])
    out = toxicity.score(docs.select("doc_id", "text"), chain)
    return out.select("doc_id", "p_junk", "p_toxic", (out.p_toxic >= 0.5).alias("toxic"))


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after 20-word windows that also start earlier are cut."""
    out = substring_dedup.remove_repeated_windows(_table(spark, sf_dir, "documents"), words=20, seed=10)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left after later copies of runs of two or more lines, or of one of 20 words, are deleted."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.remove_repeated_lines(docs, min_lines=2, min_words=20)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


@_query
def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes over 4-word shingles at a similarity of 0.8."""
    return minhash_join.near_duplicate_classes(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item."""
    out = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@_query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at a cosine of 0.95 or more, their links and components."""
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, the last of its prefix counts."""
    out = token_counts.prefix_counts(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (out.n_tokens > 1024).alias("over_limit"))


@_query
def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded."""
    out = bpe_automaton.encode_and_decode(_table(spark, sf_dir, "documents"),
                                          _vocabulary("word_bpe_49k.json"))
    return bpe_automaton.digests(out)


@_query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under word counts and under the neural model."""
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


@_query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language against each other, and the terms that mark a source."""
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


@_query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds around eight centroids."""
    return centroid_clustering.cluster_vectors(_table(spark, sf_dir, "embeddings")).drop("centroid")


@_query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return best_fit_packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


ORACLES["op6_line_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS num
  FROM documents),
solid AS (
  SELECT doc_id, num, line, row_number() OVER (PARTITION BY doc_id ORDER BY num) AS pos
  FROM raw WHERE translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> ''),
runs AS (
  SELECT a.doc_id, a.pos, row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.pos) AS copy
  FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
long AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS copy FROM solid
  WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 20),
gone AS (
  SELECT doc_id, pos FROM runs WHERE copy > 1
  UNION SELECT doc_id, pos + 1 FROM runs WHERE copy > 1
  UNION SELECT doc_id, pos FROM long WHERE copy > 1),
marked AS (
  SELECT r.doc_id, r.num, r.line, s.pos IS NOT NULL AS solid, g.pos IS NOT NULL AS gone
  FROM raw r LEFT JOIN solid s ON s.doc_id = r.doc_id AND s.num = r.num
  LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos)
SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY num) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLES["op2_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY array_to_string(words[start:start + 19], ' ')
                                           ORDER BY doc_id, start) AS copy
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM split)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM windows WHERE copy > 1),
each_word AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM each_word ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""

ORACLES["op3_decontamination"] = r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
lists AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM split),
wanted AS (
  SELECT DISTINCT id AS item, k, array_to_string(words[start:start + k - 1], ' ') AS win
  FROM (SELECT id, words, k, unnest(range(1, len(words) - k + 2)) AS start
        FROM (SELECT *, least(len(words), 10) AS k FROM lists WHERE kind = 'i' AND len(words) > 0))),
hits AS (
  SELECT id, start, k, item
  FROM (SELECT id, k, start, array_to_string(words[start:start + k - 1], ' ') AS win
        FROM (SELECT id, words, k, unnest(range(1, len(words) - k + 2)) AS start
              FROM lists, (SELECT DISTINCT k FROM wanted) WHERE kind = 'd')) JOIN wanted USING (k, win)),
covered AS (SELECT id, count(DISTINCT pos) AS n FROM (SELECT id, unnest(range(start, start + k)) AS pos FROM hits) GROUP BY 1),
found AS (SELECT id, list_sort(list(DISTINCT CAST(item AS VARCHAR))) AS items FROM hits GROUP BY 1)
SELECT id AS doc_id, len(words) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM lists LEFT JOIN covered USING (id) LEFT JOIN found USING (id) WHERE kind = 'd'"""

_REACH = """reach AS (
  SELECT id AS a, id AS b FROM ids UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"""

ORACLES["op4_embedding_dedup"] = f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b FROM ids x JOIN ids y ON x.id <> y.id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
{_REACH}
SELECT a AS vec_id, (SELECT count(*) FROM links WHERE links.a = reach.a) AS n_links, min(b) AS component_id,
       a = min(b) AS kept FROM reach GROUP BY a"""

ORACLES["op7_minhash_join"] = rf"""
WITH RECURSIVE ids AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT id, array_to_string(words[start:start + 3], ' ') AS shingle
  FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS start FROM ids WHERE len(words) > 0)),
sizes AS MATERIALIZED (SELECT id, count(*) AS n FROM shingles GROUP BY 1),
links AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y USING (shingle)
                        WHERE x.id <> y.id GROUP BY 1, 2) c
  JOIN sizes s ON s.id = c.a JOIN sizes t ON t.id = c.b WHERE 100 * c.n >= 80 * (s.n + t.n - c.n)),
{_REACH}
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN sizes ON id = a GROUP BY a"""

ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocabulary AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM found GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
counted AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN vocabulary USING (lang, term) GROUP BY 1, 2, 3),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS n_lang
  FROM groups g JOIN vocabulary v ON v.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
totals AS (
  SELECT *, count(*) OVER grp AS v, sum(n) OVER grp AS total, sum(n_lang) OVER grp AS total_lang
  FROM dense WINDOW grp AS (PARTITION BY lang, source)),
shares AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (total + v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (n_lang + 1) // (total_lang + v) AS q FROM totals),
sums AS (
  SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.other = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200"""


def _rounds_in_sql(rounds: int) -> str:
    """Assignments and centroids of every round, each from the ones before."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT vec_id, min(best) AS best FROM (
    SELECT v.vec_id, {{'distance': list_sum(list_transform(list_zip(v.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'cluster': q.cluster}} AS best
    FROM v CROSS JOIN q{r} q) GROUP BY vec_id),"""
    move = """
q{n} AS MATERIALIZED (
  SELECT q.cluster, coalesce(m.x, q.x) AS x FROM q{r} q LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM (
      SELECT best.cluster AS cluster, pos, sum(x) AS s, count(*) AS n
      FROM (SELECT best, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM a{r} JOIN v USING (vec_id)) GROUP BY 1, 2)
    GROUP BY 1) m USING (cluster)),"""
    return "".join(assign.format(r=r) + move.format(r=r, n=r + 1) for r in range(rounds)) + assign.format(r=rounds)


ORACLES["op12_centroid_clustering"] = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
q0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY draw) - 1 AS INTEGER) AS cluster, x
  FROM (SELECT sha256('3:' || vec_id) AS draw, x FROM v ORDER BY draw LIMIT 8)),{_rounds_in_sql(10)}
digests AS (SELECT cluster, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM q10)
SELECT vec_id, best.cluster AS cluster, CAST(best.distance AS BIGINT) AS distance,
       CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a10 JOIN digests ON digests.cluster = best.cluster"""

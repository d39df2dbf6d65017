"""Every registered query against its SQL, and what is registered."""

import duckdb
import pytest

from anchorline.llm import toxicity
from anchorline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    import __spark_entry__ as entry
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    labels = labels.withColumn("junk", 1 - labels.quality)
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"), ["junk", "toxic"])
    out = toxicity.score(docs.join(labels.where("doc_id % 3 = 0"), "doc_id").select("doc_id", "text", "toxic"), chain).collect()
    toxic = [r["p_toxic"] >= 0.5 for r in out if r["toxic"]]
    clean = [r["p_toxic"] >= 0.5 for r in out if not r["toxic"]]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)

"""Driver contract and a few oracle comparisons at sf0.001."""

import duckdb
import pytest

from helpers import SF001

FAST = ("name_source_list", "count_per_source", "tokens_lexical", "shingles", "structural_features",
        "extension_top5", "curated_semi", "curated_missing", "quota_filled", "cluster_center_member",
        "farthest_points", "similar_pairs_exact", "dedup_exact_links", "tfidf_vocabulary",
        "dedup_lsh_kept", "dedup_minhash_links", "representatives", "combined_features", "halstead", "best_k",
        "pca_points", "selection_summary", "features_fallback", "designs_array_roundtrip", "similar_classes", "dedup_modes")


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["duplicate_index", "original_index", "similarity"]
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "documents", "embeddings", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF001)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm(df.collect(), df.columns) == _norm(res.fetchall(), dcols)

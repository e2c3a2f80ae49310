"""The registered queries against their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from seqflow import catalog

CHEAP = ["most_distant", "multi_target", "seq_stats", "token_batches", "kmer_search", "seq_records", "best_n", "inflight",
         "interval_rates", "fasta_scan", "telemetry_scan", "saved_embeddings", "stream_rates", "stream_token_batches"]


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())
    assert len(catalog.queries()) >= 75


def test_entry(spark, smoke_dir):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "pos", "avg_rank", "min_cos", "min_l2"] and df.count() == 10


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, smoke_dir, name):
    duckdb = pytest.importorskip("duckdb")
    import check

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{smoke_dir}/{t}.parquet'")
    result, _ = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], smoke_dir)
    assert result.startswith("ok") and "types" not in result, result

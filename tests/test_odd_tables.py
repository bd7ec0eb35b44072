"""Every query of the library runs over empty tables and over tables with null rows."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from docweave.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    for kind in ("empty", "nulls"):
        (at / kind).mkdir()
    for t in TABLES:
        source = f"'{DATA}/{t}.parquet'"
        duckdb.sql(f"COPY (SELECT * FROM {source} LIMIT 0) TO '{at}/empty/{t}.parquet' (FORMAT parquet)")
        nulls = "SELECT " + ", ".join(f"NULL AS {r[0]}" for r in duckdb.sql(f"DESCRIBE SELECT * FROM {source}").fetchall())
        duckdb.sql(f"COPY (SELECT * FROM (SELECT * FROM {source} LIMIT 30) UNION ALL BY NAME {nulls} UNION ALL BY NAME {nulls}) TO '{at}/nulls/{t}.parquet' (FORMAT parquet)")
    return at


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_queries_run(spark, folders, kind):
    def fault(name):
        try:
            registry.QUERIES[name](spark, f"{folders}/{kind}").collect()
        except Exception as e:  # noqa: BLE001  # all faults are told at once
            return f"{name}: {type(e).__name__} {str(e)[:200]}"
        return None

    with ThreadPoolExecutor(4) as pool:
        faults = [f for f in pool.map(fault, sorted(registry.QUERIES)) if f]
    assert not faults, "\n".join(faults)

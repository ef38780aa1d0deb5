"""Schemas of a table in which the number of their owners is no longer the smallest."""

import duckdb
import oracle
import pytest

from palimpsest.plans import catalog, knowledge  # noqa: F401


@pytest.fixture(scope="module")
def larger(sf_dir, tmp_path_factory):
    """The tables with three times the vectors."""
    folder = tmp_path_factory.mktemp("larger")
    for t in oracle.TABLES:
        (folder / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    (folder / "embeddings.parquet").unlink()
    duckdb.sql(f"copy (select t.* replace (vec_id + k * (select count(*) from '{sf_dir}/embeddings.parquet') as vec_id) from range(3) r(k), '{sf_dir}/embeddings.parquet' t) to '{folder}/embeddings.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["grf_collisions", "grf_core_merge", "grf_inherit", "top_beh"])
def test_owners_of_schemas_grow_as_the_sql_says(spark, larger, name):
    assert oracle.difference(oracle.connect(larger), catalog.QUERIES[name](spark, larger), catalog.SQL[name]) is None

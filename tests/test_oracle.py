"""Every registered query of the search engine against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from glyphsift import queries
from tests.oracle import assert_same, connect

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, con, name):
    assert_same(con, queries.QUERIES[name](spark, str(FOLDER)), queries.SQL[name])


def test_every_query_has_sql():
    assert set(queries.SQL) == set(queries.QUERIES)


def test_entry_works_without_the_other_package(monkeypatch):
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("glyphsift.llm") or n == "corpus_pipeline" else find(n, *a))
    assert set(__spark_entry__.queries()) == set(queries.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(queries.SQL)

"""Every registered query next to its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from check_queries import TEST_DATA, compare, duck

SF = f"{TEST_DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "masked_text", "n_masked"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    _, verdict = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict == "ok" or verdict == "rows only", verdict


def test_masked_texts_are_written_once_before_they_are_restored(spark):
    """Restoring reads them three times; a plan that goes back to the documents masks them as often."""
    files = entry.queries()["restore_documents"](spark, SF).inputFiles()
    assert files and not any("documents.parquet" in f for f in files)

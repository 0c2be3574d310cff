import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracle import TABLES, fetched, shown

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")

# One query per family; tools/check_oracle.py compares all of them.
SAMPLE = (
    "token_sets phrase_keys numbers_in_texts sentences_of_documents merged_sightings folded_titles relevance_scores quota_selection placement finding_checks "
    "row_strength mirrored_interactions phrase_clusters selected_sections article_records document_rules running_totals live_meter nearest_vectors"
).split()


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship_runs(spark):
    df = entry(spark)
    assert {"topic", "pure", "diversified", "helped"} <= set(df.columns) and df.count() > 0


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    df = queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    assert fetched(con, oracle_sql()[name]) == (names, rows)

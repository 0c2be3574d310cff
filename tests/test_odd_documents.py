"""Document queries against their SQL on texts that are missing, empty, blank, or hold other line breaks and marks."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tools.check_oracle import fetched, shown

TEXTS = [
    "", " ", "\n", "\r\n", None, "abc def.\n", "One two.\rThree four five six seven eight.", "One.\x0b# Two three four", "# Heading\nx y", "tail\n\n", "...",
    "see ](gone.md) and [a](b c) there", "has \\u00e9 inside it", "---\nx: 1\n---\nbody text", "Ab Cd.\r\nEf gh ij.\r\n", "x\x1c# y\x85# z", "a plain text of six words",
]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("odd"))
    docs = [(50, "a text of unknown size", "en", "src1", None)] + [(i, text, "fr" if i % 4 == 0 else "en", f"src{i % 3}", len(text or "") + i) for i, text in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, len(TEXTS), 2)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{sf}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    return sf, con


def _equal(spark, given, name):
    sf, con = given
    df = queries()[name](spark, sf)
    names = sorted(df.columns)
    assert fetched(con, oracle_sql()[name]) == (names, sorted(tuple(shown(r[c]) for c in names) for r in df.collect()))


@pytest.mark.parametrize("name", ["located_quotes", "quotes_in_documents"])
def test_quotes_of_odd_documents(spark, given, name):
    _equal(spark, given, name)


@pytest.mark.parametrize("name", ["document_rules", "bundle_findings"])
def test_rules_over_odd_documents(spark, given, name):
    _equal(spark, given, name)

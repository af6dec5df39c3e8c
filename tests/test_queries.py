"""Registered queries against their SQL, on the smallest test tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from recjobs.jobs import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
#: Learned models run in tests of their own; here the ones with SQL.
NAMES = sorted(queries.SQL)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    want = duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(columns, want.fetchall())


def test_confusions_of_classes_that_are_often_right(spark, tmp_path):
    rows = [(k, "x" * (2000 if (k % 2 == 1) != (k < 20) else 9), k % 2) for k in range(2400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    table.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    table.select("doc_id", "quality").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.QUERIES["ev13_weak_classes"](spark, str(tmp_path)).select("label", "prediction", "mean_n", "right").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 5.0, 595.0), (1, 0, 5.0, 595.0)]


HIDDEN = """
import sys

class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "recjobs.llm" or name.startswith("recjobs.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Hide())
import __spark_entry__
print(sorted(__spark_entry__.queries()) == sorted(__spark_entry__.jobs.QUERIES), sorted(__spark_entry__.oracle_sql()) == sorted(__spark_entry__.jobs.SQL))
"""


def test_entry_file_without_the_corpus_package():
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", HIDDEN], cwd=root, capture_output=True, text=True, check=True)
    assert done.stdout.split() == ["True", "True"]


def test_entry_file_lists_all():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

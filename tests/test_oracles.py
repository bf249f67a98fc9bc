"""Every registered query with SQL gives what DuckDB gives on the smallest tables; the others give rows."""

import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# Empty at the smallest scale only.
MAY_BE_EMPTY = {"unapplied_jobs_anti", "vector_l2_range", "hybrid_match_topk", "hybrid_stage_counts", "fts_all_terms", "fts_stemmed_terms", "titles_by_trigrams"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline"))
def test_query(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    rows = df.collect()
    assert rows or name in MAY_BE_EMPTY
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        found = duck.execute(sql)
        columns = [c[0] for c in found.description]
        assert canonical(df.columns, rows) == canonical(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_corpus_is_optional():
    """Nothing outside the corpus folders imports them."""
    from pathlib import Path

    root = Path(importlib.util.find_spec("larkmill").origin).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "larkmill.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path

"""Every query that has SQL, against DuckDB on the same tables; the entry module without the optional subpackage."""

import glob
import subprocess
import sys
import textwrap

import duckdb
import pytest

from keratoline import catalog, catalog_pages  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def shown(v):
    return "" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, data, db, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got, "a query without rows tells nothing"
    cursor = db.execute(catalog.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_every_query_but_one_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"visit_key_compat"}


def test_entry_without_the_subpackage(tmp_path):
    root = next(p for p in sys.path if glob.glob(f"{p}/__spark_entry__.py"))
    code = f"""
        import sys
        sys.path.insert(0, {root!r})
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name.startswith(("keratoline.llm", "corpus_pipeline")):
                    raise ModuleNotFoundError("gone", name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert "best_value" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
        assert set(e.oracle_sql()) <= set(e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=tmp_path)


def test_joins_are_by_hash_or_merge_not_nested_loops(spark, data):
    plan = catalog.QUERIES["band_join_count"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

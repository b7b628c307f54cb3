"""The queries that SQL can express, against that SQL in DuckDB."""

import duckdb
import pytest

from keratoline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    out = queries.QUERIES[name](spark, data)
    columns = sorted(out.columns)
    want = con.sql(queries.ORACLE[name])
    assert sorted(want.columns) == columns
    rows = lambda rs: sorted(map(tuple, rs), key=lambda r: tuple((x is None, x) for x in r))
    assert rows(out.select(*columns).collect()) == rows(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall())


def test_vector_links_equal_their_sql_where_there_are_some(spark, tmp_path):
    """The tables at hand have no pair at 0.9: vectors with near copies, chains of them and equal ones."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    heads = unit(rng.standard_normal((300, 64)))
    parts = [heads]
    for size, cosine in ((40, 0.98), (12, 0.97), (5, 0.93)):
        for h in heads[rng.permutation(300)[:6]]:
            turn = rng.standard_normal((size, 64))
            turn = unit(turn - (turn @ h)[:, None] * h)
            parts.append(cosine * h + np.sqrt(1 - cosine**2) * turn)
    chain = [heads[0]]
    for _ in range(8):
        turn = rng.standard_normal(64)
        turn = unit(turn - turn @ chain[-1] * chain[-1])
        chain.append(0.95 * chain[-1] + np.sqrt(1 - 0.95**2) * turn)
    x = np.concatenate([*parts, np.stack(chain[1:]), heads[7:9], heads[7:8], np.zeros((1, 64))]) * rng.uniform(0.1, 9, (1,))
    order = rng.permutation(len(x))
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x[order].astype(np.float32)), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.ORACLE['op5_embedding_near_dedup']}) ORDER BY 1").fetchall()
    assert sum(n for _, n, _, _ in want) > 4000 and sum(k for *_, k in want) < len(want) - 300
    out = queries.QUERIES["op5_embedding_near_dedup"](spark, str(tmp_path))
    assert [tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").orderBy("vec_id").collect()] == want

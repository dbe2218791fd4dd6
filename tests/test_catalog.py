import ast
import os

import pytest

import __spark_entry__ as entry
from docsieve.plans import catalog, notes  # noqa: F401  notes registers in catalog

SF = "/root/testdata/sf0.001"


def duck(sql):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con.sql(sql)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def plain(x):
    """Numbers to nine digits, and the same text for lists of either engine."""
    if isinstance(x, float):
        return f"{x:.9g}"
    return repr([plain(y) for y in x]) if isinstance(x, (list, tuple)) else repr(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_queries_match_their_sql(spark, name):
    df, rel = catalog.QUERIES[name](spark, SF), duck(catalog.ORACLE[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    assert sorted(plain([r[c] for c in names]) for r in df.collect()) == sorted(plain([x[rel.columns.index(c)] for c in names]) for x in rel.fetchall())


def test_nothing_else_imports_the_optional_package():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "docsieve")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, f)).read())
                names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                assert not [n for n in names if "docsieve.llm" in n], f


def test_lsh_recall_is_that_of_the_candidates(spark, tmp_path):
    import numpy as np

    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(size=64)], i % 5) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    exact = set(zip(*(x.tolist() for x in np.nonzero(np.triu(v @ v.T >= 0.3, 1))), strict=True))
    found = {(r.i, r.j) for r in catalog.lsh_candidates(spark, str(tmp_path)).collect()}
    assert len(found & exact) >= 0.9 * len(exact) > 0

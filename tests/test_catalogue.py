"""Every registered query that SQL can express returns what DuckDB returns on the smallest tables; the package stands without its corpus part."""

import subprocess
import sys
from pathlib import Path

import pytest

from geofold.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def value(v):
        return round(v, 5) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert plain(map(tuple, df.select(*columns).collect())) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry_imports_without_the_corpus_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "geofold").mkdir()
    for p in (root / "geofold").iterdir():
        if p.name != "llm":
            (tmp_path / "geofold" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    (tmp_path / "entry.py").write_text((root / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import entry; q = entry.queries(); s = entry.oracle_sql(); print(len(q), any(n.startswith('op1_') for n in q), set(s) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert said.stdout.split()[1:] == ["False", "True"], said.stderr

"""Every query of the library against its DuckDB equivalent, and that it imports without the llm subpackage."""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from brevispark.plans import more, more_oracle, oracle, queries

QUERIES, SQL = queries.QUERIES | more.QUERIES, oracle.SQL | more_oracle.SQL
SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    if name not in SQL:
        assert rows
        return
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    rel = c.sql(SQL[name])
    assert sorted(rel.columns) == cols
    fold = lambda rows: Counter(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows)
    assert fold(map(tuple, rows)) == fold(rel.select(*[f'"{x}"' for x in cols]).fetchall())


def test_entry_without_the_llm_subpackage(tmp_path):
    for name in ("brevispark", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name)
    code = "import sys; sys.modules['brevispark.llm'] = None; import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; print(len(e.queries()))"
    out = subprocess.run(
        [sys.executable, "-c", code],
        cwd=tmp_path,
        capture_output=True,
        text=True,
        env=os.environ | {"PYTHONPATH": str(tmp_path)},
    )
    assert out.returncode == 0, out.stderr

"""The driver's contract, and that the library stands without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == entry.entry(spark).columns


def test_core_does_not_import_the_subpackage():
    code = "import sys, claimloom.plans.registry as r; r.queries(); assert not any(m.startswith('claimloom.llm') for m in sys.modules), 'imported'"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_queries_equal_their_sql(spark):
    """A few of them on the smallest tables; the driver compares all."""
    import duckdb

    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        return
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in Path(d).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    for name in ("claims_processed", "claims_merged", "graph_conflicts", "corpus_rule_scores", "audit_kappa", "quality_difference"):
        df = entry.queries()[name](spark, d)
        rows = sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))]) for r in df.collect())
        got = con.execute(entry.oracle_sql()[name])
        cols = [x[0] for x in got.description]
        order = [cols.index(c) for c in sorted(cols)]
        want = sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in got.fetchall())
        assert sorted(cols) == sorted(df.columns) and rows == want, name

"""Every query with a SQL oracle gives the same rows as DuckDB (sf0.001)."""

import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from innsight.plans import catalog
from tests.conftest import SF_SMALL

ORACLES = catalog.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert _rows(got, df.columns) == _rows(want, cols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"market_segment_type", "cancel_rate_pct", "n"}


def test_every_query_has_callable():
    q = E.queries()
    assert set(ORACLES) <= set(q)
    assert len(q) >= 100


@pytest.mark.parametrize("blocked", ["public_tokenizers", "innsight.llm"])
def test_booking_queries_remain_without_the_corpus_operators(blocked):
    """In a process where a module can't be imported, every booking query is still there."""
    code = f"""
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {blocked!r} or name.startswith({blocked + '.'!r}):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as E
from innsight.plans import catalog
assert set(E.queries()) == set(catalog.queries()) and set(E.oracle_sql()) == set(catalog.oracle_sql())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)

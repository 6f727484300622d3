"""Every core query that SQL can express, on the smallest test tables, against DuckDB."""

import math
import os
import re
from pathlib import Path

import pytest

from veilspan.plans import oracle, registry
from veilspan.sources import workloads

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


def test_nothing_outside_imports_the_optional_package():
    root = Path(registry.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", p.read_text(encoding="utf-8"), re.M), p


def test_every_query_but_the_generator_has_sql():
    assert set(registry.queries()) - set(SQL) == {"generated_workloads"} and set(SQL) <= set(registry.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 7)
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_generated_workloads_are_whole_and_marked(spark):
    got = registry.queries()["generated_workloads"](spark, FOLDER).collect()
    assert {w: sum(r.workload == w for r in got) for w in workloads.SIZES} == {w: n for w, (n, _) in workloads.SIZES.items()}
    assert len({r.id for r in got}) == len(got) and all(r.annotations > 0 and len(r.text) > 20 for r in got)

"""The driver's contract: entry, queries and their SQL twins at the smallest scale."""
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

ROOT = Path(contract.__file__).parent
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
#: Every twin but those of the numbered operators, whose tests lie beside them.
TWINS = [n for n in contract.oracle_sql() if n in contract.QUERIES]


def test_entry_runs(spark):
    row = contract.entry(spark).first()
    assert row.molecules > 0 and 0 < row.mrr < 1


def test_every_twin_has_a_query_and_every_operator_a_name():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    codes = {n.split("_")[0] for n in contract.queries()}
    expected = {f"{p}{i}" for p, n in (("S", 17), ("P", 20), ("J", 18), ("A", 21), ("R", 25), ("D", 17), ("F", 27), ("M", 14),
                                       ("B", 6), ("X", 5), ("U", 6)) for i in range(1, n + 1)}
    assert expected <= codes


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", TWINS)
def test_query_equals_its_twin(spark, sf, con, name):
    df = contract.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(contract.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    pick = lambda columns, rows: sorted(tuple(repr(r[columns.index(c)]) for c in sorted(columns)) for r in rows)
    assert sorted(df.columns) == sorted(cols)
    assert pick(df.columns, got) == pick(cols, rel.fetchall())


def test_tables_are_never_subset(spark, sf):
    """Views cover every row of their source."""
    from massloom.plans.views import Tables

    t = Tables(spark, sf)
    assert t.spectra.count() == t.table("orders").count()
    assert t.peaks.count() == t.table("lineitem").count()
    assert t.catalog.count() == t.table("part").count()


def test_the_rest_stands_without_the_training_data_subpackage(tmp_path):
    """The entry imports, and registers the same other queries, where that folder and the pipeline's sources are gone."""
    for name in ("massloom", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    gone = tmp_path / "massloom" / "llm"
    if gone.exists():
        shutil.rmtree(gone)
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    ask = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == sorted(contract.QUERIES)

"""A sample of registered queries against their SQL; tools/compare.py runs them all."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from shelfmark.checks import load_all
from shelfmark.checks.fixtures import REGISTRY
from tools.compare import TABLES, rows_of

SAMPLE = ["a03_physical_dedup", "a11_upsert_tracks", "b09_tag_rules", "c08_moves_auto", "c14_fill_absent_keys", "c18_range_join", "d02_first_values", "e02_collision_rank_hot", "e07_geometry_changes", "g05_reconcile_dropped", "h34_gain_and_peak", "k8_map_importer_items"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_every_section_is_registered():
    load_all()
    names = entry.queries()
    assert {n[0] for n in REGISTRY} == set("abcdefghik")
    assert set(REGISTRY) <= set(names) and all(n in names for n in entry.oracle_sql())
    assert len(REGISTRY) > 150


@pytest.mark.parametrize("left", [[], ["corpus_pipeline.py"], ["corpus_pipeline.py", "shelfmark/llm/__pycache__/old.pyc"]])
def test_the_rest_works_without_the_optional_part(tmp_path, left):
    home = Path(entry.__file__).parent
    shutil.copytree(home / "shelfmark", tmp_path / "shelfmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    for name in left:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        if (home / name).exists():
            shutil.copy(home / name, tmp_path / name)
        else:
            (tmp_path / name).touch()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "path"] and df.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, fx):
    from shelfmark.operators import catalog as C
    from shelfmark.plans.view import render

    p = plan(C.orphan_art(fx.art(), fx.track_art(), "art_sha256", "sha256"))
    assert "LeftAnti" in p and "NestedLoop" not in p
    p = plan(render(fx.tracks(), fx.tags(), "$artist/$title"))
    assert "CartesianProduct" not in p and "o_totalprice" not in p and "Python" not in p
    p = plan(fx.tracks().where("id = 42").select("id", "format"))
    assert "PushedFilters: [IsNotNull(o_orderkey)" in p and "ReadSchema: struct<o_orderkey:bigint>" in p

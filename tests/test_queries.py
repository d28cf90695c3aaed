"""Every registered query against its SQL, and the entry point without the llm subpackage."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__
from lodeweave.functions.analyzer import parse_query
from lodeweave.operators import blocks, fts, vectors
from lodeweave.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_gives_its_sql_rows(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(oracles.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and plain(got, columns) == plain(want, columns)


def test_rows_only_queries(spark):
    for name in set(queries.QUERIES) - set(oracles.ORACLES):
        assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("analyzer", ["simple", "english"])
def test_postings_give_what_a_scan_gives(spark, analyzer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    asked = [parse_query(q, analyzer) for q in ("things oned tion", '"of the" and', "thing that -for", "the or which", '"thing of the"', "zzz")]
    posted = fts.postings(docs, ["doc_id"], {"text": 1.0}, analyzer).withColumn("block", blocks.block_of("doc_id")).persist()
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "exact", "terms", "density", "rank").collect()))
    want = rows(fts.text_search(docs, asked, 15, "doc_id", "text", analyzer))
    search = lambda some, k: blocks.bounded_search(posted, blocks.bounds(posted), docs.select("doc_id"), some, k, "doc_id")
    assert rows(search(asked, 15)) == want and len({r[0] for r in want}) >= 3
    assert search([parse_query("the", "english")], 5).count() == 0


def test_a_row_is_split_once(spark):
    for name in ("fts_topk", "fts_phrase", "fts_or", "fts_cover", "multi_query_rrf"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count(r"[\p{L}\p{N}]+") == 1, name


def test_cells_find_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16)), np.zeros((2, 16))])
    base = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9999, None)], "vec_id long, embedding array<double>")
    asked = base.where("vec_id % 20 = 0")
    cells = vectors.fit_cells(base, 10, sample=1000)
    assert cells.probes < len(cells.centres) / 2
    true = {(r.query_id, r.vec_id) for r in vectors.nearest(base, asked, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in vectors.nearest_cells(base, asked, 10, cells).collect()}
    assert len(true & found) >= 0.9 * len(true)
    nothing = base.limit(0)
    assert vectors.nearest_cells(nothing, nothing, 10).count() == 0


def test_diversified_results_differ(spark):
    out = queries.hybrid_diversified(spark, SF).collect()
    assert [r.place for r in out] == list(range(1, len(out) + 1)) and len({r.id for r in out}) == len(out)


def test_llm_sql(spark, db):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in sorted(set(sql) - set(oracles.ORACLES)):
        got, want = found[name](spark, SF).toPandas(), db.execute(sql[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns) and plain(got, columns) == plain(want, columns)


def test_the_rest_works_without_llm(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in (".git", "lodeweave", "corpus_pipeline.py", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "lodeweave").mkdir()
    for p in (ROOT / "lodeweave").iterdir():
        if p.name != "llm":
            (tmp_path / "lodeweave" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(queries.QUERIES)), "False"], out.stderr


def test_plans(spark):
    """Filters and columns reach the scan, top k has no shuffle of all rows, and small sides are broadcast."""

    def plan(name):
        return queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    children = plan("ls_children")
    assert "EqualTo(source,src2)" in children
    assert "TakeOrderedAndProject" in plan("fts_topk") and "TakeOrderedAndProject" in plan("glob_page")
    assert "WindowGroupLimit" in plan("catalog_top_titles") and "WindowGroupLimit" in plan("multi_query_rrf")

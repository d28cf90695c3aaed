"""What grows with a corpus: no step of an ingest shuffles what it makes of texts, and pages don't repeat a search."""

from __future__ import annotations

import gc
import weakref
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.api import Engine
from lodeweave.operators import blocks, files, fts, ingest, trigrams, vectors
from lodeweave.operators.numbering import marked, marks, number_in_place
from lodeweave.store import Commit

TEXTS = ["the cat and the dog", None, "", "A Cat 😀 sat", "the the the", "no", "x\ny z"] * 30


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def test_indexes_are_made_without_a_shuffle(rows):
    posted = fts.postings(rows, ["id"], {"text": 1.0}).withColumn("block", blocks.block_of("id"))
    for made in (posted, blocks.bounds_in_place(posted), trigrams.index(rows, "id", "text"), ingest.chunked(rows.withColumn("name", F.lit("x")), "id", "text", keep=["name"])):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_indexes_hold_every_term(rows):
    posted = fts.postings(rows, ["id"], {"text": 1.0}).withColumn("block", F.floor(F.col("id") / 64).cast("long"))
    want = {}
    for i, words in rows.select("id", fts.analyzed(F.col("text"))).collect():
        for at, w in enumerate(words or [], 1):
            want.setdefault((w, i), []).append(at)
    assert {(r.term, r.id): r.positions for r in posted.collect()} == want
    found = blocks.bounds_in_place(posted).groupBy("term", "block").agg(F.max("most").cast("int").alias("most"))
    assert sorted(found.collect()) == sorted(blocks.bounds(posted).collect())
    grams = {(r.gram, i) for r in trigrams.index(rows, "id", "text").collect() for i in r.ids}
    assert grams == {(g, i) for i, t in enumerate(TEXTS) for g in trigrams.trigrams_of(t or "")}


def test_bounds_come_from_texts(spark, tmp_path):
    """An ingest makes bounds without reading its postings, which are far more; plain texts and others have the same words as the scan's."""
    texts = [*TEXTS[:40], "ÀÉ×a÷b ß ÿ, x_y Z9²", " Straße\tÉTÉ École ", "Σίσυφος ΣΊΣΥΦΟΣ naïve", "İstanbul ﬁ ½ ×", "１２ abc ABC"]
    rows = spark.createDataFrame([(i, "k" if i % 3 else None, t) for i, t in enumerate(texts)], "id long, kind string, text string").withColumn("block", F.floor(F.col("id") / 16).cast("long"))
    posted = fts.postings(rows, ["id", "kind", "block"], {"text": 1.0})
    want = {(w, i): [k for k, x in enumerate(words, 1) if x == w] for i, words in rows.where("text IS NOT NULL").select("id", fts.analyzed(F.col("text"))).collect() for w in words}
    assert {(r.term, r.id): r.positions for r in posted.collect()} == want
    for analyzer in ("simple", "english"):
        made = fts.most_places(rows, ["block", "kind"], "text", analyzer)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        posted = fts.postings(rows, ["id", "kind", "block"], {"text": 1.0}, analyzer)
        found = made.groupBy("term", "block", "kind").agg(F.max("most").alias("most")).collect()
        assert {tuple(r) for r in found} == {tuple(r) for r in blocks.bounds(posted, ["kind"]).collect()} and found
    assert fts.most_places(rows.where("id < 5"), ["block", "kind"], "text").count() == fts.most_places(rows.where("id < 5"), ["block", "kind"], "text").select("term", "block", "kind").distinct().count()


def test_numbers_in_place(spark, rows, tmp_path):
    rows.repartition(5).withColumn("at", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "rows"))
    got = number_in_place(spark.read.parquet(str(tmp_path / "rows")).withColumnRenamed("id", "old"), "at", 7).collect()
    assert sorted(r.id for r in got) == list(range(8, 8 + len(TEXTS)))


def test_ingest_gives_a_table(spark, tmp_path):
    engine = Engine(spark, tmp_path, analyzer="simple")
    files = spark.createDataFrame([(f"upload://{i}.md", 5, b"text " + str(i).encode()) for i in range(40)] + [("upload://bad.md", 1, b"\0")], "path string, length long, content binary")
    assert engine.ingest_table(files).groupBy("status").count().collect() and engine.store.table("nodes").count() == 40
    again = {r.name: r.status for r in engine.ingest_table(files.where("path <> 'upload://3.md'")).collect()}
    assert len(again) == 40 and again["bad.md"] == "failed" and again["1.md"] == "unchanged"
    nodes = engine.store.table("nodes").select("id", "name", "content").collect()
    assert sorted(r.id for r in nodes) == list(range(1, 41)) and all(r.content == f"text {r.name[:-3]}" for r in nodes)
    assert {r.chunks for r in engine.report_table().where("status = 'ready'").collect()} == {1}


def test_pages_read_ahead_equal_pages_read_alone(spark, monkeypatch):
    monkeypatch.setattr(files, "GREP_FILES", 4)
    rows = [(i, "doc", f"{i}.md", "c", f"{i}.md", f"u{i}", "doc", 1, None if i % 7 == 0 else "the\nx\nthe cat\nthe" if i % 3 else "nothing") for i in range(1, 40)]
    nodes = spark.createDataFrame(rows, "id long, kind string, name string, collection string, path string, uri string, role string, size_bytes long, content string").coalesce(1).persist()
    for ahead_of, limit in ((10_000, 5), (9, 5), (10_000, 100)):
        monkeypatch.setattr(files, "AHEAD", ahead_of)
        after, served, ahead = (0, 0), 0, None
        while after is not None:
            want = files.grep_page(nodes, "^the", None, True, limit, after)
            ahead = files.grep_ahead(nodes, "^the", None, True, after) if ahead is None or ahead.page(limit, after) is None else ahead
            got = ahead.page(limit, after)
            assert got is None or got == want
            served += got is not None
            after = want[1]
        assert served > 3


def test_postings_come_in_sorted_runs(rows, tmp_path, monkeypatch):
    """They are written as they come: no task sorts all that it has."""
    monkeypatch.setattr(fts, "PLACES", 40)
    monkeypatch.setattr(fts, "_ROWS", 7)
    words = fts.analyzed(F.col("text")).alias("words")
    batch = rows.select("id", words).where("words IS NOT NULL").toArrow().combine_chunks().to_batches()[0]
    parts = [[r for some in fts._placed(batch.slice(at, n)) for r in some.to_pylist()] for at, n in fts._runs_of(batch.column(1))]
    assert len(parts) > 5
    for part in parts:
        assert [(r["term"].encode(), r["id"]) for r in part] == sorted((r["term"].encode(), r["id"]) for r in part)
    want = {(w, i): [k for k, x in enumerate(ws, 1) if x == w] for i, ws in zip(*batch.to_pydict().values(), strict=True) for w in ws if w}
    assert {(r["term"], r["id"]): r["positions"] for part in parts for r in part} == want


def test_an_ingest_sorts_no_postings_and_bounds_have_no_documents(spark, tmp_path, monkeypatch):
    sorts, add = {}, Commit.add
    monkeypatch.setattr(Commit, "add", lambda self, name, rows, sort="all": sorts.update({name: sort}) or add(self, name, rows, sort))
    engine = Engine(spark, tmp_path, analyzer="simple")
    engine.ingest_bytes([(f"{i}.md", b"the cat sat") for i in range(20)])
    engine.ingest_skill({"SKILL.md": b"---\nname: pet\ndescription: pets\n---\nx", "cat.md": b"the cat"})
    assert sorts["postings"] == "none"
    bounds = engine.store.table("bounds")
    assert bounds.where("kind = 'doc' AND term = 'cat'").count() == 1
    assert {r.name for r in bounds.where("kind = 'skill'").collect()} == {"pet"}
    assert len(engine.search(["cat"], scope="skills/pet")) == 1 and len(engine.search(["cat"], scope="docs")) > 1


def test_candidates_are_cut_to_each_querys_best(spark, monkeypatch):
    """What a task passes on follows the queries, not the pairs of blocks; equal distances go by id, also where only rounding makes them equal."""
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    x[::3] = x[0]  # copies
    x[1::30] = x[0] + [0, 0, 0, 1e-4]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3).persist()
    asked = rows.where("vec_id % 20 = 0")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    true = spark.createDataFrame([(q, i, float(1 - unit[q] @ unit[i])) for q in range(0, 300, 20) if x[q].any() for i in range(300) if x[i].any()], "q long, i long, d double")
    want = {}
    for r in true.select("q", "i", F.round("d", 6).alias("d")).collect():
        want.setdefault(r.q, []).append((r.d + 0.0, r.i))
    want = {(q, i, n) for q, found in want.items() for n, (_, i) in enumerate(sorted(found)[:5], 1)}
    for held in (500_000, 50, 1):
        monkeypatch.setattr(vectors, "HELD", held)
        pairs = vectors.nearest(rows, asked, 5)
        assert {(r.query_id, r.vec_id, r["rank"]) for r in pairs.collect()} == want
        cells = vectors.nearest_cells(rows, asked, 5, vectors.Cells(unit[[1, 2, 4, 5]], 4))
        assert {(r.query_id, r.vec_id, r["rank"]) for r in cells.collect()} == want
    names, ids, d = vectors.best_of(np.repeat([7, 3], 100), np.tile(np.arange(100), 2)[::-1], np.zeros(200), 5)
    assert list(names) == [3] * 5 + [7] * 5 and list(ids) == [0, 1, 2, 3, 4] * 2 and not d.any()


def test_distances_round_as_spark_does(spark):
    rng = np.random.default_rng(1)
    halves = (rng.integers(0, 2_000_000, 2_000) + 0.5) / 1e6
    d = np.concatenate([rng.random(2_000) * 2, halves, np.nextafter(halves, 0), [-1e-16, 0.0, 2.0]])
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(d)], "i long, d double").orderBy("i").select(F.round("d", 6) + F.lit(0.0)).collect()]
    assert vectors.rounded(d).tolist() == want


def test_chunks_hold_one_batch_and_few_texts(monkeypatch):
    """A batch goes before the next one is read, and long texts are cut fewer at a time."""
    made = {}
    monkeypatch.setattr(ingest, "F", MagicMock())
    nodes = MagicMock()
    nodes.select.return_value.mapInArrow.side_effect = lambda cut, schema: made.update(cut=cut)
    ingest.chunked(nodes, "id", "text")
    alive = []

    def batches():
        for k in range(4):
            gc.collect()
            assert not [b for b in alive if b() is not None]
            batch = Batch(pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([f"# {k}\n\ntext {i}" for i in range(600)])], ["node_id", "text"]))
            alive.append(weakref.ref(batch))
            yield batch
            del batch

    found = [b.num_rows for b in made["cut"](batches())]
    assert sum(found) == 2_400 and max(found) <= ingest._ROWS
    texts = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * 30, None, "é" * 30, "", "x"])], ["node_id", "text"])
    monkeypatch.setattr(ingest, "_BYTES", 31)
    assert [s.num_rows for s in ingest._slices(texts)] == [2, 1, 2]


class Batch:
    """A record batch that can be referred to weakly."""

    def __init__(self, batch):
        self.batch, self.num_rows = batch, batch.num_rows

    def column(self, k):
        return self.batch.column(k)

    def slice(self, at, n):
        return self.batch.slice(at, n)


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    """Rows are known by a bit each, also the last of 64, and of later tasks."""
    spark.range(0, 300, 1, 3).withColumn("at", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    wanted = rows.where("id % 7 = 0 OR id IN (0, 63, 64, 163, 299)")
    got = marked(rows, marks(wanted, "at"), "at")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in wanted.collect()) and got.columns == rows.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert marks(rows, "at").count() <= -(-300 // 64) + 3


@pytest.mark.parametrize("most", [0, 2, 100_000])
def test_an_ingest_shuffles_new_texts_alone(spark, tmp_path, monkeypatch, most):
    """And postings have no names of documents."""
    monkeypatch.setattr("lodeweave.api.BROADCAST_KEYS", most)
    asked, ask = [], api.marked

    def told(*a):  # now, as what is staged goes with the commit
        asked.append(sorted(r.content for r in ask(*a).collect()))
        return ask(*a)

    monkeypatch.setattr(api, "marked", told)
    engine = Engine(spark, tmp_path, analyzer="simple")
    texts = {f"{i}.md": f"# A\n\n{'word ' * (i * 40)}\n\n# B\n\nthe cat {i}" for i in range(15)}
    engine.ingest_bytes([(n, t.encode()) for n, t in texts.items()])
    asked.clear()
    texts |= {"3.md": "a new dog", "41.md": "one more"}
    engine.ingest_bytes([(n, t.encode()) for n, t in texts.items()])
    assert asked == ([["a new dog", "one more"]] if most else [])
    assert {r.name: r.content for r in engine.store.table("nodes").collect()} == texts
    posted = engine.store.table("postings").select("id", "name").collect()
    assert {r.id for r in posted} == {r.id for r in engine.store.table("chunks").collect()} and {r.name for r in posted} == {None}
    assert [h.fields["name"] for h in engine.search(["dog"])] == ["3.md"]

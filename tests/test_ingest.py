"""Ingest of trees, renames, clashes and versions, through the engine and its stored tables."""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from datetime import UTC, datetime

import numpy as np
import pytest

from lodeweave.api import EmbeddingStopped, Engine
from lodeweave.functions import paging
from lodeweave.functions.text import InputError
from lodeweave.operators import ingest
from lodeweave.operators.vectors import BadInput, Busy, HashEmbedder, Patience
from lodeweave.sources import files
from lodeweave.store import MigrationRequired, Store, StoreError

SKILL = "---\nname: {}\ndescription: A skill of its own\n---\n# Use\n\nDo it."


def tree(folder, parts):
    for name, text in parts.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return folder


def sources(engine):
    return {(r.collection, r.name): r for r in engine.store.table("sources").collect()}


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    tree(folder, {"x/readme.md": "# X\n\nfirst of two", "y/readme.md": "# Y\n\nsecond of two", "skills/foo/SKILL.md": SKILL.format("foo"), "skills/foo/references/a.md": "# A\n\nmore", "skills/bad/SKILL.md": "no head", "z[1].md": "brackets", "a.md": "same bytes"})
    return folder, Engine(spark, tmp_path_factory.mktemp("corpus"))


def test_trees_hold_skills_and_files_of_equal_names(home):
    folder, engine = home
    results = {(r.kind, r.name): r.status for r in engine.ingest_paths([folder], "k")}
    assert results == {("doc", "a.md"): "ingested", ("doc", "x/readme.md"): "ingested", ("doc", "y/readme.md"): "ingested", ("doc", "z[1].md"): "ingested", ("skill", "foo"): "ingested", ("skill", "bad"): "failed"}
    assert engine.skill("foo")["files"][0]["path"] == "SKILL.md" and not engine.glob("/docs/**/SKILL.md")
    assert {r.status for r in engine.ingest_paths([folder], "k")} == {"unchanged", "failed"}
    before = sources(engine)
    (folder / "x/readme.md").write_text("# X\n\nchanged now")
    assert [r.name for r in engine.ingest_paths([folder], "k") if r.status == "ingested"] == ["x/readme.md"]
    after = sources(engine)
    assert {k: r.id for k, r in after.items()} == {k: r.id for k, r in before.items()} and len(after) == 5
    x = ("k", "x/readme.md")
    assert after[x].created_at == before[x].created_at and after[x].updated_at > before[x].updated_at
    assert engine.store.table("nodes").where("kind = 'doc'").count() == 4
    assert [h.content for h in engine.search(["second"])] == ["# Y\n\nsecond of two"]


def test_a_copy_stays_while_its_file_is_there(home):
    folder, engine = home
    tree(folder, {"later/b.md": "same bytes"})
    assert [r.status for r in engine.ingest_paths([folder / "later"], "k")] == ["ingested"]
    assert {("k", "a.md"), ("k", "b.md")} <= set(sources(engine))
    (folder / "later/b.md").rename(folder / "later/c.md")
    assert [r.status for r in engine.ingest_paths([folder / "later"], "k")] == ["ingested"]
    assert ("k", "b.md") not in sources(engine) and {("k", "a.md"), ("k", "c.md")} <= set(sources(engine))


def test_paths_are_free_among_stored_ones(home):
    _, engine = home
    engine.ingest_bytes([("p.md", b"one")], "free")
    engine.ingest_bytes([("p", b"two"), ("p-1.md", b"three")], "free")
    engine.ingest_bytes([("p", b"two again")], "free")
    paths = {r.name: r.path for r in engine.store.table("nodes").where("collection = 'free'").collect()}
    assert paths["p.md"] == "p.md" and paths["p-1.md"] == "p-1.md" and paths["p"] == "p-2.md"
    assert engine.store.table("nodes").groupBy("uri").count().where("count > 1").count() == 0


def test_the_last_file_of_a_name_stays(home):
    _, engine = home
    got = [r.status for r in engine.ingest_bytes([("q.md", b"early"), ("q.md", b"late")], "twice")]
    assert sorted(got) == ["ingested", "superseded"] and len([k for k in sources(engine) if k[0] == "twice"]) == 1


def test_cursors_into_changed_texts_are_stale(home):
    _, engine = home
    engine.ingest_bytes([("long.md", b"line of text\n" * 9000)], "stale")
    page = engine.read("ctx://docs/stale/long.md")
    assert engine.read("ctx://docs/stale/long.md", page["next"])["text"]
    engine.ingest_bytes([("long.md", b"other text\n" * 9000)], "stale")
    with pytest.raises(paging.CursorError) as e:
        engine.read("ctx://docs/stale/long.md", page["next"])
    assert e.value.code == "STALE_CURSOR"


def test_uploads_have_limits(home):
    with pytest.raises(InputError):
        home[1].ingest_bytes([(f"{i}.md", b"x") for i in range(21)])


def test_walks_have_limits(tmp_path, monkeypatch):
    tree(tmp_path, {"a/b/c/d.md": "x", ".hidden/e.md": "x", "node_modules/f.md": "x", "g.zip": "x"})
    (tmp_path / "link.md").symlink_to(tmp_path / "g.zip")
    assert [(f.kind, f.name) for f in files.walk(tmp_path)] == [("doc", "a/b/c/d.md"), ("archive", "g.zip")]
    monkeypatch.setattr(files, "DIR_DEPTH", 3)
    assert [(f.kind, f.name) for f in files.walk(tmp_path)] == [("failed", "a/b/c"), ("archive", "g.zip")]
    monkeypatch.setattr(files, "DIR_MEMBERS", 1)
    assert [f.kind for f in files.walk(tmp_path)] == ["failed"]


def test_one_writer_wins(spark, tmp_path):
    store = Store(spark, tmp_path)
    first, second = store.begin(), store.begin()
    assert first.done(settings={"a": "1"}) == 1
    with pytest.raises(StoreError):
        second.done(settings={"a": "2"})
    assert store.version == 1 and store.setting("a") == "1"


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodeweave.store.SEGMENTS", 2)
    store = Store(spark, tmp_path)
    row = lambda i, name: spark.createDataFrame([(i, "skill", name, "", "o", "h", "ready", None, None, None)], store.table("sources").schema)
    for i in range(5):
        work = store.begin()
        work.add("sources", row(i, f"n{i}"))
        if i:
            work.remove(spark.createDataFrame([(i - 1,)], "gone long"))
        work.done()
    assert [r.id for r in store.table("sources").collect()] == [4]
    m = store.manifest()
    assert len(m["tables"]["sources"]) <= 3 and all(g["version"] > min(s["version"] for s in m["tables"]["sources"]) for g in m["gone"]) and m["ids"]["sources"] == 4


def test_old_layouts_are_migrated(spark, tmp_path):
    engine = Engine(spark, tmp_path / "new", analyzer="simple")
    engine.ingest_bytes([("kettle.md", b"Boil the water")], "home")
    old = tmp_path / "old"
    tables = {}
    for name in ("sources", "nodes", "chunks", "skills"):
        rows = engine.store.table(name)
        rows = rows.selectExpr("*", "CAST(NULL AS array<float>) AS embedding") if name == "chunks" else rows
        rows.write.parquet(str(old / "v1" / name))
        tables[name] = f"v1/{name}"
    (old / "manifest-1.json").write_text(json.dumps({"version": 1, "tables": tables, "settings": {"analyzer": "simple"}}))
    (old / "_current").write_text("manifest-1.json")
    with pytest.raises(MigrationRequired):
        Engine(spark, old, analyzer="simple").search(["boil"])
    assert Store(spark, old).migrate() and not Store(spark, old).migrate()
    moved = Engine(spark, old, analyzer="simple")
    assert [h.fields["name"] for h in moved.search(["boil"])] == ["kettle.md"]
    assert moved.ingest_bytes([("tea.md", b"Pour the tea")], "home")[0].status == "ingested" and moved.store.table("nodes").count() == 2


class _Picky(HashEmbedder):
    def embed(self, texts, kind="document"):
        if any("poison" in t for t in texts):
            raise BadInput("no")
        return super().embed(texts, kind)


def test_rejected_texts_are_remembered(spark, tmp_path):
    engine = Engine(spark, tmp_path, embedder=_Picky(16))
    engine.ingest_bytes([("a.md", b"fine text"), ("b.md", b"poison text")])
    assert engine.embed_missing() == {"total": 2, "embedded": 1, "rejected": 1}
    assert engine.embed_missing()["total"] == 0
    assert {r["name"]: r["embedded"] for r in engine.report()} == {"a.md": 1, "b.md": 0}


def test_an_index_of_cells_serves_searches(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("LODEWEAVE_BULK_INDEX_THRESHOLD", "30")
    engine = Engine(spark, tmp_path, embedder=HashEmbedder(32))
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(3)
    engine.ingest_files(spark.createDataFrame([(f"mem:/{i}.md", 1, " ".join(rng.choice(words, 12)).encode()) for i in range(40)], "path string, length long, content binary"))
    assert engine.embed_missing()["embedded"] == 40 and engine.store.setting("cells")
    assert engine.store.table("vectors").where("cell IS NULL").count() == 0
    assert engine.search_with_diagnostics(["w3 w5"]).retrieval_mode == "hybrid"
    engine.ingest_bytes([("new.md", b"w1 w2 w3")])
    engine.embed_missing()
    assert engine.store.table("vectors").where("cell IS NULL").count() == 0 and engine.store.table("vectors").count() == 41


def test_large_documents(spark):
    """140000 pairs of words are over 500 chunks, in seconds."""
    text = "".join(f"word{i} pair{i}. " for i in range(140_000))
    began = time.perf_counter()
    chunks = ingest.chunked(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()
    assert len(chunks) > 500 and time.perf_counter() - began < 30
    sizes = ingest.chunk_sizes(spark.createDataFrame([(1, text), (2, None), (3, " ")], "id long, t string"), "id", "t").collect()
    assert [(r.node_id, r.chunks, r.tokens) for r in sizes] == [(1, len(chunks), sum(c.token_count for c in chunks))]


class _Limited(HashEmbedder):
    """Answers `calls` times over all, counted in a folder, then asks to wait."""

    def __init__(self, folder, calls, retry_after="0"):
        super().__init__(8)
        self.folder, self.calls, self.retry_after = str(folder), calls, retry_after

    def embed(self, texts, kind="document"):
        n = len(os.listdir(self.folder))
        for t in texts:
            with open(f"{self.folder}/{n:06}-{zlib.crc32(t.encode())}-{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        if n >= self.calls:
            for name in os.listdir(self.folder):
                if name.startswith(f"{n:06}-"):
                    os.rename(f"{self.folder}/{name}", f"{self.folder}/refused-{name}")
            raise Busy("slow down", self.retry_after)
        return super().embed(texts, kind)


def test_a_provider_that_fails_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("LODEWEAVE_EMBED_MAX_ATTEMPTS", "2")
    monkeypatch.setattr("lodeweave.api.EMBED_COMMIT", 5)
    asked = tmp_path / "asked"
    asked.mkdir()
    engine = Engine(spark, tmp_path / "corpus", embedder=_Limited(asked, 4))
    engine.ingest_bytes([(f"{i}.md", f"text number {i}".encode()) for i in range(12)])
    with pytest.raises(EmbeddingStopped, match="slow down"):
        engine.embed_missing()
    first = engine.store.table("vectors").count()
    assert 0 < first < 12 and engine.store.table("vectors").where("embedding IS NULL").count() == 0
    engine.embedder = _Limited(asked, 10**6)
    assert engine.embed_missing()["total"] == 12 - first and engine.store.table("vectors").select("id").distinct().count() == 12
    answered = [n.split("-")[1] for n in os.listdir(asked) if not n.startswith("refused")]
    assert len(answered) == len(set(answered)) == 12


def test_patience():
    now = datetime(2026, 1, 1, tzinfo=UTC)
    p = Patience(attempts=3, timeout_ms=200, most_ms=4_000, first_ms=1)
    assert [p.wait_ms(k, None, now) for k in (0, 1, 13)] == [1, 2, 4_000]
    assert p.wait_ms(0, "3", now) == 3_000 and p.wait_ms(0, "5", now) is None and p.wait_ms(1, "Thu, 01 Jan 2026 00:00:02 GMT", now) == 2_000
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Busy("wait")
        return "done"

    assert p.ask(flaky) == "done" and len(calls) == 3
    with pytest.raises(RuntimeError, match="no answer in 200 ms"):
        Patience(attempts=1, timeout_ms=200).ask(lambda: time.sleep(2))
    with pytest.raises(BadInput):
        p.ask(lambda: (_ for _ in ()).throw(BadInput("no")))


def test_all_vectors_are_compared_on_demand(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("LODEWEAVE_BULK_INDEX_THRESHOLD", "30")
    engine = Engine(spark, tmp_path, embedder=HashEmbedder(16))
    rng = np.random.default_rng(4)
    engine.ingest_files(spark.createDataFrame([(f"mem:/{i}.md", 1, " ".join(rng.choice([f"w{k}" for k in range(30)], 9)).encode()) for i in range(60)], "path string, length long, content binary"))
    engine.embed_missing()
    assert float(engine.store.setting("cells_recall")) >= 0.9
    chunks = engine.store.table("chunks").select("id", "content", "context").collect()
    vectors_ = {c.id: np.array(engine.embedder.embed([f"{c.context}\n\n{c.content}"])[0]) for c in chunks}
    q = np.array(engine.embedder.embed(["w1 w2 w3"])[0])
    want = sorted((round(1 - float(v @ q), 6), i) for i, v in vectors_.items())[:5]
    hits = engine.search(["w1 w2 w3"], limit=60, per_query=5, exact=True)
    ranks = {h.chunk_id: h.fields["ranks"].get("vec:0") for h in hits}
    assert sorted(i for i, r in ranks.items() if r) == sorted(i for _, i in want)

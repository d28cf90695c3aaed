from __future__ import annotations

import io
import stat
import zipfile

import pytest

from lodeweave.api import Engine, TooExpensive, parse_scope
from lodeweave.functions.text import InputError, TextError
from lodeweave.operators import files
from lodeweave.operators.fusion import recall_and_mrr
from lodeweave.operators.numbering import number_rows
from lodeweave.operators.vectors import BadInput, HashEmbedder, embed_rows
from lodeweave.sources.files import NeedsOcr, archive_members, bundle, bundle_roots, detect, plain_normalizer, read_files
from lodeweave.streaming.watch import changed_since, subscribed, watch_for_changes

SKILL = b"---\nname: pdf-tools\ndescription: Work with PDF files\nallowed-tools: [Read]\n---\n# Use\n\nRead the reference."
BUNDLE = {"SKILL.md": SKILL, "references/forms.md": b"# Forms\n\n## Axial\n\nFill in every field of the form before saving it.", "scripts/run.py": b"print(1)\n", "assets/logo.bin": b"\x00\xff\x01"}
DOCS = [
    ("kettle.md", b"# Kettle\n\nBoil water in the kettle. Descale the kettle with vinegar every month."),
    ("bread.md", b"# Bread\n\nKnead the dough for ten minutes. Let the bread rise in a warm place."),
    ("bike.md", b"# Bike\n\n## Chain\n\nOil the bike chain weekly. A dry chain wears the sprockets."),
    ("page.html", b"<title>Garden</title><article><p>Water the tomato plants in the evening.</p></article>"),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, tmp_path_factory.mktemp("corpus"), embedder=HashEmbedder(256))
    assert [r.status for r in e.ingest_bytes(DOCS, "home")] == ["ingested"] * 4
    assert e.ingest_skill(BUNDLE).status == "ingested"
    assert e.embed_missing()["embedded"] == 5
    return e


def test_ingest_again_changes_nothing(engine):
    version = engine.store.version
    assert {r.status for r in engine.ingest_bytes(DOCS, "home")} == {"unchanged"}
    assert engine.ingest_skill(BUNDLE).status == "unchanged"
    assert engine.store.version == version


def test_nodes_of_a_bundle(engine):
    s = engine.skill("pdf-tools")
    assert [f["role"] for f in s["files"]] == ["skill_md", "asset", "reference", "script"]
    assert s["body"].startswith("# Use") and s["allowed_tools"] == ["Read"]


def test_search(engine):
    hits = engine.search(["descale kettle"], limit=3)
    assert hits[0].fields["name"] == "kettle.md" and "**" in hits[0].fields["snippet"] and hits[0].fields["via"] == ["fts", "vector"]
    assert engine.search(["zzzz qqqq"], max_distance=0.01) == []
    assert all(h.fields["kind"] == "skill" for h in engine.search(["form field water"], scope="skills"))
    both = engine.search_with_diagnostics(["bread dough", "bike chain"], limit=2)
    assert {h.fields["name"] for h in both.hits} == {"bread.md", "bike.md"} and both.retrieval_mode == "hybrid"
    for bad in ([], [" "], ["x"] * 9):
        with pytest.raises(InputError):
            engine.search(bad)


def test_search_quality(engine):
    asked = {"boil water kettle": "kettle.md", "knead dough": "bread.md", "oil chain": "bike.md", "tomato plants": "page.html"}
    found = [[h.fields["name"] for h in engine.search([q])] for q in asked]
    recall, mrr = recall_and_mrr(found, [[n] for n in asked.values()])
    assert recall >= 0.8 and mrr >= 0.8


def test_search_skills(engine):
    assert engine.search_skills(["pdf-tools"])[0]["uri"] == "ctx://skills/pdf-tools/SKILL.md"
    assert engine.search_skills(["bread"]) == []
    with pytest.raises(InputError):
        engine.search_skills(["x"], scope="docs")


def test_scopes():
    assert parse_scope("docs/home") == ("doc", "home") and parse_scope(None) == (None, None)
    for bad in ("other", "docs/a/b", "docs/"):
        if bad != "docs/":
            with pytest.raises(InputError):
                parse_scope(bad)


def test_files(engine):
    assert [e["name"] for e in engine.ls("/")["entries"]] == ["skills/", "docs/"] and engine.ls("/")["entries"][1]["note"] == "4 docs in 1 collections"
    assert [e["name"] for e in engine.ls("/skills/pdf-tools")["entries"]] == ["assets/", "references/", "scripts/", "SKILL.md"]
    assert engine.ls("/other")["missing"] and engine.ls("/docs/none")["missing"]
    assert [g["path"] for g in engine.glob("/docs/home/b*.md")] == ["/docs/home/bike.md", "/docs/home/bread.md"]
    assert engine.complete("skill", "PDF") == ["pdf-tools"] and engine.complete("collection", "ho") == ["home"]


def test_grep(engine):
    found = engine.grep("^## Axial")
    assert [(m["line"], m["text"]) for m in found["matches"]] == [(3, "## Axial")]
    seen, cursor = [], None
    while True:
        page = engine.grep("the", limit=1, cursor=cursor)
        seen += [(m["node_id"], m["line"]) for m in page["matches"]]
        cursor = page["next"]
        if cursor is None:
            break
    assert len(seen) == len(set(seen)) == len(engine.grep("the")["matches"]) and seen == sorted(seen)
    for bad in ("", "(", "(?<n>x)"):
        with pytest.raises(InputError):
            engine.grep(bad)


def test_read(engine):
    bare = engine.read("ctx://skills/pdf-tools/SKILL.md")["text"]
    framed = engine.read("ctx://docs/home/kettle.md")["text"]
    assert bare == SKILL.decode() and "untrusted" in framed
    assert "Boil" in engine.read("ctx://docs/home/kettle.md#chunk=0")["text"] and "bytes" in engine.read("ctx://skills/pdf-tools/assets/logo.bin")["text"]
    with pytest.raises(InputError):
        engine.read("ctx://docs/home/none.md")
    assert "4 docs" in engine.catalog() and "pdf-tools" in engine.catalog()


def test_time_limit(engine):
    def slow():
        with engine._timed(200):
            engine.spark.range(10**12).selectExpr("sum(sqrt(id) * sin(id))").collect()

    with pytest.raises(TooExpensive):
        slow()
    assert engine.spark.range(3).count() == 3


def test_failures_changes_renames_and_removal(spark, tmp_path):
    def normalizer(data, filename):
        if filename.endswith(".scan"):
            raise NeedsOcr([1], 1)
        return plain_normalizer(data, filename)

    e = Engine(spark, tmp_path / "c", normalizer=normalizer)
    results = {r.name: r.status for r in e.ingest_bytes([("a.md", b"alpha text"), ("b.scan", b"x"), ("c.bin", b"\x00\x01"), ("d.txt", b"delta")], "k")}
    assert results == {"a.md": "ingested", "b.scan": "needs_ocr", "c.bin": "failed", "d.txt": "ingested"}
    assert "b.scan" in e.catalog() and e.search_with_diagnostics(["alpha"]).retrieval_mode == "full_text"
    assert [r.status for r in e.ingest_bytes([("a.md", b"alpha changed")], "k")] == ["ingested"]
    assert [h.content for h in e.search(["changed"])] == ["alpha changed"] and e.search(["text"]) == []
    assert [r.status for r in e.ingest_bytes([("a.md", b"\x00")], "k")] == ["failed"]
    assert [h.content for h in e.search(["changed"])] == ["alpha changed"]
    e.ingest_bytes([("old.md", b"moving content")], "m", origin="file:/x/")
    e.ingest_bytes([("new.md", b"moving content")], "m", origin="file:/x/")
    assert [g["path"] for g in e.glob("/docs/m/*")] == ["/docs/m/new.md"]
    assert e.remove_source("doc", "d.txt") and not e.remove_source("doc", "d.txt") and e.glob("/docs/k/d*") == []


def test_pinned_settings(engine, spark):
    with pytest.raises(InputError):
        Engine(spark, engine.store.folder, analyzer="simple")
    other = Engine(spark, engine.store.folder, embedder=HashEmbedder(64))
    with pytest.raises(InputError):
        other.embed_missing()
    assert other.search_with_diagnostics(["kettle"]).warnings


def test_change_stream(spark, tmp_path):
    e = Engine(spark, tmp_path / "c")
    e.ingest_bytes([("a.md", b"one"), ("b.md", b"two")])
    seen: list[list[str]] = []
    watch_for_changes(e.store, seen.append, tmp_path / "p", page=1).awaitTermination(60)
    assert seen == [["ctx://docs/default/a.md"], ["ctx://docs/default/b.md"]]
    e.remove_source("doc", "a.md")
    watch_for_changes(e.store, seen.append, tmp_path / "p").awaitTermination(60)
    assert seen[2:] == [[]]
    assert [r.uri for r in changed_since(e.store.changes(), 1).collect()] == ["ctx://docs/default/a.md"]
    calls: list[str] = []
    subscribed(lambda: calls.append("list"), calls.append, {"u"})(["u", "v"])
    assert calls == ["list", "u"]


def _zip(entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body, mode in entries:
            info = zipfile.ZipInfo(name)
            info.external_attr = mode << 16
            z.writestr(info, body)
    return data.getvalue()


def test_archives(engine):
    good = _zip([("one/SKILL.md", SKILL.replace(b"pdf-tools", b"one"), 0o644), ("two/SKILL.md", SKILL.replace(b"pdf-tools", b"two"), 0o644)])
    assert bundle_roots(list(archive_members(good))) == ["one/", "two/"]
    for bad in (_zip([("../x", b"", 0o644)]), _zip([("l", b"x", stat.S_IFLNK | 0o777)]), _zip([("/x", b"", 0o644)]), b"no zip"):
        with pytest.raises(InputError):
            archive_members(bad)


def test_detection(spark, tmp_path):
    assert detect("x/SKILL.md", b"") == "skill" and detect("a.md", b"%PDF-1") == "pdf" and detect("a.html", b"<p>") == "html" and detect("a.zip", b"PK\x03\x04") == "archive"
    assert [m.path for m in bundle({"b.md": b"", ".x": b"", "SKILL.md": b""})] == ["SKILL.md", "b.md"]
    with pytest.raises(TextError):
        plain_normalizer(b"  ", "a.txt")
    for name in ("a.md", ".hidden.md", "sub/b.md", "node_modules/c.md"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(name)
    assert sorted(r.path.rsplit("/", 1)[1] for r in read_files(spark, str(tmp_path)).collect()) == ["a.md", "b.md"]


class _Picky(HashEmbedder):
    def embed(self, texts, kind="document"):
        if any("bad" in t for t in texts):
            raise BadInput("no")
        return super().embed(texts, kind)


def test_bad_texts_fail_alone(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id long, t string")
    out = {r.id: (r.embedding is not None, r.embed_error) for r in embed_rows(rows, _Picky(8), "t").collect()}
    assert out == {1: (True, None), 2: (False, "no"), 3: (True, None)}


def test_numbers_are_dense(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    got = number_rows(rows, ["k"], 5).collect()
    assert sorted(r.id for r in got) == list(range(6, 1006)) and {(r.k, r.id) for r in got} == {(r.k, r.id) for r in number_rows(rows, ["k"], 5).collect()}


def test_glob_pushes_its_literal_parts(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "doc", "n", "c", "a/b.md", "u", "doc", 1, "x")], "id long, kind string, name string, collection string, path string, uri string, role string, size_bytes long, content string")
    nodes.write.parquet(str(tmp_path / "n"))
    plan = files.glob(spark.read.parquet(str(tmp_path / "n")), "/docs/c/a/*.md")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,a/)" in plan and "EqualTo(kind,doc)" in plan and "content" not in plan.split("ReadSchema")[1]

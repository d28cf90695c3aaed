from __future__ import annotations

import numpy as np
import pytest

from lodeweave.api import Engine
from lodeweave.operators.vectors import quantized, quantized_distance
from lodeweave.tools import Tools

SKILL = b"---\nname: long-one\ndescription: A long skill\n---\n" + "Do 😀 this. ".encode() * 6000


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "docs").mkdir()
    for i in range(12):
        (folder / "docs" / f"d{i:02}.md").write_text(f"# Doc {i}\n\nMULTI\nLINE text number {i} about kettles.")
    (folder / "skill" / "assets").mkdir(parents=True)
    (folder / "skill" / "SKILL.md").write_bytes(SKILL)
    (folder / "skill" / "assets" / "x.bin").write_bytes(b"\x00\x01\xff")
    engine = Engine(spark, tmp_path_factory.mktemp("corpus"))
    results = engine.ingest_paths([folder / "docs", folder / "skill", folder / "none"], "k")
    assert [r.status for r in results] == ["ingested"] * 13 + ["failed"]
    return Tools(engine)


def pages(call):
    out, cursor = [], None
    while True:
        page = call(cursor)
        assert "error" not in page, page
        out.append(page)
        cursor = page["next_cursor"]
        if cursor is None:
            return out


def test_cursor_loops(tools):
    found = [e["path"] for p in pages(lambda c: tools.glob("/docs/k/*", limit=5, cursor=c)) for e in p["entries"]]
    assert found == [f"/docs/k/d{i:02}.md" for i in range(12)]
    matches = [(m["node_id"], m["line"]) for p in pages(lambda c: tools.grep("text number", limit=5, cursor=c)) for m in p["entries"]]
    assert len(set(matches)) == 12
    body = "".join(p["text"] for p in pages(lambda c: tools.skill("long-one", cursor=c)))
    assert body.count("😀") == 6000 and "assets/x.bin" in body


def test_pattern_over_lines_has_no_line(tools):
    page = tools.grep("MULTI\nLINE")
    assert page["entries"] == [] and page["scanned_files"] == 12


def test_reads_and_lists(tools):
    assert tools.read("ctx://skills/long-one/assets/x.bin")["data"] == "AAH/" and "12 docs" in tools.ls()["text"]
    assert [e["name"] for e in tools.ls("/skills/long-one")["entries"]] == ["assets/", "SKILL.md"]
    assert tools.search(["kettles number 3"])["entries"] and tools.search(["long skill"], target="skills")["entries"][0]["name"] == "long-one"
    assert len(tools.engine.resources()) == 14 and tools.engine.resources(1, 1)[0]["name"] == "long-one"
    assert {r["chunks"] for r in tools.engine.report() if r["kind"] == "doc"} == {1}


@pytest.mark.parametrize(
    ("tool", "arguments", "code"),
    [
        ("ls", {"path": "/docs/none"}, "NOT_FOUND"), ("ls", {"path": "../x"}, "INVALID_ARGUMENT"), ("glob", {"pattern": "{a"}, "INVALID_ARGUMENT"),
        ("glob", {"pattern": "*", "limit": 501}, "INVALID_ARGUMENT"), ("grep", {"pattern": "("}, "INVALID_ARGUMENT"), ("read", {"uri": "x"}, "INVALID_ARGUMENT"),
        ("search", {"queries": []}, "INVALID_ARGUMENT"), ("search", {"queries": ["x"], "cursor": "a.b"}, "EXPIRED_CURSOR"), ("skill", {"name": "none"}, "INVALID_ARGUMENT"),
        ("glob", {"pattern": "*", "cursor": "zz"}, "INVALID_CURSOR"),
    ],
)
def test_errors_are_data(tools, tool, arguments, code):
    assert getattr(tools, tool)(**arguments)["error"]["code"] == code


def test_blobs_go_with_their_source(tools):
    files = lambda: [p.name for p in (tools.engine.store.folder / "blobs").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert files() == ["x.bin"]
    assert tools.engine.remove_source("skill", "long-one")
    assert files() == []


def test_quantized_vectors_rank_alike():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.argsort(quantized_distance(x[:20], x, "float"))[:, :10]
    for kind, least in (("float", 1), ("half", 0.99), ("int8", 0.9), ("binary", 0.2)):
        got = np.argsort(quantized_distance(quantized(x[:20], kind), quantized(x, kind), kind), kind="stable")[:, :10]
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, got, strict=True)]) >= least

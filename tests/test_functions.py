from __future__ import annotations

import re
import time
from datetime import datetime, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodeweave import config
from lodeweave.functions import globs, paging, safety
from lodeweave.functions.analyzer import Phrase, analyze, cover_density, parse_query
from lodeweave.functions.frontmatter import SkillError, parse_skill, strip_frontmatter, tokenize_tools
from lodeweave.functions.html import html_to_markdown
from lodeweave.functions.markdown import Block, blocks_from_markdown, chunk_blocks, split_block
from lodeweave.functions.stemmer import stem
from lodeweave.functions.text import InputError, TextError, clip, decode_text, estimate_tokens, looks_like_text, utf16_length
from lodeweave.functions.uri import UriError, build_uri, check_path, parse_uri, path_to_uri, uri_to_path
from lodeweave.operators.fusion import Hit, diversify, overlaps, recall_and_mrr, rerank, rrf
from lodeweave.operators.vectors import HashEmbedder, plan_batches


def test_heading_paths():
    text = "# Guide\n\n" + "a b. " * 60 + "\n\n## Setup\n\n" + "c d. " * 60 + "\n\n### Linux\n\n" + "e f. " * 60
    assert [c.heading_path for c in chunk_blocks(blocks_from_markdown(text))] == [["Guide"], ["Guide", "Setup"], ["Guide", "Setup", "Linux"]]


def test_skipped_level_and_trailing_heading():
    chunks = chunk_blocks(blocks_from_markdown("# A\n\n### C\n\n" + "x y. " * 60 + "\n\n## End"))
    assert [c.heading_path for c in chunks] == [["A", "C"]]


def test_code_stays_whole_and_tables_repeat_their_header():
    fence = "```\n" + "line of code\n" * 600 + "```"
    assert any(c.content == fence for c in chunk_blocks(blocks_from_markdown(fence)))
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | value {i} |" for i in range(400))
    parts = split_block(Block("table", table), 200)
    assert len(parts) > 1 and all(p.text.startswith("| a | b |\n|---|---|\n") for p in parts)
    assert [r for p in parts for r in p.text.split("\n")[2:]] == table.split("\n")[2:]


def test_unterminated_fence_is_closed():
    assert blocks_from_markdown("~~~~\nx")[0].text == "~~~~\nx\n~~~~"


def test_large_text_makes_many_chunks():
    chunks = chunk_blocks(blocks_from_markdown("word pair " * 140_000))
    assert len(chunks) > 500 and [c.ord for c in chunks] == list(range(len(chunks)))
    assert max(c.token_count for c in chunks) <= 800


@given(st.text(alphabet="ab. \n😀!", max_size=900))
def test_split_loses_nothing(text):
    parts = split_block(Block("paragraph", text), 5)
    assert "".join(p.text for p in parts) == text
    assert all(estimate_tokens(p.text) <= 5 for p in parts)


@given(st.text(alphabet="ab\n😀é", max_size=300), st.integers(1, 8))
def test_pages_join_to_the_text(text, budget):
    cursor, parts = None, []
    while True:
        page = paging.text_page(text, "k", budget, cursor)
        parts.append(page.text)
        cursor = page.next_cursor
        if cursor is None:
            break
    assert "".join(parts) == text


def test_cursors_belong_to_their_request():
    c = paging.encode_cursor("a", 5, "r")
    assert paging.decode_cursor(c, "a", "r") == 5
    for key, revision, code in (("b", "r", "INVALID_CURSOR"), ("a", "s", "STALE_CURSOR")):
        with pytest.raises(paging.CursorError) as e:
            paging.decode_cursor(c, key, revision)
        assert e.value.code == code
    assert paging.decode_grep_cursor(paging.encode_grep_cursor("k", 3, 4), "k") == (3, 4)
    with pytest.raises(paging.CursorError):
        paging.text_page("x", "k", 1, cursor=paging.encode_cursor("k", 1, paging.fingerprint("x")), offset=1)


def test_cache_forgets():
    now = [0.0]
    cache = paging.BoundedCache(2, 100, 5, lambda: now[0])
    for k in "abc":
        cache.put(k, k, 1)
    assert cache.get("a") is None and cache.get("c") == "c"
    now[0] = 6
    assert cache.get("c") is None
    with pytest.raises(paging.CursorError) as e:
        paging.SearchPages(cache).page("c")
    assert e.value.code == "EXPIRED_CURSOR"


def test_budgets():
    assert paging.fit_entries(["a" * 10] * 5, str, 6)[0] == ["a" * 10] * 2
    with pytest.raises(InputError):
        paging.fit_entries(["a" * 99], str, 6)
    assert paging.cap("x", 1) == "x" and "2 more lines" in paging.cap("aaaa\nbbbb\ncccc", 2)


@pytest.mark.parametrize(
    ("pattern", "path", "fits"),
    [
        ("/docs/**/x.md", "/docs/x.md", True), ("/docs/**/x.md", "/docs/a/b/x.md", True), ("/docs/*/x.md", "/docs/a/b/x.md", False),
        ("/docs/?.md", "/docs/a.md", True), ("/docs/{a,b}.md", "/docs/b.md", True), ("/docs/[!a].md", "/docs/a.md", False),
        ("/docs/[ab].md", "/docs/a.md", True), ("*.md", "/docs/x/y.md", True), ("/docs/a+b.md", "/docs/a+b.md", True), ("/docs/**", "/docs/a\nb", True),
    ],
)
def test_globs(pattern, path, fits):
    assert bool(re.search(globs.plan_glob(pattern).regex, path, re.S)) == fits


@pytest.mark.parametrize("pattern", ["/docs/{a,{b}}", "/docs/{a", "/docs/[a", "/docs/[]", "/docs/[a/b]"])
def test_bad_globs(pattern):
    with pytest.raises(InputError):
        globs.plan_glob(pattern)


def test_glob_plans():
    plan = globs.plan_glob("/docs/c/a/b/*.md")
    assert (plan.kind, plan.root, plan.prefix) == ("doc", "c", "a/b/")
    assert globs.plan_glob("/docs/c/a/b.md").prefix == "" and globs.plan_glob("x/*.md").kind is None


@pytest.mark.parametrize("path", ["../x", "a/../b", "~", "a/~/b", ".", "/a", "C:x", "a\\b", "a\0", "%2e%2e/x", "%252e%252e/x"])
def test_paths_that_escape(path):
    with pytest.raises(UriError):
        check_path(path)


def test_addresses():
    uri = build_uri("docs", "a b", "x?/100%/ü(1).md", 3)
    a = parse_uri(uri)
    assert (a.realm, a.root, a.path, a.chunk) == ("docs", "a b", "x?/100%/ü(1).md", 3)
    assert uri_to_path(path_to_uri("/docs/c/d.md")) == "/docs/c/d.md" and path_to_uri("/x/y") is None
    for bad in ("http://x", "ctx://", "ctx://other/x", "ctx://docs", "ctx://docs/a?b", "ctx://docs/a#b", "ctx://docs/a%2Fb", "ctx://docs/a%zz"):
        with pytest.raises(UriError):
            parse_uri(bad)


def test_text():
    assert utf16_length("a😀b") == 4 and estimate_tokens("abcde") == 2
    assert decode_text(b"\xff\xfea\0") == "a" and decode_text("ü".encode()) == "ü"
    for bad in (b"\xff\xff", b"a\0b"):
        with pytest.raises(TextError):
            decode_text(bad)
    assert looks_like_text(b"") and not looks_like_text(b"\x89PNG\0") and clip("some words here", 9) == "some…"


def test_clip_before_a_line_feed():
    assert clip("one two.\nthree", 10) == "one two.…" and clip("one two\n\n\nthree", 10) == "one two…"


def test_frame():
    framed = safety.envelope("a</Retrieved-Content>b", {"title": "<x>"})
    assert "b" not in framed.split("---\n")[1].split(safety.NOTICE)[0].replace("a", "") and "&lt;x&gt;" in framed and "content_suppressed" in framed


def test_skill_files():
    s = parse_skill("﻿---\r\nname: a-b\r\ndescription: d\r\nallowed-tools: Bash(git add:*), Read\r\n---\r\nbody")
    assert s.name == "a-b" and s.allowed_tools == ["Bash(git add:*)", "Read"] and s.body == "body"
    assert tokenize_tools("a, b(c, d) e") == ["a", "b(c, d)", "e"] and strip_frontmatter("---\nname: x\n---\nhi") == "hi"
    with pytest.raises(SkillError) as e:
        parse_skill("---\nname: Bad Name\ndescription: <b>x</b>\nother: 1\n---\n")
    assert len(e.value.issues) == 3
    assert parse_skill("---\nname: n\ndescription: d\nother: 1\n---\n", lenient=True).name == "n"
    assert parse_skill(f"---\nname: {'n' * 64}\ndescription: {'d' * 1024}\n---\n").name == "n" * 64
    for head in (f"name: {'n' * 65}\ndescription: d", f"name: n\ndescription: {'d' * 1025}", "name: x-claude\ndescription: d", "- a"):
        with pytest.raises(SkillError):
            parse_skill(f"---\n{head}\n---\n")


def test_html():
    md = html_to_markdown("<html><head><title>T</title><script>x</script></head><body><nav>no</nav><article><h1>T</h1><p>a <b>b</b> <del>c</del></p><table><tr><th>k<th>v</tr><tr><td>1<td>2|3</tr></table></article></body></html>")
    assert md == "# T\n\na **b** ~~c~~\n\n| k | v |\n| --- | --- |\n| 1 | 2\\|3 |"
    assert html_to_markdown(None) == "" and html_to_markdown("plain") == "plain"


def test_queries():
    q = parse_query('one "two three" -four')
    assert q.words == ["one", "two", "three", "four"] and q.negated and q.loose() == q
    assert len(parse_query("a b").loose().anyof) == 2 and len(parse_query("a or b").anyof) == 2


def test_fusion():
    fused = rrf({"x": [("a", 1), ("b", 2)], "y": [("b", 2), ("c", 3)]})
    assert [f.key for f in fused] == ["b", "a", "c"]
    assert [f.key for f in rrf({"x": [(9, 0)], "y": [(10, 0)]})] == [10, 9]
    assert overlaps("a b c", "A b c!") and not overlaps("a b", "c d") and not overlaps("", "x")


def test_diversify():
    hits = [Hit(i, i // 10, f"w{i} x{i} y{i}") for i in range(30)]
    out = diversify({"fts:0": hits[:10], "fts:1": hits[20:]}, 2, 6)
    assert [h.chunk_id for h in out] == [0, 20, 1, 21, 2, 22]
    assert len(diversify({"fts:0": hits[:10]}, 1, 8)) == 3
    assert diversify({"fts:0": hits}, 1, 2, preferred=[25, 12])[0].chunk_id == 25


class _Reverse:
    def order(self, query, documents):
        return list(range(len(documents)))[::-1]


class _Broken:
    def order(self, query, documents):
        return [0]


def test_rerank_and_metrics():
    assert rerank(_Reverse(), "q", ["a", "b"]) == ([1, 0], None) and rerank(None, "q", []) == (None, None)
    assert rerank(_Broken(), "q", ["a", "b"])[1]
    assert recall_and_mrr([["x", "y"], ["z"]], [["y"], ["x"]]) == (0.5, 0.25)


def test_batches():
    texts = ["x" * 30] * 200 + ["y" * 999_999]
    plan = plan_batches(texts)
    assert [i for b in plan for i in b] == list(range(201)) and max(map(len, plan)) == 96
    v = HashEmbedder(64).embed(["a b a"])[0]
    assert abs(sum(x * x for x in v) - 1) < 1e-9


#: From the stemmer's published sample.
STEMS = """consigned consign consignment consign consistency consist consolatory consolatori consolingly consol conspirators conspir
knackeries knackeri kneading knead knightly knight knives knive knitted knit generously generous general general communism communism running run
hoping hope hopping hop relational relat happily happili dying die ties tie cries cri gas gas this this by by say say skies sky
news news proceed proceed inning inning luxuriated luxuri vileness vile ability abil national nation skis ski agreed agre feed feed"""


def test_stems():
    pairs = STEMS.split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]
    assert analyze("The kettles were boiling", "english") == ["", "kettl", "", "boil"]
    assert parse_query('"boil the water" the', "english").anyof == ((Phrase(("boil", "", "water")),),)


def plain_covers(terms, query):
    """Every stretch tried: the end is the first that satisfies from a term on, the beginning the last that still does."""
    wanted = set(query.words)
    entries = [i for i, t in enumerate(terms) if t in wanted]

    def fine(low, high):
        part = terms[low : high + 1]
        has = lambda p: any(all(not w or part[i + j] == w for j, w in enumerate(p.words)) for i in range(len(part) - len(p.words) + 1))
        return any(g and all(has(p) for p in g if not p.negated) and any(not p.negated for p in g) for g in query.anyof)

    total, k = 0.0, 0
    while k < len(entries):
        high = next((e for e in entries[k:] if fine(entries[k], e)), None)
        if high is None:
            break
        begin = max(i for i in range(k, len(entries)) if entries[i] <= high and fine(entries[i], high))
        inside = sum(entries[begin] <= e <= high for e in entries) - 1
        total += 1 / (1 + (high - entries[begin]) - inside)
        k = begin + 1
    return total


@given(st.lists(st.sampled_from("abcdx"), max_size=25), st.sampled_from(["a b -z", "a b c -z", '"a b" c -z', "a", "a b", '"a b" c', "a b or c d -z", '"a a" -z']))
def test_cover_density(terms, text):
    loose = parse_query(text).loose()
    assert abs(cover_density(terms, loose) - plain_covers(terms, loose)) < 1e-9


def test_settings():
    assert config.number("search_timeout_ms", {}) == 10_000 and config.number("max_distance", {"LODEWEAVE_MAX_DISTANCE": "0.5"}) == 0.5
    assert len(config.check({})) == 16
    for bad in ("", "x", "0", "1.5", "nan", "3600001"):
        with pytest.raises(InputError):
            config.check({"LODEWEAVE_SEARCH_TIMEOUT_MS": bad})
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert config.retry_after_ms("2", now) == 2000 and config.retry_after_ms("Mon, 01 Jan 2024 00:00:05 GMT", now) == 5000
    assert config.retry_after_ms(None, now) is None and config.retry_after_ms("soon", now) is None


@given(st.text("ab c.é😀\n", max_size=400), st.integers(2, 60))
def test_pieces_are_bounded_and_join(text, budget):
    parts = split_block(Block("paragraph", text), budget)
    assert "".join(p.text for p in parts) == text and all(utf16_length(p.text) <= max(4, 4 * budget) for p in parts)


def test_texts_are_cut_in_linear_time():
    times = []
    for n in (20_000, 160_000):
        began = time.process_time()
        assert chunk_blocks([Block("paragraph", "The quick brown fox. Over 😀 " * n)])
        times.append(time.process_time() - began)
    assert times[1] < 24 * times[0]


def test_python_values_are_few_at_a_time(spark):
    """What Python holds of an Arrow batch doesn't grow with the batch; nulls and empty lists stay."""
    import pyarrow as pa

    from lodeweave.functions import slices

    held, most = [], []

    class Value(str):
        def __init__(self, _):
            held.append(1)

        def __del__(self):
            held.pop()

    def of(text):
        most.append(len(held))
        return None if text is None else [Value(text), ""]

    texts = pa.array([None if i % 7 == 0 else f"t{i}" for i in range(5_000)])
    got = slices.in_slices(texts, of, pa.list_(pa.string()))
    assert got.to_pylist() == [None if t is None else [t, ""] for t in texts.to_pylist()] and max(most) <= slices.ROWS
    assert slices.in_slices(pa.array([], pa.string()), of, pa.list_(pa.string())).to_pylist() == []
    rows = spark.range(3).selectExpr("id", "CASE WHEN id > 0 THEN concat('x', id) END AS t")
    out = rows.select(slices.mapped("a string, n long", lambda t: {"a": t, "n": len(t or "")}, rows.t).alias("p")).select("p.a", "p.n")
    assert sorted(map(tuple, out.collect()), key=str) == [("x1", 2), ("x2", 2), (None, 0)]

"""Block bounds, trigrams, contained sets, free paths, and two writers of one store."""

from __future__ import annotations

import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from lodeweave.api import Engine
from lodeweave.functions.analyzer import cover_density, parse_query
from lodeweave.operators import blocks, containment, files, fts, ingest, trigrams, vectors
from lodeweave.store import Conflict, Store

RNG = random.Random(12)
WORDS = ["tea", "boil", "water", "eggs", "milk", "cup", "the", "of"]


def plain_search(texts, query, k):
    """The ranking by its definition, over all rows."""
    words, loose, out = set(query.words), query.loose(), []
    for i, t in texts:
        if t is not None and query.anyof and fts.satisfies(t.split(), loose):
            own = [w if w in words else "" for w in t.split()]
            out.append((int(fts.satisfies(own, query)), len(words & set(own)), round(cover_density(own, loose), 6), i))
    out.sort(key=lambda r: (-r[0], -r[1], -r[2], r[3]))
    return [(i, e, t, d, n) for n, (e, t, d, i) in enumerate(out[:k], 1)]


def some_query():
    parts = []
    for _ in range(RNG.randrange(1, 5)):
        word = RNG.choice(WORDS) if RNG.random() < 0.7 else f'"{RNG.choice(WORDS)} {RNG.choice(WORDS)}"'
        parts.append(("-" if RNG.random() < 0.3 else "") + word)
        if RNG.random() < 0.3:
            parts.append("or")
    return " ".join(parts)


@pytest.fixture(scope="module")
def posted(spark):
    texts = [(i, " ".join(RNG.choice(WORDS[: RNG.randrange(1, 9)]) for _ in range(RNG.randrange(1, 12)))) for i in range(0, 900, 3)]
    texts += [(901, None), (902, ""), (903, texts[0][1]), (904, texts[0][1])]
    rows = spark.createDataFrame(texts, "id long, text string")
    made = fts.postings(rows, ["id"], {"text": 1.0}).withColumn("block", F.floor(F.col("id") / 16).cast("long")).persist()
    return texts, made, blocks.bounds(made).persist(), rows.where("text IS NOT NULL").select("id").persist()


@pytest.mark.parametrize("waves", [(1, 2), (3, 50), (64, 1_024)])
def test_bounded_search_equals_the_scan(posted, monkeypatch, waves):
    texts, made, known, ids = posted
    monkeypatch.setattr(blocks, "WAVES", waves)
    monkeypatch.setattr(blocks, "FIRST_IDS", 20)
    for k in (1, 7):
        queries = ["-tea", "eggs or -tea", '"boil water" or -eggs', "-tea -milk -the", "zzz", "zzz or -tea", "", '-"the of"', *(some_query() for _ in range(12))]
        asked = [parse_query(q) for q in queries]
        found = blocks.bounded_search(made, known, ids, asked, k, "id").collect()
        for n, (q, text) in enumerate(zip(asked, queries, strict=True)):
            assert [(r.id, r.exact, r.terms, r.density, r["rank"]) for r in found if r.query_id == n] == plain_search(texts, q, k), text


def test_fewer_rows_need_fewer_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WAVES", (2, 4, 8, 16, 32))
    rows = spark.createDataFrame([(i, "tea " * (1 + (i * 7919) % 400)) for i in range(1_000)], "id long, text string")
    made = fts.postings(rows, ["id"], {"text": 1.0}).withColumn("block", F.floor(F.col("id") / 16).cast("long")).persist()
    known, counts = blocks.bounds(made).persist(), []
    for k in (1, 20, 900):
        read = blocks.Read()
        got = blocks.bounded_search(made, known, rows.select("id"), [parse_query("tea")], k, "id", read).collect()
        want = sorted(((i * 7919) % 400 + 1, -i) for i in range(1_000))[::-1][:k]
        assert [(r.density, -r.id) for r in got] == want
        counts.append(len(read.blocks) if not read.rest else 64)
    assert counts[0] < counts[1] < counts[2]


PATTERNS = ["the cat", "cat|dogs?", "(?i)THE", "^the .* mat$", "[ct]at on", "colou?r", "a.c", "x+yz", r"\bmat\b", "(the|a) (dog|cat)", r"do\w+s", "no such words", "(?:ca){1}t", "[^c]at", "ca{1,2}t", r"\.end", "K"]


def test_trigram_conditions_hold_for_all_matches():
    texts = [" ".join(RNG.choice(["The", "the", "cat", "caat", "dogs", "dog", "mat", "on", "a", "color", "colour", "xxyz", ".end", "abc"]) for _ in range(6)) for _ in range(400)]
    for p in PATTERNS:
        condition = trigrams.condition_of(p)
        matching = [t for t in texts if re.search(p, t)]
        assert condition is None or all(condition.holds(trigrams.trigrams_of(t)) for t in matching), p
    assert [trigrams.condition_of(p) for p in ("a.c", r"\p{L}abc", "[a&&b]ccc", r"\Qab\E", "(?x)a b c", "(a)bcd|", r"(.)\1abc")] == [None] * 7
    assert not trigrams.condition_of("the cat").holds(trigrams.trigrams_of("the dog"))


def test_grep_by_trigrams_equals_the_scan(spark, monkeypatch):
    lines = lambda: "\n".join(" ".join(RNG.choice(["The", "the", "cat", "caat", "dogs", "mat", "on", "a", "colour", ".end"]) for _ in range(4)) for _ in range(3))
    rows = [(i, "doc", f"{i}.md", "c", f"{i}.md", f"ctx://docs/c/{i}.md", "doc", 1, None if i % 50 == 7 else "needle in hay" if i % 40 == 3 else lines()) for i in range(1, 300)]
    nodes = spark.createDataFrame(rows, "id long, kind string, name string, collection string, path string, uri string, role string, size_bytes long, content string").persist()
    grams = trigrams.index(nodes, "id", "content").persist()
    for wave, waves in ((1_000, 3), (20, 2)):
        monkeypatch.setattr(files, "GREP_WAVE", wave)
        monkeypatch.setattr(files, "GREP_WAVES", waves)
        for p, ignore in (("needle", True), ("NEEDLE", True), ("NEEDLE", False), ("cat on|dogs mat", False), (r"^the .* mat$", True), ("[ct]aat", False), (r"\p{Lu}he cat", False), ("zzzz", True)):
            after, pages = (0, 0), []
            for _ in range(4):
                plain, by_index = (files.grep_page(nodes, p, None, ignore, 60, after, g) for g in (None, grams))
                assert plain == by_index, p
                pages.append(plain)
                if plain[1] is None:
                    break
                after = plain[1]
    # a rare string's files are all that is read
    assert trigrams.candidates(grams, trigrams.condition_of("needle")).count() == sum(r[8] == "needle in hay" for r in rows)


def test_contained_sets(spark, monkeypatch):
    monkeypatch.setattr(containment, "FREQUENT", 5)
    words = [f"w{k}" for k in range(30)]
    base = [RNG.sample(words, RNG.randrange(1, 25)) for _ in range(12)]
    sets = [(i, RNG.choice([None, "g", "h"]), [w for w in RNG.choice(base) if RNG.random() < 0.95] + RNG.sample(words, RNG.randrange(0, 2))) for i in range(150)]
    sets += [(200, "g", []), (201, "g", None), (202, "g", sets[0][2] * 2), (None, "g", words)]
    pairs, members = containment.contained_pairs(spark.createDataFrame(sets, "id long, grp string, w array<string>"), "id", "w", "grp", 0.85)
    kinds: dict = {}
    for i, g, w in sets:
        if w and i is not None:
            kinds.setdefault((g, frozenset(w)), []).append(i)
    first = {k: min(ids) for k, ids in kinds.items()}
    assert {(r.id, r["class"]) for r in members.collect()} == {(i, first[k]) for k, ids in kinds.items() for i in ids}
    want = {(min(x, y), max(x, y)) for (g, a), x in first.items() for (h, b), y in first.items() if g == h and a != b and len(a & b) / min(len(a), len(b)) > 0.85}
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_contained_sets_pass_on_pairs_alone(spark, monkeypatch):
    """Sets that share frequent words, in several parts of a group: what is met within the tasks is right, and few pairs leave them."""
    monkeypatch.setattr(containment, "MET_WORDS", 3_000)
    monkeypatch.setattr(containment, "CHOSEN_WORDS", 5_000)
    rng = random.Random(3)
    base = [[f"c{k}" for k in range(30)] + [f"r{i}-{k}" for k in range(10)] for i in range(200)]
    sets = [(i, "g" if i % 200 < 180 else None, [w for w in base[i % 200] if rng.random() < 0.97]) for i in range(400)]
    rows = spark.createDataFrame(sets, "id long, grp string, w array<string>")
    pairs, members = containment.contained_pairs(rows, "id", "w", "grp", 0.85)
    classes = {r["class"] for r in members.collect()}
    of = {i: (g, set(w)) for i, g, w in sets if i in classes}
    share = lambda a, b: len(a & b) / min(len(a), len(b))
    want = {(a, b) for a in of for b in of if a < b and of[a][0] == of[b][0] and share(of[a][1], of[b][1]) > 0.85}
    got = [(r.a, r.b) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 150
    sized = rows.where(F.col("id").isin(*classes)).select("id", "grp", F.size("w").alias("n"), F.transform("w", lambda w: F.hash(w)).alias("codes"))
    assert containment._candidates(sized, 0.85).count() < 2 * len(want)


def test_contained_sets_are_judged_where_they_meet(spark, monkeypatch):
    """Tasks pass on pairs alone, with the number of common words: no candidate meets its words again.  Words of one hash are told apart."""
    monkeypatch.setattr(containment, "MET_WORDS", 2_000)
    monkeypatch.setattr(containment, "OFTEN", 8)
    plain = containment._hashed
    monkeypatch.setattr(containment, "_hashed", lambda word, salt: plain(word, salt) if salt else F.pmod(plain(word, 0), F.lit(7)))
    rng = random.Random(5)
    base = [[f"c{k}" for k in range(20)] + [f"r{i}-{k}" for k in range(12)] for i in range(40)]
    sets = [(i, None if i % 9 == 4 else f"g{i % 2}", [w for w in base[i % 40] if rng.random() < 0.97]) for i in range(240)]
    pairs, members = containment.contained_pairs(spark.createDataFrame(sets, "id long, grp string, w array<string>"), "id", "w", "grp", 0.85)
    classes = {r["class"] for r in members.collect()}
    of = {i: (g, set(w)) for i, g, w in sets if i in classes}
    share = lambda a, b: len(a & b) / min(len(a), len(b))
    want = {(a, b): share(of[a][1], of[b][1]) for a in of for b in of if a < b and of[a][0] == of[b][0] and share(of[a][1], of[b][1]) > 0.85}
    assert {(r.a, r.b): r.share for r in pairs.collect()} == want and len(want) > 100
    tree = pairs._jdf.queryExecution().executedPlan().toString()
    assert "FlatMap" in tree and "Join" not in tree.split("FlatMap")[0]


def test_paths_have_no_greatest_number(spark):
    schema = "id long, collection string, name string"
    stored = spark.createDataFrame([("c", "x.md"), *(("c", f"x-{n}.md") for n in range(1, 130) if n not in (7, 101))], "collection string, path string")
    new = spark.createDataFrame([(i, "c", "x" if i == 2 else "x.md") for i in (1, 2, 3)] + [(9, "d", "x.md")], schema)
    assert {r.id: r.path for r in ingest.distinct_paths(new, stored).collect()} == {1: "x-7.md", 2: "x-101.md", 3: "x-130.md", 9: "x.md"}
    many = ingest.distinct_paths(spark.createDataFrame([(i, "c", "x.md") for i in range(300)], schema)).collect()
    assert {r.path for r in many} == {"x.md", *(f"x-{n}.md" for n in range(1, 300))}


def test_equal_files_are_not_paired(spark):
    new = spark.createDataFrame([("c", f"n{i}", "h") for i in range(300)], "collection string, name string, content_hash string")
    old = spark.createDataFrame([(i, "c", f"o{i}", "h", f"file:/o{i}") for i in range(300)], "id long, collection string, name string, content_hash string, origin_uri string")
    assert ingest.twins(new, old).count() == 300


def test_two_writers(spark, tmp_path):
    """Writers of different collections both succeed; of one source the later one fails, and what it wrote goes."""
    engine = Engine(spark, tmp_path, analyzer="simple")
    engine.ingest_bytes([("a.md", b"boil water")], "home")
    one, two = Store(spark, tmp_path), Engine(spark, tmp_path, analyzer="simple")
    began, go = threading.Event(), threading.Event()

    def slow_done(commit, *args, real=type(one.begin()).done, **how):
        began.set()
        go.wait(120)
        return real(commit, *args, **how)

    def late(name, collection):
        out: list = []
        began.clear()
        go.clear()
        slow = Engine(spark, tmp_path, analyzer="simple")
        real_begin = slow.store.begin

        def begin():
            commit = real_begin()
            commit.done = lambda *a, **h: slow_done(commit, *a, **h)
            return commit

        slow.store.begin = begin

        def run():
            try:
                out.append(slow.ingest_bytes([(name, f"{name} eggs".encode())], collection)[0].status)
            except Conflict as e:
                out.append(e)

        t = threading.Thread(target=run)
        t.start()
        assert began.wait(300)
        return t, out

    t, out = late("b.md", "work")
    assert two.ingest_bytes([("c.md", b"more eggs")], "home")[0].status == "ingested"
    go.set()
    t.join()
    assert out == ["ingested"] and one.version == 3
    ids = [r.id for r in one.table("sources").collect()]
    assert len(ids) == len(set(ids)) == 3 and one.table("nodes").select("id").distinct().count() == 3
    assert {h.fields["name"] for h in engine.search(["eggs"])} == {"b.md", "c.md"}
    assert {h.fields["name"] for h in engine.search(["-eggs"])} == {"a.md"} and {h.fields["name"] for h in engine.search(["boil or -more"])} == {"a.md", "b.md"}
    t, out = late("a.md", "home")
    assert two.ingest_bytes([("a.md", b"boil milk")], "home")[0].status == "ingested"
    go.set()
    t.join()
    assert isinstance(out[0], Conflict) and [h.fields["name"] for h in engine.search(["milk"])] == ["a.md"] and not engine.search(["water"])
    found = engine.grep("boil m[ai]lk")["matches"]
    assert [m["path"] for m in found] == ["/docs/home/a.md"]


def test_vacuum_keeps_what_is_leased(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodeweave.store.SEGMENTS", 2)
    store = Store(spark, tmp_path)
    schema = store.table("skills").schema
    row = lambda i: spark.createDataFrame([(i, f"s{i}", "d", None, None, None, None)], schema)
    for i in range(2):
        work = store.begin()
        work.add("skills", row(i))
        work.done()
    with store.lease() as seen:
        work = store.begin()
        work.add("skills", row(2))
        work.done()  # the third segment: they are merged
        assert len(store.manifest()["tables"]["skills"]) == 1
        gone = store.vacuum(keep=1)
        assert store.table("skills", seen).count() == 2 and len(gone) == 1  # the segment that only the version between had
    assert len(store.vacuum(keep=1)) == 2 and store.versions() == [4]
    assert sorted(r.source_id for r in store.table("skills").collect()) == [0, 1, 2] and len(store.files.names("data/skills")) == 1


def test_merged_postings_stay_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodeweave.store.SEGMENTS", 1)
    engine = Engine(spark, tmp_path, analyzer="simple")
    for name, text in (("a.md", b"zebra apple"), ("b.md", b"apple mango")):
        engine.ingest_bytes([(name, text)])
    segments = engine.store.manifest()["tables"]["postings"]
    assert len(segments) == 1
    terms = [r.term for f in sorted(engine.store.files.names(segments[0]["path"])) if f.endswith(".parquet") for r in spark.read.parquet(engine.store.files.at(f"{segments[0]['path']}/{f}")).select("term").collect()]
    assert terms == sorted(terms) and len(terms) > 4
    assert [h.fields["name"] for h in engine.search(["apple -zebra"])] == ["b.md"]


def test_best_fragments_are_those_of_all_windows():
    """Against all windows of the free places, again after each choice."""
    for _ in range(300):
        n, most, least = RNG.randrange(1, 60), RNG.choice([3, 8, 32]), RNG.choice([0, 2, 3])
        words = [RNG.choice("abcdxyzuvw") for _ in range(n)]
        hits = [(i, {w}) for i, w in enumerate(words) if w in "abcd"]
        found = fts.stretches(hits, n, 2, most, least)
        taken: set[int] = set()
        for _ in range(2):
            windows = [range(i, j) for i in range(n) for j in range(i + 1, min(n, i + most) + 1) if words[i] in "abcd" and words[j - 1] in "abcd" and not taken & set(range(i, j))]
            if not windows:
                break
            best = max(windows, key=lambda r: (len({words[i] for i in r} & set("abcd")), sum(words[i] in "abcd" for i in r), -r.start, -len(r)))
            own = [f for f in found if f[0] <= best.start and best.stop <= f[1]]
            assert len(own) == 1 and own[0][1] - own[0][0] <= max(len(best), least)
            taken |= set(range(*own[0]))
        assert taken == {i for f in found for i in range(*f)} and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    assert fts.snippet("one two tea three", {"tea"}, least=3) in ("two **tea** three", "one two **tea**") and fts.snippet("no hit", {"tea"}) == "no hit"


def test_search_by_stored_codes(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    base = base.union(spark.createDataFrame([(9_001, None), (9_002, [0.0] * 64)], base.schema))
    asked = base.where("vec_id % 20 = 0")
    true = vectors.nearest(base, asked, 6)
    rows = lambda df: {(r.query_id, r.vec_id, r["rank"]) for r in df.collect()}
    measured = {}
    for kind in ("float", "half", "int8", "binary"):
        codes = vectors.coded_vectors(base, kind).persist()
        assert codes.count() == base.count() - 2
        measured[kind] = [vectors.compared_storage(true, f, 5).first() for f in (vectors.nearest_codes(codes, asked, 6, kind), vectors.nearest_by_codes(codes, base, asked, 6, kind))]
        if kind == "float":
            assert rows(vectors.nearest_by_codes(codes, base, asked, 6, kind)) == rows(true)
    assert all(m.recall >= 0.9 and m.mrr >= 0.9 for kind in ("float", "half", "int8") for m in measured[kind])
    assert measured["binary"][1].recall >= measured["binary"][0].recall
    assert vectors.nearest_codes(codes.limit(0), asked, 3, "binary").count() == 0


@pytest.mark.parametrize("kind", ["exact", "float", "binary"])
def test_queries_of_a_block_are_compared_some_at_a_time(spark, monkeypatch, kind):
    """No distances of whole blocks: a task holds SOME rows of them.  Ties at the edge go to the least ids."""
    import numpy as np

    monkeypatch.setattr(vectors, "SOME", 16)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.integers(-2, 3, (60, 8)).astype(float) + 0.25, 2, axis=0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    if kind == "exact":
        found = vectors.nearest(rows, rows, 5)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = np.round(1 - u @ u.T, 6)
    else:
        found = vectors.nearest_codes(vectors.coded_vectors(rows, kind), rows, 5, kind)
        u = vectors.quantized(x / np.linalg.norm(x, axis=1, keepdims=True), kind)
        d = np.round(vectors.quantized_distance(u, u, kind).astype(float), 9)
    want = {(q, i) for q in range(len(x)) for i in np.lexsort((np.arange(len(x)), d[q]))[:5]}
    assert {(r.query_id, r.vec_id) for r in found.collect()} == want

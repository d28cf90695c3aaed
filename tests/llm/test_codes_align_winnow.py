"""Vector codes, tokenizer alignment and winnowing against brute force, on odd tables too."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeweave.llm import align, codes, winnow

SF = "/root/testdata/sf0.001"
RNG = random.Random(7)
LONG = " ".join(RNG.choice(["alpha", "beta", "gamma", "Ünï", "x9"]) for _ in range(9_000))


def same_rows(got, want):
    assert collections.Counter(map(repr, got)) == collections.Counter(map(repr, want))


# Vector codes


def plain_codes(rows, width):
    """rows: (id, vector, label); all by the definition, without bounds."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and all(abs(256 * x) <= codes.largest(width) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = width // 16
    parts = [[v[p * d : p * d + d] for p in range(16)] for _, v, _ in kept]
    books = [[list(parts[r][p]) for r in range(min(64, len(kept)))] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        new = []
        for p in range(16):
            members = collections.defaultdict(list)
            for row in parts:
                members[nearest(p, row[p])[1]].append(row[p])
            new.append([[sum(c) // len(c) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])])
        books = new
    found = [[nearest(p, row[p]) for p in range(16)] for row in parts]
    errors = [sum(x[0] for x in f) for f in found]
    by_label = collections.Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{x[1]:02x}" for x in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)]


@pytest.mark.parametrize("n,width", [(150, 64), (20, 16), (70, 48)])
def test_codes(spark, n, width):
    rows = [(k // 2 if k % 7 == 0 else k, [float(np.float32(RNG.choice([RNG.gauss(0, 0.2), RNG.randrange(-3, 3) / 256]))) for _ in range(width)], RNG.choice([None, 1, 2])) for k in range(n)]
    rows += [rows[3], (None, rows[5][1], 1), (None, None, 1), (900, None, 1), (901, [], 2), (902, [None] * width, 2), (903, [float("nan")] * width, 1), (904, [float("-inf")] + [0.0] * (width - 1), 1), (905, [0.5] * (width + 16), 1), (906, [0.5] * 3, 1), (907, [3e38] * width, None)]
    table = spark.createDataFrame([(*r, "code", 5) for r in rows], "vec_id long, embedding array<float>, label int, code string, id long")
    same_rows([tuple(r) for r in codes.compressed_vectors(table).collect()], plain_codes(rows, width))
    assert codes.compressed_vectors(table.limit(0)).count() == 0
    assert codes.compressed_vectors(table.where("vec_id > 899")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_many_labels_meet_by_a_shuffle(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    few = codes.compressed_vectors(rows).collect()
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    same_rows(few, codes.compressed_vectors(rows).collect())


def test_bounds_leave_no_nearest_entry_out():
    rng = np.random.default_rng(3)
    for width, spread in ((4, 3), (4, 300), (5, 40), (1, 9), (16, 1 << 20)):
        entries, parts = (rng.integers(-spread, spread + 1, (k, width)) for k in (64, 4_000))
        distances = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        index, error = codes.Codebook(entries).nearest(parts)
        assert (index == distances.argmin(axis=1)).all() and (error == distances.min(axis=1)).all()


def test_codes_decode_to_their_entries(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors, width = codes.integer_vectors(rows)
    books = codes.learned_codebooks(vectors, width)
    coded = codes.coded(vectors, books, width)
    back = codes.decoded_vectors(coded, books).join(vectors.select("id", F.col("vec").alias("own")), "id").join(coded.select("id", "error"), "id").collect()
    assert back and all(sum((a - b) ** 2 for a, b in zip(r.vec, r.own, strict=True)) == r.error for r in back)


# Alignment


def plain_alignment(texts):
    """Two pointers over whole texts that are encoded by the libraries."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbols = align.byte_symbols()
    made = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            made.append(([], [], [], ""))
            continue
        i = j = end_a = end_b = 0
        links, groups, own_a, own_b = [], [], [], []
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            stop_a, stop_b = end_a + len(bytes_a[i]), end_b + len(bytes_b[j])
            if stop_a <= stop_b:
                own_a, i, end_a = [*own_a, ids_a[i]], i + 1, stop_a
            if stop_b <= stop_a:
                own_b, j, end_b = [*own_b, ids_b[j]], j + 1, stop_b
            if stop_a == stop_b:
                groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
                own_a, own_b = [], []
        made.append((ids_a, ids_b, links, ";".join(groups)))
    counts = collections.Counter(pair for m in made for pair in set(m[2]))
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), g, hashlib.sha256(g.encode()).hexdigest() if g else "") for x, y, links, g in made]


ODD = [None, "", " ", "  two  spaces \n\n x\t y ", "a▁b c", "foo▁ bar", "don't 12345 <|endoftext|> <s> [INST] \x00\x1c a \x1c b é 😀 漢字 ﬁ", "x" * 3000, LONG, "  a   b　c", "'s 's'll  '"]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 20])
def test_alignments(spark, monkeypatch, frequent):
    monkeypatch.setattr(align, "FREQUENT", frequent)
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], LONG]
    rows = [(None if k == 1 else k // 2, t, "row", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n_a int")
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    want = [(r[0], *w) for r, w in zip(rows, plain_alignment([t or "" for t in texts]), strict=True)]
    same_rows([tuple(r) for r in align.alignments(docs, *paths).collect()], want)
    assert align.alignments(docs.limit(0), *paths).count() == 0


# Winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items):
    def words(text):
        return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for at in range(max(len(w) - 9, 1) if w else 0):
            wins[tuple(w[at : at + 10])].add("null" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (win := tuple(w[at : at + n])) in wins:
                    hit |= set(range(at, at + n))
                    named |= wins[win]
        out.append((d, len(w), len(hit), len(named), bool(hit), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()))
    return out


def winnow_tables(short):
    few = [f"w{k}" for k in range(6)]
    some = lambda n: " ".join(RNG.choice(few) for _ in range(n))
    passages = [" ".join(f"{RNG.choice('abcdeé')}{RNG.randrange(9)}" for _ in range(RNG.randrange(10, 60))) for _ in range(12)]
    items = [(k, p) for k, p in enumerate(passages)] + [(20, passages[0]), (20, passages[1] + " more"), (None, passages[2].upper()), (21, None), (22, ""), (23, "?! -"), (24, "same " * 40)]
    if short:
        items += [(30, "w1 w2 w3"), (31, "w4 w5"), (32, "ünï"), (33, some(5)), (34, some(8)), (35, "w0 w0 w0 w0")]
    docs = [(1, None), (2, ""), (3, " \x00;"), (4, LONG), (4, LONG), (None, passages[3]), (5, "same " * 25), (6, some(400)), (7, passages[4].replace(" ", "--\n"))]
    docs += [(8 + k, f"{some(k)} {p[: RNG.randrange(20, len(p))]} {some(3)} {p[len(p) // 2 :]}") for k, p in enumerate(passages)]
    docs += [(40, f"{some(2_050)} {passages[5]} {some(1_940)} {passages[6]} {some(3_000)} {passages[7]}"), (41, "Ünï É " + passages[8])]
    return docs, items


@pytest.mark.parametrize("short,size", [(False, winnow.PASS), (True, winnow.PASS), (True, 60)])
def test_winnowing(spark, monkeypatch, short, size):
    monkeypatch.setattr(winnow, "PASS", size)
    docs, items = winnow_tables(short)
    table = spark.createDataFrame([(*d, "row", [1], 5) for d in docs], "doc_id long, text string, row string, words array<int>, item_id int")
    tests = spark.createDataFrame([(*i, "win") for i in items], "item_id long, text string, key string")
    found = winnow.decontaminated(table, tests)
    same_rows([tuple(r) for r in winnow.decontamination_digests(found).collect()], plain_hits(docs, items))
    for r in found.where("contaminated").collect():
        assert sum(h.stop - h.start for h in r.hits) == r.n_hit and all(x.stop < y.start for x, y in zip(r.hits, r.hits[1:], strict=False))
    assert winnow.decontaminated(table.limit(0), tests).count() == 0
    assert winnow.decontaminated(table, tests.limit(0)).where("NOT contaminated AND n_items = 0").count() == len(docs)


def test_winnowing_is_native(spark):
    rows = winnow.decontaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    plan = rows._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan

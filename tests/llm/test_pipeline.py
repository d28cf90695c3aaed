"""The pipeline's stages on a small corpus, each held against its rows going in."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lodeweave.llm import bpe, mixing, quality, queries, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """What goes into each stage, and what comes out of the last."""
    rows = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        rows.append(stage(spark, rows[-1], SF).persist())
    return rows


def test_columns(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "secret scans", "source mix", "byte bpe"]
    for rows in staged[1:-1]:
        assert rows.columns == staged[0].columns


def test_quality_stage(spark, staged):
    trees = quality.fit_quality_model(staged[0], spark.read.parquet(f"{SF}/labels.parquet"))
    before = staged[0].collect()
    kept = quality.verdicts([(r.text or "").encode() for r in before], trees)[3]
    assert collections.Counter(r for r, k in zip(before, kept, strict=True) if k) == collections.Counter(staged[1].collect())


def test_duplicate_stage(staged):
    rows = staged[1].collect()
    hashes = [simhash.shingle_hashes(r.text.encode(), 5) for r in rows]
    a = np.array([simhash.fingerprint_of(h) for h in hashes], np.uint64)
    b = np.array([simhash.fingerprint_of(simhash.second_hashes(h)) for h in hashes], np.uint64)
    root = {r.doc_id: r.doc_id for r in rows}
    changed = True
    while changed:
        changed = False
        for i, r in enumerate(rows):
            apart = np.bitwise_count(a ^ a[i])
            for j in np.flatnonzero((apart <= simhash.STAGE["radius"]) & (apart + np.bitwise_count(b ^ b[i]) <= simhash.STAGE["both"])):
                low = min(root[r.doc_id], root[rows[j].doc_id])
                changed |= root[r.doc_id] != low or root[rows[j].doc_id] != low
                root[r.doc_id] = root[rows[j].doc_id] = low
    assert sorted(set(root.values())) == sorted(r.doc_id for r in staged[2].collect())


def test_secret_stage(staged):
    after = {r.doc_id: r for r in staged[3].collect()}
    assert len(after) == staged[2].count()
    for r in staged[2].collect():
        assert after[r.doc_id].text == secrets.redacted_text(r.text) and after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_mix_stage(staged):
    """Each row's number of copies against Poisson numbers that are inverted here, one by one."""
    rows = staged[3].collect()
    of_source = collections.Counter(r.source for r in rows)
    weight = {s: queries.MIX.get(s, 1.0) for s in of_source}
    want = collections.Counter()
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * len(rows) / of_source[r.source]
        parts = max(1, math.ceil(rate / mixing.PART))
        for j in range(1, parts + 1):
            u = (int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            n, p = 0, math.exp(-rate / parts)
            below = p
            while below < u:
                n += 1
                p *= rate / parts / n
                below += p
            want[r] += n
    assert collections.Counter(staged[4].collect()) == +want and len(+want) > 50


def test_bpe_stage(staged):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    text = {r.doc_id: r.text for r in staged[3].collect()}
    out = staged[5].collect()
    assert len(out) == staged[4].count()
    for r in out:
        assert r.ids == library.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_empty_documents(spark, staged):
    rows = staged[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
    assert rows.count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and ids, and columns with names that stages use themselves."""
    prose = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 400").orderBy("doc_id").limit(12).collect()}
    good = list(prose.values())
    secret = "q7Zp2Lk9Xw4Rt6Yb1Nc8Vm3Js5Hd0Fg7Qe2Ua9Kx4"
    rows = [(1, None, "en", "src0", 0), (2, "", None, None, None), (3, good[0], "en", "src0", 1), (3, good[0], "en", "src0", 1), (4, good[0], "en", None, 1), (5, good[1], "en", "src1", 2), (5, good[2], "en", "src1", 3)]
    rows += [(None, good[3], "en", "src2", 4), (None, good[3], "en", "src2", 4), (6, " ".join(good) * 40, "en", "src0", 5), (7, f"{good[4]} {secret}", "en", "src0", 6), (8, good[5] + " 😀\x00é", "en", "", 7)]
    more = [(*r, True, -1, "x", 2, "y", 0.5) for r in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, h string, node long, row string, again double")


def test_odd_documents(spark, odd):
    rows = [odd]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows[-1], SF).persist()
        assert out.columns == odd.columns, name
        rows.append(out)
    quality_, near, secret, mixed = rows[1:]
    assert {r.doc_id for r in quality_.collect()} <= {3, 4, 5, 6, 7, 8, None} and quality_.where("text IS NULL OR text = ''").isEmpty()
    kept = near.collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 4 not in ids and sum(r.doc_id is None for r in kept) == quality_.where("doc_id IS NULL").count()
    assert secret.count() == len(kept) and not any("q7Zp2Lk9" in (r.text or "") for r in secret.collect())
    copies = mixed.groupBy("doc_id").count().collect()
    assert {r.doc_id for r in copies} <= {r.doc_id for r in kept} and {repr(r) for r in mixed.collect()} <= {repr(r) for r in secret.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    assert last.count() == mixed.count()
    whole = corpus_pipeline.STAGES[-1][1](spark, odd, SF).collect()
    assert len(whole) == odd.count() and all(r.n_tokens == 0 for r in whole if r.doc_id in (1, 2))

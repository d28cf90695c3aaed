"""Cross-tokenizer alignment by elementary intervals, and how often two tokenizers' ids are linked in the corpus.

A text with a space before it is encoded by A (byte-level BPE) and B (BPE over pieces with byte fallback).  The sorted union
of both tokenizers' byte ends cuts it into elementary intervals, and the owners of each, by binary search in both arrays of
ends, are an A and a B token that overlap: each interval is one link and each link one interval.  Ends that both share close
the groups.  A group's A and B tokens are listed together; where one side has one token their product is the group's links.

Neither tokenizer has a token that reaches over a space between two other characters that aren't white space (A's pattern
begins a piece there, and B's vocabulary is looked through for it), so both end there and texts are cut at those spaces.
Each different part is encoded and aligned once, as long as it's remembered, and a text's rows are those of its parts in
order.  A part's last character, if it's a sign that no piece of B has behind a letter, is put to the part before it.  A pair's count is the number of rows of documents that have it linked.  Pairs that are over a 1/FREQUENT of all
pairs of documents are fewer than FREQUENT, and are broadcast; the others, none of which is hot, meet their documents by a
shuffle.  The highest count of each A id is broadcast too, as ids are below 65,536.

Defined cases: a null or empty text, and one whose tokens' joined bytes aren't its own with a space before it (such as one
with U+2581), has no tokens, and zeros; rows with one id are documents of their own; a null id stays null; an empty table
gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeweave.llm.shared import checkpointed

#: No pair that is broadcast has less than this part of all pairs.
FREQUENT = 1 << 18
#: Parts of a generation that is remembered (two of them are), and characters of a part that is.
CACHED, CACHED_CHARS = 250_000, 64
#: Documents, and characters of them, that are aligned at once.
BLOCK_DOCS, BLOCK_CHARS = 500, 2_000_000
#: Where both tokenizers end: before a space between characters that aren't white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SHIFT = 16


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level tokens have for each byte: itself where it is one, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(0x100 + k): b for k, b in enumerate(others)}}


#: Tokens and links of a part: n_a, n_b, n_groups, its pairs as 32-bit numbers with the A id in the upper bits, and its
#: groups' ids as text.  A plain tuple, as the collector of garbage doesn't look through those.
Part = tuple[int, int, int, bytes, str]
NO_TOKENS: Part = (0, 0, 0, b"", "")


class Aligner:
    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        gc.set_threshold(500_000, 20, 100)  # parts are many and have no cycles
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        symbols = byte_symbols()
        self.a_bytes = {i: bytes(symbols[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # a sign after a letter is a token of its own on both sides, if no piece has the two
        beside = {x for i, p in enumerate(pieces) if not self.b.is_byte(i) for x in zip(p, p[1:], strict=False)}
        self.signs = {c: (self.a.token_to_id(c), self.b.piece_to_id(c)) for c in ",.;:!?" if c in pieces and not any(y == c and x.isalpha() for x, y in beside)}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces) or max(self.a_bytes) >= 1 << _SHIFT or len(pieces) > 1 << _SHIFT:
            raise ValueError("pieces with inner spaces, or ids of over 16 bits, aren't supported")
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(t) for t in self.a_bytes.values()]
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.names = [str(i) for i in range(1 << _SHIFT)]
        self._parts: dict[str, Part | None] = {}
        self._old: dict[str, Part | None] = {}

    def align(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> list[Part | None]:
        """The parts ` text` with their tokens; none for those whose tokens have other bytes.  All are laid behind each other and aligned at once."""
        if not texts:
            return []
        whole = [(" " + t).encode() for t in texts]
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        stops = np.cumsum([len(w) for w in whole])
        every = b"".join(whole)
        if not all(
            min(map(len, ids)) and np.array_equal(ends[np.cumsum([len(x) for x in ids]) - 1], stops) and b"".join([known[i] for i in flat]) == every
            for ids, ends, flat, known in ((a, ends_a, flat_a, self.a_bytes), (b, ends_b, flat_b, self.b_bytes))
        ):
            fine = [b"".join([self.a_bytes[i] for i in x]) == w == b"".join([self.b_bytes[i] for i in y]) for x, y, w in zip(a, b, whole, strict=True)]
            some = iter(self.align(*([x for x, f in zip(xs, fine, strict=True) if f] for xs in (texts, a, b))))
            return [next(some) if f else None for f in fine]
        ends = np.union1d(ends_a, ends_b)
        owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        pairs = (ids_a[owner_a] << _SHIFT | ids_b[owner_b]).astype(np.uint32)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cut_a, cut_b = (np.append(0, np.searchsorted(e, shared) + 1).tolist() for e in (ends_a, ends_b))
        names_a, names_b = [self.names[i] for i in flat_a], [self.names[i] for i in flat_b]
        groups = [f"{','.join(names_a[i:k])}|{','.join(names_b[j:m])}" for (i, k), (j, m) in zip(pairwise(cut_a), pairwise(cut_b), strict=True)]
        to_link, to_group = (np.append(0, np.searchsorted(e, stops) + 1).tolist() for e in (ends, shared))
        return [(len(x), len(y), g1 - g0, pairs[l0:l1].tobytes(), ";".join(groups[g0:g1])) for x, y, (l0, l1), (g0, g1) in zip(a, b, pairwise(to_link), pairwise(to_group), strict=True)]

    def parts(self, needed: set[str]) -> dict[str, Part | None]:
        """What each part is aligned to."""
        if len(self._parts) > CACHED:
            self._parts, self._old = {}, self._parts
        signed = {p for p in needed if p[-1:] in self.signs and p[-2:-1].isalpha() and p not in self._parts}
        wanted = (needed - signed) | {p[:-1] for p in signed}
        found = {p: self._parts[p] for p in wanted if p in self._parts}
        again = {p: self._old[p] for p in wanted - found.keys() if p in self._old}
        fresh = list(wanted - found.keys() - again.keys())
        made = {}
        if fresh:
            coded_a = self.a.encode_batch_fast([" " + p for p in fresh], add_special_tokens=False)
            coded_b = self.b.encode(fresh, num_threads=1)
            made = dict(zip(fresh, self.align(fresh, [x.ids for x in coded_a], coded_b), strict=True))
        self._parts.update((p, x) for some in (again, made) for p, x in some.items() if len(p) <= CACHED_CHARS)
        known = {**found, **again, **made}
        return known | {p: self._with_sign(known[p[:-1]], p[-1]) for p in signed}

    def _with_sign(self, part: Part | None, sign: str) -> Part | None:
        """A part that ends in a letter, and a sign behind it."""
        if part is None:
            return None
        a, b = self.signs[sign]
        return part[0] + 1, part[1] + 1, part[2] + 1, part[3] + np.uint32(a << _SHIFT | b).tobytes(), f"{part[4]};{a}|{b}"


_MADE: dict[bytes, Aligner] = {}


def _aligner(a: bytes, b: bytes) -> Aligner:
    key = hashlib.sha256(a + b).digest()
    if key not in _MADE:
        _MADE[key] = Aligner(a, b)
    return _MADE[key]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the rows with their texts: BLOCK_DOCS rows and BLOCK_CHARS characters at most, or one row."""
    start, size, texts = 0, 0, []
    for i in range(batch.num_rows):
        text = batch.column(1)[i].as_py() or ""
        if texts and (len(texts) >= BLOCK_DOCS or size + len(text) > BLOCK_CHARS):
            yield batch.slice(start, i - start), texts
            start, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield batch.slice(start), texts


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """For each document: the id, n_a, n_b, n_groups, n_links, groups (if kept), groups_sha256, and its different pairs with their numbers.

    Both files are read at the driver and broadcast; they are vocabularies of ids below 65,536.
    """
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times"]
        for batch in batches:
            for rows, texts in _blocks(batch):
                cut = [_CUT.split(t) if t else [] for t in texts]
                known = aligner.parts(set().union(*cut))
                # documents with a part that can't be aligned have none
                odd = {p for p, x in known.items() if x is None}
                cut = [[] if odd and not odd.isdisjoint(words) else words for words in cut]
                parts = [x or NO_TOKENS for x in known.values()]
                place = dict(zip(known, range(len(parts)), strict=True))
                sizes = np.array([x[:3] for x in parts], np.int64).reshape(-1, 3)
                bounds = np.cumsum([0, *(len(x[3]) // 4 for x in parts)])
                every = np.frombuffer(b"".join([x[3] for x in parts]), np.uint32)
                at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
                of = np.repeat(np.arange(len(cut)), [len(words) for words in cut])
                counts = np.stack([np.bincount(of, sizes[at, k], len(cut)).astype(np.int64) for k in range(3)])
                # the links of all parts, in order: where each part's begin, and how far into them
                n = np.diff(bounds)[at]
                link_of = np.repeat(of, n)
                links = every[np.arange(n.sum()) + np.repeat(bounds[at] - np.cumsum(n) + n, n)]
                different, times = np.unique(link_of << 2 * _SHIFT | links, return_counts=True)
                ends = pa.array(np.searchsorted(different, np.arange(len(cut) + 1) << 2 * _SHIFT).astype(np.int32))
                texts_of = list(map([x[4] for x in parts].__getitem__, at.tolist()))
                groups = [";".join(texts_of[i:j]) for i, j in pairwise(np.cumsum([0, *map(len, cut)]).tolist())]
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), *(pa.array(c) for c in counts), pa.array(np.bincount(link_of, minlength=len(cut))),
                    pa.array(groups if keep_groups else [None] * len(groups), pa.string()), pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(different & ((1 << 2 * _SHIFT) - 1))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                ], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<int>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(made, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (documents that have it) and best (whether no pair of its A id has more), of the rows of aligned()."""
    counts = checkpointed(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    most = counts.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), F.shiftright(counts["pair"], _SHIFT) == most["a"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """For each document: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (if kept) and groups_sha256."""
    links = checkpointed(aligned(docs, a_path, b_path, id_col, text_col, keep_groups).withColumn("row", F.monotonically_increasing_id()))
    counts = checkpointed(pair_counts(links))
    every = counts.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") > every // FREQUENT
    # fewer than FREQUENT, by their number
    frequent = counts.where(common).orderBy("pair").toPandas()
    table = docs.sparkSession.sparkContext.broadcast(tuple(frequent[c].to_numpy() for c in ("pair", "n", "best")))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            keys, times = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            at = np.searchsorted(pair, keys)
            known = np.zeros(len(keys), bool) if not len(pair) else pair[np.minimum(at, len(pair) - 1)] == keys
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row[known], n[at[known]] * times[known])
            np.add.at(sums[1], row[known], best[at[known]] * times[known])
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=batch.num_rows))]).astype(np.int32))
            rare = (pa.ListArray.from_arrays(ends, pa.array(x[~known])) for x in (keys, times))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), *rare], ["row", "count_sum", "n_best", "pairs", "times"])

    split = checkpointed(links.select("row", "pairs", "times").mapInArrow(summed, "row long, count_sum long, n_best long, pairs array<long>, times array<long>"))
    rare = split.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = rare.join(counts.where(~common), "pair").select("row", (F.col("n") * F.col("times")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
    sums = split.select("row", "count_sum", "n_best").unionByName(met).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return links.drop("pairs", "times").join(sums, "row").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")

"""Suffix-array dedup: bytes covered by a string of WINDOW bytes that also begins elsewhere are removed.

Every window is assigned the anchors it contains: the KGRAM-byte strings of least hash.  Equal windows have equal
anchors at equal places, so a repeated window lies in the contexts (all bytes that a window around the anchor can have)
of two occurrences of one anchor.  Contexts that occur twice with all their bytes are covered whole.  Of the others, those
that by hashes of what stands beside the anchor may have a window in common go, one of each kind, by their anchor, to a
task.  It cuts them to what any two have in common, builds a run-length index of them (lodeweave.llm.rlbwt), streams
their matching statistics and marks long matches.  An anchor with over HOT different contexts that may have a window in
common isn't indexed in one task: the windows of its contexts are counted by a 128-bit digest instead.

Texts are known by their 64-bit hash and length, contexts by their anchor's and their own 64-bit hashes; copies are
worked on once a task.

Defined cases: a null text counts as empty, nothing removed; rows with equal texts (or ids) repeat each other; a text
shorter than WINDOW keeps all; an empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.rlbwt import joined, second_matches
from lodeweave.llm.shared import as_bytes, checkpointed, shuffle_width

WINDOW = 400
KGRAM = 128
#: An anchor with more different contexts of that kind than HOT (some 34 MB) doesn't go to one task.
HOT = 50_000
#: Up to so many keys by which contexts meet are broadcast.
BROADCAST_KEYS = 100_000
#: Bytes of contexts in an index, if no single anchor has more.
INDEX_BYTES = 2_000_000
#: Places of a text that are hashed at once.
SEGMENT = 1_000_000
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            p = np.full(max(n, 1 << 14), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Polynomial hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * down[:-1], out=self.sums[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.up[low]

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:-size]) * self.up[:n]


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or largest) of each `width` neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


#: Common stretches beside an anchor are told apart in so many steps a side.
STEPS = 4


@dataclass
class Anchors:
    """Of each anchor: its hash, its context's hash, its place, and STEPS 16-bit hashes of what stands left and right of it (0: less stands there)."""

    hash: np.ndarray
    context: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray


def bounds(at: np.ndarray, n: np.ndarray | int, window: int, kgram: int) -> tuple[np.ndarray, np.ndarray]:
    """A context: what the windows that have this anchor can cover."""
    return np.maximum(at - (window - kgram), 0), np.minimum(at + window, n)


def anchors(text: bytes, window: int = WINDOW, kgram: int = KGRAM) -> Anchors | None:
    grams, step = window - kgram + 1, (window - kgram) // STEPS
    n_windows = len(text) - window + 1
    found: list[tuple[np.ndarray, ...]] = []
    data = np.frombuffer(text, np.uint8)
    done = -1
    for start in range(0, max(n_windows, 0), SEGMENT):
        # the windows that begin in this segment, and the bytes of their anchors' contexts
        stop = min(start + SEGMENT, n_windows)
        low, high = max(0, start - grams), min(len(text), stop + 2 * window)
        hashed = Hashed(data[low:high])
        order = mixed(hashed.all(kgram))[start - low : stop - low + grams - 1]
        least = sliding(order, grams, True)
        wide = np.zeros(len(order) + grams - 1, np.uint64)
        wide[grams - 1 : grams - 1 + len(least)] = least
        at = np.flatnonzero(sliding(wide, grams, False) == order) + start
        at = at[at > done]
        if not len(at):
            continue
        done = int(at[-1])
        a, b = bounds(at, len(text), window, kgram)
        whole = mixed(hashed.of(a - low, b - low) + mixed(((at - a) << 16 | (b - a)).astype(np.uint64)))
        sides = []
        for sign in (-1, 1):
            packed = np.zeros(len(at), np.uint64)
            for j in range(1, STEPS + 1):
                x, y = (at - j * step, at) if sign < 0 else (at + kgram, at + kgram + j * step)
                fine = (x >= a) & (y <= b)
                short = mixed(hashed.of(np.where(fine, x, a) - low, np.where(fine, y, a) - low)) % np.uint64(65535) + np.uint64(1)
                packed |= np.where(fine, short, np.uint64(0)) << np.uint64(16 * (j - 1))
            sides.append(packed)
        found.append((order[at - start], whole, at, *sides))
    return Anchors(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else None


_NAMES = ["h", "c", "k", "n", "at", "left", "right", "lead"]
_ANCHORS = "h long, c long, k long, n int, at int, left long, right long, lead boolean"


def anchor_rows(texts: DataFrame, window: int = WINDOW, kgram: int = KGRAM) -> DataFrame:
    """Anchors of texts (k, text).  A task gives those of equal texts twice at most; lead: the first two of a context in a batch."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            parts = []
            for k, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                key = (k, len(text))
                seen[key] = seen.get(key, 0) + 1
                if seen[key] <= 2 and (x := anchors(text, window, kgram)):
                    m = len(x.at)
                    parts.append((x.hash, x.context, np.full(m, k), np.full(m, len(text), np.int32), x.at.astype(np.int32), x.left, x.right))
            if not parts:
                continue
            h, c, k, n, at, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.lexsort((c, h))
            same = (h[by[1:]] == h[by[:-1]]) & (c[by[1:]] == c[by[:-1]])
            lead = np.ones(len(h), bool)
            lead[by[2:]] = ~(same[1:] & same[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (h, c, k, n, at, left, right, lead)], _NAMES)

    return texts.mapInArrow(made, _ANCHORS)


_WHOLE, _INDEX, _COUNT, _OPEN = 0, 1, 2, 3
_SORTED = "kind int, h long, c long, k long, n int, at int, twice boolean, left long, right long"


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[np.ndarray]]:
    """Columns, batch by batch, cut only where the sorted key column changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.flatnonzero(rows[key] != rows[key][-1])
        last = int(change[-1]) + 1 if len(change) else 0
        if held and (last or held[-1][key][-1] != rows[key][0]):
            yield [np.concatenate(c) for c in zip(*held, [c[:last] for c in rows], strict=True)]
            held = []
        elif last:
            yield [c[:last] for c in rows]
        held.append([c[last:] for c in rows])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _steps_shared(run: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """How many steps beside its anchor each context has in common with another of its run."""
    packed, steps = packed.view(np.uint64), np.zeros(len(run), np.int64)
    for j in range(STEPS):
        short = ((packed >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64)
        _, of, times = np.unique(run << 16 | short, return_inverse=True, return_counts=True)
        steps += (steps == j) & (short > 0) & (times[of] > 1)
    return steps


def _told(rows: DataFrame) -> DataFrame:
    """What sorted_anchors() gives for anchors within one of its ranges; those that may go on in the next are left open."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(h: np.ndarray, c: np.ndarray, *rest: np.ndarray, open_h: list[int]) -> pa.RecordBatch:
            left, right = rest[3:]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
            twice = np.diff(np.append(first, len(h))) > 1
            run = np.cumsum(np.concatenate([[0], h[first][1:] != h[first][:-1]]))
            edge = np.isin(h[first], open_h)
            # windows in common need (window - kgram) bytes beside the anchor: STEPS steps, of which two may be begun
            able = ~edge & (_steps_shared(run, left[first]) + _steps_shared(run, right[first]) >= STEPS - 1)
            kinds = np.bincount(run, able)[run]
            out = []
            for kind, some in ((_WHOLE, twice), (_INDEX, able & (kinds > 1)), (_OPEN, edge)):
                i = first[some]
                out.append((np.full(len(i), kind, np.int32), h[i], c[i], *(x[i] for x in rest[:3]), twice[some], left[i], right[i]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], [x.split()[0] for x in _SORTED.split(", ")])

        # the first and the last anchor are told apart only when the next group, or none, has come
        start, held = None, None
        for group in _groups(batches, 0):
            start = int(group[0][0]) if start is None else start
            if held is not None:
                yield judged(*held, open_h=[start])
            held = group
        if held is not None:
            yield judged(*held, open_h=[start, int(held[0][-1])])

    return rows.mapInArrow(told, _SORTED)


def _closed(open_rows: DataFrame, hot: int) -> DataFrame:
    """Of the anchors that ranges left open, the contexts that may have a window in common with another, by joins.

    Of the 272 bytes beside the anchor that equal windows share, whole steps are i on the left and STEPS - 1 - i on the right
    for some i: contexts meet by the hashes of these.
    """
    at = lambda side, i: F.shiftrightunsigned(side, 16 * (i - 1)).bitwiseAND(F.lit(0xFFFF)) if i else F.lit(1).cast("long")
    sides = [(at("left", i), at("right", STEPS - 1 - i)) for i in range(STEPS)]
    rest, parts = open_rows.select("h", "c", "left", "right"), []
    for i, (x, y) in enumerate(sides):
        each = lambda rows: rows.select("h", "c", x.alias("x"), y.alias("y")).where("x > 0 AND y > 0")  # noqa: B023, E731
        shared = checkpointed(each(open_rows).groupBy("h", "x", "y").agg(F.count("*").alias("times")).where("times > 1").select("h", "x", "y"))
        few = shared.count() <= BROADCAST_KEYS
        found = checkpointed(each(rest).join(F.broadcast(shared) if few else shared, ["h", "x", "y"], "left_semi").select("h", "c"))
        parts.append(found)
        if i + 1 < STEPS:
            rest = checkpointed(rest.join(found, ["h", "c"], "left_anti"))
    able = reduce(DataFrame.union, parts)
    sizes = able.groupBy("h").agg(F.count("*").alias("kinds"))
    kind = F.when(F.col("kinds") > hot, _COUNT).otherwise(_INDEX)
    marked = able.join(F.broadcast(sizes), "h").select("h", "c", kind.alias("kind"))  # at most two anchors a range
    return open_rows.drop("kind").join(marked, ["h", "c"]).select(*[x.split()[0] for x in _SORTED.split(", ")])


def sorted_anchors(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Of anchors that occur twice: contexts that are covered whole (h, c), and one of each kind that may have a window in common with another kind.

    Rows are dealt by ranges of (anchor, context), which a sample cuts evenly, so an anchor with very many contexts lies in
    many ranges; equal contexts never part.
    """
    width = shuffle_width(rows.sparkSession)
    leads = rows.where("lead").select("h", "c", "k", "n", "at", "left", "right")
    found = checkpointed(_told(leads.repartitionByRange(width, "h", "c").sortWithinPartitions("h", "c", "k", "at")))
    edge = found.where(F.col("kind") == _OPEN)
    return found.where(F.col("kind") != _OPEN).unionByName(_closed(edge, hot))


def packed_texts(texts: DataFrame) -> DataFrame:
    """(k, n, data): each text once a task, compressed."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        pack = zstandard.ZstdCompressor(3)
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if (k, len(text)) not in seen:
                    seen.add((k, len(text)))
                    rows.append((k, len(text), pack.compress(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["k", "n", "data"])

    return texts.mapInArrow(made, "k long, n int, data binary")


def _beside_texts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (k, n, kind, data, asked columns...), dealt by text: kind 0 has the text, then come what asks for it."""
    names = [c for c in asked.columns if c not in ("k", "n")]
    kinds = {f.name: f.dataType for f in asked.schema.fields}
    left = packed_texts(texts).select("k", "n", F.lit(0).alias("kind"), "data", *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    right = asked.select("k", "n", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("data"), *names)
    return left.union(right).repartition(shuffle_width(texts.sparkSession), "k", "n").sortWithinPartitions("k", "n", "kind")


_CONTEXT = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]


def contexts(texts: DataFrame, asked: DataFrame, window: int = WINDOW, kgram: int = KGRAM) -> DataFrame:
    """asked (h, k, n, at, twice) with where each context begins and its bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        key, packed, text = None, b"", None
        for batch in batches:
            out = []
            for k, n, kind, data, h, at, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if key != (k, n):
                        key, packed, text = (k, n), data, None
                elif key == (k, n):
                    text = unpack.decompress(packed, max_output_size=n) if text is None else text
                    low, high = max(at - (window - kgram), 0), min(at + window, n)
                    out.append((h, k, n, at, low, twice, text[low:high]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CONTEXT, strict=True)], ["h", "k", "n", "at", "low", "twice", "data"])

    return _beside_texts(texts, asked.select("k", "n", "h", "at", "twice")).mapInArrow(cut, "h long, k long, n int, at int, low int, twice boolean, data binary")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _longest_shared(strings: list[bytes]) -> list[int]:
    """For each string the longest prefix that another one has too: that of a neighbour in sorted order."""
    by = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for x, y in zip(by, by[1:], strict=False):
        n = _common(strings[x], strings[y])
        out[x], out[y] = max(out[x], n), max(out[y], n)
    return out


@dataclass
class Piece:
    k: int
    n: int
    low: int
    data: bytes
    #: Whether it is covered whole by other means.
    twice: bool


def trimmed(rows: list[tuple], window: int) -> tuple[list[tuple[int, int, int, int]], list[Piece]]:
    """The contexts of one anchor, cut to what any two of them have in common to the left and right: marks on those that are equal then, and one of each kind."""
    right = _longest_shared([r[6][r[3] - r[4] :] for r in rows])
    left = _longest_shared([r[6][: r[3] - r[4]][::-1] for r in rows])
    kinds: dict[tuple[int, bytes], list[Piece]] = {}
    for (_, k, n, at, low, twice, data), x, y in zip(rows, left, right, strict=True):
        if x + y >= window:
            kinds.setdefault((x, data[at - low - x : at - low + y]), []).append(Piece(k, n, at - x, data[at - low - x : at - low + y], twice))
    marks, pieces = [], []
    for same in kinds.values():
        if len(same) > 1:
            marks += [(p.k, p.n, p.low, p.low + len(p.data)) for p in same]
            same[0].twice = True
        pieces.append(same[0])
    return marks, pieces if len(pieces) > 1 else []


def merged_pieces(pieces: list[Piece]) -> list[Piece]:
    """Pieces of one text that overlap become one, so that no place is in an index twice."""
    out: list[Piece] = []
    for p in sorted(pieces, key=lambda p: (p.k, p.n, p.low, len(p.data))):
        last = out[-1] if out else None
        if last and (last.k, last.n) == (p.k, p.n) and p.low <= last.low + len(last.data):
            more = p.low + len(p.data) - (last.low + len(last.data))
            out[-1] = Piece(p.k, p.n, last.low, last.data + p.data[len(p.data) - more :] if more > 0 else last.data, last.twice and p.twice)
        else:
            out.append(p)
    return out


def indexed_marks(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Marks (k, n, low, high) from run-length indexes over trimmed contexts, those of an anchor together."""

    def batch_of(marks: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*marks, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], ["k", "n", "low", "high"])

    def index(pieces: list[Piece]) -> list[tuple[int, int, int, int]]:
        whole = merged_pieces(pieces)
        found = second_matches([p.data for p in whole], window)
        return [(p.k, p.n, p.low + a, p.low + b) for p, spans in zip(whole, found, strict=True) if not p.twice for a, b in spans]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Piece] = []
        anchor: list[tuple] = []
        size = 0

        def ended() -> list[tuple[int, int, int, int]]:
            nonlocal held, size
            marks, pieces = trimmed(anchor, window)
            held += pieces
            size += sum(len(p.data) for p in pieces)
            if size > INDEX_BYTES:
                marks += index(held)
                held, size = [], 0
            anchor.clear()
            return marks

        for batch in batches:
            marks = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor and anchor[0][0] != row[0]:
                    marks += ended()
                anchor.append(row)
            yield batch_of(marks)
        if anchor:
            yield batch_of(ended())
        yield batch_of(index(held))

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "h").sortWithinPartitions("h", "k", "n", "at")
    return dealt.mapInArrow(indexed, "k long, n int, low int, high int")


def counted_marks(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same for anchors with very many contexts: windows whose 128-bit digest occurs twice beside one anchor."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, k, n, low, twice, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)), strict=True):
                m = len(data) - window + 1
                if m > 0:
                    w = [hashlib.blake2b(data[i : i + window], digest_size=16).digest() for i in range(m)]
                    out.append((np.full(m, h), np.array(w, "S16"), np.full(m, k), np.full(m, n, np.int32), low + np.arange(m, dtype=np.int32), np.full(m, twice)))
            if out:
                h, w, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
                digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(w), [None, pa.py_buffer(w.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h), digest, *map(pa.array, rest)], ["h", "w", "k", "n", "low", "twice"])

    each = rows.mapInArrow(windows, "h long, w binary, k long, n int, low int, twice boolean").distinct()
    times = each.groupBy("h", "w").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("times")).where("times > 1").select("h", "w")
    return each.where("NOT twice").join(times, ["h", "w"]).select("k", "n", "low", (F.col("low") + window).alias("high"))


def repeated_stretches(texts: DataFrame, window: int = WINDOW, kgram: int = KGRAM, hot: int = HOT) -> DataFrame:
    """Marks (k, n, low, high) on texts (k, text): their union is what repeated windows cover."""
    rows = checkpointed(anchor_rows(texts, window, kgram))
    found = checkpointed(sorted_anchors(rows, hot))
    whole = found.where(F.col("kind") == _WHOLE).select("h", "c")
    low, high = F.greatest(F.col("at") - (window - kgram), F.lit(0)), F.least(F.col("at") + window, F.col("n"))
    marks = rows.where(high - low >= window).select("h", "c", "k", "n", "at").join(whole, ["h", "c"]).select("k", "n", low.alias("low"), high.alias("high"))
    marks = marks.union(indexed_marks(contexts(texts, found.where(F.col("kind") == _INDEX), window, kgram), window))
    many = found.where(F.col("kind") == _COUNT)
    return marks if many.isEmpty() else marks.union(counted_marks(contexts(texts, many, window, kgram), window))


_RESULT = "k long, n int, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut_texts(texts: DataFrame, marks: DataFrame, keep_text: bool) -> DataFrame:
    """What is left of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        key, packed = None, b""
        held: list[tuple[int, int]] = []

        def result() -> tuple:
            text = unpack.decompress(packed, max_output_size=key[1]) if key[1] else b""
            spans = joined(np.array([a for a, _ in held], np.int64), np.array([b for _, b in held], np.int64))
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            return (*key, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_text else None)

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)], [x.split()[0] for x in _RESULT.split(", ")])

        for batch in batches:
            out = []
            for k, n, kind, data, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (k, n):
                    if key is not None:
                        out.append(result())
                    key, held = (k, n), []
                if kind == 0:
                    packed = data
                else:
                    held.append((low, high))
            yield rows(out)
        if key is not None:
            yield rows([result()])

    return _beside_texts(texts, marks.select("k", "n", "low", "high")).mapInArrow(cut, _RESULT)


def without_repeats(docs: DataFrame, window: int = WINDOW, kgram: int = KGRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes, if kept) of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), F.octet_length(text).alias("n"), text.alias("text"))
    texts = rows.select("k", "text")
    cut = _cut_texts(texts, repeated_stretches(texts, window, kgram, hot), keep_text)
    return rows.select("id", "k", "n").join(cut, ["k", "n"]).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept")

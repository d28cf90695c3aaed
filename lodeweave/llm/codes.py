"""Vector code compression: 16 parts, each coded by the nearest of 64 learned entries, found under segment-mean lower bounds.

Components become floor(256 x).  An entry is compared with a part coarse to fine: a part is cut to 1, 2, 4 ... blocks, and by
their means and what is left of their norms no entry can be nearer than the sum, over the blocks, of the block's width times
the squared difference of the means plus the squared difference of the residual norms.  Entries whose bound exceeds the
exact distance of the most promising entry, by more than rounding can, are out; survivors get exact integer distances, of
which the least, and of equal ones the lowest entry, counts.

Codebooks, 64 entries a part, are all that reaches the driver: each task sums its parts by entry, and those sums are summed.

Defined cases: a vector that is null, empty or holds a null or non-finite component is left out, as is one whose width isn't
that of the smallest kept id (or isn't a multiple of 16), and one with a component of such size that a squared distance
might not fit into a long.  A null id comes after all others; rows with equal ids are ordered by their vectors, and each has
its own row; equal vectors have equal codes.  With fewer than 64 kept vectors there are as many entries.  Null labels are one
label, whose errors are summed together; a sum that doesn't fit into a long is null.  An empty table gives no rows.  Only the
id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.shared import checkpointed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Up to so many labels their sums are broadcast; beyond, rows meet them by a shuffle, each label in SALTS parts.
BROADCAST_LABELS, SALTS = 20_000, 64
#: Rounding of bounds, as a share of the squared norms, is far below this.
SLACK = 1e-9
#: Parts that are compared with a codebook at once.
STEP = 16_384


def largest(width: int) -> int:
    """The largest component with which squared distances of this width fit into 62 bits."""
    return math.isqrt((1 << 60) // max(width, 1))


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """Rows (id, label, vec: whole components) of the vectors that are kept, written to the shared folder; their width."""
    vec = F.transform("real", lambda x: F.floor(x * SCALE))
    sane = F.forall(F.col(vector_col).cast("array<double>"), lambda x: F.coalesce(F.abs(x) * SCALE <= F.lit(float(1 << 30)) * (1 << 30), F.lit(False)))
    width = F.size(vector_col)
    some = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("real"), width.alias("width"), sane.alias("sane")).where("sane AND width > 0 AND width % 16 = 0")
    whole = some.select("id", "label", "width", vec.alias("vec"))
    fits = F.lit(False)
    first = whole.where(F.array_max(F.transform("vec", lambda x: F.abs(x))) <= F.floor(F.sqrt(F.lit(float(1 << 60)) / F.col("width")))).orderBy(F.col("id").asc_nulls_last(), "vec").select("width").first()
    if first:
        fits = (F.col("width") == first.width) & F.forall("vec", lambda x: F.abs(x) <= largest(first.width))
    return checkpointed(whole.where(fits).select("id", "label", "vec")), first.width if first else PARTS


def block_bounds(width: int) -> list[np.ndarray]:
    """Starts of the blocks of each level, coarse to fine."""
    counts = [1 << k for k in range(width.bit_length()) if 1 << k < width] or [1]
    return [np.array([i * width // n for i in range(n)]) for n in counts]


def block_means(vectors: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of the blocks, the norms of what is left, and the widths of the blocks."""
    widths = np.diff(np.append(starts, vectors.shape[1]))
    means = np.add.reduceat(vectors, starts, axis=1) / widths
    rest = vectors - np.repeat(means, widths, axis=1)
    return means, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1)), widths


class Codebook:
    """One part position's entries, with their block means and residual norms."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.levels = [(starts, *block_means(entries.astype(np.float64), starts)) for starts in block_bounds(entries.shape[1])]
        self.norms = (entries.astype(np.float64) ** 2).sum(axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each part's nearest entry, the lowest of equal ones, and its exact squared distance."""
        found = [self._nearest(parts[at : at + STEP]) for at in range(0, len(parts), STEP)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))  # type: ignore[return-value]

    def _nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        real = parts.astype(np.float64)
        slack = SLACK * ((real * real).sum(axis=1)[:, None] + self.norms[None, :])
        starts, means, rests, widths = self.levels[0]
        own_means, own_rests, _ = block_means(real, starts)
        bound = widths[0] * (own_means - means[:, 0][None, :]) ** 2 + (own_rests - rests[:, 0][None, :]) ** 2
        promising = bound.argmin(axis=1)
        best = ((parts - self.entries[promising]) ** 2).sum(axis=1)
        row, entry = np.nonzero(bound <= best[:, None] + slack)
        for starts, means, rests, widths in self.levels[1:]:
            own_means, own_rests, _ = block_means(real, starts)
            gap = (widths * (own_means[row] - means[entry]) ** 2 + (own_rests[row] - rests[entry]) ** 2).sum(axis=1)
            stay = gap <= best[row] + slack[row, entry]
            row, entry = row[stay], entry[stay]
        exact = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        # rows are in order, and each has its promising entry at least
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, begin)
        hit = np.flatnonzero(exact == least[row])
        return entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]], least


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """rows x parts x components"""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, PARTS, width // PARTS)


def learned_codebooks(vectors: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The entries of each part position: those of the smallest ids, moved `rounds` times to the means, rounded down, of what is nearest to them."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vec").select("vec").limit(ENTRIES).collect()
    start = np.array([r.vec for r in first], np.int64).reshape(-1, PARTS, width // PARTS)
    books = [start[:, p] for p in range(PARTS)]
    for _ in range(rounds if len(start) else 0):

        def summed(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            ready, n = [Codebook(b) for b in books], len(books[0])
            counts, sums = np.zeros((PARTS, n), np.int64), np.zeros((PARTS, n, width // PARTS), np.int64)
            for batch in batches:
                parts = _parts(batch.column(0), width)
                for p, book in enumerate(ready):
                    index, _ = book.nearest(parts[:, p])
                    counts[p] += np.bincount(index, minlength=n)
                    np.add.at(sums[p], index, parts[:, p])
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        made = vectors.select("vec").mapInArrow(summed, "part int, entry int, n long, sums array<long>")
        total = made.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        books = [b.copy() for b in books]
        for r in total:
            books[r.part][r.entry, r["at"]] = r.x // r.n
    return books


def coded(vectors: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """id, label, code and error of every vector."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in books]
        for batch in batches:
            parts = _parts(batch.column(2), width)
            found = [book.nearest(parts[:, p]) for p, book in enumerate(ready)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = np.sum([distance for _, distance in found], axis=0, dtype=np.int64)
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("id", "label", "vec").mapInArrow(encoded, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def decoded_vectors(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The vector of entries that each code stands for, in whole components: id, vec."""
    size = books[0].shape[1]
    index = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(PARTS)]
    parts = [F.slice(F.array(*map(F.lit, b.ravel().tolist())), i * size + 1, size) for i, b in zip(index, books, strict=True)]
    return codes.select("id", F.concat(*parts).alias("vec"))


def compressed_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The id, code, error, label_error and codebooks_sha256 of every kept vector."""
    vectors, width = integer_vectors(rows, id_col, vector_col, label_col)
    books = learned_codebooks(vectors, width)
    out = checkpointed(coded(vectors, books, width))
    sums = checkpointed(out.groupBy(F.col("label").alias("same")).agg(F.try_sum("error").alias("label_error")))
    same = out["label"].eqNullSafe(sums["same"])
    if sums.count() <= BROADCAST_LABELS:
        joined = out.join(F.broadcast(sums), same)
    else:
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = out.withColumn("own", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, dealt["label"].eqNullSafe(salted["same"]) & (dealt["own"] == salted["salt"]))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))

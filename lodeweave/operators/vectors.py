"""Vectors: nearest neighbours, exact in blocks or by an inverted file; a deterministic embedder, batches for hosted ones."""

from __future__ import annotations

import hashlib
import io
import math
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from decimal import ROUND_HALF_UP, Decimal
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lodeweave import config
from lodeweave.functions.analyzer import WORD
from lodeweave.functions.text import InputError, conservative_tokens

# Bounds of a batch.
BATCH_ITEMS, BATCH_TOKENS = 96, 120_000
BLOCK = 4096
#: Queries of a block that are compared at a time, and candidates that a task holds before all but each query's best go.
SOME, HELD = 256, 500_000


class Embedder(Protocol):
    id: str
    dims: int

    def embed(self, texts: Sequence[str], kind: str) -> list[list[float]]: ...


class HashEmbedder:
    """A bag of words hashed to `dims` places, of unit length.  Needs no network."""

    def __init__(self, dims: int = 1024) -> None:
        self.dims = dims
        self.id = f"hash-{dims}"

    def embed(self, texts: Sequence[str], kind: str = "document") -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dims)
            for w in WORD.findall(text.lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dims] += 1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out


def plan_batches(texts: Sequence[str], items: int = BATCH_ITEMS, tokens: int = BATCH_TOKENS) -> list[list[int]]:
    """Indices in order, in batches within both bounds; a text over the bound is a batch of its own."""
    out: list[list[int]] = []
    used = 0
    for i, text in enumerate(texts):
        size = conservative_tokens(text)
        if not out or len(out[-1]) == items or used + size > tokens:
            out.append([])
            used = 0
        out[-1].append(i)
        used += size
    return out


class BadInput(ValueError):
    """An embedder rejects a text; others of its batch may be fine."""


class Busy(RuntimeError):
    """A provider asks to wait.  retry_after: its header, seconds or a date, if it gave one."""

    def __init__(self, message: str = "", retry_after: str | None = None) -> None:
        super().__init__(message)
        self.retry_after = retry_after


@dataclass(frozen=True)
class Patience:
    """How often a provider is asked for one batch, how long for an answer, and how long between: as it says, or twice as long each time."""

    attempts: int = 6
    timeout_ms: int = 30_000
    most_ms: int = 120_000
    first_ms: int = 500
    #: Calls a second of all tasks together, of which each of `tasks` tasks takes its part; 0: as many as there are.
    per_second: float = 0.0
    tasks: int = 1

    @staticmethod
    def from_settings(**how: float) -> Patience:
        return Patience(int(config.number("embed_max_attempts")), int(config.number("embed_timeout_ms")), int(config.number("embed_retry_max_ms")), **how)  # type: ignore[arg-type]

    def wait_ms(self, attempt: int, retry_after: str | None, now: datetime) -> int | None:
        """Before the attempt after this one (from 0); None if it isn't worth it."""
        told = config.retry_after_ms(retry_after, now)
        if told is None:
            return min(self.most_ms, self.first_ms << attempt)
        return told if told <= self.most_ms else None

    def ask(self, call: Callable[[], Any]) -> Any:
        """call(), again while it fails otherwise than by BadInput; the last failure is raised."""
        for attempt in range(self.attempts):
            began = time.monotonic()
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(call).result(self.timeout_ms / 1000)
            except BadInput:
                raise
            except Exception as e:
                wait = self.wait_ms(attempt, getattr(e, "retry_after", None), datetime.now(UTC))
                if wait is None or attempt + 1 == self.attempts:
                    if isinstance(e, TimeoutError):
                        raise RuntimeError(f"no answer in {self.timeout_ms} ms") from e
                    raise
                time.sleep(wait / 1000)
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
                if self.per_second:
                    time.sleep(max(0.0, self.tasks / self.per_second - (time.monotonic() - began)))
        raise RuntimeError("no attempts")


def embed_rows(rows: DataFrame, embedder: Embedder, text_col: str, kind: str = "document", patience: Patience | None = None) -> DataFrame:
    """rows with embedding, embed_error and embed_waits.

    A rejected batch is tried text by text, and what is rejected alone has an error.  Without patience a failure of the provider
    ends the job.  With it, a batch is asked for again; if that doesn't help, the task's other rows wait (embed_waits says
    why) and nothing that was made is lost.
    """
    schema = rows.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("embed_error", F.lit(None).cast("string")).withColumn("embed_waits", F.lit(None).cast("string")).schema

    def checked(texts: list[str]) -> list[list[float]]:
        call = lambda: embedder.embed(texts, kind)
        found = patience.ask(call) if patience else call()
        if len(found) != len(texts) or not all(len(v) == embedder.dims and all(map(math.isfinite, v)) for v in found):
            raise RuntimeError("the embedder gave wrong vectors")
        return found

    def embedded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped: str | None = None
        for frame in frames:
            texts = [t or "" for t in frame[text_col]]
            vectors: list[list[float] | None] = [None] * len(texts)
            errors: list[str | None] = [None] * len(texts)
            waits: list[str | None] = [None] * len(texts)
            for batch in plan_batches(texts):
                try:
                    if stopped is None:
                        try:
                            for i, v in zip(batch, checked([texts[i] for i in batch]), strict=True):
                                vectors[i] = v
                        except BadInput:
                            for i in batch:
                                try:
                                    vectors[i] = checked([texts[i]])[0]
                                except BadInput as e:
                                    errors[i] = str(e)
                except Exception as e:
                    if patience is None:
                        raise
                    stopped = f"{type(e).__name__}: {e}"
                if stopped is not None:
                    for i in batch:
                        waits[i] = stopped if vectors[i] is None and errors[i] is None else None
            yield frame.assign(embedding=vectors, embed_error=errors, embed_waits=waits)

    return rows.mapInPandas(embedded, schema)


def cosine_distance(a: Column, b: Column) -> Column:
    """0 to 2; null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def check_distance(limit: float) -> float:
    if not 0 <= limit <= 2:
        raise InputError("the largest distance must be between 0 and 2")
    return limit


def _blocks(rows: DataFrame, id_col: str, vector_col: str, prefix: str) -> DataFrame:
    """Blocks of vectors: ids and unit vectors, packed."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = np.array(batch.column(1).to_pylist(), np.float64)
                norm = np.linalg.norm(x, axis=1)
                fine = norm > 0
                x = x[fine] / norm[fine, None]
                ids = np.array(batch.column(0).to_pylist(), np.int64)[fine]
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([x.tobytes()]), pa.array([x.shape[1]], pa.int32())], [f"{prefix}ids", f"{prefix}x", f"{prefix}dims"])

    some = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col)
    return some.mapInArrow(packed, f"{prefix}ids binary, {prefix}x binary, {prefix}dims int")


def nearest(base: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", max_distance: float = 2.0) -> DataFrame:
    """(query_id, id, distance, rank) of each query's k nearest rows, exactly; ties by id.

    Blocks of queries meet blocks of rows in matrix products, each of which passes on k rows a query at most.
    """
    pairs = _blocks(base, id_col, vector_col, "b_").crossJoin(_blocks(queries, id_col, vector_col, "q_"))
    return _ranked(pairs, k, id_col, max_distance)


def rounded(d: np.ndarray) -> np.ndarray:
    """Six places, as Spark's round() gives them: halves of the shortest decimal go up."""
    scaled = d * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):  # where the product's error counts
        out[i] = float(Decimal(repr(float(d[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0


def best_of(names: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k least by (distance, id), in the queries' order."""
    by = np.lexsort((ids, d, names))
    names, ids, d = names[by], ids[by], d[by]
    first = np.arange(len(names)) - np.searchsorted(names, names) < k
    return names[first], ids[first], d[first]


def _ranked(pairs: DataFrame, k: int, id_col: str, max_distance: float) -> DataFrame:
    """The k nearest of each query from pairs of blocks; a task's candidates are cut to each query's k while they come."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return best_of(*(np.concatenate(c) for c in zip(*held, strict=True)), k)

        def given(some: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(some[0]), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + BLOCK]) for c in some], ["query_id", id_col, "distance"])

        for batch in batches:
            for bi, bx, dims, qi, qx in (tuple(c[n] for c in batch.columns) for n in range(batch.num_rows)):
                b, all_q = (np.frombuffer(x.as_buffer()).reshape(-1, dims.as_py()) for x in (bx, qx))
                ids, all_names = (np.frombuffer(x.as_buffer(), np.int64) for x in (bi, qi))
                if not len(ids):
                    continue
                m = min(k, len(ids))
                for at in range(0, len(all_names), SOME):
                    q, names = all_q[at : at + SOME], all_names[at : at + SOME]
                    d = 1 - q @ b.T
                    if m < len(ids):  # what may be as near as the k-th when both are rounded stays
                        row, col = np.nonzero(d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m] + 2e-6)
                        some = names[row], ids[col], rounded(d[row, col])
                        some = best_of(*some, k) if len(row) > m * len(names) else some
                    else:
                        some = np.repeat(names, len(ids)), np.tile(ids, len(names)), rounded(d.ravel())
                    held.append(some)
                    size += len(some[0])
                    if size >= HELD:
                        held = [cut()]
                        size = len(held[0][0])
                        if size > HELD // 2:  # so many queries that little goes
                            yield from given(held[0])
                            held, size = [], 0
        if held:
            yield from given(cut())

    found = pairs.select("b_ids", "b_x", "b_dims", "q_ids", "q_x").mapInArrow(best, f"query_id long, {id_col} long, distance double")
    found = found.withColumn("distance", F.round("distance", 6) + F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy("distance", id_col)
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return ranked.where(F.col("distance") <= check_distance(max_distance))


#: An inverted file is fitted on at most so many vectors, has at most so many cells, and asks for so many of the true neighbours.
SAMPLE, CELLS, RECALL = 20_000, 4_096, 0.97


@dataclass(frozen=True)
class Cells:
    """Centres of unit vectors, and how many cells a query looks into."""

    centres: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n cells of greatest product, for each row."""
        products = x @ self.centres.T
        n = min(n, len(self.centres))
        return np.argpartition(-products, n - 1, axis=1)[:, :n]

    def of_queries(self, queries: Sequence[Sequence[float]]) -> list[int]:
        """The cells that any of these queries looks into."""
        x = _units([(q,) for q in queries])
        return sorted({int(c) for c in self.nearest(x, self.probes).ravel()}) if len(x) else []

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, probes=np.array(self.probes))
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Cells:
        got = np.load(io.BytesIO(data))
        return Cells(got["centres"], int(got["probes"]))


def with_cells(rows: DataFrame, cells: Cells, vector_col: str = "embedding", cell_col: str = "cell") -> DataFrame:
    """rows with the cell that is nearest to their vector; null without a vector."""
    shared = rows.sparkSession.sparkContext.broadcast(cells.centres)

    @F.pandas_udf("int")
    def nearest_cell(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else int(np.argmax(shared.value @ np.asarray(v, np.float64)))).astype("Int32")

    return rows.withColumn(cell_col, nearest_cell(vector_col))


def _units(found: Sequence[Row | tuple]) -> np.ndarray:
    x = np.array([r[0] for r in found], np.float64)
    norm = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
    return x[norm > 0] / norm[norm > 0, None] if len(x) else x


def fit_cells(base: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = RECALL, rounds: int = 8, seed: int = 5) -> Cells:
    """Spherical k-means on at most `sample` rows, those of least hash; as many probes as find the wanted share of the k nearest within the sample."""
    some = base.where(F.col(vector_col).isNotNull())
    n = some.count()
    drawn = some.select(vector_col, F.xxhash64(id_col).alias("draw")).orderBy("draw").limit(sample)
    x = _units(drawn.collect())
    if not len(x):
        return Cells(np.zeros((1, 1)), 1)
    cells = max(1, min(CELLS, round(math.sqrt(n)), len(x)))
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + BLOCK] @ centres.T, axis=1) for i in range(0, len(x), BLOCK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    own = np.concatenate([np.argmax(x[i : i + BLOCK] @ centres.T, axis=1) for i in range(0, len(x), BLOCK)])
    asked = x[rng.permutation(len(x))[:500]]
    found = np.argpartition(-(asked @ x.T), min(k, len(x)) - 1, axis=1)[:, : min(k, len(x))]
    # the place of each true neighbour's cell among the cells in the query's order
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(cells), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, own[found], axis=1).ravel())
    return Cells(centres, int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1)


def cell_blocks(rows: DataFrame, cells: Cells, id_col: str, vector_col: str, prefix: str, probes: int = 1) -> DataFrame:
    """(cell, ids, x): unit vectors packed by cell, each row in its `probes` nearest cells."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # at most CELLS centres

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64)
            norm = np.linalg.norm(x, axis=1)
            fine = norm > 0
            x, ids = x[fine] / norm[fine, None], np.array(batch.column(0).to_pylist(), np.int64)[fine]
            out: list[tuple[int, bytes, bytes]] = []
            if len(ids):
                near = shared.value.nearest(x, probes)
                of, row = near.ravel(), np.repeat(np.arange(len(ids)), near.shape[1])
                by = np.argsort(of, kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(of[by])) + 1):
                    out += [(int(of[part[0]]), ids[row[p]].tobytes(), x[row[p]].tobytes()) for p in np.split(part, range(BLOCK, len(part), BLOCK))]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["cell", f"{prefix}ids", f"{prefix}x"])

    some = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col)
    return some.mapInArrow(packed, f"cell int, {prefix}ids binary, {prefix}x binary")


def nearest_cells(base: DataFrame, queries: DataFrame, k: int, cells: Cells | None = None, id_col: str = "vec_id", vector_col: str = "embedding", max_distance: float = 2.0) -> DataFrame:
    """nearest() from an inverted file: rows lie in their nearest cell, queries look into the cells nearest to them.

    Every row is indexed.  The join by cell is one that adaptive execution splits where a cell has very many rows.
    """
    cells = cells or fit_cells(base, k, id_col, vector_col)
    rows = cell_blocks(base, cells, id_col, vector_col, "b_")
    pairs = rows.join(cell_blocks(queries, cells, id_col, vector_col, "q_", cells.probes), "cell")
    return _ranked(pairs.withColumn("b_dims", F.lit(cells.centres.shape[1])), k, id_col, max_distance)


def measured_cells(base: DataFrame, cells: Cells, k: int, id_col: str = "vec_id", vector_col: str = "embedding", asked: int = 50) -> tuple[Cells, float]:
    """cells with so many probes that RECALL of the k nearest of stored vectors are found among all that are stored, and the share that is.

    The questions are the `asked` stored vectors of least hash.
    """
    some = base.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col), F.lit("recall"))).limit(asked).select(id_col, vector_col)
    true = {(r.query_id, r[id_col]) for r in nearest(base, some, k, id_col, vector_col).collect()}
    while True:
        found = {(r.query_id, r[id_col]) for r in nearest_cells(base, some, k, cells, id_col, vector_col).collect()}
        share = len(true & found) / len(true) if true else 1.0
        if share >= RECALL or cells.probes >= len(cells.centres):
            return cells, share
        cells = replace(cells, probes=min(len(cells.centres), 2 * cells.probes))


def quantized(x: np.ndarray, kind: str) -> np.ndarray:
    """Unit vectors as they would be kept: float, half, int8 or binary (signs); bytes fall from 4 a number to an eighth."""
    if kind == "float":
        return x.astype(np.float32)
    if kind == "half":
        return x.astype(np.float16)
    if kind == "int8":
        return np.clip(np.round(x * 127), -127, 127).astype(np.int8)
    if kind == "binary":
        return np.packbits(x > 0, axis=1)
    raise InputError(f"unknown kind {kind!r}")


def quantized_distance(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """Distances of rows of a to rows of b, for ranking: cosine, or differing signs."""
    if kind == "binary":
        return np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2)
    x, y = a.astype(np.float64), b.astype(np.float64)
    return 1 - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T


def coded_vectors(rows: DataFrame, kind: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): unit vectors as a storage of this kind keeps them.  Zero vectors and nulls have none."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64)
            norm = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
            codes = quantized(x[norm > 0] / norm[norm > 0, None], kind) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(norm > 0)), pa.array([c.tobytes() for c in codes], pa.binary())], [id_col, "code"])

    return rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col).mapInArrow(coded, f"{id_col} long, code binary")


_CODES = {"float": np.float32, "half": np.float16, "int8": np.int8, "binary": np.uint8}


def _code_blocks(codes: DataFrame, prefix: str) -> DataFrame:
    """Blocks of codes: ids, and their codes behind each other."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()]), pa.array([b"".join(batch.column(1).to_pylist())]), pa.array([batch.num_rows], pa.int32())], [f"{prefix}ids", f"{prefix}codes", f"{prefix}n"])

    return codes.mapInArrow(packed, f"{prefix}ids binary, {prefix}codes binary, {prefix}n int")


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int, kind: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank) of each query's k nearest by stored codes alone; ties by id.

    Blocks of codes meet blocks of queries, which are coded alike; each pair of blocks passes on k rows a query.
    """
    dtype = _CODES[kind]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bc, bn, qi, qc, qn in (tuple(c[n] for c in batch.columns) for n in range(batch.num_rows)):
                if not bn.as_py() or not qn.as_py():
                    continue
                ids, all_names = (np.frombuffer(x.as_buffer(), np.int64) for x in (bi, qi))
                b, all_q = (np.frombuffer(x.as_buffer(), dtype).reshape(n.as_py(), -1) for x, n in ((bc, bn), (qc, qn)))
                m = min(k, len(ids))
                for at in range(0, len(all_names), SOME):
                    names = all_names[at : at + SOME]
                    d = np.round(quantized_distance(all_q[at : at + SOME], b, kind).astype(np.float64), 9)
                    # of equal distances at the edge those of the least ids
                    row, col = np.nonzero(d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m])
                    by = np.lexsort((ids[col], d[row, col], row))
                    row, col = row[by], col[by]
                    first = np.arange(len(row)) - np.searchsorted(row, row) < m
                    row, col = row[first], col[first]
                    yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids[col]), pa.array(d[row, col])], ["query_id", id_col, "distance"])

    asked = _code_blocks(coded_vectors(queries, kind, id_col, vector_col), "q_")
    found = _code_blocks(codes, "b_").crossJoin(asked).mapInArrow(best, f"query_id long, {id_col} long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def nearest_by_codes(codes: DataFrame, base: DataFrame, queries: DataFrame, k: int, kind: str, wider: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """nearest() with candidates from codes: `wider` times k a query, whose whole vectors are then compared exactly."""
    some = nearest_codes(codes, queries, wider * k, kind, id_col, vector_col).select("query_id", id_col)
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("asked"))
    whole = some.join(base.select(id_col, vector_col), id_col).join(asked, "query_id")
    found = whole.select("query_id", id_col, (F.round(cosine_distance(F.col("asked"), F.col(vector_col)), 6) + F.lit(0.0)).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def compared_storage(true: DataFrame, found: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """(recall, mrr) of lists against the exact ones: the share of the true k that is among the found k, and of 1 / rank of the truly nearest.  A query itself doesn't count."""

    def places(rows: DataFrame, name: str) -> DataFrame:
        others = rows.where(F.col("query_id") != F.col(id_col))
        return others.select("query_id", id_col, F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias(name)).where(F.col(name) <= k)

    met = places(true, "place").join(places(found, "got"), ["query_id", id_col], "left")
    each = met.groupBy("query_id").agg((F.count("got") / F.count("*")).alias("recall"), F.max(F.when(F.col("place") == 1, F.coalesce(1 / F.col("got"), F.lit(0.0)))).alias("rr"))
    return each.agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"))

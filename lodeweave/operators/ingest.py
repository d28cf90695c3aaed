"""Ingest: texts to sources, nodes and chunks; what is unchanged, renamed or replaced."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.markdown import OVERLAP, TARGET, blocks_from_markdown, chunk_blocks

KEY = ["kind", "collection", "name"]
#: A path with a number: no more than nine digits, as there are never so many documents of one name.
NUMBERED = r"-([1-9]\d{0,8})\.md$"


#: Rows whose chunks are given back together, and the bytes of text from which there are fewer of them.
_ROWS, _BYTES = 250, 1 << 20


def _slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of _ROWS rows and _BYTES of a column's text at most, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, "right"))
        to = max(at + 1, min(to, at + _ROWS))
        yield batch.slice(at, to - at)
        at = to


def chunked(nodes: DataFrame, id_col: str, text_col: str, target: int = TARGET, overlap: int = OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """(node_id, ord, heading_path, content, token_count, and the columns to keep), without a shuffle."""
    names = ["node_id", "ord", "heading_path", "content", "token_count", *keep]

    def some_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some in _slices(batch):
            found = [(n, c) for n, t in enumerate(some.column(1).to_pylist()) for c in chunk_blocks(blocks_from_markdown(t or ""), target, overlap)]
            of, chunks = pa.array([n for n, _ in found], pa.int64()), [c for _, c in found]
            made = [pa.array([c.ord for c in chunks], pa.int32()), pa.array([c.heading_path for c in chunks], pa.list_(pa.string())), pa.array([c.content for c in chunks], pa.string()), pa.array([c.token_count for c in chunks], pa.int32())]
            yield pa.RecordBatch.from_arrays([some.column(0).take(of), *made, *[some.column(2 + k).take(of) for k in range(len(keep))]], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # no name holds a batch while the next one is read
        return chain.from_iterable(map(some_of, batches))

    kept = "".join(f", {c} {nodes.schema[c].dataType.simpleString()}" for c in keep)
    return nodes.select(F.col(id_col).cast("long").alias("node_id"), F.col(text_col).alias("text"), *keep).mapInArrow(cut, f"node_id long, ord int, heading_path array<string>, content string, token_count int{kept}")


def chunk_sizes(nodes: DataFrame, id_col: str, text_col: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(node_id, chunks, tokens) of texts that have a chunk: what comes from one row is counted there."""

    def sized(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = [[c.token_count for c in chunk_blocks(blocks_from_markdown(t or ""), target, overlap)] for t in frame["text"]]
            out = pd.DataFrame({"node_id": frame["node_id"], "chunks": [len(s) for s in sizes], "tokens": [sum(s) for s in sizes]})
            yield out[out["chunks"] > 0]

    return nodes.select(F.col(id_col).alias("node_id"), F.col(text_col).alias("text")).mapInPandas(sized, "node_id long, chunks long, tokens long")


def last_of_name(incoming: DataFrame, order: str = "origin_uri") -> DataFrame:
    """incoming with `superseded`: true for all rows of a key but the last, as a later file replaces an earlier one of its name."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(order), F.desc("content_hash")))
    return incoming.withColumn("superseded", place > 1)


def compared(incoming: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """incoming (kind, collection, name, content_hash, status) with change: new, changed or unchanged, and what is known of the current row.

    A document is only unchanged if it was readable.
    """
    columns = {"id": "current_id", "content_hash": "current_hash", "status": "current_status", "created_at": "current_created"}
    known = current.select(*KEY, *[F.col(c).alias(n) for c, n in columns.items() if c in current.columns])
    same = F.col("current_hash").eqNullSafe(F.col("content_hash")) & ((F.col("kind") == "skill") | (F.col("current_status") == "ready")) & F.lit(not force)
    return incoming.join(known, KEY, "left").withColumn("change", F.when(F.col("current_id").isNull(), "new").when(same, "unchanged").otherwise("changed"))


def twins(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """(collection, content_hash, old_name, old_id, old_origin): stored documents, one row each, that a new one has the bytes of.

    incoming has new names alone.  However many new documents have the bytes, and however many stored ones do, they aren't paired.
    """
    old = current.where(~F.col("origin_uri").startswith("upload://")).select("collection", "content_hash", F.col("name").alias("old_name"), F.col("id").alias("old_id"), F.col("origin_uri").alias("old_origin"))
    return old.join(incoming.select("collection", "content_hash").distinct(), ["collection", "content_hash"], "left_semi")


def renamed(found: DataFrame, existing: DataFrame) -> DataFrame:
    """The twins whose old file is gone.  existing: (path) of the files that are there."""
    return found.join(existing.select(F.col("path").alias("there")), F.col("old_origin") == F.col("there"), "left_anti").select("collection", "content_hash", "old_name", "old_id")


def distinct_paths(documents: DataFrame, taken: DataFrame | None = None, collection: str = "collection", name: str = "name", order: str = "id") -> DataFrame:
    """documents with a path that no other has: `.md` stays, others get it, and where it is taken the least free number.

    taken: (collection, path) of stored documents but for those that these replace.  A path `x-3.md` also takes the number
    3 of `x.md`, whether it is stored or the plain path of a document here.
    """
    base = F.when(F.lower(name).endswith(".md"), F.col(name)).otherwise(F.concat(F.col(name), F.lit(".md")))
    based = documents.withColumn("path_base", base).withColumn("path_no", F.row_number().over(Window.partitionBy(collection, "path_base").orderBy(order)))
    others = based.where("path_no = 1").select(F.col(collection).alias("c"), F.col("path_base").alias("p"), F.lit(False).alias("stored"))
    if taken is not None:
        others = others.union(taken.select("collection", "path", F.lit(True)))
    number = F.regexp_extract("p", NUMBERED, 1)
    plain = others.where("stored").select("c", F.col("p").alias("path_base"), F.lit(0).alias("n"))
    numbered = others.where(number != "").select("c", F.regexp_replace("p", NUMBERED, ".md").alias("path_base"), number.cast("int").alias("n"))
    used = plain.union(numbered).distinct()
    # as many numbers are free below a used one as it is above its place among the used; the j-th free one lies above all used ones with fewer than j
    place = F.row_number().over(Window.partitionBy("c", "path_base").orderBy("n"))
    taken_ = used.withColumn("free", F.col("n") - place + 1).select("c", "path_base", "free", F.lit(1).alias("used"), F.lit(None).cast("int").alias("path_no"))
    asked = based.select(F.col(collection).alias("c"), "path_base", (F.col("path_no") - 1).alias("free"), F.lit(0).alias("used"), "path_no")
    below = Window.partitionBy("c", "path_base").orderBy("free", F.desc("used"), "path_no").rowsBetween(Window.unboundedPreceding, 0)
    numbers = taken_.union(asked).withColumn("no", F.col("free") + F.sum("used").over(below)).where("used = 0").select(F.col("c").alias("taken_c"), F.col("path_base").alias("taken_base"), F.col("path_no").alias("taken_no"), "no")
    joined = based.join(numbers, F.col(collection).eqNullSafe(F.col("taken_c")) & (F.col("path_base") == F.col("taken_base")) & (F.col("path_no") == F.col("taken_no")))
    path = F.when(F.col("no") == 0, F.col("path_base")).otherwise(F.concat(F.regexp_replace("path_base", r"(?i)\.md$", ""), F.lit("-"), F.col("no"), F.lit(".md")))
    return joined.withColumn("path", path).drop("path_base", "path_no", "taken_c", "taken_base", "taken_no", "no")

"""The engine: ingest, embed, remove; ls, glob, grep, read, search, skill."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave import config
from lodeweave.functions import paging, safety
from lodeweave.functions.analyzer import Query, parse_query
from lodeweave.functions.frontmatter import SkillError, parse_skill, strip_frontmatter
from lodeweave.functions.text import BUDGETS, InputError, decode_text
from lodeweave.functions.uri import INDEX, build_uri, normal_path, parse_uri
from lodeweave.operators import blocks, catalog, files, fts, fusion, ingest, sinks, trigrams, vectors
from lodeweave.operators.numbering import marked, marks, number_in_place, number_rows
from lodeweave.schemas import COLLECTION, TABLES
from lodeweave.sources.files import Normalizer, archive_members, bundle, bundle_roots, literal_path, normalized, plain_normalizer, walk
from lodeweave.store import BROADCAST_KEYS, Commit, Store

# Limits of one call.
MAX_QUERIES, PER_QUERY, POOL = 8, 30, 30
INLINE_BYTES = 3 << 20
#: Chunks whose vectors are committed together; nodes of a file.
EMBED_COMMIT, NODES_A_FILE = 50_000, 8_192


class EmbeddingStopped(RuntimeError):
    """A provider failed; what it gave before is kept."""


class TooExpensive(RuntimeError):
    """A query took longer than its time."""


@dataclass(frozen=True)
class IngestResult:
    status: str
    kind: str
    name: str
    collection: str | None = None
    source_id: int | None = None
    detail: str | None = None


@dataclass
class SearchResult:
    hits: list[fusion.Hit]
    retrieval_mode: str
    warnings: list[str] = field(default_factory=list)


def parse_scope(text: str | None) -> tuple[str | None, str | None]:
    """(kind, name) of `skills`, `docs`, `skills/{name}` or `docs/{collection}`."""
    parts = (text or "").strip().strip("/").split("/")
    if parts == [""]:
        return None, None
    kind = {"skills": "skill", "docs": "doc"}.get(parts[0])
    if kind is None or len(parts) > 2 or not parts[-1]:
        raise InputError(f"scope {text!r} must be skills, docs, skills/NAME or docs/COLLECTION")
    return kind, parts[1] if len(parts) == 2 else None


def scoped(rows: DataFrame, scope: str | None) -> DataFrame:
    """Ready rows in a scope; the conditions are plain, so scans push them down."""
    kind, name = parse_scope(scope)
    rows = rows.where(F.col("status") == "ready")
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.where(F.col("name" if kind == "skill" else "collection") == name) if name else rows


class Engine:
    def __init__(self, spark: SparkSession, folder: str | Path, analyzer: str = "english", embedder: vectors.Embedder | None = None, reranker: fusion.Reranker | None = None, normalizer: Normalizer = plain_normalizer) -> None:
        self.spark, self.store = spark, Store(spark, folder)
        self.embedder, self.reranker, self.normalizer = embedder, reranker, normalizer
        pinned = self.store.setting("analyzer")
        if pinned not in (None, analyzer):
            raise InputError(f"this corpus was built with the analyzer {pinned!r}")
        self.analyzer = analyzer
        self.pages = paging.SearchPages()
        # for those who ask for page after page: what was read ahead, and which requests have gone on once
        self._ahead: paging.BoundedCache[files.Ahead] = paging.BoundedCache(8, 32 << 20)
        self._gone_on: paging.BoundedCache[bool] = paging.BoundedCache()

    @contextmanager
    def _timed(self, milliseconds: int) -> Iterator[None]:
        """Jobs of this thread end after a time, as TooExpensive."""
        context, tag, late = self.spark.sparkContext, f"lodeweave-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(milliseconds / 1000, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            yield
        except Exception as e:
            if late.is_set():
                raise TooExpensive(f"stopped after {milliseconds} ms: narrow the request") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    # Ingest

    def ingest_bytes(self, items: Sequence[tuple[str, bytes]], collection: str = COLLECTION, force: bool = False, origin: str = "upload://") -> list[IngestResult]:
        """Documents by name and bytes: one result each; what can't be read is a result too."""
        most, size = int(config.number("upload_max_files")), int(config.number("upload_max_bytes"))
        if origin.startswith("upload://") and (len(items) > most or any(len(d) > size for _, d in items)):
            raise InputError(f"an upload has at most {most} files of {size} bytes")
        rows = [(origin + name, len(data), data) for name, data in items]
        return self.ingest_files(self.spark.createDataFrame(rows, "path string, length long, content binary"), collection, force)

    def ingest_files(self, incoming: DataFrame, collection: str = COLLECTION, force: bool = False, root: str | None = None) -> list[IngestResult]:
        """Documents by (path, length, content), as read_files() gives them.  A document's name is its path below `root`, or its last part."""
        folder = f"results/{uuid.uuid4().hex}"
        try:
            return [IngestResult(**r.asDict()) for r in self.ingest_table(incoming, collection, force, root, folder).collect()]
        finally:
            self.store.files.delete(folder)

    def ingest_table(self, incoming: DataFrame, collection: str = COLLECTION, force: bool = False, root: str | None = None, folder: str | None = None) -> DataFrame:
        """ingest_files() for any number of documents: the results are rows, in a folder of the corpus that the caller may delete."""
        name = F.element_at(F.split("path", "/"), -1)
        if root is not None:
            below = F.locate(root.rstrip("/") + "/", F.col("path"))
            name = F.when(below > 0, F.substr("path", below + F.lit(len(root.rstrip("/")) + 1))).otherwise(name)
        read = normalized(incoming, self.normalizer).withColumn("name", name)
        shaped = read.select(F.lit("doc").alias("kind"), F.lit(collection).alias("collection"), "name", F.col("path").alias("origin_uri"), "content_hash", "status", "detail", F.col("markdown").alias("content"))
        return self._write(shaped, force, folder or f"results/{uuid.uuid4().hex}")

    def ingest_skill(self, members: dict[str, bytes], force: bool = False, allow_reserved: bool = False, lenient: bool = False, origin: str = "upload://") -> IngestResult:
        """A bundle with a SKILL.md."""
        parts, label = bundle(members), origin.rstrip("/").rsplit("/", 1)[-1]
        if not parts or parts[0].path != "SKILL.md":
            return IngestResult("failed", "skill", label, detail="no SKILL.md")
        try:
            skill = parse_skill(decode_text(parts[0].data), allow_reserved, lenient)
        except (SkillError, ValueError) as e:
            return IngestResult("failed", "skill", label, detail=str(e))
        import hashlib

        digest = hashlib.sha256(b"".join(m.path.encode() + b"\0" + m.data for m in parts)).hexdigest()
        work = self.store.begin()
        before = self.store.table("sources", work.before)
        same = before.where((F.col("kind") == "skill") & (F.col("name") == skill.name)).select("id", "content_hash", "created_at").first()
        if same and same.content_hash == digest and not force:
            return IngestResult("unchanged", "skill", skill.name, source_id=same.id)
        moved = [r.id for r in before.where((F.col("kind") == "skill") & (F.col("origin_uri") == origin) & (F.col("name") != skill.name) & ~F.col("origin_uri").startswith("upload://")).select("id").collect()]
        gone = self.spark.createDataFrame([(i,) for i in [*moved, *([same.id] if same else [])]], "gone long")
        source_id = same.id if same else work.reserve("sources", 1) + 1
        now = F.current_timestamp()
        created = F.lit(same.created_at) if same else now
        source = self.spark.createDataFrame([(source_id, "skill", skill.name, "", origin, digest, "ready", None)], "id long, kind string, name string, collection string, origin_uri string, content_hash string, status string, detail string").withColumns({"created_at": created, "updated_at": now})
        start = work.reserve("nodes", len(parts))
        folder = f"blobs/{uuid.uuid4().hex}"
        made = [(start + i, source_id, "skill", skill.name, "", "ready", m.path, build_uri("skills", skill.name, m.path), m.mime, m.size, m.role, decode_text(m.data) if m.is_text else None, None if m.is_text else f"{folder}/{m.path}") for i, m in enumerate(parts, 1)]
        for m in parts:
            if not m.is_text:
                self.store.files.write(f"{folder}/{m.path}", m.data)
        nodes = self.spark.createDataFrame(made, "id long, source_id long, kind string, name string, collection string, status string, path string, uri string, mime_type string, size_bytes long, role string, content string, blob_ref string").withColumns({"created_at": now, "updated_at": now})
        skills = self.spark.createDataFrame([(source_id, skill.name, skill.description, skill.allowed_tools, skill.compatibility, skill.license, str(skill.metadata) if skill.metadata else None)], "source_id long, name string, description string, allowed_tools array<string>, compatibility string, license string, metadata string")
        work.add("sources", source)
        work.add("skills", skills)
        written = work.add("nodes", nodes)
        self._commit(work, written, written.where((F.col("role") == "reference") & F.col("content").isNotNull()), gone)
        return IngestResult("ingested", "skill", skill.name, source_id=source_id)

    def ingest_paths(self, paths: Sequence[str | Path], collection: str = COLLECTION, force: bool = False) -> list[IngestResult]:
        """Files, folders, skill folders and archives that the driver sees; vectors for all of them at the end, if it can."""
        results: list[IngestResult] = []
        for path in map(Path, paths):
            docs: list[Path] = []
            for found in walk(path):
                if found.kind == "failed":
                    results.append(IngestResult("failed", "doc", found.name, collection, detail=found.detail))
                elif found.kind == "skill":
                    members = {p.relative_to(found.path).as_posix(): p.read_bytes() for p in sorted(found.path.rglob("*")) if p.is_file() and not p.is_symlink()}
                    results.append(self._skill_result(found.path.name, lambda m=members, f=found: [self.ingest_skill(m, force, origin=f.path.resolve().as_uri())])[0])
                elif found.kind == "archive":
                    results += self._skill_result(found.name, lambda f=found: self.ingest_archive(f.path.read_bytes(), origin=f.path.resolve().as_uri(), force=force))
                else:
                    docs.append(found.path.resolve())
            if docs:
                rows = self.spark.read.format("binaryFile").load([literal_path(str(p)) for p in docs]).select("path", "length", "content")
                results += self.ingest_files(rows, collection, force, root=str(path.resolve()) if path.is_dir() else None)
        if self.embedder is not None and any(r.status == "ingested" for r in results):
            try:
                self.embed_missing()
            except Exception as e:  # full text works without vectors
                results.append(IngestResult("failed", "doc", "embeddings", collection, detail=str(e)))
        return results

    @staticmethod
    def _skill_result(name: str, ingest_it: Callable[[], list[IngestResult]]) -> list[IngestResult]:
        """A bad bundle is a result; what comes after it goes on."""
        try:
            return ingest_it()
        except (InputError, ValueError) as e:
            return [IngestResult("failed", "skill", name, detail=str(e))]

    def ingest_archive(self, data: bytes, origin: str = "upload://", **options: Any) -> list[IngestResult]:
        members = archive_members(data)
        roots = bundle_roots(list(members))
        return [self.ingest_skill({p[len(r) :]: d for p, d in members.items() if p.startswith(r)}, origin=origin if len(roots) == 1 else f"{origin}#{r.rstrip('/')}", **options) for r in roots]

    def _write(self, incoming: DataFrame, force: bool, folder: str) -> DataFrame:
        """What is new or changed among incoming documents.  Each step is written and read back, so plans stay shallow and texts are read once.

        Texts are only written, and shuffled once to the files of their nodes; all else is decided on rows without them.
        """
        work = self.store.begin()
        current = self.store.table("sources", work.before).where("kind = 'doc'")
        texts = work.staged(incoming.withColumn("row_no", F.monotonically_increasing_id()))
        checked = work.staged(ingest.compared(ingest.last_of_name(texts.drop("content")), current, force))
        told = self._results(checked)
        told.write.parquet(self.store.files.at(folder))
        results = self.spark.read.schema(told.schema).parquet(self.store.files.at(folder))
        if results.where("status NOT IN ('unchanged', 'superseded')").isEmpty():
            work.abandon()
            return results
        keep = (F.col("status") != "ready") & F.coalesce(F.col("current_status") == "ready", F.lit(False))  # a readable version stays
        fresh = checked.where((F.col("change") != "unchanged") & ~keep & ~F.col("superseded"))
        added = fresh.where("change = 'new'")
        new = number_rows(added, ["collection", "name"], work.reserve("sources", added.count()))
        changed = fresh.where("change = 'changed'").withColumn("id", F.col("current_id"))
        now = F.current_timestamp()
        source = work.staged(new.unionByName(changed).withColumns({"created_at": F.coalesce("current_created", now), "updated_at": now}))
        work.add("sources", source)
        gone = source.where("change = 'changed'").select(F.col("id").alias("gone"))
        twins = work.staged(ingest.twins(source.where("status = 'ready' AND change = 'new'"), current))
        if not twins.isEmpty():
            gone = gone.union(ingest.renamed(twins, self._existing(twins)).select("old_id"))
        gone = work.staged(gone.distinct())
        old = self.store.table("nodes", work.before).where("kind = 'doc'").select("source_id", "collection", "path")
        taken = old.join(source.select("collection").distinct(), "collection", "left_semi").join(gone, F.col("source_id") == F.col("gone"), "left_anti")
        paths = ingest.distinct_paths(source.where("status = 'ready'"), taken)
        uri = F.concat(F.lit("ctx://docs/"), _encoded("collection"), F.lit("/"), _encoded("path"))
        placed = work.staged(paths.select("row_no", F.col("id").alias("source_id"), "kind", "name", "collection", "status", "path", uri.alias("uri"), "created_at", "updated_at"))
        n = placed.count()
        parts = 1 if n <= NODES_A_FILE else max(-(-n // NODES_A_FILE), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        texts, placed, known = work.reread([texts, placed, work.staged(marks(placed, "row_no"))], parts)
        # ids go first by the part that a text is shuffled to, so each file has a range of ids
        numbered = number_rows(placed, ["row_no"], work.reserve("nodes", n), slot=F.pmod(F.hash("row_no"), F.lit(parts)))
        kept = texts.select("row_no", "content")
        if known.count() <= BROADCAST_KEYS:  # texts that stay as they are aren't shuffled; beyond as many marks the join alone tells them apart
            kept = marked(kept, known, "row_no")
        whole = kept.repartition(parts, "row_no").join(numbered.repartition(parts, "row_no").hint("shuffle_hash"), "row_no")
        shaped = whole.withColumns({"mime_type": F.lit("text/markdown"), "size_bytes": F.length("content").cast("long"), "role": F.lit("doc"), "blob_ref": F.lit(None).cast("string")})
        nodes = work.add("nodes", shaped, "within")
        self._commit(work, nodes, nodes, gone)
        return results

    @staticmethod
    def _results(checked: DataFrame) -> DataFrame:
        """What is said of each file: an IngestResult's fields."""
        old, kept = F.col("superseded"), (F.col("status") != "ready") & (F.col("change") != "unchanged") & F.coalesce(F.col("current_status") == "ready", F.lit(False))
        status = F.when(old, "superseded").when(F.col("change") == "unchanged", "unchanged").when(F.col("status") != "ready", F.col("status")).otherwise("ingested")
        detail = F.when(old, "a later file of this call has this name").when(kept, F.concat("detail", F.lit("; previous ready source preserved"))).otherwise(F.col("detail"))
        return checked.select(status.alias("status"), F.lit("doc").alias("kind"), "name", "collection", F.when(~old, F.col("current_id")).alias("source_id"), detail.alias("detail"))

    def _existing(self, twins: DataFrame) -> DataFrame:
        """(path) of the files in the folders that twins come from, from listings."""
        folders = [r.folder for r in twins.select(F.regexp_replace("old_origin", "/[^/]*$", "").alias("folder")).distinct().collect()]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        rows = []
        for folder in folders:
            at = jvm.org.apache.hadoop.fs.Path(folder or "/")
            fs = at.getFileSystem(conf)
            if fs.exists(at):
                rows += [(s.getPath().toString(),) for s in fs.listStatus(at)]
        return self.spark.createDataFrame(rows, "path string")

    def _chunks(self, nodes: DataFrame) -> DataFrame:
        """Chunks of nodes, with their context: where they are and under which headings."""
        cut = ingest.chunked(nodes, "id", "content", keep=["source_id", "kind", "name", "collection", "status", "uri", "path"])
        head = F.when(F.col("kind") == "skill", F.concat_ws(" / ", "name", "path")).otherwise(F.concat_ws(" / ", "collection", "name"))
        context = F.concat_ws(" / ", head, F.array_join("heading_path", " / "))
        return cut.withColumn("context", F.regexp_replace(context, " / $", ""))

    def _commit(self, work: Commit, nodes: DataFrame, texts: DataFrame, gone: DataFrame) -> None:
        """Chunks and postings of new nodes; the old rows of sources that are gone or replaced go."""
        cut = work.staged(self._chunks(texts).withColumn("row_no", F.monotonically_increasing_id()))
        work.add("chunks", number_in_place(cut, "row_no", work.reserve("chunks", cut.count())), "none")
        self.store._post(work, work.in_small_parts("chunks"), self.analyzer)
        work.add("grams", trigrams.index(nodes.where("content IS NOT NULL"), "id", "content"), "none")
        work.remove(gone)
        dead = self.store.table("nodes", work.before).join(F.broadcast(gone.distinct()) if gone.count() <= BROADCAST_KEYS else gone.distinct(), F.col("source_id") == F.col(gone.columns[0]), "left_semi")
        blobs = [r.blob_ref for r in dead.where("blob_ref IS NOT NULL").select("blob_ref").collect()]
        alive = nodes.select("uri", F.lit("written").alias("change"))
        work.done(alive.unionByName(dead.select("uri", F.lit("deleted").alias("change"))), {"analyzer": self.analyzer})
        for blob in blobs:  # files that the commit left behind
            self.store.files.delete(blob)

    def remove_source(self, kind: str, name: str, collection: str | None = None) -> bool:
        """Without a collection, the name's sources of every collection go."""
        found = self.store.table("sources").where((F.col("kind") == kind) & (F.col("name") == name))
        found = found if collection is None else found.where(F.col("collection") == collection)
        ids = [r.id for r in found.select("id").collect()]
        if ids:
            work = self.store.begin()
            none = self.spark.createDataFrame([], TABLES["nodes"])
            self._commit(work, none, none, self.spark.createDataFrame([(i,) for i in ids], "gone long"))
        return bool(ids)

    def embed_missing(self, again: bool = False, per_second: float = 0.0) -> dict[str, int]:
        """Vectors for chunks that have none, or for all; the first model is pinned.

        They are committed EMBED_COMMIT chunks at a time.  If the provider fails, what it gave is kept, and EmbeddingStopped says
        how many chunks wait: the next call asks for these alone.  per_second: calls that all tasks together may make.
        """
        if self.embedder is None:
            raise InputError("there is no embedder")
        pinned = self.store.setting("embed_model")
        if pinned not in (None, self.embedder.id) and not again:
            raise InputError(f"this corpus was embedded by {pinned!r}")
        first = self.store.begin()
        chunks, known = self.store.table("chunks", first.before), self.store.table("vectors", first.before)
        todo = first.staged(chunks if again else chunks.join(known.select("id"), "id", "left_anti"))
        total, bad, waiting, why = todo.count(), 0, 0, None
        tasks = self.spark.sparkContext.defaultParallelism
        patience = vectors.Patience.from_settings(per_second=per_second, tasks=tasks)
        texted = todo.withColumn("embed_text", F.concat_ws("\n\n", "context", "content"))
        settings: dict[str, str | None] = {"embed_model": self.embedder.id}
        slices = 1 if again else -(-total // EMBED_COMMIT)
        try:
            for part in range(slices):
                some = texted.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == part).repartition(tasks)
                done = first.staged(vectors.embed_rows(some, self.embedder, "embed_text", patience=patience).withColumn("cell", F.lit(None).cast("int")))
                told = done.agg(F.count("embed_error").alias("bad"), F.count("embed_waits").alias("waiting"), F.max("embed_waits").alias("why")).first()
                bad, waiting, why = bad + told.bad, told.waiting, told.why
                if again and waiting:  # the old vectors stay
                    break
                work = self.store.begin()
                cells = None if again else self._cells(work.before)
                made = done.where("embed_waits IS NULL")
                (work.replace if again else work.add)("vectors", vectors.with_cells(made, cells) if cells else made)
                work.done(settings=settings | ({"cells": None, "cells_of": None, "cells_recall": None} if again else {}))
                if waiting:
                    break
            n = self._index_vectors()
        finally:
            first.abandon()
        if waiting:
            raise EmbeddingStopped(f"{waiting} chunks of the last {min(total, EMBED_COMMIT)} have no vector yet: {why}")
        return {"total": total, "embedded": n, "rejected": bad}

    def _index_vectors(self) -> int:
        """From the threshold on, an index of cells serves searches; it is made anew when as many vectors have come as it was made of."""
        work = self.store.begin()
        everything = self.store.table("vectors", work.before)
        n = everything.where("embedding IS NOT NULL").count()
        made_of = int(work.before["settings"].get("cells_of", 0))
        if n < config.number("bulk_index_threshold") or n < 2 * made_of:
            work.abandon()
            return n
        cells, recall = vectors.measured_cells(everything, vectors.fit_cells(everything, PER_QUERY, "id"), PER_QUERY, "id")
        name = f"cells/{uuid.uuid4().hex}.npz"
        self.store.files.write(name, cells.packed())
        work.replace("vectors", vectors.with_cells(everything, cells))
        work.done(settings={"cells": name, "cells_of": str(n), "cells_recall": f"{recall:.4f}"})
        return n

    def _cells(self, manifest: dict) -> vectors.Cells | None:
        name = manifest["settings"].get("cells")
        return vectors.Cells.unpacked(self.store.files.read(name)) if name else None

    # Reads

    def search(self, queries: Sequence[str], limit: int = 10, per_query: int = PER_QUERY, scope: str | None = None, max_distance: float | None = None, timeout_ms: int | None = None, exact: bool = False) -> list[fusion.Hit]:
        """Hits by full text and vectors.  exact: all vectors are compared, where an index of cells would leave some out."""
        return self.search_with_diagnostics(queries, limit, per_query, scope, max_distance, timeout_ms, exact).hits

    def search_with_diagnostics(self, queries: Sequence[str], limit: int = 10, per_query: int = PER_QUERY, scope: str | None = None, max_distance: float | None = None, timeout_ms: int | None = None, exact: bool = False) -> SearchResult:
        asked = [q.strip() for q in queries if q.strip()]
        if not asked or len(asked) > MAX_QUERIES:
            raise InputError(f"give 1 to {MAX_QUERIES} queries")
        max_distance = vectors.check_distance(config.number("max_distance") if max_distance is None else max_distance)
        parse_scope(scope)
        warnings = []
        use_vectors = self.embedder is not None and self.store.setting("embed_model") == self.embedder.id
        if self.embedder is None:
            warnings.append("EMBEDDER_MISSING: full text only")
        elif not use_vectors:
            warnings.append("EMBED_MODEL_MISMATCH: full text only")
        parsed = [parse_query(q, self.analyzer) for q in asked]
        with self._timed(timeout_ms or int(config.number("search_timeout_ms"))), ExitStack() as held:
            manifest = held.enter_context(self.store.lease())
            rows, posted, known = (scoped(self.store.table(t, manifest), scope) for t in ("chunks", "postings", "bounds"))
            lists = blocks.bounded_search(posted, known, rows.select("id"), parsed, per_query, "id").select(F.concat(F.lit("fts:"), F.col("query_id")).alias("list"), "id", "rank")
            if use_vectors:
                try:
                    asked_for = self.embedder.embed(asked, "query")  # type: ignore[union-attr]
                    wanted = self.spark.createDataFrame(list(enumerate(asked_for)), "id long, embedding array<double>")
                except Exception as e:  # a provider's failure must not fail the search
                    warnings.append(f"EMBEDDING_FAILED: {e}")
                    use_vectors = False
                else:
                    known, cells = scoped(self.store.table("vectors", manifest), scope), self._cells(manifest)
                    if cells is not None and not exact:  # a few queries look into a few cells: the condition reaches the scan
                        known = known.where(F.col("cell").isNull() | F.col("cell").isin(cells.of_queries(asked_for)))
                    near = vectors.nearest(known, wanted, per_query, "id", "embedding", max_distance)
                    lists = lists.unionByName(near.select(F.concat(F.lit("vec:"), F.col("query_id")).alias("list"), "id", "rank"))
            words = sorted({w for q in parsed for w in q.words})
            listed = lists.collect()  # at most MAX_QUERIES * 2 * per_query rows
            told = self.spark.createDataFrame(listed, lists.schema)
            shown = rows.where(files.among("id", sorted({r.id for r in listed}))).join(F.broadcast(told), "id")
            shown = shown.withColumn("snippet", fts.snippets(F.col("content"), words, self.analyzer))
            found = shown.orderBy("list", "rank").collect()
        return SearchResult(self._chosen(asked, parsed, found, limit, warnings), "hybrid" if use_vectors else "full_text", warnings)

    def _chosen(self, asked: list[str], parsed: list[Query], found: list, limit: int, warnings: list[str]) -> list[fusion.Hit]:
        lists: dict[str, list[fusion.Hit]] = {}
        seen: dict[int, list[str]] = {}
        ranks: dict[int, dict[str, int]] = {}
        for r in found:
            seen.setdefault(r.id, []).append(r["list"])
            ranks.setdefault(r.id, {})[r["list"]] = r["rank"]
        for r in found:
            fields = {"uri": f"{r.uri}#chunk={r.ord}", "path": f"/skills/{r.name}/{r.path}" if r.kind == "skill" else f"/docs/{r.collection}/{r.path}", "ranks": ranks[r.id], "heading_path": r.heading_path, "snippet": r.snippet, "name": r.name, "kind": r.kind, "collection": r.collection, "via": sorted({"fts" if x.startswith("fts") else "vector" for x in seen[r.id]}), "matched_queries": sorted({int(x[4:]) for x in seen[r.id]})}
            lists.setdefault(r["list"], []).append(fusion.Hit(r.id, r.node_id, r.content, 0.0, fields))
        pool = [f.item for f in fusion.rrf({n: [(h.chunk_id, h) for h in hs] for n, hs in lists.items()})][: max(POOL, limit)]
        order, warning = fusion.rerank(self.reranker, "\n".join(asked), ["\n".join([h.fields["name"], *h.fields["heading_path"], h.content]) for h in pool])
        if warning:
            warnings.append(f"RERANK_FAILED: {warning}")
        return fusion.diversify(lists, len(parsed), limit, preferred=[pool[i].chunk_id for i in order] if order else [])

    def search_skills(self, queries: Sequence[str], scope: str | None = None, limit: int = 8, timeout_ms: int | None = None) -> list[dict[str, Any]]:
        """Skills by name and description: the exact name first, then all words, then weight."""
        kind, name = parse_scope(scope)
        asked = [q.strip() for q in queries if q.strip()]
        if kind == "doc" or not asked:
            raise InputError("give a query, and a skills scope or none")
        with self._timed(timeout_ms or int(config.number("search_timeout_ms"))):
            skills = self.store.table("skills")
            skills = skills.where(F.col("name") == name) if name else skills
            ready = self.store.table("sources").where("status = 'ready'").select(F.col("id").alias("source_id"))
            words = skills.join(ready, "source_id", "left_semi").withColumns({"w": fts.analyzed(F.concat_ws(" ", "name", "description"), self.analyzer), "wn": fts.analyzed(F.col("name"), self.analyzer)})
            totals: dict[str, dict[str, Any]] = {}
            for q in asked:
                parsed = parse_query(q, self.analyzer)
                wanted = F.array(*map(F.lit, parsed.words)) if parsed.words else F.array().cast("array<string>")
                weight = F.size(F.filter("wn", lambda w: F.array_contains(wanted, w))) * 0.6 + F.size(F.filter("w", lambda w: F.array_contains(wanted, w))) * 0.4
                best = words.where(fts.matches(F.col("w"), parsed.loose(phrases=False))).orderBy((F.lower("name") == q.lower()).desc(), fts.matches(F.col("w"), parsed).desc(), weight.desc(), "name").limit(limit)
                for rank, r in enumerate(best.select("name", "description").collect(), 1):
                    hit = totals.setdefault(r.name, {"name": r.name, "description": r.description, "uri": build_uri("skills", r.name, "SKILL.md"), "score": 0.0})
                    hit["score"] += 1 / (fusion.RRF_K + rank)
        return sorted(totals.values(), key=lambda h: (-h["score"], h["name"]))[:limit]

    def glob(self, pattern: str, limit: int = 200, offset: int = 0) -> list[dict[str, Any]]:
        return [r.asDict() for r in files.glob(self.store.table("nodes"), pattern, limit, offset).collect()]

    def grep(self, pattern: str, path_glob: str | None = None, ignore_case: bool = True, limit: int = 60, cursor: str | None = None, timeout_ms: int | None = None) -> dict[str, Any]:
        key = repr(("grep", pattern, path_glob, ignore_case))
        after = paging.decode_grep_cursor(cursor, key) or (0, 0)
        manifest = self.store.manifest()
        name = repr((manifest["version"], key))
        ahead = self._ahead.get(name) if cursor else None
        page = ahead.page(limit, after) if ahead and ahead.since <= after else None
        if page is None:
            with self._timed(timeout_ms or int(config.number("grep_timeout_ms"))):
                nodes = self.store.table("nodes", manifest)
                if cursor and self._gone_on.get(name):
                    ahead = files.grep_ahead(nodes, pattern, path_glob, ignore_case, after)
                    self._ahead.put(name, ahead, ahead.size())
                    page = ahead.page(limit, after)
                page = page or files.grep_page(nodes, pattern, path_glob, ignore_case, limit, after, self.store.table("grams", manifest))
            if cursor:
                self._gone_on.put(name, True, 1)
        found, following, scanned = page
        return {"matches": [r.asDict() for r in found], "next": following and paging.encode_grep_cursor(key, *following), "scanned_files": scanned}

    @staticmethod
    def grep_cursor(pattern: str, path_glob: str | None, ignore_case: bool, node_id: int, line: int) -> str:
        """A cursor after a match."""
        return paging.encode_grep_cursor(repr(("grep", pattern, path_glob, ignore_case)), node_id, line)

    def ls(self, path: str = "/", offset: int = 0, limit: int = 200) -> dict[str, Any]:
        """Entries (name, type, note, uri) under a path; missing for what isn't there."""
        path = normal_path(path)
        parts = [p for p in path.split("/") if p]
        sources, nodes = self.store.table("sources"), self.store.table("nodes")

        def page(rows: list, render: Callable[[Any], dict]) -> dict[str, Any]:
            return {"path": path, "entries": [render(r) for r in rows[:limit]], "next_offset": offset + limit if len(rows) > limit else None, "missing": False}

        if not parts:
            n = files.root_counts(sources).first()
            return page([("skills/", f"{n.skills} skills"), ("docs/", f"{n.docs} docs in {n.collections} collections")], lambda r: {"name": r[0], "type": "dir", "note": r[1]})
        if parts[0] not in ("skills", "docs"):
            return {"path": path, "entries": [], "next_offset": None, "missing": True}
        if parts == ["skills"]:
            status = sources.select(F.col("id").alias("source_id"), "status")
            rows = self.store.table("skills").join(status, "source_id").orderBy("name").offset(offset).limit(limit + 1).collect()
            return page(rows, lambda r: {"name": f"{r.name}/", "type": "dir", "note": r.description if r.status == "ready" else f"[{r.status}] {r.description}"})
        if parts == ["docs"]:
            rows = files.collections(sources).offset(offset).limit(limit + 1).collect()
            return page(rows, lambda r: {"name": f"{r.collection}/", "type": "dir", "note": f"{r.docs} docs"})
        rows = files.children(nodes, "skill" if parts[0] == "skills" else "doc", parts[1], "/".join(parts[2:])).offset(offset).limit(limit + 1).collect()
        out = page(rows, lambda r: {"name": f"{r.name}/", "type": "dir", "note": f"{r['count']} files"} if r.directory else {"name": r.name, "type": "file", "uri": r.uri, "note": r.role, "size": r.size})
        return out | {"missing": not rows and offset == 0}

    def resolve(self, uri: str) -> Any:
        a = parse_uri(uri)
        return self.store.table("nodes").where(F.col("uri") == build_uri(a.realm, a.root, a.path)).first()

    def read(self, uri: str, cursor: str | None = None, offset: int = 0, limit: int | None = None, raw: bool = False) -> dict[str, Any]:
        """A page of a file, or a chunk with its neighbours.  Skills come bare, all else in a frame."""
        a = parse_uri(uri)
        node = self.resolve(uri)
        if node is None:
            raise InputError(f"nothing at {uri}")
        if a.chunk is not None:
            near = self.store.table("chunks").where((F.col("node_id") == node.id) & F.col("ord").between(a.chunk - (not raw), a.chunk + (not raw))).orderBy("ord").collect()
            own = next((c for c in near if c.ord == a.chunk), None)
            if own is None:
                raise InputError(f"no chunk {a.chunk} in {uri}")
            return {"text": own.content if raw else safety.envelope(own.content, {"uri": uri, "heading": own.heading_path}), "neighbours": [f"{node.uri}#chunk={c.ord}" for c in near if c.ord != a.chunk], "next": None}
        if node.content is None:
            inline = node.blob_ref is not None and node.size_bytes <= (config.number("max_resource_blob_bytes") if raw else INLINE_BYTES)
            data = {"data": self.store.files.read(node.blob_ref)} if inline else {}
            return {"text": f"{node.path}: {node.mime_type}, {node.size_bytes} bytes", "next": None} | data
        trusted = node.role == "skill_md"
        page = paging.text_page(node.content, node.uri, BUDGETS["read"], cursor, offset, limit, f"{node.id}:{node.updated_at}", untrusted=not trusted)
        return {"text": page.text if trusted or raw else safety.envelope(page.text, {"uri": node.uri, "lines": f"{page.first_line}-{page.last_line} of {page.total_lines}"}), "next": page.next_cursor, "page": page}

    def skill(self, name: str) -> dict[str, Any]:
        """Metadata, the instructions without their head, and the files."""
        found = self.store.table("skills").where(F.col("name") == name).first()
        if found is None:
            raise InputError(f"no skill {name!r}")
        parts = self.store.table("nodes").where(F.col("source_id") == found.source_id).orderBy("path").collect()
        body = next(n.content for n in parts if n.role == "skill_md")
        return found.asDict() | {"body": strip_frontmatter(body).strip(), "files": [{"path": n.path, "uri": n.uri, "role": n.role} for n in parts]}

    def catalog(self, budget: int = BUDGETS["index"]) -> str:
        sources, chunks = self.store.table("sources"), self.store.table("chunks")
        counts = chunks.groupBy("source_id").agg(F.count("*").alias("n"))
        status = sources.select(F.col("id").alias("source_id"), "status")
        skills = [r.asDict() for r in self.store.table("skills").join(status, "source_id").orderBy("name").collect()]
        titles = {r.collection: r.titles.split(", ") for r in catalog.top_titles(sources).collect()}
        groups = [r.asDict() | {"titles": titles.get(r.collection, [])} for r in catalog.collection_rollup(sources, counts).orderBy("collection").collect()]
        return catalog.render_catalog(skills, groups, [r.asDict() for r in catalog.problems(sources).limit(200).collect()], budget)

    def resources(self, offset: int = 0, limit: int | None = None) -> list[dict[str, Any]]:
        """The index, then skills, then documents, a page at a time."""
        index = self.spark.createDataFrame([(0, "", INDEX, "catalog")], "grp int, sort string, uri string, name string")
        rows = files.resource_page(index, self.store.table("nodes"), offset, limit or int(config.number("resource_page")))
        return [{"uri": r.uri, "name": r.name} for r in rows.collect()]

    def report(self) -> list[dict[str, Any]]:
        """Each source's files, chunks and vectors."""
        return [r.asDict() for r in self.report_table().orderBy("kind", F.col("collection").asc_nulls_first(), "name").collect()]

    def report_table(self) -> DataFrame:
        """report() for any number of sources, in no order."""
        s = catalog.source_report(*(self.store.table(t) for t in ("sources", "nodes", "chunks", "vectors")))
        return s.select("kind", "collection", "name", "status", "detail", "files", "chunks", "embedded")

    def summary(self) -> dict[str, int]:
        """How many sources have each status."""
        return {r.status: r.n for r in catalog.status_counts(self.store.table("sources")).collect()}

    def export(self, table: str, folder: str) -> None:
        """A table's rows as lines of JSON."""
        sinks.json_rows(self.store.table(table)).write.mode("overwrite").text(folder)

    def complete(self, what: str, prefix: str) -> list[str]:
        rows = self.store.table("skills").select(F.col("name").alias("v")) if what == "skill" else self.store.table("sources").where("kind = 'doc'").select(F.col("collection").alias("v"))
        return [r.v for r in files.completions(rows, "v", prefix).collect()]


def _encoded(column: str) -> Any:
    from lodeweave.functions.uri import encoded_path

    return encoded_path(F.col(column))


__all__ = ["EmbeddingStopped", "Engine", "IngestResult", "SearchResult", "TooExpensive", "parse_scope"]

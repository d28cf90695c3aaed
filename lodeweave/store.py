"""Snapshots of the corpus tables on any file system that Spark reads.

A table is a list of segments.  A commit writes the new rows of the tables that change as new segments, and the keys of the
sources whose old rows go, so its work follows what is new and not what is there.  Then it writes a manifest of that
version, under a name that no other writer can take, so readers see one version or the other.  A writer that comes second
looks at what was committed since it began: if that has none of its sources and addresses, it goes on from there; else it
fails.  Ids are reserved in ranges, so no two writers give the same.

Segments are merged when there are many, by a commit of its own that gives way to others.  vacuum() deletes what only
versions have that are neither among the last ones nor leased by a reader.  The log of changes is append-only, for streams.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import blocks, fts, trigrams
from lodeweave.schemas import CHANGES, IDS, KEYS, ORDERS, SCHEMA, TABLES

#: Segments of a table, and versions of deleted keys, before they are merged; deleted keys up to which they are broadcast.
SEGMENTS, BROADCAST_KEYS = 24, 100_000
#: How tables are written: small groups of rows, so that scans leave many out and sorts within a task are small.
WRITTEN = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
#: Versions that vacuum() keeps, and the seconds that a reader's lease lasts.
KEPT_VERSIONS, LEASE_S = 10, 3_600
#: Times that a writer goes on from a later version.
REBASES = 20
_NAME = re.compile(r"(\d{12})\.json")


class StoreError(RuntimeError):
    pass


class Conflict(StoreError):
    """Another writer committed the same sources."""


class MigrationRequired(StoreError):
    """The corpus was written by an older layout: Store.migrate() brings it up to date."""


class Files:
    """Small files of a folder on Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        text = str(folder)
        self.root = text if re.match(r"[a-z][a-z0-9+.-]*:", text) else Path(text).resolve().as_uri()
        self.root = self.root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def write_once(self, name: str, data: bytes) -> bool:
        """Whole or not at all; False if the name is taken."""
        waiting = f"{name}.{uuid.uuid4().hex}"
        self.write(waiting, data)
        fs = self.jvm.org.apache.hadoop.fs
        options = SparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:
            fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._path(waiting), self._path(name), options)
        except Py4JJavaError as e:
            self.fs.delete(self._path(waiting), False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def mkdirs(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))


EMPTY: dict[str, Any] = {"version": 0, "schema": SCHEMA, "tables": {}, "ids": {}, "gone": [], "settings": {}}


class Store:
    """Tables under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.spark, self.folder = spark, folder
        self.files = Files(spark, folder)

    def manifest(self) -> dict:
        versions = self.versions()
        if not versions:
            if self.files.exists("_current"):
                raise MigrationRequired("this corpus has the layout of version 1: run migrate()")
            return json.loads(json.dumps(EMPTY))
        found = json.loads(self.files.read(f"_log/{versions[-1]:012}.json"))
        if found["schema"] != SCHEMA:
            raise MigrationRequired(f"this corpus has the layout of version {found['schema']}, not {SCHEMA}")
        return found

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names("_log") if (m := _NAME.fullmatch(n)))

    def manifest_of(self, version: int) -> dict:
        return json.loads(self.files.read(f"_log/{version:012}.json"))

    @property
    def version(self) -> int:
        return self.manifest()["version"]

    @contextmanager
    def lease(self) -> Iterator[dict]:
        """A manifest whose files stay until the lease is given back, or LEASE_S have passed."""
        name = f"_leases/{uuid.uuid4().hex}"
        while True:
            seen = self.manifest()
            self.files.write(name, json.dumps({"version": seen["version"], "until": time.time() + LEASE_S}).encode())
            # a vacuum that began before the lease was there may have taken the version meanwhile
            if not seen["version"] or seen["version"] in self.versions():
                break
        try:
            yield seen
        finally:
            self.files.delete(name)

    def vacuum(self, keep: int = KEPT_VERSIONS) -> list[str]:
        """Deletes the files that only old versions have, which no reader leases, and those versions; the deleted paths.

        What no version has yet belongs to a writer and stays.
        """
        versions = self.versions()
        leased = []
        for name in self.files.names("_leases"):
            lease = json.loads(self.files.read(f"_leases/{name}"))
            if lease["until"] < time.time():
                self.files.delete(f"_leases/{name}")
            else:
                leased.append(lease["version"])
        kept = {*versions[-max(keep, 1) :], *leased}
        old = [v for v in versions if v not in kept]
        paths = lambda m: {s["path"] for t in m["tables"].values() for s in t} | {g["path"] for g in m["gone"]}
        needed = set().union(*(paths(self.manifest_of(v)) for v in kept if v in versions)) if versions else set()
        going = sorted(set().union(*(paths(self.manifest_of(v)) for v in old)) - needed) if old else []
        for path in going:
            self.files.delete(path)
        for v in old:
            self.files.delete(f"_log/{v:012}.json")
        return going

    def compact(self) -> bool:
        """Merges tables of many segments into one each, in the table's order; whether it did.  Another writer's commit goes first."""
        seen = self.manifest()
        many = [t for t, segments in seen["tables"].items() if len(segments) > SEGMENTS or len(seen["gone"]) > SEGMENTS]
        if not many:
            return False
        work = self.begin()
        for name in many:
            if name == "grams":  # of nodes that are there
                work.replace(name, trigrams.index(self.table("nodes", work.after).where("content IS NOT NULL"), "id", "content"), "none")
            elif name != "bounds":
                work.replace(name, self.table(name, work.before))
        if "postings" in many or "bounds" in many:  # bounds of rows that went are no longer needed
            work.replace("bounds", blocks.bounds(_without_documents(self.table("postings", work.after)), BOUND_KEYS))
        oldest = min((s["version"] for t in work.after["tables"].values() for s in t), default=work.version)
        work.after["gone"] = [g for g in work.after["gone"] if g["version"] > oldest]
        try:
            work.done()
        except Conflict:
            return False
        return True

    def table(self, name: str, manifest: Mapping | None = None) -> DataFrame:
        """The rows of a version, without those whose source went later than they came."""
        seen = manifest or self.manifest()
        segments = seen["tables"].get(name, [])
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(f"{TABLES[name]}, seg_version long").parquet(*[self.files.at(s["path"]) for s in segments])
        oldest = min(s["version"] for s in segments)
        gone = [g for g in seen["gone"] if g["version"] > oldest]
        if gone and name in KEYS:
            keys = self.spark.read.schema("gone_key long, gone_version long").parquet(*[self.files.at(g["path"]) for g in gone])
            keys = F.broadcast(keys) if sum(g["rows"] for g in gone) <= BROADCAST_KEYS else keys
            rows = rows.join(keys, (F.col(KEYS[name]) == F.col("gone_key")) & (F.col("seg_version") < F.col("gone_version")), "left_anti")
        return rows.drop("seg_version")

    def setting(self, key: str) -> str | None:
        return self.manifest()["settings"].get(key)

    def changes(self) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(self.files.at("changes")) if self.files.exists("changes") else self.spark.createDataFrame([], CHANGES)

    def begin(self) -> Commit:
        return Commit(self)

    def commit(self, tables: Mapping[str, DataFrame] | None = None, changed: DataFrame | None = None, settings: Mapping[str, str | None] | None = None) -> int:
        """A new version with whole new tables.  changed: (uri, change), for the log.  settings: a None removes the key."""
        work = self.begin()
        for name, rows in (tables or {}).items():
            work.replace(name, rows)
        return work.done(changed, settings)

    def migrate(self) -> bool:
        """Brings a corpus of an older layout up to date; whether there was anything to do.

        Layout 1 had one folder a table and version, layout 2 no blocks of postings.
        """
        versions = self.versions()
        if versions:
            old = self.manifest_of(versions[-1])
            if old["schema"] == SCHEMA:
                return False
            work = Commit(self, old | {"schema": SCHEMA})
            path = [self.files.at(s["path"]) for s in old["tables"].get("postings", [])]
            chunks = self.table("chunks", work.before) if path else None
            if chunks is not None:
                self._post(work, chunks, old["settings"].get("analyzer", "simple"), whole=True)
            work.replace("grams", trigrams.index(self.table("nodes", work.before).where("content IS NOT NULL"), "id", "content"), "none")
            work.done(None, None)
            return True
        if not self.files.exists("_current"):
            return False
        old = json.loads(self.files.read(self.files.read("_current").decode()))
        work = Commit(self, json.loads(json.dumps(EMPTY)) | {"settings": old["settings"]})
        for name, where in old["tables"].items():
            rows = work.add(name, self.spark.read.parquet(self.files.at(where)))
            if name == "chunks":
                whole = self.spark.read.parquet(self.files.at(where))
                some = whole.where("embedding IS NOT NULL").withColumns({"embed_error": F.lit(None).cast("string"), "cell": F.lit(None).cast("int")})
                work.add("vectors", some)
                self._post(work, rows, old["settings"].get("analyzer", "simple"))
            if name == "nodes":
                work.add("grams", trigrams.index(rows.where("content IS NOT NULL"), "id", "content"), "none")
        work.done(None, None)
        return True

    @staticmethod
    def _post(work: Commit, chunks: DataFrame, analyzer: str, whole: bool = False) -> None:
        """Postings of chunks and their bounds."""
        searched = _without_documents(chunks).withColumn("searched", F.concat_ws("\n\n", "context", "content"))
        made = fts.postings(searched, ["id", "source_id", "kind", "name", "collection", "status"], {"searched": 1.0}, analyzer)
        put = work.replace if whole else work.add
        put("postings", made.withColumn("block", blocks.block_of("id")), "none")
        # texts are read again, as there are far fewer of them than postings
        put("bounds", fts.most_places(searched.withColumn("block", blocks.block_of("id")), ["block", *BOUND_KEYS], "searched", analyzer), "none")


#: What bounds are kept by besides term and block.
BOUND_KEYS = ["kind", "name", "collection", "status"]


def _without_documents(rows: DataFrame) -> DataFrame:
    """Chunks or postings without documents' names, which no scope asks for and which would make bounds as many as postings."""
    return rows.withColumn("name", F.when(F.col("kind") == "skill", F.col("name")))


class Commit:
    """What one writer does between two versions."""

    def __init__(self, store: Store, before: dict | None = None) -> None:
        self.store, self.spark = store, store.spark
        self.before = store.manifest() if before is None else before
        self.version = self.before["version"] + 1
        self.after = json.loads(json.dumps(self.before)) | {"version": self.version}
        self.name = uuid.uuid4().hex
        self.whole = False  # whether tables are replaced, not only added to
        self.mine: dict[str, list[dict]] = {}
        self.ids: dict[str, int] = {}
        self.stages: list[tuple[DataFrame, str]] = []

    def add(self, name: str, rows: DataFrame, sort: str = "all") -> DataFrame:
        """New rows of a table in its order, written and read back, so that what follows is planned upon files.

        sort: "within" only sorts what each task has, for rows of which no task has many; "none" is for rows that come in order.
        """
        order, path = ORDERS.get(name), f"data/{name}/{self.version:012}-{uuid.uuid4().hex[:8]}"
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        shaped = rows.select(*columns, F.lit(self.version).cast("long").alias("seg_version"))
        if order and sort != "none":
            shaped = shaped.sort(*order) if sort == "all" else shaped.sortWithinPartitions(*order)
        shaped.write.options(**WRITTEN).parquet(self.store.files.at(path))
        segment = {"path": path, "version": self.version}
        self.after["tables"].setdefault(name, []).append(segment)
        self.mine.setdefault(name, []).append(segment)
        written = self.spark.read.schema(TABLES[name]).parquet(self.store.files.at(path))
        if name in IDS:
            self.ids[name] = self.after["ids"][name] = max(self.after["ids"].get(name, 0), written.agg(F.max("id")).first()[0] or 0)
        return written

    def in_small_parts(self, name: str) -> DataFrame:
        """This commit's rows of a table, read in parts of one group of rows each, for what makes much of a row in a task."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", WRITTEN["parquet.block.size"])
        return session.read.schema(TABLES[name]).parquet(*[self.store.files.at(x["path"]) for x in self.mine[name]])

    def reserve(self, name: str, n: int) -> int:
        """The id before n new ones of a table, which no other writer gets."""
        files = self.store.files
        while True:
            taken = sorted(x for x in files.names(f"_ids/{name}") if x.isdigit())
            start = max(self.after["ids"].get(name, 0), int(files.read(f"_ids/{name}/{taken[-1]}")) if taken else 0)
            if not n:
                return start
            if files.write_once(f"_ids/{name}/{int(taken[-1]) + 1 if taken else 0:012}", str(start + n).encode()):
                for x in taken[:-2]:
                    files.delete(f"_ids/{name}/{x}")
                return start

    def staged(self, rows: DataFrame) -> DataFrame:
        """Rows that only this commit needs, written and read back."""
        path = f"staging/{self.name}/{uuid.uuid4().hex}"
        rows.write.options(**WRITTEN).parquet(self.store.files.at(path))
        self.stages.append((self.spark.read.schema(rows.schema).parquet(self.store.files.at(path)), path))
        return self.stages[-1][0]

    def reread(self, staged: Sequence[DataFrame], parts: int) -> list[DataFrame]:
        """Staged rows in a session where a shuffle has so many parts: Spark may give a smaller repartition() before a join its own number."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.shuffle.partitions", str(parts))
        return [session.read.schema(rows.schema).parquet(self.store.files.at(path)) for own in staged for rows, path in self.stages if rows is own]

    def abandon(self) -> None:
        self.store.files.delete(f"staging/{self.name}")

    def replace(self, name: str, rows: DataFrame, sort: str = "all") -> DataFrame:
        kept = self.after["tables"].pop(name, None)
        self.whole = True
        try:
            return self.add(name, rows, sort)
        except BaseException:
            self.after["tables"][name] = kept or []
            raise

    def remove(self, keys: DataFrame) -> None:
        """Rows of these sources that are there before this commit go."""
        path = f"data/gone/{self.version:012}-{uuid.uuid4().hex[:8]}"
        keys.select(F.col(keys.columns[0]).cast("long").alias("gone_key"), F.lit(self.version).cast("long").alias("gone_version")).distinct().write.parquet(self.store.files.at(path))
        n = self.spark.read.parquet(self.store.files.at(path)).count()
        if n:
            segment = {"path": path, "version": self.version, "rows": n}
            self.after["gone"].append(segment)
            self.mine.setdefault("_gone", []).append(segment)

    def _rows(self, schema: str, segments: list[dict]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self.store.files.at(x["path"]) for x in segments]) if segments else self.spark.createDataFrame([], schema)

    def _conflicts(self, theirs: dict[str, list[dict]]) -> bool:
        """Whether what was committed since has a source, an address or a removed key of this commit."""
        for table, columns, schema in (("sources", ["kind", "collection", "name"], TABLES["sources"]), ("nodes", ["uri"], TABLES["nodes"]), ("_gone", ["gone_key"], "gone_key long")):
            own, other = (self._rows(schema, x.get(table, [])).select(*columns) for x in (self.mine, theirs))
            if not own.join(other, [own[c].eqNullSafe(other[c]) for c in columns], "left_semi").isEmpty():
                return True
        # a source that one writer removes and the other wrote again, or made vectors of
        for a, b in ((self.mine, theirs), (theirs, self.mine)):
            for table in ("sources", "vectors"):
                gone, ids = self._rows("gone_key long", a.get("_gone", [])), self._rows(TABLES[table], b.get(table, [])).select(F.col(KEYS[table]).alias("own"))
                if not gone.join(ids, F.col("gone_key") == F.col("own"), "left_semi").isEmpty():
                    return True
        return False

    def _rebased(self, settings: Mapping[str, str | None]) -> None:
        """Goes on from the newest version, if that has nothing of this commit."""
        now = self.store.manifest()
        of = lambda m, k: m["settings"].get(k)
        changed = any(of(now, k) not in (of(self.before, k), v) for k, v in settings.items())
        before = {x["path"] for t in self.before["tables"].values() for x in t} | {g["path"] for g in self.before["gone"]}
        theirs = {name: [x for x in segments if x["path"] not in before] for name, segments in {**now["tables"], "_gone": now["gone"]}.items()}
        there = {x["path"] for t in now["tables"].values() for x in t}
        merged = any(x["path"] not in there for t in self.before["tables"].values() for x in t)
        if self.whole or merged or changed or self._conflicts(theirs):
            raise Conflict(f"another writer made version {now['version']}: read again and repeat")
        self.after = json.loads(json.dumps(now)) | {"version": now["version"] + 1}
        for name, segments in self.mine.items():
            if name == "_gone":
                self.after["gone"] += segments
            else:
                self.after["tables"].setdefault(name, []).extend(segments)
        for name, last in self.ids.items():
            self.after["ids"][name] = max(last, now["ids"].get(name, 0))

    def done(self, changed: DataFrame | None = None, settings: Mapping[str, str | None] | None = None) -> int:
        self.after["settings"] = self._settings(self.before, settings)
        logged = None
        for _ in range(REBASES):
            self.after["committed_at"] = time.time()
            if changed is not None and logged != self.after["version"]:  # before the manifest: a change that is told too early does no harm, one that isn't told does
                log = changed.select(F.lit(self.after["version"]).cast("long").alias("version"), "uri", "change", F.current_timestamp().alias("committed_at"))
                log.write.mode("append").parquet(self.store.files.at("changes"))
                logged = self.after["version"]
            if self.store.files.write_once(f"_log/{self.after['version']:012}.json", json.dumps(self.after).encode()):
                self.abandon()
                if not self.whole:
                    self.store.compact()
                return self.after["version"]
            try:
                self._rebased(settings or {})
            except Conflict:
                for segment in (x for segments in self.mine.values() for x in segments):
                    self.store.files.delete(segment["path"])
                self.abandon()
                raise
            self.after["settings"] = self._settings(self.after, settings)
        raise Conflict(f"other writers made {REBASES} versions meanwhile: repeat")

    @staticmethod
    def _settings(before: Mapping, new: Mapping[str, str | None] | None) -> dict[str, str]:
        return {k: v for k, v in {**before["settings"], **(new or {})}.items() if v is not None}

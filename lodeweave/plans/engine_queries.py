"""Registered queries through the engine: the documents are ingested twice, the second time with changes, and then looked at.

The corpus is built once for an application and a folder of tables, in the folder that the cluster shares.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.api import Engine

COLLECTION, GREP, ASKED = "all", "^The .* and ", 12


@dataclass
class Corpus:
    engine: Engine
    second: DataFrame


_BUILT: dict[tuple[str, str], Corpus] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/engine-{uuid.uuid4().hex}"


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        engine = Engine(spark, shared_folder(spark), analyzer="simple")
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

        def files(rows: DataFrame, text: object) -> DataFrame:
            named = F.concat(F.lit("upload://"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))
            return rows.select(named.alias("path"), F.octet_length(text).cast("long").alias("length"), text.cast("binary").alias("content"))  # type: ignore[attr-defined,arg-type]

        engine.ingest_table(files(docs.where("doc_id % 10 <> 3"), F.col("text")), COLLECTION)
        more = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
        _BUILT[key] = Corpus(engine, engine.ingest_table(files(docs, more), COLLECTION))
    return _BUILT[key]


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return corpus(spark, sf_dir).engine


def engine_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second ingest said of each file."""
    return corpus(spark, sf_dir).second.select("name", "status")


def engine_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _engine(spark, sf_dir).store.table("nodes")
    return nodes.select("name", "collection", "path", "uri", "role", "mime_type", "status", "size_bytes", F.sha2("content", 256).alias("hash"))


def engine_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed sources keep the time of their first ingest, and all ids are dense."""
    s = _engine(spark, sf_dir).store.table("sources")
    return s.agg(F.count_if(F.col("updated_at") > F.col("created_at")).alias("changed"), F.count_distinct("id").alias("ids"), F.max("id").alias("most"))


def engine_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).store.changes().groupBy("version", "change").agg(F.count("*").alias("n"))


def engine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).report_table().select("kind", "collection", "name", "status", "files", "embedded", (F.col("chunks") > 0).alias("chunked"))


def engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(_engine(spark, sf_dir).summary().items()), "status string, n long")


def engine_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir).ls(f"/docs/{COLLECTION}", 10, 40)
    return spark.createDataFrame([(e["name"], e["type"], e["size"], e["uri"]) for e in found["entries"]], "name string, type string, size long, uri string")


def engine_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir).glob(f"/docs/{COLLECTION}/src1-*[16].md", 500)
    return spark.createDataFrame([(e["path"], e["uri"], e["size_bytes"]) for e in found], "path string, uri string, size_bytes long")


def engine_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir).resources(0, 50)
    return spark.createDataFrame([(r["uri"], r["name"]) for r in found], "uri string, name string")


def engine_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches below some paths, page by page."""
    engine, found, cursor = _engine(spark, sf_dir), [], None
    while True:
        page = engine.grep(GREP, f"/docs/{COLLECTION}/*1.md", False, 25, cursor, 600_000)
        found += [(m["path"], m["line"], m["text"]) for m in page["matches"]]
        cursor = page["next"]
        if cursor is None:
            return spark.createDataFrame(found, "path string, line long, text string")


def _some(spark: SparkSession, sf_dir: str) -> list[str]:
    """The first few stored names, of short documents."""
    nodes = _engine(spark, sf_dir).store.table("nodes")
    return [r.name for r in nodes.orderBy(F.length("name"), "name").limit(ASKED).select("name").collect()]


def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for names, which stand before each chunk: what they find, and where it is."""
    engine, found = _engine(spark, sf_dir), set()
    names = _some(spark, sf_dir)
    for at in range(0, len(names), 6):
        some = names[at : at + 6]
        for hit in engine.search(['"' + re.sub(r"[^a-z0-9]+", " ", n) + '"' for n in some], limit=25, timeout_ms=600_000):
            found.add((hit.fields["name"], hit.fields["collection"], hit.fields["path"], hit.fields["uri"].split("#")[0]))
    return spark.createDataFrame(sorted(found), "name string, collection string, path string, uri string")


def engine_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read page by page."""
    engine, out = _engine(spark, sf_dir), []
    for name in _some(spark, sf_dir):
        text, cursor = "", None
        while True:
            page = engine.read(f"ctx://docs/{COLLECTION}/{name}", cursor, raw=True)
            text += page["text"]
            cursor = page["next"]
            if cursor is None:
                break
        out.append((name, hashlib.sha256(text.encode()).hexdigest()))
    return spark.createDataFrame(out, "name string, hash string")


def engine_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as lines of JSON, read again."""
    engine = _engine(spark, sf_dir)
    folder = engine.store.files.at(f"export/{uuid.uuid4().hex}")
    engine.export("sources", folder)
    return spark.read.schema("name string, status string, kind string").json(folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        engine_ingest, engine_nodes, engine_times, engine_changes, engine_report, engine_summary, engine_ls, engine_glob, engine_resources, engine_grep,
        engine_search, engine_read, engine_export,
    )
}

#: What the corpus holds: the text as it is read, and whether it can be.
_DOCS = rf"""docs AS (SELECT doc_id, source || '-' || doc_id || '.md' AS name, doc_id % 10 = 3 AS fresh, doc_id % 10 = 5 AS revised,
  CASE WHEN doc_id % 10 = 5 THEN text || ' more' ELSE text END AS content, text FROM documents),
held AS (SELECT *, regexp_matches(content, '\S') AND NOT regexp_matches(content, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS fine,
  regexp_matches(text, '\S') AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS fine_before, replace(content, chr(13) || chr(10), chr(10)) AS body,
  '/docs/{COLLECTION}/' || name AS vfs_path, 'ctx://docs/{COLLECTION}/' || name AS uri FROM docs)"""
_FIRST = f"(SELECT name FROM held WHERE fine ORDER BY length(name), name LIMIT {ASKED})"

ORACLES: dict[str, str] = {
    "engine_ingest": f"WITH {_DOCS} SELECT name, CASE WHEN NOT fine THEN 'failed' WHEN fresh OR revised THEN 'ingested' ELSE 'unchanged' END AS status FROM held",
    "engine_nodes": f"WITH {_DOCS} SELECT name, '{COLLECTION}' AS collection, name AS path, uri, 'doc' AS role, 'text/markdown' AS mime_type, 'ready' AS status, length(body) AS size_bytes, sha256(body) AS hash FROM held WHERE fine",
    "engine_times": f"WITH {_DOCS} SELECT count(*) FILTER (WHERE NOT fresh AND (revised OR NOT fine)) AS changed, count(*) AS ids, count(*) AS most FROM held",
    "engine_changes": f"""WITH {_DOCS} SELECT * FROM (SELECT 1::BIGINT AS version, 'written' AS change, count(*) AS n FROM held WHERE NOT fresh AND fine_before
  UNION ALL SELECT 2, 'written', count(*) FROM held WHERE fine AND (fresh OR revised) UNION ALL SELECT 2, 'deleted', count(*) FROM held WHERE NOT fresh AND revised AND fine_before) WHERE n > 0""",
    "engine_report": f"WITH {_DOCS} SELECT 'doc' AS kind, '{COLLECTION}' AS collection, name, CASE WHEN fine THEN 'ready' ELSE 'failed' END AS status, fine::BIGINT AS files, 0::BIGINT AS embedded, fine AS chunked FROM held",
    "engine_summary": f"WITH {_DOCS} SELECT CASE WHEN fine THEN 'ready' ELSE 'failed' END AS status, count(*) AS n FROM held GROUP BY 1",
    "engine_ls": f"WITH {_DOCS} SELECT name, 'file' AS type, length(body) AS size, uri FROM held WHERE fine ORDER BY name LIMIT 40 OFFSET 10",
    "engine_glob": f"WITH {_DOCS} SELECT vfs_path AS path, uri, length(body) AS size_bytes FROM held WHERE fine AND regexp_matches(name, '^src1-.*[16]\\.md$') ORDER BY path LIMIT 500",
    "engine_resources": f"WITH {_DOCS} SELECT uri, name FROM (SELECT 0 AS grp, '' AS name_, 'ctx://index' AS uri, 'catalog' AS name UNION ALL SELECT 2, name, uri, name FROM held WHERE fine) ORDER BY grp, name_ LIMIT 50",
    "engine_grep": f"""WITH {_DOCS}, cut AS (SELECT vfs_path AS path, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM held WHERE fine AND name LIKE '%1.md')
SELECT path, line::BIGINT AS line, substring(trim(raw, ' '), 1, 300) AS text FROM cut WHERE regexp_matches(raw, '(?s){GREP}')""",
    "engine_search": f"WITH {_DOCS} SELECT name, '{COLLECTION}' AS collection, vfs_path AS path, uri FROM held WHERE name IN {_FIRST}",
    "engine_read": f"WITH {_DOCS} SELECT name, sha256(body) AS hash FROM held WHERE name IN {_FIRST}",
    "engine_export": f"WITH {_DOCS} SELECT name, CASE WHEN fine THEN 'ready' ELSE 'failed' END AS status, 'doc' AS kind FROM held",
}

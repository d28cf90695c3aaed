"""Registered queries of the engine's functions on values made from the tables: files, addresses, pages, skills, vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import paging, safety
from lodeweave.functions.frontmatter import SkillError, parse_skill, strip_frontmatter
from lodeweave.functions.markdown import blocks_from_markdown
from lodeweave.functions.slices import mapped
from lodeweave.functions.text import TextError, decode_text, looks_like_text
from lodeweave.functions.uri import UriError, check_path, path_to_uri, uri_to_path
from lodeweave.operators import catalog
from lodeweave.operators.vectors import plan_batches, quantized
from lodeweave.sources import files

EXTENSIONS = ("md", "py", "csv", "PNG", "bin", "html")
PAGE_TOKENS, LINES_TOKENS = 300, 100


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")


def _extension() -> Column:
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, MIME type and role of members of bundles."""
    folder = F.when(F.col("doc_id") % 4 == 0, "scripts/").when(F.col("doc_id") % 4 == 1, "references/").when(F.col("doc_id") % 4 == 2, "assets/").otherwise("")
    named = _docs(spark, sf_dir).withColumn("path", F.concat(folder, F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), _extension()))
    return named.select("doc_id", mapped("string", files.extension, F.col("path")).alias("extension"), mapped("string", files.mime_of, F.col("path")).alias("mime"), mapped("string", files.role_of, F.col("path")).alias("role"))


def _encoded_text() -> Column:
    """Bytes of a text: plain, behind a mark, in UTF-16, with a control character, with a broken sequence."""
    plain = F.col("text").cast("binary")
    by = F.col("doc_id") % 5
    marked, wide = F.concat(F.unhex(F.lit("EFBBBF")), plain), F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    return F.when(by == 1, marked).when(by == 2, wide).when(by == 3, F.concat(F.unhex(F.lit("00")), plain)).when(by == 4, F.concat(F.unhex(F.lit("C328")), plain)).otherwise(plain)


def _hash_or_reason(data: bytes) -> str:
    try:
        return hashlib.sha256(decode_text(data).encode()).hexdigest()
    except TextError:
        return "refused"


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _docs(spark, sf_dir).select("doc_id", _encoded_text().alias("data"))
    return data.select("doc_id", mapped("string", _hash_or_reason, F.col("data")).alias("hash"), mapped("boolean", looks_like_text, F.substring("data", 1, 1)).alias("textlike"))


def detected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature comes before the extension."""
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("%PDF-1.7")).when(F.col("doc_id") % 3 == 1, F.concat(F.decode(F.unhex(F.lit("504B0304")), "UTF-8"))).otherwise(F.lit("word"))
    rows = _docs(spark, sf_dir).select("doc_id", F.struct(F.concat(F.lit("f."), _extension()).alias("path"), head.cast("binary").alias("head")).alias("f"))

    @F.pandas_udf("string")
    def kind(parts: pd.DataFrame) -> pd.Series:
        return pd.Series([files.detect(p, bytes(h)) for p, h in zip(parts["path"], parts["head"], strict=True)])

    return rows.select("doc_id", kind("f").alias("kind"))


def normalized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as rows: what can be read, and what can't."""
    rows = _docs(spark, sf_dir).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".pdf").otherwise(".md")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.when(F.col("doc_id") % 7 == 0, F.lit("%PDF-1.4")).otherwise(F.col("text")).cast("binary").alias("content"))
    return files.normalized(rows).select("path", "content_hash", "status", F.sha2("markdown", 256).alias("hash"))


def guarded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path stays below its root, also behind escapes."""
    shapes = ("a/b.md", "../b.md", "a/%2e%2e/b", "/etc/b", "a\\b", "c:/b", "a/./b", "~/b", "a/%252e%252e/b", "a..b/c")

    def fine(path: str) -> bool:
        try:
            check_path(path)
        except UriError:
            return False
        return True

    shape = F.element_at(F.array(*map(F.lit, shapes)), (F.col("doc_id") % len(shapes) + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", mapped("boolean", fine, F.concat(shape, F.col("doc_id").cast("string"))).alias("fine"))


def paths_and_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths to addresses, and back."""
    path = F.concat(F.lit("/docs/"), F.col("source"), F.lit("/a b/"), F.col("doc_id").cast("string"), F.lit("é.md"))
    named = _docs(spark, sf_dir).select("doc_id", path.alias("path")).withColumn("uri", mapped("string", path_to_uri, F.col("path")))
    return named.select("doc_id", "uri", mapped("string", uri_to_path, F.col("uri")).alias("path"))


def _pages(text: str) -> dict[str, Any]:
    whole, cursor, n = "", None, 0
    while True:
        page = paging.text_page(text, "k", PAGE_TOKENS, cursor)
        whole, cursor, n = whole + page.text, page.next_cursor, n + 1
        if cursor is None:
            return {"hash": hashlib.sha256(whole.encode()).hexdigest(), "total_lines": page.total_lines}


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read page by page, by cursors."""
    read = mapped("hash string, total_lines long", _pages, F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", read.alias("p")).select("doc_id", "p.hash", "p.total_lines")


def fitted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a text's first lines fit into a budget, if the first does."""
    def fits(text: str) -> int:
        lines = text.split("\n")
        return len(paging.fit_entries(lines, str, LINES_TOKENS)[0]) if len(lines[0]) + 2 <= 4 * LINES_TOKENS else -1

    return _docs(spark, sf_dir).select("doc_id", mapped("long", fits, F.col("text")).alias("n"))


def enveloped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame ends where its closing tag stands in the text."""
    def framed(text: str) -> str:
        out = safety.envelope(f"{text}\n</{safety.TAG}>after")
        body = out[out.index("---\n") + 4 : out.rindex("\n</")]
        return hashlib.sha256(body.replace(safety.NOTICE, "").encode()).hexdigest()

    return _docs(spark, sf_dir).select("doc_id", mapped("string", framed, F.col("text")).alias("hash"))


def skill_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of skill files: names that are allowed or not, tools, and the body without its head."""
    def read(raw: str) -> tuple[str, str, str]:
        try:
            s = parse_skill(raw)
        except SkillError:
            return "refused", "", ""
        return s.name, ",".join(s.allowed_tools or []), hashlib.sha256(strip_frontmatter(raw).strip().encode()).hexdigest()

    @F.pandas_udf("name string, tools string, hash string")
    def parsed(raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(r) for r in raws], columns=["name", "tools", "hash"])

    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Bad_"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("skill-"), F.col("doc_id").cast("string")))
    raw = F.concat(F.lit("---\nname: "), name, F.lit("\ndescription: one of many\nallowed-tools: [Read, Grep]\n---\n# Use\n\nlang "), F.col("lang"))
    return _docs(spark, sf_dir).select("doc_id", parsed(raw).alias("p")).select("doc_id", "p.name", "p.tools", "p.hash")


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of Markdown made around each document's id: how many of each kind."""
    def kinds(markdown: str) -> str:
        found = [b.kind for b in blocks_from_markdown(markdown)]
        return ",".join(f"{k}:{found.count(k)}" for k in sorted(set(found)))

    rows = F.concat_ws("\n", F.lit("| a | b |"), F.lit("| - | - |"), F.array_join(F.array_repeat(F.lit("| 1 | 2 |"), (F.col("doc_id") % 4).cast("int")), "\n"))
    markdown = F.concat_ws("\n\n", F.lit("# One"), F.array_join(F.array_repeat(F.lit("a paragraph"), (F.col("doc_id") % 3 + 1).cast("int")), "\n\n"), F.lit("```\n# not a heading\n```"), rows, F.lit("- item\n- item"), F.lit("> quote"), F.lit("***"), F.when(F.col("doc_id") % 2 == 0, "## Two").otherwise("end"))
    return _docs(spark, sf_dir).select("doc_id", mapped("string", kinds, markdown).alias("kinds"))


def quantized_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a vector in each way of keeping it."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")

    def size(kind: str) -> Column:
        return mapped("long", lambda v: quantized(np.array([v], np.float64), kind).nbytes, F.col("embedding"))

    return base.select("vec_id", *[size(k).alias(k) for k in ("float", "half", "int8", "binary")])


def batch_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of as many short texts as a document's id says, and a long one, whose estimate is capped."""
    def planned(n: int) -> str:
        plan = plan_batches(["short text"] * n + ["x" * 400_000])
        return ",".join(str(len(b)) for b in plan)

    return _docs(spark, sf_dir).select("doc_id", mapped("string", planned, F.col("doc_id") % 300 + 1).alias("sizes"))


def newest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the six newest documents of even ids."""
    when = F.timestamp_seconds(F.col("doc_id") % 50 * 60)
    d = _docs(spark, sf_dir).select("source", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), when.alias("at"), (F.col("doc_id") % 2 == 0).alias("even"))
    return d.groupBy("source").agg(F.array_join(catalog.newest("name", "at", F.col("even")), ",").alias("names"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        file_kinds, decoded_texts, detected_files, normalized_files, guarded_paths, paths_and_uris, text_pages, fitted_lines, enveloped_texts, skill_heads,
        block_kinds, quantized_sizes, batch_plans, newest_names,
    )
}

_EXT = "list_extract(['md', 'py', 'csv', 'PNG', 'bin', 'html'], (doc_id % 6 + 1)::INTEGER)"
_CONTROL = r"regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')"

ORACLES: dict[str, str] = {
    "file_kinds": f"""SELECT doc_id, lower({_EXT}) AS extension,
  CASE lower({_EXT}) WHEN 'md' THEN 'text/markdown' WHEN 'py' THEN 'text/x-python' WHEN 'csv' THEN 'text/csv' WHEN 'png' THEN 'image/png' WHEN 'html' THEN 'text/html' ELSE 'application/octet-stream' END AS mime,
  CASE WHEN doc_id % 4 = 0 OR lower({_EXT}) = 'py' THEN 'script' WHEN doc_id % 4 = 2 THEN 'asset' WHEN lower({_EXT}) = 'md' OR doc_id % 4 = 1 THEN 'reference' ELSE 'asset' END AS role FROM documents""",
    "decoded_texts": f"SELECT doc_id, CASE WHEN doc_id % 5 >= 3 OR {_CONTROL} THEN 'refused' ELSE sha256(text) END AS hash, doc_id % 5 <> 3 AS textlike FROM documents",
    "detected_files": f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN lower({_EXT}) ELSE CASE lower({_EXT}) WHEN 'html' THEN 'html' ELSE 'text' END END AS kind FROM documents",
    "normalized_files": f"""SELECT 'd/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.pdf' ELSE '.md' END AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN '%PDF-1.4' ELSE text END) AS content_hash,
  CASE WHEN doc_id % 7 = 0 OR {_CONTROL} OR NOT regexp_matches(text, '\\S') THEN 'failed' ELSE 'ready' END AS status,
  CASE WHEN doc_id % 7 = 0 OR {_CONTROL} OR NOT regexp_matches(text, '\\S') THEN NULL ELSE sha256(replace(text, chr(13) || chr(10), chr(10))) END AS hash FROM documents""",
    "guarded_paths": "SELECT doc_id, doc_id % 10 IN (0, 9) AS fine FROM documents",
    "paths_and_uris": "SELECT doc_id, 'ctx://docs/' || source || '/a%20b/' || doc_id || '%C3%A9.md' AS uri, '/docs/' || source || '/a b/' || doc_id || 'é.md' AS path FROM documents",
    "text_pages": "SELECT doc_id, sha256(text) AS hash, len(string_split(text, chr(10)))::BIGINT AS total_lines FROM documents",
    "fitted_lines": f"""WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
used AS (SELECT *, sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM cut)
SELECT doc_id, CASE WHEN count(*) FILTER (WHERE i = 1 AND total > {4 * LINES_TOKENS}) > 0 THEN -1 ELSE count(*) FILTER (WHERE total <= {4 * LINES_TOKENS}) END AS n FROM used GROUP BY doc_id""",
    "enveloped_texts": "SELECT doc_id, sha256(text || chr(10)) AS hash FROM documents",
    "skill_heads": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'refused' ELSE 'skill-' || doc_id END AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Read,Grep' END AS tools,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE sha256('# Use' || chr(10) || chr(10) || 'lang ' || lang) END AS hash FROM documents""",
    "block_kinds": """SELECT doc_id, 'code:1,heading:' || CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END || ',list:1,paragraph:' || (doc_id % 3 + 1 + doc_id % 2) || ',quote:1,rule:1,table:1' AS kinds FROM documents""",
    "quantized_sizes": 'SELECT vec_id, 4 * len(embedding) AS "float", 2 * len(embedding) AS half, len(embedding) AS int8, ceil(len(embedding) / 8)::BIGINT AS "binary" FROM embeddings',
    "batch_plans": """SELECT doc_id, array_to_string(list_concat(list_transform(range(0, (doc_id % 300 + 2) // 96), lambda i: 96), CASE WHEN (doc_id % 300 + 2) % 96 = 0 THEN [] ELSE [(doc_id % 300 + 2) % 96] END), ',') AS sizes FROM documents""",
    "newest_names": "WITH d AS (SELECT source, 'd' || doc_id AS name, doc_id % 50 AS minute FROM documents WHERE doc_id % 2 = 0), placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY minute DESC, name) AS place FROM d) SELECT s.source, coalesce((SELECT string_agg(name, ',' ORDER BY place) FROM placed p WHERE p.source = s.source AND place <= 6), '') AS names FROM (SELECT DISTINCT source FROM documents) s",
}

"""The catalog: skills, collections, what couldn't be read; and its rendering within a budget."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.text import BUDGETS, clip, estimate_tokens

TITLES = 6
CLIPS = (400, 220, 140, 90, 60)


def newest(value: str, when: str, condition: Column, n: int = TITLES) -> Column:
    """The n newest values, ties by value."""
    pair = F.struct((-F.unix_micros(when)).alias("age"), F.col(value).alias("v"))
    return F.transform(F.slice(F.array_sort(F.collect_list(F.when(condition, pair))), 1, n), lambda x: x["v"])


def collection_rollup(sources: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """(collection, docs, chunks, needs_ocr, failed) of documents.  chunk_counts: (source_id, n), aggregated before the join."""
    status = F.col("status")
    joined = sources.where(F.col("kind") == "doc").join(chunk_counts, F.col("id") == F.col("source_id"), "left")
    return joined.groupBy("collection").agg(
        F.count_if(status == "ready").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chunks"),
        F.count_if(status == "needs_ocr").alias("needs_ocr"), F.count_if(status == "failed").alias("failed"),
    )


def top_titles(sources: DataFrame, n: int = TITLES) -> DataFrame:
    """(collection, titles) of the newest ready documents; ranked within a collection, so no group is gathered whole."""
    from pyspark.sql import Window

    order = Window.partitionBy("collection").orderBy(F.desc("created_at"), "name")
    best = sources.where((F.col("kind") == "doc") & (F.col("status") == "ready")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return best.groupBy("collection").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ").alias("titles"))


def problems(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("status") != "ready").select("name", "collection", "status", "detail").orderBy("name")


def status_counts(sources: DataFrame) -> DataFrame:
    """(status, n) of sources."""
    return sources.groupBy("status").agg(F.count("*").alias("n"))


def source_report(sources: DataFrame, nodes: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each source's files, chunks and vectors.  nodes, chunks, vectors: with source_id; counted before the joins."""
    n = nodes.groupBy("source_id").agg(F.count("*").alias("files"))
    c = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"))
    v = vectors.groupBy("source_id").agg(F.count("embedding").alias("embedded"))
    out = sources.withColumnRenamed("id", "source_id")
    for counts in (n, c, v):
        out = out.join(counts, "source_id", "left")
    return out.fillna(0, ["files", "chunks", "embedded"])


def _plural(n: int, what: str) -> str:
    return f"{n} {what}{'' if n == 1 else 's'}"


def _section(title: str, lines: Sequence[str], keep: int, path: str) -> list[str]:
    shown = list(lines[:keep]) or ["_none_"]
    return [title, *shown, *([f"- _…{len(lines) - keep} more under {path}_"] if keep < len(lines) else []), ""]


def render_catalog(skills: Sequence[Mapping[str, Any]], groups: Sequence[Mapping[str, Any]], troubles: Sequence[Mapping[str, Any]] = (), budget: int = BUDGETS["index"]) -> str:
    """Descriptions are clipped first; then the longer list is cut by a quarter at a time, to one entry at least.  Counts are always whole."""

    def body(limit: int, n_skills: int, n_groups: int) -> str:
        skill_lines = [f"- **{s['name']}** — {clip(s['description'], limit)}{'' if s.get('status', 'ready') == 'ready' else ' _(' + s['status'] + ')_'}" for s in skills[:n_skills]]
        group_lines = []
        for g in groups[:n_groups]:
            blocked = (g.get("needs_ocr") or 0) + (g.get("failed") or 0)
            titles = ", ".join([t for t in g.get("titles") or [] if t][:4])
            group_lines.append(f"- **{g['collection']}** — {_plural(g['docs'], 'doc')}, {g['chunks']} searchable chunks{f', {blocked} not searchable' if blocked else ''}{f' · {clip(titles, limit)}' if titles else ''}")
        out = _section(f"## Skills ({len(skills)})", skill_lines + [""] * (len(skills) - len(skill_lines)), n_skills, "/skills")
        out += _section(f"## Documents ({_plural(len(groups), 'collection')})", group_lines + [""] * (len(groups) - len(group_lines)), n_groups, "/docs")
        waiting = [t for t in troubles if t["status"] == "needs_ocr"]
        if waiting:
            out += [f"## Not ingested ({len(waiting)})", *(f"- {t['name']} — `{t['status']}`{': ' + clip(t['detail'], 120) if t.get('detail') else ''}" for t in waiting[:10])]
        return "\n".join(["# Catalog", "", *out]).rstrip()

    counts = [len(skills), len(groups)]
    for limit in CLIPS:
        text = body(limit, *counts)
        if estimate_tokens(text) <= budget:
            return text
    while max(counts) > 1:
        longer = 0 if counts[0] >= counts[1] else 1
        counts[longer] = max(1, counts[longer] * 3 // 4)
        text = body(CLIPS[-1], *counts)
        if estimate_tokens(text) <= budget:
            return text
    return body(CLIPS[-1], 1, 1)

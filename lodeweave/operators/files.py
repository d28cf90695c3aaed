"""The virtual file system: listing, globs, grep, point lookups.

Nodes have id, kind, name, collection (never null), path, uri, role, size_bytes, content.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.globs import GlobPlan, plan_glob
from lodeweave.functions.text import InputError
from lodeweave.functions.uri import source_path
from lodeweave.operators import trigrams

# Fixed values.
GREP_FILES = 200
GREP_LINE = 300
FILE_DONE = 2**31 - 1
#: Files with the pattern's trigrams that are read at once, and how often before all files are scanned.
GREP_WAVE, GREP_WAVES = 1_000, 3
#: Files and lines that are read ahead for those who ask for page after page.
AHEAD = 10_000

_LITERAL = re.compile(r"[A-Za-z0-9 _,;:@#%&=<>'\"!/~`-]{3,}")


def with_path(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("vfs_path", source_path(F.col("kind"), F.col("name"), F.col("collection"), F.col("path")))


def in_glob(plan: GlobPlan) -> Column:
    """The glob's condition: literal parts, which scans can push down, then the expression on the whole path."""
    condition = F.col("vfs_path").rlike("(?s)" + plan.regex)
    if plan.prefix:
        condition = F.col("path").startswith(plan.prefix) & condition
    if plan.root is not None:
        condition = ((F.col("name") == plan.root) | (F.col("collection") == plan.root)) & condition
    if plan.kind is not None:
        condition = (F.col("kind") == plan.kind) & condition
    return condition


def glob(nodes: DataFrame, pattern: str, limit: int = 200, offset: int = 0) -> DataFrame:
    """(path, uri, role, size_bytes) by path and uri."""
    found = with_path(nodes).where(in_glob(plan_glob(pattern)))
    return found.select(F.col("vfs_path").alias("path"), "uri", "role", "size_bytes").orderBy("path", "uri").offset(offset).limit(limit)


def check_pattern(pattern: str, spark: object | None = None) -> str:
    """A Java pattern that can be used, else InputError.  Named groups aren't allowed."""
    if not pattern:
        raise InputError("invalid regular expression: empty pattern")
    if re.search(r"\(\?P?<[A-Za-z]", pattern):
        raise InputError("invalid regular expression: named groups aren't supported")
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)  # type: ignore[attr-defined]
        except Exception as e:
            raise InputError(f"invalid regular expression: {str(e).splitlines()[0]}") from None
    return pattern


def required_literal(pattern: str) -> str | None:
    """A string that every match has, if one can be seen: then `contains` narrows the scan."""
    if re.search(r"[|\\()\[\]{}*?+]", pattern):
        return None
    found = max(_LITERAL.findall(pattern.strip("^$").replace(".", "\n")), key=len, default="")
    return found or None


def _flagged(flags: str, pattern: str) -> str:
    """A pattern with flags, merged with those that it begins with."""
    own = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    every = "".join(dict.fromkeys(flags + (own[1] if own else "")))
    return (f"(?{every})" if every else "") + (pattern[own.end() :] if own else pattern)


def grep_candidates(nodes: DataFrame, pattern: str, path_glob: str | None = None, ignore_case: bool = True, after: tuple[int, int] = (0, 0)) -> DataFrame:
    """Files whose content matches, after the key, within the glob."""
    node, line = after
    found = with_path(nodes).where(F.col("content").isNotNull())
    if after != (0, 0):
        found = found.where((F.col("id") > node) | ((F.col("id") == node) & F.lit(line < FILE_DONE)))
    if path_glob is not None:
        found = found.where(in_glob(plan_glob(path_glob)))
    literal = None if ignore_case else required_literal(pattern)
    if literal:
        found = found.where(F.col("content").contains(literal))
    return found.where(F.col("content").rlike(_flagged("im" if ignore_case else "m", pattern)))


def lines(rows: DataFrame, keys: list[Column], text_col: str, separator: str = "\n") -> DataFrame:
    """keys, pos (from 0) and raw of each line or part of a text."""
    return rows.select(*keys, F.posexplode(F.split(text_col, separator)).alias("pos", "raw"))


def grep_lines(files: DataFrame, pattern: str, ignore_case: bool = True, after: tuple[int, int] = (0, 0)) -> DataFrame:
    """(node_id, uri, path, line, text) of matching lines, trimmed and cut."""
    node, line = after
    cut = lines(files, [F.col("id").alias("node_id"), F.col("uri"), F.col("vfs_path").alias("path")], "content")
    hit = cut.where(F.col("raw").rlike(_flagged("i" if ignore_case else "", pattern))).withColumn("line", (F.col("pos") + 1).cast("long"))
    if after != (0, 0):
        hit = hit.where((F.col("node_id") != node) | (F.col("line") > line))
    return hit.select("node_id", "uri", "path", "line", F.substring(F.trim("raw"), 1, GREP_LINE).alias("text"))


def grep_page(nodes: DataFrame, pattern: str, path_glob: str | None = None, ignore_case: bool = True, limit: int = 60, after: tuple[int, int] = (0, 0), grams: DataFrame | None = None) -> tuple[list, tuple[int, int] | None, int]:
    """Matches, the next key, and how many files were looked at; a page reads GREP_FILES files at most.

    grams: an index of trigrams.  Where the pattern says anything of these, only files that have them are read, GREP_WAVE at a
    time; where it says too little, or nothing, all files are scanned.
    """
    check_pattern(pattern, nodes.sparkSession)
    condition = trigrams.condition_of(pattern) if grams is not None else None
    if condition is None:
        ids = _matching(nodes, pattern, path_glob, ignore_case, after)
    else:
        ids, at = [], after[0] - 1
        for _ in range(GREP_WAVES):
            some = [r.id for r in trigrams.candidates(grams, condition, at).orderBy("id").limit(GREP_WAVE).collect()]
            ids += _matching(nodes.where(among("id", some)), pattern, path_glob, ignore_case, after) if some else []
            if len(some) < GREP_WAVE or len(ids) > GREP_FILES:
                break
            at = some[-1]
        else:  # the trigrams are too common to help
            ids += _matching(nodes, pattern, path_glob, ignore_case, (at, FILE_DONE))
        ids = ids[: GREP_FILES + 1]
    scope = ids[:GREP_FILES]
    if not scope:
        return [], None, 0
    files = with_path(nodes).where(among("id", scope))
    found = grep_lines(files, pattern, ignore_case, after).orderBy("node_id", "line").limit(limit + 1).collect()
    following = (found[limit - 1].node_id, found[limit - 1].line) if len(found) > limit else (scope[-1], FILE_DONE) if len(ids) > GREP_FILES else None
    return found[:limit], following, len(scope)


@dataclass
class Ahead:
    """What a search has from a key on, for many pages: ids of files that match, and their lines; whether these are all."""

    since: tuple[int, int]
    ids: list[int]
    all_ids: bool
    lines: list
    all_lines: bool

    def page(self, limit: int, after: tuple[int, int]) -> tuple[list, tuple[int, int] | None, int] | None:
        """grep_page() of a key that isn't before this one's; None if more must be read for it."""
        node, line = after
        ids = self.ids[bisect_right(self.ids, node) if line >= FILE_DONE else bisect_left(self.ids, node) :][: GREP_FILES + 1]
        if len(ids) <= GREP_FILES and not self.all_ids:
            return None
        scope = ids[:GREP_FILES]
        if not scope:
            return [], None, 0
        place = lambda r: (r.node_id, r.line)
        found = self.lines[bisect_right(self.lines, after, key=place) : bisect_right(self.lines, (scope[-1], FILE_DONE), key=place)][: limit + 1]
        if len(found) <= limit and not self.all_lines and self.lines[-1].node_id <= scope[-1]:
            return None
        following = place(found[limit - 1]) if len(found) > limit else (scope[-1], FILE_DONE) if len(ids) > GREP_FILES else None
        return found[:limit], following, len(scope)

    def size(self) -> int:
        return 64 * len(self.ids) + sum(400 + 2 * len(r.text) + 2 * len(r.path) + 2 * len(r.uri) for r in self.lines)


def grep_ahead(nodes: DataFrame, pattern: str, path_glob: str | None = None, ignore_case: bool = True, after: tuple[int, int] = (0, 0)) -> Ahead:
    """What the pages after a key need, by two scans for all of them: AHEAD files and lines at most."""
    found = grep_candidates(nodes, pattern, path_glob, ignore_case, after)
    ids = [r.id for r in found.select("id").orderBy("id").limit(AHEAD).collect()]
    some = found.where(F.col("id").between(ids[0], ids[-1])) if ids else found.limit(0)
    lines = grep_lines(some, pattern, ignore_case, after).orderBy("node_id", "line").limit(AHEAD).collect() if ids else []
    return Ahead(after, ids, len(ids) < AHEAD, lines, len(lines) < AHEAD)


def _matching(nodes: DataFrame, pattern: str, path_glob: str | None, ignore_case: bool, after: tuple[int, int]) -> list[int]:
    """The first files that match, by id: one more than a page has."""
    window = grep_candidates(nodes, pattern, path_glob, ignore_case, after).orderBy("id").limit(GREP_FILES + 1)
    return [r.id for r in window.select("id").collect()]


def among(column: str, values: Sequence[int]) -> Column:
    """column is one of these, as sets so small that a scan looks for each value."""
    return reduce(lambda a, b: a | b, [F.col(column).isin(*values[i : i + 10]) for i in range(0, len(values), 10)], F.lit(False))


def children(nodes: DataFrame, kind: str, root: str, prefix: str = "") -> DataFrame:
    """(name, directory, count, uri, role, size) of what lies directly under a path; directories first."""
    depth = prefix.count("/") + 2 if prefix else 1
    inside = nodes.where((F.col("kind") == kind) & ((F.col("name") if kind == "skill" else F.col("collection")) == root))
    inside = inside.where(F.col("path").startswith(prefix + "/")) if prefix else inside
    parts = F.split("path", "/")
    split = inside.select(F.get(parts, F.lit(depth - 1)).alias("name"), (F.size(parts) > depth).alias("directory"), "uri", "role", "size_bytes")
    out = split.groupBy("name", "directory").agg(F.count("*").alias("count"), F.min("uri").alias("uri"), F.min("role").alias("role"), F.max("size_bytes").alias("size"))
    return out.orderBy(F.desc("directory"), "name")


def root_counts(sources: DataFrame) -> DataFrame:
    doc = F.col("kind") == "doc"
    return sources.agg(F.count_if(F.col("kind") == "skill").alias("skills"), F.count_if(doc).alias("docs"), F.count_distinct(F.when(doc, F.col("collection"))).alias("collections"))


def collections(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("kind") == "doc").groupBy("collection").agg(F.count("*").alias("docs")).orderBy("collection")


def completions(values: DataFrame, column: str, prefix: str, limit: int = 100) -> DataFrame:
    """Distinct values that begin so, whatever the case."""
    return values.where(F.lower(column).startswith(prefix.lower())).select(column).distinct().orderBy(column).limit(limit)


def neighbours(chunks: DataFrame, node_id: int, ord_: int, radius: int = 1) -> DataFrame:
    return chunks.where((F.col("node_id") == node_id) & F.col("ord").between(ord_ - radius, ord_ + radius) & (F.col("ord") != ord_)).orderBy("ord")


def neighbours_of(chunks: DataFrame, wanted: DataFrame, radius: int = 1) -> DataFrame:
    """(node_id, ord, near, ...): for each wanted (node_id, ord) the chunks around it, with all other columns of chunks."""
    at = wanted.select("node_id", F.col("ord").alias("wanted_ord"))
    around = at.select("node_id", "wanted_ord", F.explode(F.sequence((F.col("wanted_ord") - radius).cast("long"), (F.col("wanted_ord") + radius).cast("long"))).alias("near")).where("near <> wanted_ord AND near >= 0")
    there = chunks.withColumnRenamed("ord", "near").withColumn("near", F.col("near").cast("long"))
    return around.join(there, ["node_id", "near"]).withColumnRenamed("wanted_ord", "ord")


def resource_page(index: DataFrame, nodes: DataFrame, offset: int, limit: int) -> DataFrame:
    """(grp, sort, uri, name): the index, then skills by name, then documents by path; a page of them."""
    skills = nodes.where("role = 'skill_md'").select(F.lit(1).alias("grp"), F.col("name").alias("sort"), "uri", "name")
    docs = nodes.where("role = 'doc'").select(F.lit(2).alias("grp"), F.col("path").alias("sort"), "uri", "name")
    return index.unionByName(skills).unionByName(docs).orderBy("grp", "sort", "uri").offset(offset).limit(limit)

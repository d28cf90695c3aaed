"""Fusion of ranked lists, and choice of different results among them."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.analyzer import WORD

# Fixed values.
RRF_K = 60
PER_DOCUMENT = 3
OVERLAP = 0.85


def fuse(lists: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """(key, score, best, lists) of rows (list, key, rank), by score, best rank, key as text.  Sums are partial before the shuffle."""
    return lists.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best"), F.array_sort(F.collect_set("list")).alias("lists")).orderBy(F.desc("score"), "best", F.col(key).cast("string"))


@dataclass(frozen=True)
class Fused:
    key: Any
    item: Any
    score: float
    ranks: dict[str, int]


def rrf(lists: Mapping[str, Sequence[tuple[Any, Any]]], k: int = RRF_K) -> list[Fused]:
    """The same for small lists of (key, item)."""
    ranks: dict[Any, dict[str, int]] = defaultdict(dict)
    items: dict[Any, Any] = {}
    for name, rows in lists.items():
        for rank, (key, item) in enumerate(rows, 1):
            items.setdefault(key, item)
            ranks[key].setdefault(name, rank)
    out = [Fused(key, items[key], sum(1 / (k + r) for r in by.values()), by) for key, by in ranks.items()]
    return sorted(out, key=lambda f: (-f.score, min(f.ranks.values()), str(f.key)))


@dataclass(frozen=True)
class Hit:
    chunk_id: int
    node_id: int
    content: str
    score: float = 0.0
    fields: dict[str, Any] = field(default_factory=dict)


def overlaps(a: str, b: str) -> bool:
    """Whether the smaller set of words is nearly within the other."""
    left, right = set(WORD.findall(a.lower())), set(WORD.findall(b.lower()))
    return len(left & right) > OVERLAP * min(len(left), len(right)) if left and right else a == b


def diversify(lists: Mapping[str, Sequence[Hit]], queries: int, limit: int, per_document: int = PER_DOCUMENT, preferred: Sequence[int] = ()) -> list[Hit]:
    """Results in turns: each query gives its next acceptable hit until the limit, then the fused list fills up.

    lists: `fts:i` and `vec:i` for query i.  A hit is acceptable if it is new, its node has fewer than per_document hits
    and none that says nearly the same.
    """
    place = {c: i for i, c in enumerate(preferred)}

    def fused(names: Sequence[str]) -> list[Fused]:
        out = rrf({n: [(h.chunk_id, h) for h in lists.get(n, ())] for n in names})
        return sorted(out, key=lambda f: place.get(f.key, math.inf)) if place else out

    whole = fused(list(lists))
    scores = {f.key: f.score for f in whole}
    queues = [iter(fused([f"fts:{i}", f"vec:{i}"])) for i in range(queries)]
    chosen: list[Hit] = []
    of_node: dict[int, list[Hit]] = defaultdict(list)

    def taken(hit: Hit) -> bool:
        near = of_node[hit.node_id]
        if len(chosen) >= limit or len(near) >= per_document or any(h.chunk_id == hit.chunk_id or overlaps(h.content, hit.content) for h in near):
            return False
        near.append(hit)
        chosen.append(replace(hit, score=scores[hit.chunk_id]))
        return True

    for _ in range(math.ceil(limit / max(1, queries))):
        for queue in queues:
            next((f for f in queue if taken(f.item)), None)
    for f in whole:
        taken(f.item)
    return chosen


#: Links that one answer shows.
LINKS = 20


def distinct_links(hits: DataFrame, limit: int = LINKS) -> DataFrame:
    """(uri, rank): each address once, with its best rank, the best first.  hits: uri, rank."""
    return hits.groupBy("uri").agg(F.min("rank").alias("rank")).orderBy("rank", "uri").limit(limit)


class Reranker(Protocol):
    def order(self, query: str, documents: Sequence[str]) -> list[int]: ...


def rerank(reranker: Reranker | None, query: str, documents: Sequence[str]) -> tuple[list[int] | None, str | None]:
    """A whole permutation, or none and a warning; never an error."""
    if reranker is None:
        return None, None
    try:
        order = list(reranker.order(query, documents))
    except Exception as e:  # a reranker's failure must not fail the search
        return None, f"reranking failed: {e}"
    return (order, None) if sorted(order) == list(range(len(documents))) else (None, "the reranker gave no whole order")


def recall_and_mrr(found: Sequence[Sequence[Any]], expected: Sequence[Sequence[Any]], k: int = 5) -> tuple[float, float]:
    """Mean recall at k and mean reciprocal rank of the first expected result."""
    recall = [len(set(f[:k]) & set(e)) / len(set(e)) for f, e in zip(found, expected, strict=True)]
    first: Callable[[Any, Any], float] = lambda f, e: next((1 / r for r, x in enumerate(f, 1) if x in e), 0.0)
    mrr = [first(f, e) for f, e in zip(found, expected, strict=True)]
    return sum(recall) / max(1, len(recall)), sum(mrr) / max(1, len(mrr))

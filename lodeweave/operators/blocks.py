"""Full-text search by stored postings that reads only the blocks of ids that can still give a result.

Ids are cut to blocks of BLOCK.  For each term and block the greatest number of places in a row is kept, and with it what
the ranking of any row of the block can be at most: which groups of phrases it may satisfy, how many terms it may have, and
a cover density of no more than all places together.  A search takes the blocks in the order of that bound, some at a
time, and ends when no block left can reach the k-th row found.  Only postings of those blocks are read and put together by
id.  What is still in question after the waves is read in one go, with its bound as the condition.

Rows without any term of a query can only satisfy an alternative of negated phrases alone.  They rank behind all
others, in the order of their ids, and are the scope's ids without those of the query's terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.analyzer import Phrase, Query, cover_density
from lodeweave.operators import fts

BLOCK = 256
#: Blocks a query that each wave reads, before the rest is read in one go; ids that are looked through for rows without terms.
WAVES, FIRST_IDS = (64, 1_024), 1_024


def block_of(id_col: str) -> Column:
    return F.floor(F.col(id_col) / BLOCK).cast("long")


def bounds(posted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(term, block, keys, most) of postings with a block: the most places that a row of the block has."""
    return posted.groupBy("term", "block", *keys).agg(F.max(F.size("positions")).cast("int").alias("most"))


def bounds_in_place(posted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """bounds() without a shuffle, in the rows' order.  A block may have several rows of a term, of which the greatest counts."""
    names = ["term", "block", *keys]

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([("most", "max")]).select([*names, "most_max"])
            yield from found.rename_columns([*names, "most"]).to_batches()

    types = "".join(f"{k} {posted.schema[k].dataType.simpleString()}, " for k in names)
    return posted.select(*names, F.size("positions").cast("int").alias("most")).mapInArrow(most, f"{types}most int")


@dataclass
class Read:
    """What a search has looked at."""

    waves: int = 0
    blocks: set[int] = field(default_factory=set)
    rest: bool = False


@dataclass
class _Asked:
    """A query and how far its search is: the best rows (exact, terms, density, id), and the last block that was read."""

    number: int
    query: Query
    best: list[tuple] = field(default_factory=list)
    after: tuple | None = None
    done: bool = False

    @property
    def loose(self) -> Query:
        return self.query.loose()

    @property
    def words(self) -> list[str]:
        return self.query.words

    @property
    def without_terms(self) -> bool:
        return any(all(p.negated for p in g) for g in self.loose.anyof)

    def keep(self, found: list[tuple], k: int) -> None:
        self.best = sorted({*self.best, *found}, key=lambda r: (-r[0], -r[1], -r[2], r[3]))[:k]


def _may(query: Query, there: dict[str, Column]) -> Column:
    """Whether a block may have a row that satisfies the query."""

    def group(phrases: tuple[Phrase, ...]) -> Column:
        needed = {w for p in phrases if not p.negated for w in p.words if w}
        return reduce(lambda a, b: a & b, [there[w] for w in sorted(needed)], F.lit(True))

    return reduce(lambda a, b: a | b, [group(g) for g in query.anyof], F.lit(False))


def _bounded(known: DataFrame, asked: Sequence[_Asked]) -> DataFrame:
    """(number, block, exact, terms, density) of each block that may have rows with a term of a query: its upper bounds."""
    terms = sorted({w for a in asked for w in a.words})
    most = {t: f"most_{i}" for i, t in enumerate(terms)}
    by_block = known.where(F.col("term").isin(terms)).groupBy("block").agg(*[F.max(F.when(F.col("term") == t, F.col("most"))).alias(n) for t, n in most.items()])
    there = {t: F.col(n).isNotNull() for t, n in most.items()}
    parts = []
    for a in asked:
        own = [F.coalesce(F.col(most[w]), F.lit(0)) for w in a.words]
        some = F.struct(F.lit(a.number).cast("long").alias("number"), F.col("block"), _may(a.query, there).cast("long").alias("exact"), sum(((x > 0).cast("long") for x in own), F.lit(0).cast("long")).alias("terms"), sum(own, F.lit(0)).cast("double").alias("density"))
        parts.append(F.when(_may(a.loose, there), some))
    each = by_block.select(F.explode(F.array_compact(F.array(*parts))).alias("b"))  # bounds are read once for all queries
    return each.select("b.number", "b.block", "b.exact", "b.terms", "b.density").where("terms > 0")


def _open(a: _Asked, k: int) -> Column:
    """Whether a block is a query's, wasn't read and can still reach its k-th row."""
    bound = F.struct("exact", "terms", "density")
    value = lambda r: F.struct(F.lit(r[0]).cast("long").alias("exact"), F.lit(r[1]).cast("long").alias("terms"), F.lit(r[2]).cast("double").alias("density"))
    left = F.col("number") == a.number
    if len(a.best) == k:
        left &= bound >= value(a.best[-1])
    if a.after is not None:
        left &= (bound < value(a.after)) | ((bound == value(a.after)) & (F.col("block") > a.after[3]))
    return left


def _any(asked: Sequence[_Asked], k: int) -> Column:
    return reduce(lambda a, b: a | b, [_open(a, k) for a in asked])


def _judged(rows: DataFrame, asked: Sequence[_Asked], id_col: str) -> DataFrame:
    """(query_id, id, exact, terms, density) of rows (term, id, positions): a row's own terms are put together, all other words are gaps."""
    terms = sorted({w for a in asked for w in a.words})
    # as many tasks as cores: little is shuffled, but much is done in Python for it
    spread = rows.where(F.col("term").isin(terms)).select("term", id_col, "positions").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, id_col)
    mine = spread.groupBy(id_col).agg(F.collect_list(F.struct("term", "positions")).alias("own"))
    queries = [(a.number, a.query, a.loose, set(a.words)) for a in asked]

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, own in zip(frame[id_col], frame["own"], strict=True):
                at = {int(p): e["term"] for e in own for p in e["positions"]}
                line = [at.get(p, "") for p in range(1, max(at) + 1)] if at else []
                have = set(at.values())
                for i, q, loose, words in queries:
                    if have & words and fts.satisfies(line, loose):
                        out.append((i, key, int(fts.satisfies(line, q)), len(have & words), round(cover_density(line, loose), 6)))
            yield pd.DataFrame(out, columns=["query_id", id_col, "exact", "terms", "density"])

    return mine.mapInPandas(judged, f"query_id long, {id_col} {rows.schema[id_col].dataType.simpleString()}, exact long, terms long, density double")


def _take(found: DataFrame, asked: Sequence[_Asked], k: int, id_col: str) -> None:
    """Each query's best rows of what was read: at most k a query come to the driver."""
    rows = fts._best(found, k, id_col, len(asked) == 1).collect()
    for a in asked:
        a.keep([(r.exact, r.terms, r.density, r[id_col]) for r in rows if r.query_id == a.number], k)


def _without_terms(posted: DataFrame, ids: DataFrame, a: _Asked, k: int, id_col: str) -> None:
    """Fills up with the smallest ids of the scope that have none of the query's terms."""
    missing = k - len(a.best)
    own = posted.where(F.col("term").isin(a.words)).select(id_col) if a.words else posted.select(id_col).limit(0)
    first = [r[0] for r in ids.select(id_col).orderBy(id_col).limit(FIRST_IDS).collect()]
    if not first:
        return
    has = {r[0] for r in own.where(F.col(id_col) <= first[-1]).distinct().collect()}
    found = [i for i in first if i not in has]
    if len(found) < missing and len(first) == FIRST_IDS:
        later = ids.where(F.col(id_col) > first[-1]).select(id_col).join(own.where(F.col(id_col) > first[-1]), id_col, "left_anti")
        found += [r[0] for r in later.orderBy(id_col).limit(missing).collect()]
    a.keep([(1, 0, 0.0, i) for i in found[:missing]], k)


def bounded_search(posted: DataFrame, known: DataFrame, ids: DataFrame, queries: Sequence[Query], k: int, id_col: str, read: Read | None = None) -> DataFrame:
    """fts.text_search() from postings (term, block, id, positions), their bounds, and the ids of the scope.

    Equal to the scan for every query.  read is told what was looked at.
    """
    read = Read() if read is None else read
    asked = [_Asked(i, q) for i, q in enumerate(queries)]
    live = [a for a in asked if a.words]
    blocks = _bounded(known, live) if live else None
    for size in WAVES:
        live = [a for a in live if not a.done]
        if not live:
            break
        order = [F.desc("exact"), F.desc("terms"), F.desc("density"), F.asc("block")]
        place = F.row_number().over(Window.partitionBy("number").orderBy(*order))
        some = blocks.where(_any(live, k)).withColumn("place", place).where(F.col("place") <= size).collect()
        for a in live:
            own = sorted(((r.exact, r.terms, r.density, r.block) for r in some if r.number == a.number), key=lambda r: (-r[0], -r[1], -r[2], r[3]))
            a.after = own[-1] if own else a.after
            a.done = len(own) < size
        wanted = sorted({r.block for r in some})
        if wanted:
            read.waves += 1
            read.blocks |= set(wanted)
            _take(_judged(posted.where(F.col("block").isin(wanted)), live, id_col), live, k, id_col)
    live = [a for a in live if not a.done]
    if live:
        rest = blocks.where(_any(live, k)).select("block").distinct()
        read.rest = True
        _take(_judged(posted.join(rest, "block", "left_semi"), live, id_col), live, k, id_col)
    for a in asked:
        if a.without_terms and len(a.best) < k:
            _without_terms(posted, ids, a, k, id_col)
    rows = [(a.number, r[3], r[0], r[1], float(r[2]), n) for a in asked for n, r in enumerate(a.best, 1)]
    return posted.sparkSession.createDataFrame(rows, f"query_id long, {id_col} {posted.schema[id_col].dataType.simpleString()}, exact long, terms long, density double, rank long")

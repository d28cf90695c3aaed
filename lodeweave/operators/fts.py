"""Full-text search: by a scan of words, or by postings.

A scan evaluates queries on each row's array of terms, which is made once a row, and passes on k rows a query from each
task.  Postings, made row by row without a shuffle and stored by term, give the same ranking from the terms' rows alone.

The ranking: whether the query matches as it was asked; how many of its terms a row has; cover density, which for
alternatives of words is the number of their places; the id.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.analyzer import Phrase, Query, analyze, cover_density
from lodeweave.functions.slices import mapped
from lodeweave.functions.text import words_of

#: Places of words that are put in order together, unless one row has more, and entries that are given back together.
PLACES, _ROWS = 1_000_000, 50_000


def analyzed(text: Column, analyzer: str = "simple") -> Column:
    """A text's terms, in order."""
    if analyzer == "simple":
        return words_of(text)

    return mapped("array<string>", lambda t: None if t is None else analyze(t, analyzer), text)


def _spaced(words: Column) -> Column:
    # terms have no spaces, so neighbours in the array are neighbours in its joined form
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _pattern(phrase: Phrase) -> str:
    """Where a phrase begins; what follows is only looked at, so that overlapping places count."""
    first, *rest = phrase.words
    return f"(?<= ){first}(?= {''.join(w or '[^ ]*' for w in rest[:1])}{''.join(' ' + (w or '[^ ]*') for w in rest[1:])} )"


def _phrase_matches(words: Column, phrase: Phrase) -> Column:
    return F.array_contains(words, phrase.words[0]) if len(phrase.words) == 1 else F.regexp(_spaced(words), F.lit(_pattern(phrase)))


def _phrase_places(words: Column, phrase: Phrase) -> Column:
    return F.size(F.filter(words, lambda w: w == phrase.words[0])) if len(phrase.words) == 1 else F.regexp_count(_spaced(words), F.lit(_pattern(phrase)))


def matches(words: Column, query: Query) -> Column:
    """Whether an array of words satisfies a query."""
    if not query.anyof:
        return F.lit(False)
    groups = [reduce(lambda a, b: a & b, [~_phrase_matches(words, p) if p.negated else _phrase_matches(words, p) for p in group]) for group in query.anyof]
    return reduce(lambda a, b: a | b, groups)


def density(words: Column, loose: Query) -> Column:
    """cover_density() of an array of words.  Alternatives of single phrases are counted in place; else Python is asked."""
    wanted = [[p for p in g if not p.negated] for g in loose.anyof]
    if any(len(g) > 1 for g in wanted):

        @F.pandas_udf("double")
        def covers(terms: pd.Series) -> pd.Series:
            return terms.map(lambda t: 0.0 if t is None else cover_density(list(t), loose))

        return covers(words)
    phrases = list(dict.fromkeys(g[0] for g in wanted if g))
    singles = [p.words[0] for p in phrases if len(p.words) == 1]
    places = F.size(F.filter(words, lambda w: w.isin(singles))) if singles else F.lit(0)
    # a phrase with a word that is an alternative by itself never makes a stretch of its own
    for p in phrases:
        if len(p.words) > 1 and not set(singles) & set(p.words):
            places = places + _phrase_places(words, p)
    return places.cast("double")


def _judged(words: Column, query: Query, query_id: int) -> Column:
    """query_id, exact, terms and density of a row that matches loosely; null for another."""
    wanted = F.array(*map(F.lit, query.words)).cast("array<string>")
    loose = query.loose()
    found = F.struct(F.lit(query_id).cast("long").alias("query_id"), matches(words, query).cast("long").alias("exact"), F.size(F.array_intersect(words, wanted)).cast("long").alias("terms"), density(words, loose).alias("density"))
    return F.when(matches(words, loose), found)


def scored(rows: DataFrame, queries: Sequence[Query], id_col: str, text_col: str, analyzer: str = "simple") -> DataFrame:
    """(query_id, id, exact, terms, density) of every row that matches a query loosely.  A row's terms are made once."""
    words = rows.select(id_col, analyzed(F.col(text_col), analyzer).alias("words"))
    counts = {i: q for i, q in enumerate(queries) if any(len([p for p in g if not p.negated]) > 1 for g in q.loose().anyof)}
    column = F.col("words")
    parts = []
    if len(counts) < len(queries):
        each = F.array_compact(F.array(*[_judged(column, q, i) for i, q in enumerate(queries) if i not in counts]))
        parts.append(words.select(id_col, F.explode(each).alias("m")).select("m.query_id", id_col, "m.exact", "m.terms", "m.density"))
    for i, q in counts.items():  # stretches are sought in Python, in rows that match alone
        kept = words.select(id_col, F.explode(F.array_compact(F.array(F.when(matches(column, q), column)))).alias("words"))
        wanted = F.array(*map(F.lit, q.words)).cast("array<string>")
        parts.append(kept.select(F.lit(i).cast("long").alias("query_id"), id_col, F.lit(1).cast("long").alias("exact"), F.size(F.array_intersect("words", wanted)).cast("long").alias("terms"), F.round(density(column, q.loose()), 6).alias("density")))
    return reduce(DataFrame.unionByName, parts)


def ranking(id_col: str) -> list[Column]:
    return [F.desc("exact"), F.desc("terms"), F.desc("density"), F.asc(id_col)]


def _best(found: DataFrame, k: int, id_col: str, one: bool) -> DataFrame:
    """Each query's best k, of which only as many a task are shuffled."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(*ranking(id_col))).cast("long")
    if one:
        return found.orderBy(*ranking(id_col)).limit(k).withColumn("rank", order)
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def text_search(rows: DataFrame, queries: Sequence[Query], k: int, id_col: str, text_col: str, analyzer: str = "simple") -> DataFrame:
    """(query_id, id, exact, terms, density, rank) of each query's best k, by one scan."""
    return _best(scored(rows, queries, id_col, text_col, analyzer), k, id_col, len(queries) == 1)


def _runs(rows: DataFrame, keys: Sequence[str], words: Column) -> DataFrame:
    """keys, and entries (term, positions) of each row's terms, without a shuffle: a row's terms are sorted, then cut where they change."""
    placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("term"), (i + 1).alias("at"))), lambda e: e["term"] != "")
    by_term = rows.select(*keys, F.array_sort(placed).alias("sorted_terms"))
    s = F.col("sorted_terms")
    before = F.transform(s, lambda e, i: F.when(i == 0, F.lit(None).cast("string")).otherwise(F.get(s, i - 1)["term"]))
    cut = by_term.select(*keys, "sorted_terms", F.filter(F.transform(F.arrays_zip(s.alias("e"), before.alias("b")), lambda x, i: F.when(~x["e"]["term"].eqNullSafe(x["b"]), i)), lambda i: i.isNotNull()).alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array(F.size(s)))
    spans = F.arrays_zip(F.col("starts").alias("low"), ends.alias("high"))
    return cut.select(*keys, "sorted_terms", F.explode(spans).alias("span")).where("span.low IS NOT NULL")


def _runs_of(words: pa.ListArray) -> Iterator[tuple[int, int]]:
    """(row, rows) of parts of a batch that have PLACES words at most, or one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PLACES, "right")))
        yield at, to - at
        at = to


#: Bytes of plain text in small letters, with a space for what isn't a letter or digit.
_SMALL = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def _is_plain(text: Column) -> Column:
    """Whether a text has no other characters than ASCII and U+00C0 to U+00FF, whose words are found in bytes."""
    return (F.octet_length(text) == F.length(text)) | F.regexp(text, F.lit(r"\A[\x00-\x7F\u00C0-\u00FF]*+\z"))


def plain_words(texts: pa.StringArray) -> pa.ListArray:
    """words_of() of plain texts, for whole Arrow arrays; an empty word stands for no words, and nulls stay."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    small = _SMALL[raw]
    at = np.flatnonzero(raw == 0xC3) + 1  # the second byte of what isn't ASCII
    second = raw[at]
    small[at[(second <= 0x9E) & (second != 0x97)]] += 32
    signs = at[(second == 0x97) | (second == 0xB7)]  # the signs of multiplication and division
    small[signs] = small[signs - 1] = 32
    there = texts.is_valid() if texts.null_count else None
    lower = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(small))
    found = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lower))
    return found if there is None else pc.if_else(there, found, pa.scalar(None, found.type))


def _with_words(rows: DataFrame, keys: Sequence[str], text: Column, analyzer: str) -> DataFrame:
    """keys, plain, words: plain texts as they are, the words of the others."""
    whole = rows.select(*keys, text.alias("whole")).where("whole IS NOT NULL")
    if analyzer != "simple":
        return whole.select(*keys, F.lit(None).cast("string").alias("plain"), analyzed(F.col("whole"), analyzer).alias("words"))
    asked = whole.withColumn("is_plain", _is_plain(F.col("whole")))
    return asked.select(*keys, F.when(F.col("is_plain"), F.col("whole")).alias("plain"), F.when(~F.col("is_plain"), analyzed(F.col("whole"))).alias("words"))


def _all_words(batch: pa.RecordBatch) -> pa.ListArray:
    """The words of a batch of _with_words(), whichever way they came."""
    plain, words = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    if plain.null_count == len(plain):
        return words
    is_plain = plain.is_valid().to_numpy(zero_copy_only=False)
    own = plain_words(plain.drop_null())
    if is_plain.all():
        return own
    place = np.where(is_plain, np.cumsum(is_plain) - 1, len(own) + np.arange(len(words)))
    return pa.concat_arrays([own.cast(words.type), words]).take(pa.array(place))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Keys and words of a batch of _with_words(), PLACES words or one row at a time."""
    words, names = _all_words(batch), batch.schema.names[:-2]
    for at, n in _runs_of(words):
        yield pa.RecordBatch.from_arrays([*[c.slice(at, n) for c in batch.columns[:-2]], words.slice(at, n)], [*names, "words"])


def _entries(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order; of each term and row, by term and row: the term's number, the row, where its places begin; and all places."""
    flat, parents = words.flatten(), pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.searchsorted(parents, np.arange(len(words)))
    places = np.arange(len(parents)) - first[parents] + 1 if len(parents) else np.zeros(0, np.int64)
    known = flat.dictionary_encode()
    by_bytes = pc.array_sort_indices(known.dictionary).to_numpy()  # as Spark orders strings
    rank = np.empty(len(by_bytes), np.int64)
    rank[by_bytes] = np.arange(len(by_bytes))
    codes = rank[known.indices.to_numpy(zero_copy_only=False)]
    fine = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
    run = (codes * max(1, len(words)) + parents)[fine]
    order = np.argsort(run, kind="stable")
    run, at = run[order], places[fine][order].astype(np.int32)
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    code, of = np.divmod(run[starts], max(1, len(words)))
    return known.dictionary.take(pa.array(by_bytes)), code, of, starts, at


def _placed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(term, keys, positions) of a batch of keys and words, by term and then in the rows' order."""
    *keys, words = batch.columns
    terms, code, of, starts, at = _entries(words)
    ends = np.append(starts[1:], len(at))
    for low in range(0, len(starts), _ROWS):
        some = slice(low, low + _ROWS)
        begin, end = starts[low], ends[some][-1]
        positions = pa.ListArray.from_arrays(pa.array(np.append(starts[some], end) - begin, pa.int32()), pa.array(at[begin:end]))
        rows = pa.array(of[some])
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(code[some])), *[c.take(rows) for c in keys], positions], ["term", *batch.schema.names[:-1], "positions"])


def _most(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(term, keys, most) of a batch of keys and words, by term: the most places that a row of these keys has."""
    *keys, words = batch.columns
    terms, code, of, starts, at = _entries(words)
    names = batch.schema.names[:-1]
    known = pa.table([*keys, pa.array(np.arange(len(words)))], [*names, "row"])
    each = known.group_by(names, use_threads=False).aggregate([("row", "list")]).combine_chunks()
    lists = each.column("row_list").combine_chunks()
    group = np.empty(len(words), np.int64)
    group[lists.flatten().to_numpy()] = pc.list_parent_indices(lists).to_numpy()
    own = code * max(1, each.num_rows) + group[of]
    order = np.argsort(own, kind="stable")
    own, n = own[order], np.diff(np.append(starts, len(at)))[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(n, first) if len(first) else n
    term, kept = np.divmod(own[first], max(1, each.num_rows))
    whole = each.select(names).to_batches()
    for low in range(0, len(first), _ROWS):
        rows = pa.array(kept[low : low + _ROWS])
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(term[low : low + _ROWS])), *[c.take(rows) for c in whole[0].columns], pa.array(most[low : low + _ROWS], pa.int32())], ["term", *names, "most"])


def _kinds(rows: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)


def postings(rows: DataFrame, keys: Sequence[str], texts: Mapping[str, float], analyzer: str = "simple") -> DataFrame:
    """(term, keys, positions, weight) of each term in each text column, without a shuffle; texts: weight by column.

    They come in runs of PLACES words, each by term and then in the rows' order.  So they can be written as they come: a
    sort of all that a task has would need memory for it.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _parts(batch):
                yield from _placed(some)

    parts = []
    for column, weight in texts.items():
        made = _with_words(rows, keys, F.col(column), analyzer).mapInArrow(placed, f"term string, {_kinds(rows, keys)}positions array<int>")
        parts.append(made.withColumn("weight", F.lit(float(weight))))
    return reduce(DataFrame.unionByName, parts)


def most_places(rows: DataFrame, keys: Sequence[str], text_col: str, analyzer: str = "simple") -> DataFrame:
    """(term, keys, most) of texts without their postings and without a shuffle: the most places that a row of these keys has.

    They come in runs as postings() do, so keys may have several rows of a term, of which the greatest counts.
    """

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _parts(batch):
                yield from _most(some)

    return _with_words(rows, keys, F.col(text_col), analyzer).mapInArrow(most, f"term string, {_kinds(rows, keys)}most int")


def term_statistics(rows: DataFrame, text_col: str, analyzer: str = "simple") -> DataFrame:
    """(term, docs, places): each row gives a term once, and sums are partial before the shuffle."""
    runs = _runs(rows, [], analyzed(F.col(text_col), analyzer))
    each = runs.select(F.get("sorted_terms", F.col("span.low"))["term"].alias("term"), (F.col("span.high") - F.col("span.low")).alias("n"))
    return each.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("places"))


def postings_search(posted: DataFrame, words: DataFrame, id_col: str, k: int) -> DataFrame:
    """Best k of each query by terms, then weight times places.  words: (query_id, term), the queries' few words."""
    hits = posted.join(F.broadcast(words), "term").groupBy("query_id", id_col).agg(F.count_distinct("term").alias("terms"), F.sum(F.size("positions") * F.col("weight")).alias("density"))
    order = Window.partitionBy("query_id").orderBy(F.desc("terms"), F.desc("density"), F.asc(id_col))
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def satisfies(terms: Sequence[str], query: Query) -> bool:
    """matches() of one list of terms."""

    def has(phrase: Phrase) -> bool:
        n = len(phrase.words)
        return any(all(not w or terms[i + j] == w for j, w in enumerate(phrase.words)) for i in range(len(terms) - n + 1))

    return any(all(has(p) != p.negated for p in g) for g in query.anyof)


def stretches(hits: Sequence[tuple[int, frozenset[str] | set[str]]], length: int, fragments: int = 2, most: int = 32, least: int = 12) -> list[tuple[int, int]]:
    """The best `fragments` stretches of at most `most` words, as (start, stop), in order; none overlap.

    hits: place and terms of each word that matches, in order.  The stretch with most different terms is taken, of equal ones that
    with most hits, then the first; then the best of what is left beside it.  A stretch begins and ends with a hit, and is then
    widened to `least` words where there is room.
    """
    free, out = [(0, length)], []
    while len(out) < fragments:
        best: tuple[int, int, int, int] | None = None
        for low, high in free:
            inside = [h for h in hits if low <= h[0] < high]
            counts: dict[str, int] = {}
            stop = 0
            for k, (start, terms) in enumerate(inside):
                while stop < len(inside) and inside[stop][0] < start + most:
                    for t in inside[stop][1]:
                        counts[t] = counts.get(t, 0) + 1
                    stop += 1
                if best is None or (len(counts), stop - k) > best[:2]:
                    best = (len(counts), stop - k, start, inside[stop - 1][0] + 1)
                for t in terms:
                    counts[t] -= 1
                    if not counts[t]:
                        del counts[t]
        if best is None:
            break
        start, stop = best[2:]
        low, high = next(f for f in free if f[0] <= start < f[1])
        missing = max(0, least - (stop - start))
        start = max(low, start - missing // 2)
        stop = min(high, max(stop, start + least))
        start = max(low, min(start, stop - least))
        out.append((start, stop))
        free = sorted([f for f in free if f != (low, high)] + [f for f in ((low, start), (stop, high)) if f[0] < f[1]])
    return sorted(out)


def snippet(text: str, words: set[str], analyzer: str = "simple", fragments: int = 2, most: int = 32, least: int = 12) -> str:
    """The best stretches, in which matching words are marked **so**."""
    tokens = text.split()
    found = {i: terms for i, t in enumerate(tokens) if (terms := set(analyze(t, analyzer)) & words)}
    spans = stretches(list(found.items()), len(tokens), fragments, most, least) or [(0, min(len(tokens), least))]
    return " … ".join(" ".join(f"**{tokens[i]}**" if i in found else tokens[i] for i in range(a, b)) for a, b in spans)


def snippets(text: Column, words: Sequence[str], analyzer: str = "simple") -> Column:
    """snippet() for the few rows that are shown."""
    wanted = set(words)

    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if t is None else snippet(t, wanted, analyzer))

    return cut(text)

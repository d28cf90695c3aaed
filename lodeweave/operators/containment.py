"""Set-containment join: pairs of sets of which the smaller lies nearly within the other.

Equal sets are one class.  A set of n words, of which at least o must be in another of its size or larger, shares at least
NEEDED of any n - o + NEEDED of its words with it.  Its rarest words are taken; as any choice of words gives all pairs, what
counts as rare decides on time alone, so words are counted by FREQUENT hashed slots.  The sets of a group are dealt to parts, and the
sets of a part meet those of another within one task: by the chosen words first, and those that share enough of them word by word.
So the task passes on the pairs alone, and neither words nor candidates are shuffled.  Sets are sent once for each part that they meet,
the OFTEN most frequent words as short numbers.  Words are known by 64 bits, by a hash that was seen to differ for all words there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a pair must share among the chosen ones, where it must share so many at all; slots by which frequent words are told from
#: others; words with a number of 16 bits.
NEEDED, FREQUENT, OFTEN = 10, 1 << 20, 1 << 15
#: Words of the sets that are met in one task, and of those that meet them.  Less is in a task until all make PARTS of them.
MET_WORDS, CHOSEN_WORDS, LEAST_WORDS, PARTS = 12_000_000, 64_000_000, 1_000_000, 24
#: Words, and places of words, that are looked at together.
_RUN = 1 << 22


def _least(n: object, share: float) -> object:
    return (F.floor(n * F.lit(float(share)) + 1e-9) + 1).cast("int")  # type: ignore[operator]


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values, and how many each list has."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)


def _word_counts(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words each slot has; the most frequent words, in order, and how often they are there.  FREQUENT + OFTEN numbers are all that comes to the driver."""
    words = sets.select(F.explode("codes").alias("code")).groupBy(F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n")).persist()
    found = words.groupBy(F.pmod("code", F.lit(FREQUENT)).alias("slot")).agg(F.sum("n").alias("n")).toArrow()
    most = np.iinfo(np.int32).max
    slots = np.zeros(FREQUENT, np.int32)
    slots[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), most)
    often = words.orderBy(F.desc("n"), "code").limit(OFTEN).orderBy("code").toArrow()
    words.unpersist()
    return slots, often.column("code").to_numpy(), np.minimum(often.column("n").to_numpy(), most)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Sets:
    """Some sets' words as numbers, each set's rarest first: frequent ones by their own number, others by their place among `known`; -1 is none of these."""

    def __init__(self, rare: pa.ListArray, often: pa.ListArray, known: np.ndarray | None = None) -> None:
        codes, of_rare = _flat(rare)
        numbers, of_often = _flat(often)
        if known is None:
            self.known, at = np.unique(codes, return_inverse=True)
        else:
            self.known, at = known, np.searchsorted(known, codes)
            at = np.where(np.append(known, 0)[at] == codes, at, -1 - OFTEN) if len(known) else np.full(len(codes), -1 - OFTEN)
            at[at == len(known)] = -1 - OFTEN  # above all that are known
        self.sizes = of_rare + of_often
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.empty(self.ends[-1], np.int32)
        self.words[np.repeat(self.ends[:-1], of_rare) + _within(of_rare)] = at + OFTEN
        self.words[np.repeat(self.ends[:-1] + of_rare, of_often) + _within(of_often)] = numbers


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of parts whose sizes make `most` together, or of one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _having(places: list[np.ndarray], total: int, needed: int, wide: int) -> np.ndarray:
    """The numbers below `wide` that are there `needed` times or more, in order."""
    if total * 8 < wide:
        all_ = np.sort(np.concatenate(places))
        return np.unique(all_[: len(all_) - needed + 1][all_[needed - 1 :] == all_[: len(all_) - needed + 1]]) if total >= needed else all_[:0]
    counts = np.zeros(wide, np.int64)
    for at, to in _runs(np.array([len(p) for p in places]), _RUN):
        counts += np.bincount(np.concatenate(places[at:to]), minlength=wide)
    return np.flatnonzero(counts >= needed)


def _group_pairs(table: pa.Table, left: np.ndarray, right: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left row, right row, words in common) of pairs of a group."""
    rows = lambda c, of: table.column(c).take(pa.array(of))
    met = _Sets(rows("rare", right), rows("often", right))
    n, needed, many = (table.column(c).to_numpy() for c in ("n", "needed", "many"))
    order = np.argsort(met.words)
    owner = np.repeat(np.arange(len(right), dtype=np.int32), met.sizes)[order]
    del order
    first = np.concatenate([[0], np.cumsum(np.bincount(met.words, minlength=OFTEN + len(met.known)))])
    mark, ny = np.zeros(OFTEN + len(met.known), np.int32), n[right]
    for low, high in _runs(n[left], _RUN):
        some = left[low:high]
        own = _Sets(rows("rare", some), rows("often", some), met.known)
        for k, row in enumerate(some.tolist()):
            words = own.words[own.ends[k] : own.ends[k + 1]]
            chosen = words[: many[row]]
            chosen = chosen[chosen >= 0]
            begin, end = first[chosen], first[chosen + 1]
            places = [owner[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            total = int((end - begin).sum())
            if total < needed[row]:
                continue
            found = _having(places, total, int(needed[row]), len(right))
            found = found[(ny[found] >= n[row]) & (right[found] != row)]
            if not len(found):
                continue
            there = words[words >= 0]
            mark[there] = 1
            for a, b in _runs(met.sizes[found], _RUN):
                part = found[a:b]
                sizes = met.sizes[part]
                shared = np.add.reduceat(mark[met.words[np.repeat(met.ends[part], sizes) + _within(sizes)]], np.cumsum(sizes) - sizes)
                fine = shared / n[row] > share
                yield np.full(int(fine.sum()), row), right[part[fine]], shared[fine]
            mark[there] = 0


def _met(share: float) -> Callable[[pa.Table], pa.Table]:
    def met(table: pa.Table) -> pa.Table:
        """Pairs of a left set and a right one of its group, not smaller, that has enough of its words.  A pair of one size may come from both sides."""
        table = table.combine_chunks()
        group = table.column("grp").combine_chunks()
        group = (pa.concat_arrays(group.chunks) if isinstance(group, pa.ChunkedArray) else group).dictionary_encode("encode").indices.to_numpy()
        order = np.argsort(group, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]])
        left, right = (table.column(c).to_numpy().astype(bool) for c in ("is_left", "is_right"))
        out = [(np.zeros(0, np.int64),) * 3]
        for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
            rows = order[cuts[k] : cuts[k + 1]]
            if left[rows].any() and right[rows].any():
                out += _group_pairs(table, rows[left[rows]], rows[right[rows]], share)
        x, y, shared = (np.concatenate(c) for c in zip(*out, strict=True))
        ids, n = table.column("id"), table.column("n").to_numpy()
        return pa.table({"x": ids.take(pa.array(x)), "nx": pa.array(n[x], pa.int32()), "y": ids.take(pa.array(y)), "ny": pa.array(n[y], pa.int32()), "shared": pa.array(shared, pa.int32())})

    return met


def _candidates(sets: DataFrame, share: float) -> DataFrame:
    """(x, nx, y, shared) of classes of one group that are a pair, once each.  sets: id, grp, n, codes of classes; a code is one word's."""
    counts = sets.sparkSession.sparkContext.broadcast(_word_counts(sets))

    @F.arrow_udf("struct<rare:array<bigint>,often:array<smallint>>")
    def coded(codes: pa.Array) -> pa.Array:
        slots, often, times = counts.value
        flat, sizes = _flat(codes)
        flat = flat.astype(np.int64)
        at = np.minimum(np.searchsorted(often, flat), max(0, len(often) - 1))
        is_often = often[at] == flat if len(often) else np.zeros(len(flat), bool)
        weight = np.where(is_often, (1 << 31) + (times[at] if len(often) else 0), slots[flat % len(slots)])
        order = np.argsort(np.repeat(np.arange(len(sizes)), sizes) << 33 | weight)
        flat, at, is_often = flat[order], at[order], is_often[order]
        of = np.repeat(np.arange(len(sizes)), sizes)
        per = lambda those: np.bincount(of[those], minlength=len(sizes))
        return pa.StructArray.from_arrays([_lists(flat[~is_often], per(~is_often), pa.int64()), _lists(at[is_often].astype(np.int16), per(is_often), pa.int16())], ["rare", "often"])

    least, group = _least(F.col("n"), share), F.xxhash64(F.col("grp").isNull(), "grp")
    keyed = sets.withColumns({"code": group, "needed": F.least(F.lit(NEEDED), least)}).withColumn("many", F.col("n") - least + F.col("needed"))
    by_group = keyed.groupBy("code").agg(F.sum("n").alias("words"))
    total = by_group.agg(F.sum("words")).first()[0] or 0
    met_words = min(MET_WORDS, max(LEAST_WORDS, total // PARTS))
    large = by_group.where(F.col("words") > met_words)  # fewer than there are parts; the others share parts
    placed = keyed.join(F.broadcast(large), "code", "left")
    part = F.when(F.col("words").isNull(), F.pmod("code", F.lit(total // met_words + 1))).otherwise(F.col("code"))
    parts = lambda size: F.ceil(F.coalesce("words", F.lit(1)) / size).cast("long")
    dealt = placed.withColumns({"part": part, "met_parts": parts(met_words), "chosen_parts": parts(CHOSEN_WORDS), "draw": F.xxhash64("id"), "coded": coded("codes")})
    dealt = dealt.withColumns({"own_i": F.pmod("draw", "chosen_parts"), "own_j": F.pmod(F.shiftright("draw", 20), "met_parts")})
    every = lambda many: F.sequence(F.lit(0).cast("long"), F.col(many) - 1)
    tiles = F.array_union(F.transform(every("met_parts"), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j"))), F.transform(every("chosen_parts"), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j"))))
    sent = dealt.select("part", F.explode(tiles).alias("tile"), "own_i", "own_j", "id", "grp", "n", "needed", "many", "coded.rare", "coded.often")
    sent = sent.select("part", "tile.i", "tile.j", "id", "grp", "n", "needed", "many", "rare", "often", (F.col("tile.i") == F.col("own_i")).alias("is_left"), (F.col("tile.j") == F.col("own_j")).alias("is_right"))
    kind = sets.schema["id"].dataType.simpleString()
    met = sent.groupBy("part", "i", "j").applyInArrow(_met(share), f"x {kind}, nx int, y {kind}, ny int, shared int")
    return met.where((F.col("x") != F.col("y")) & ((F.col("nx") < F.col("ny")) | (F.col("x") < F.col("y")))).select("x", "nx", "y", "shared")


def _hashed(word: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), word) if salt else F.xxhash64(word)


def _codes(sets: DataFrame) -> Column:
    """Numbers for `ws` that differ for all words of sets."""
    words = sets.select(F.explode("ws").alias("w")).distinct()
    salt = next(s for s in count() if words.groupBy(_hashed(F.col("w"), s)).count().where("count > 1").isEmpty())
    return F.transform("ws", lambda w: _hashed(w, salt))


def contained_pairs(rows: DataFrame, id_col: str, words_col: str, group_col: str, share: float, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, share), a < b, of classes of one group whose common words are more than `share` of the smaller set; (id, class) of every row with a word.

    A class is named by its least id.  Ids must be unique and not null; a null group is a group of its own.  rows are read several
    times, unless there is a shared folder to which their sets are written once.
    """
    cut = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.sort_array(F.array_distinct(words_col)).alias("ws")).where("size(ws) > 0 AND id IS NOT NULL")
    sets = cut.withColumns({"n": F.size("ws"), "key": F.unhex(F.sha2(F.concat_ws(" ", "ws"), 256))})
    if folder:
        sets.write.option("compression", "zstd").parquet(folder)
        sets = rows.sparkSession.read.schema(sets.schema).parquet(folder)
    keyed = sets.select("id", "grp", "key")
    classes = keyed.groupBy("grp", "key").agg(F.min("id").alias("class"))
    members = keyed.join(classes.withColumnsRenamed({"grp": "g", "key": "k"}), F.col("grp").eqNullSafe(F.col("g")) & (F.col("key") == F.col("k"))).select(F.col("id").alias(id_col), "class")
    found = _candidates(sets.select("id", "grp", "n", _codes(sets).alias("codes")).join(classes.select("class"), F.col("id") == F.col("class"), "left_semi"), share)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("shared") / F.col("nx")).alias("share")), members

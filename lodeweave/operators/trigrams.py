"""An index of trigrams that narrows a search by regular expression to the files that can match.

The index has rows for each trigram and block of ids, with the ids of the files that have it; letters A-Z are made small.
They are made in each task for as many files as give PAIRS of both, so nothing is shuffled; where files lie in the order of
their ids, a block has few rows of a trigram.
A pattern is turned to a condition on trigrams, which every text that it matches satisfies: all trigrams of what stands in a
row, any of the alternatives.  Where nothing can be said, as for patterns that are too short or have syntax that isn't
looked at here, the condition is None and the files are scanned.
"""

from __future__ import annotations

import re
import string
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a block.
BLOCK = 4_096
#: Strings that a place in a pattern may stand for, and a run of places, before the run is cut.
CHOICES, STRINGS = 4, 16
#: Pairs of a trigram and a file that a task holds, and rows that it gives back together.
PAIRS, _ROWS = 2_000_000, 50_000
_SMALL = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Letters that may follow a backslash; with all others the syntaxes of Java and Python differ, or nothing is known.
_ESCAPES = frozenset("dDwWsSbBAntrf")


def trigrams_of(text: str) -> set[str]:
    small = text.translate(_SMALL)
    return {small[i : i + 3] for i in range(len(small) - 2)}


def _codes(text: str) -> np.ndarray:
    """trigrams_of() as numbers of three code points, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points[(points >= ord("A")) & (points <= ord("Z"))] += 32
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]) if len(points) > 2 else np.zeros(0, np.int64)


def _grouped(codes: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(gram, block, ids) of pairs, in order."""
    order = np.lexsort((ids, codes))
    codes, ids = codes[order], ids[order]
    blocks = ids // BLOCK
    starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])]))
    ends = np.append(starts[1:], len(ids))
    for at in range(0, len(starts), _ROWS):
        low, high = starts[at : at + _ROWS], ends[at : at + _ROWS]
        code = codes[low]
        letters = np.stack([code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        grams = pa.array([letters[k : k + 3] for k in range(0, len(letters), 3)], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(low, high[-1]) - low[0], pa.int32()), pa.array(ids[low[0] : high[-1]], pa.int64()))
        yield pa.RecordBatch.from_arrays([grams, pa.array(blocks[low], pa.int64()), lists], ["gram", "block", "ids"])


def index(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gram, block, ids) of texts, without a shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, n = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                own = _codes(text.as_py() or "")
                codes.append(own)
                ids.append(np.full(len(own), i.as_py(), np.int64))
                n += len(own)
                if n >= PAIRS:
                    yield from _grouped(np.concatenate(codes), np.concatenate(ids))
                    codes, ids, n = [], [], 0
        if n:
            yield from _grouped(np.concatenate(codes), np.concatenate(ids))

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(made, "gram string, block long, ids array<long>")


@dataclass(frozen=True)
class Condition:
    """All of the parts, or any; a part is a trigram or a condition."""

    every: bool
    parts: tuple[str | Condition, ...]

    def grams(self) -> set[str]:
        return set().union(*({p} if isinstance(p, str) else p.grams() for p in self.parts)) if self.parts else set()

    def of(self, there: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b if self.every else a | b, [there[p] if isinstance(p, str) else p.of(there) for p in self.parts])

    def holds(self, grams: set[str]) -> bool:
        return (all if self.every else any)(p in grams if isinstance(p, str) else p.holds(grams) for p in self.parts)


def _joined(every: bool, parts: Sequence[str | Condition | None]) -> Condition | None:
    """None stands for what always holds."""
    if not every and (None in parts or not parts):
        return None
    some = tuple(dict.fromkeys(p for p in parts if p is not None))
    return Condition(every, some) if some else None


def _of_strings(strings: set[str]) -> Condition | None:
    return _joined(False, [_joined(True, sorted(trigrams_of(s))) for s in sorted(strings)])


class _Reader:
    """Walks a parsed pattern."""

    def __init__(self) -> None:
        self.found: list[Condition | None] = []
        self.run: set[str] = {""}

    def cut(self) -> None:
        self.found.append(_of_strings(self.run))
        self.run = {""}

    def add(self, choices: set[str]) -> None:
        longer = {a + b for a, b in product(self.run, choices)}
        if len(longer) > STRINGS:
            self.cut()
            longer = choices
        self.run = longer

    def items(self, parsed: Sequence) -> None:
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                self.add({chr(value).translate(_SMALL)})
            elif name == "IN" and (chars := _members(value)):
                self.add(chars)
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                self.items(value[3])
            elif name == "BRANCH":
                self.cut()
                self.found.append(_joined(False, [_condition(x) for x in value[1]]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, what = value
                if least == most == 1:
                    self.items(what)
                    continue
                self.cut()
                if least:
                    self.found.append(_condition(what))
            elif name == "AT":  # no character stands there
                continue
            else:
                self.cut()


def _members(value: Sequence) -> set[str]:
    """The characters of a class of few, else nothing."""
    out: set[str] = set()
    for op, x in value:
        if str(op) == "LITERAL":
            out.add(chr(x).translate(_SMALL))
        elif str(op) == "RANGE" and x[1] - x[0] < CHOICES:
            out |= {chr(c).translate(_SMALL) for c in range(x[0], x[1] + 1)}
        else:
            return set()
    return out if len(out) <= CHOICES else set()


def _condition(parsed: Sequence) -> Condition | None:
    reader = _Reader()
    reader.items(parsed)
    reader.cut()
    return _joined(True, reader.found)


def condition_of(pattern: str) -> Condition | None:
    """What the trigrams of every text that a Java pattern matches satisfy; None if nothing is known."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if flags and not set(flags[1]) <= set("ims"):
        return None
    own = pattern[flags.end() :] if flags else pattern
    if re.search(r"\(\?[^:=!]|\[[^\]]*(\[|&&)|\(\?<", own) or any(x.isalnum() and x not in _ESCAPES for x in re.findall(r"\\(.)", own, re.DOTALL)):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return _condition(list(re._parser.parse(own)))  # type: ignore[attr-defined]
    except (re.error, Warning, OverflowError, RecursionError):
        return None


def candidates(grams: DataFrame, condition: Condition, after: int = -1) -> DataFrame:
    """(id) of files after an id whose trigrams satisfy the condition; only its trigrams' rows are read."""
    names = {g: f"g_{i}" for i, g in enumerate(sorted(condition.grams()))}
    read = grams.where(F.col("gram").isin(*names) & (F.col("block") >= (after + 1) // BLOCK))
    each = read.select("gram", F.explode("ids").alias("id")).where(F.col("id") > after)
    has = each.groupBy("id").agg(*[F.max(F.when(F.col("gram") == g, True).otherwise(False)).alias(n) for g, n in names.items()])
    return has.where(condition.of({g: F.col(n) for g, n in names.items()})).select("id")

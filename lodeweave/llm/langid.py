"""Language identification by hierarchical discrimination.

One-versus-rest linear support vector machines choose a language family; within it, one-versus-one machines vote for a
language.  Features are frequencies of byte pairs and hashed byte triples of the case-folded text with everything but
letters as spaces, so a margin is a mean of weights over the whole text.

Training takes at most PER_LANGUAGE documents of each language, and TRAINING_ROWS in all but for one of each language,
chosen by the hash of their id and text, from the folds that aren't held out.  Every language is learned; one that no
family lists is a family, with a machine of 512 kB.

Defined cases: a null text or one without a letter is `und` with score 0, as is everything if nothing can be learned; a
null id is neither trained on nor held out; rows with equal texts get equal results; ties between languages go to the
first in byte order; an empty table gives no rows.  Only the id, text and label columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.shared import fold

PER_LANGUAGE = 300
TRAINING_ROWS = 6_000
FOLDS = 5
UNKNOWN = "und"

# Languages of each family.  Any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en is nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "semitic": "ar he mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_PAIRS, _TRIPLES = 1 << 16, 1 << 16
SIZE = _PAIRS + _TRIPLES
_SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTER = re.compile(rb"[a-z]")


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def grams(text: str | None) -> np.ndarray | None:
    """The feature at each place of the text; None if it has no letter."""
    if not text:
        return None
    low = text.lower()
    data = low.encode("utf-8", "replace").translate(_SPACED)
    if not _ASCII_LETTER.search(data) and not any(c.isalpha() for c in low):
        return None
    b = np.frombuffer(b" " + data + b"  ", np.uint8).astype(np.uint32)
    pairs = (b[:-2] << 8) | b[1:-1]
    triples = (((pairs << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    fine = pairs != 0x2020
    return np.concatenate([pairs[fine], triples[fine] + np.uint32(_PAIRS)])


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int = SIZE, cost: float = 10.0, epochs: int = 15) -> np.ndarray:
    """Weights of an L2-regularised hinge-loss machine without bias, by dual coordinate descent.  y: -1 or 1."""
    w, alpha = np.zeros(size), np.zeros(len(y))
    norms = np.array([max(float(v @ v), 1e-12) for _, v in rows])
    order, rng = np.arange(len(y)), np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            index, value = rows[i]
            new = min(max(alpha[i] + (1 - y[i] * float(w[index] @ value)) / norms[i], 0.0), cost)
            if new != alpha[i]:
                w[index] += (new - alpha[i]) * y[i] * value
                alpha[i] = new
    return w


@dataclass
class LanguageModel:
    """Machines of families, and of pairs of languages within each; weights have the features' scale in them."""

    families: list[str]
    members: dict[str, list[str]]
    of_family: dict[str, np.ndarray]
    of_pair: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        at = grams(text)
        if at is None or not self.families:
            return UNKNOWN, 0.0
        name, sure = self.families[0], 1.0
        if len(self.families) > 1:
            margins = np.array([float(self.of_family[f][at].mean()) for f in self.families])
            odds = np.exp(3 * (margins - margins.max()))
            name, sure = self.families[int(np.argmax(margins))], float(odds.max() / odds.sum())
        langs = self.members[name]
        votes, sums = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            margin = float(self.of_pair[a, b][at].mean())
            votes[a if margin >= 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
        best = max(langs, key=lambda x: (votes[x], sums[x]))
        odds = np.exp([3 * (sums[x] - sums[best]) for x in langs])
        return best, sure * min(1.0, float(1 / odds.sum()))


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from at most per_language texts a language, of those whose fold isn't 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("id"), folds) != 0))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel([], {}, {}, {})
    per_language = max(1, min(per_language, TRAINING_ROWS // len(counts)))
    space = 1 << 30
    bounds = docs.sparkSession.createDataFrame([(r["lang"], min(space, 1 + 2 * space * per_language // r["count"])) for r in counts], "lang string, bound long")
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(space))
    # the bound leaves some two times per_language rows of each language; the rank, limited in each task first, the rest
    near = known.withColumn("draw", draw).join(F.broadcast(bounds), "lang").where("draw < bound")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    drawn = near.withColumn("rank", rank).where(F.col("rank") <= per_language)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(at, return_counts=True) if (at := grams(t)) is not None else ([], []) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(i) for i, _ in found], pa.list_(pa.int32())), pa.array([list(n) for _, n in found], pa.list_(pa.int32()))], ["lang", "draw", "at", "n"])

    got = drawn.select("lang", "draw", "text").mapInArrow(counted, "lang string, draw long, at array<int>, n array<int>").toArrow()
    langs, draws = got.column("lang").to_pylist(), got.column("draw").to_pylist()
    taken: list[tuple[str, np.ndarray, np.ndarray]] = []
    used: dict[str, int] = {}
    hists = list(zip(got.column("at"), got.column("n"), strict=True))
    for i in sorted(range(len(langs)), key=lambda i: (langs[i], draws[i], len(hists[i][0]))):
        index, n = np.array(hists[i][0].values, np.int64), np.array(hists[i][1].values, float)
        if len(index) and used.get(langs[i], 0) < per_language:
            used[langs[i]] = used.get(langs[i], 0) + 1
            taken.append((langs[i], index, n / n.sum()))
    if not taken:
        return LanguageModel([], {}, {}, {})
    mean = np.zeros(SIZE)
    for _, index, share in taken:
        mean[index] += share / len(taken)
    scale = 1 / np.sqrt(mean + 1e-5)
    rows_ = [(index, share * scale[index]) for _, index, share in taken]
    unit = np.sqrt(np.mean([float(v @ v) for _, v in rows_]))
    rows_ = [(i, v / unit) for i, v in rows_]
    of = np.array([x for x, _, _ in taken], object)
    families = sorted({family(x) for x in used})
    members = {f: sorted(x for x in used if family(x) == f) for f in families}
    fams = np.array([family(x) for x in of], object)
    signed = lambda yes: np.where(yes, 1.0, -1.0)
    of_family = {f: (linear_svm(rows_, signed(fams == f)) * scale / unit).astype(np.float32) for f in families} if len(families) > 1 else {}
    of_pair = {}
    for f in families:
        for a, b in combinations(members[f], 2):
            some = np.flatnonzero((of == a) | (of == b))
            of_pair[a, b] = (linear_svm([rows_[i] for i in some], signed(of[some] == a)) * scale / unit).astype(np.float32)
    return LanguageModel(families, members, of_family, of_pair)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """The id, held_out, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a machine of 512 kB for each family and each pair within one

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(fold(F.col(id_col), folds) == 0, F.lit(False))
    return docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(predicted, f"{id_col} {kind}, held_out boolean, lang_pred string, score double")

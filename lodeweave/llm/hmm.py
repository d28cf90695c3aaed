"""A hidden Markov language model over word classes.

A token's probability is that of its class given the latent state, times that of the word within its class.  Classes
are hashed word ends, CLASSES of them, so what Baum-Welch trains has a fixed size: its expected counts are summed over
each partition and then across partitions.  The scaled forward recursion gives a text's exact likelihood.

Word counts have no bound, so they are never broadcast.  They are summed per task, dealt out by ranges of the word's
64-bit hash, and met there by the (document, word) pairs of blocks of documents; each range sends back one partial sum
a document.  Words over 1/HOT of all tokens, of which there are fewer than HOT, are scored where the text is.

Defined cases: a null text counts as empty, one end token; a null id is trained on never and isn't held out; rows with
equal ids or texts are scored each for itself; without training texts every base score is 0; an empty table gives no
rows.  Words with equal 64-bit hashes count as one.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.shared import as_bytes, checkpointed, fold, shuffle_width

STATES = 8
#: The last class is the end token's.
CLASSES = 4097
FOLDS, HELD_OUT = 7, 2
HOT = 20_000
#: Baum-Welch first passes over each of so many parts of the training texts, then so many times over all of them.
PARTS, ROUNDS = 8, 2
BLOCK_BYTES, BLOCK_DOCS = 4_000_000, 60_000
TRELLIS_TOKENS = 400_000
#: Distinct words that a task holds before it sends its counts on.
HELD_WORDS = 2_000_000
_LOWER = bytes(range(256)).lower()
_END = np.uint64(0x9E3779B97F4A7C15)
_ENTRY = np.dtype([("h", "<u8"), ("n", "<i8"), ("c", "<u2")])


def word_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % (CLASSES - 1)


@dataclass
class Block:
    """Some documents' tokens: indices into the block's distinct words, the end token last."""

    hashes: np.ndarray
    classes: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray


def block_of(texts: list[bytes]) -> Block:
    known: dict[bytes, int] = {}
    parts, lengths = [], []
    for text in texts:
        words = text.translate(_LOWER).split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        lengths.append(len(words) + 1)
    end = len(known)
    tokens = np.concatenate([x for p in parts for x in (p, [end])]) if parts else np.zeros(0, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, end)
    classes = np.fromiter(map(word_class, known), np.uint16, end)
    return Block(np.append(hashes, _END), np.append(classes, np.uint16(CLASSES - 1)), tokens.astype(np.int64), np.array(lengths, np.int64))


def blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with at most BLOCK_BYTES of text, or one row."""
    for batch in batches:
        texts = as_bytes(batch.column(text))
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and (size + len(t) > BLOCK_BYTES or i - start >= BLOCK_DOCS):
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def hash_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def merged(entries: np.ndarray) -> np.ndarray:
    """One entry a hash, by hash, counts summed."""
    if not len(entries):
        return entries
    entries = entries[np.argsort(entries["h"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], entries["h"][1:] != entries["h"][:-1]]))
    out = entries[first].copy()
    out["n"] = np.add.reduceat(entries["n"], first)
    return out


def word_counts(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (p, data): all words of a hash range with their counts and classes, by hash.  docs: text."""

    def split(entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        entries = merged(entries)
        p = hash_range(entries["h"], ranges)
        cuts = np.searchsorted(p, np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(cuts))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([entries[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())], ["p", "data"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, fresh = [], 0, 0
        for _, texts in blocks(batches, 0):
            b = block_of(texts)
            entries = np.zeros(len(b.hashes), _ENTRY)
            entries["h"], entries["c"] = b.hashes, b.classes
            entries["n"] = np.bincount(b.tokens, minlength=len(b.hashes))
            held.append(entries)
            fresh += len(entries)
            if fresh > max(500_000, n):
                held = [merged(np.concatenate(held))]
                n, fresh = len(held[0]), 0
                if n > HELD_WORDS:
                    yield from split(held[0])
                    held, n = [], 0
        if held:
            yield from split(np.concatenate(held))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != at and held:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([merged(np.concatenate(held)).tobytes()], pa.binary())], ["p", "data"])
                    held = []
                at = p
                held.append(np.frombuffer(data, _ENTRY))
                if len(held) > 64:
                    held = [merged(np.concatenate(held))]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([merged(np.concatenate(held)).tobytes()], pa.binary())], ["p", "data"])

    schema = "p int, data binary"
    dealt = docs.mapInArrow(counted, schema).repartitionById(ranges, F.col("p")).sortWithinPartitions("p")
    return dealt.mapInArrow(summed, schema)


def class_totals(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                e = np.frombuffer(data, _ENTRY)
                n += np.bincount(e["c"], e["n"].astype(float), CLASSES)
                v += np.bincount(e["c"], minlength=CLASSES)
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some].astype(np.int64)), pa.array(v[some].astype(np.int64))], ["c", "n", "v"])

    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.select("data").mapInArrow(totals, "c int, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r.c], v[r.c] = r.n, r.v
    return n, v


def hot_words(counts: DataFrame, tokens: int) -> np.ndarray:
    """Entries of words over 1/HOT of all tokens: fewer than HOT."""

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                e = np.frombuffer(data, _ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array([e[e["n"] * HOT > tokens].tobytes()], pa.binary())], ["data"])

    found = [np.frombuffer(r.data, _ENTRY) for r in counts.select("data").mapInArrow(hot, "data binary").where("length(data) > 0").collect()]
    return merged(np.concatenate(found)) if found else np.zeros(0, _ENTRY)


@dataclass
class HiddenMarkov:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (states, classes)

    @staticmethod
    def random(seed: int = 11) -> HiddenMarkov:
        rng = np.random.default_rng(seed)
        emit = rng.random((STATES, CLASSES)) + 0.5
        move = rng.random((STATES, STATES)) * 0.1 + np.eye(STATES)
        return HiddenMarkov(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


@dataclass
class Trellis:
    """Sequences side by side, the longest first: at step t the tokens of those that are that long."""

    order: np.ndarray
    obs: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def of(sequences: list[np.ndarray]) -> Trellis:
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        cuts = np.concatenate([[0], np.cumsum(active)])
        obs = np.zeros(int(cuts[-1]), np.int64)
        for rank, i in enumerate(order):
            obs[cuts[: lengths[i]] + rank] = sequences[i]
        return Trellis(order, obs, cuts)


def trellises(sequences: list[np.ndarray], most: int = TRELLIS_TOKENS) -> Iterator[tuple[np.ndarray, Trellis]]:
    """Sequences of like length together, at most so many tokens at once (or one sequence)."""
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    start = size = 0
    for k, i in enumerate(order):
        if k > start and size + len(sequences[i]) > most:
            yield np.array(order[start:k]), Trellis.of([sequences[j] for j in order[start:k]])
            start, size = k, 0
        size += len(sequences[i])
    if start < len(order):
        yield np.array(order[start:]), Trellis.of([sequences[j] for j in order[start:]])


def forward(model: HiddenMarkov, t: Trellis, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Natural-log likelihoods (in the trellis's own order); scaled alphas and scales if kept."""
    n = int(t.cuts[1]) if len(t.cuts) > 1 else 0
    likely = np.zeros(n)
    emit, states = np.ascontiguousarray(model.emit.T), len(model.start)
    alphas, scales = (np.empty((len(t.obs), states)), np.empty(len(t.obs))) if keep else (None, None)
    a = np.broadcast_to(model.start, (n, states))
    for k in range(len(t.cuts) - 1):
        low, high = t.cuts[k], t.cuts[k + 1]
        m = high - low
        a = (a[:m] if k == 0 else a[:m] @ model.move) * emit[t.obs[low:high]]
        s = a.sum(axis=1)
        a /= s[:, None]
        likely[:m] += np.log(s)
        if keep:
            alphas[low:high], scales[low:high] = a, s
    return likely, alphas, scales


@dataclass
class Expected:
    """Expected counts of Baum-Welch."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def none() -> Expected:
        return Expected(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES)))

    def add(self, model: HiddenMarkov, t: Trellis) -> None:
        _, alphas, scales = forward(model, t, keep=True)
        emit = np.ascontiguousarray(model.emit.T)
        ahead = np.zeros((0, STATES))
        for k in range(len(t.cuts) - 2, -1, -1):
            low, high = t.cuts[k], t.cuts[k + 1]
            beta = np.ones((high - low, STATES))
            m = len(ahead)
            if m:
                beta[:m] = ahead @ model.move.T
                self.move += model.move * (alphas[low : low + m].T @ ahead)
            alpha = alphas[low:high]
            ahead = emit[t.obs[low:high]] * beta / scales[low:high, None]
            alpha *= beta  # from here on the state's probability
        self.start += alphas[: t.cuts[1]].sum(axis=0)
        for s in range(STATES):
            self.emit[s] += np.bincount(t.obs, alphas[:, s], CLASSES)

    def model(self) -> HiddenMarkov:
        start, move, emit = self.start + 0.1, self.move + 0.1, self.emit + 0.01
        return HiddenMarkov(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def rows(self) -> list[bytes]:
        return [np.concatenate([self.start, self.move.ravel()]).tobytes(), *(e.tobytes() for e in self.emit)]


def class_sequences(texts: DataFrame) -> DataFrame:
    """(part, seq): the classes of each text's tokens.  texts: part, text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in blocks(batches, 1):
            b = block_of(data)
            parts = np.split(b.classes[b.tokens], np.cumsum(b.lengths)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "seq"])

    return texts.mapInArrow(made, "part int, seq binary")


def baum_welch(sequences: DataFrame, rounds: int = ROUNDS) -> HiddenMarkov:
    """A model from all sequences (part, seq): a round over each part, so that every text is seen once while the model is rough, then `rounds` over all.

    The expected counts of every round are summed in each partition and then across partitions.  A round without
    sequences leaves the model as it is.
    """
    model = HiddenMarkov.random()
    for part in range(PARTS):
        model = _pass(sequences.where(F.col("part") == part), model)
    for _ in range(rounds):
        model = _pass(sequences, model)
    return model


def _pass(sequences: DataFrame, model: HiddenMarkov) -> HiddenMarkov:
    """One round of Baum-Welch over all sequences."""
    spark = sequences.sparkSession
    shared = spark.sparkContext.broadcast(model)  # STATES x CLASSES numbers
    slots = 1 + STATES

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Expected.none()
        for batch in batches:
            size, held = 0, []
            for data in batch.column(0).to_pylist():
                held.append(np.frombuffer(data, np.uint16))
                size += len(held[-1])
                if size > 4 * TRELLIS_TOKENS:
                    for _, t in trellises(held):
                        total.add(shared.value, t)
                    size, held = 0, []
            for _, t in trellises(held):
                total.add(shared.value, t)
        if not total.start.any():
            return
        yield pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array(total.rows(), pa.binary())], ["slot", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data)
                sums[slot] = sums[slot] + x if slot in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slot", "data"])

    schema = "slot int, data binary"
    parts = sequences.select("seq").mapInArrow(expected, schema).repartition(shuffle_width(spark), "slot")
    got = {r.slot: np.frombuffer(r.data) for r in parts.mapInArrow(summed, schema).collect()}
    if not got or not got[0].any():
        return model
    return Expected(got[0][:STATES], got[0][STATES:].reshape(STATES, STATES), np.stack([got[1 + s] for s in range(STATES)])).model()


@dataclass
class Scorer:
    model: HiddenMarkov
    hot: np.ndarray
    #: log10 of each class's N + V + 1.
    class_log: np.ndarray
    ranges: int


_DOC = np.dtype([("held", "u1"), ("n", "<i8"), ("logs", "<f8"), ("known", "<i8"), ("rest", "<f8")])
_PAIR = np.dtype([("doc", "<u2"), ("tf", "<u4")])
_PART = np.dtype([("doc", "<u2"), ("logs", "<f8"), ("known", "<u4")])
_COUNTS, _DOCS, _PAIRS = 0, 1, 2


def _scored_block(b: Block, held: list[bool], s: Scorer) -> tuple[np.ndarray, dict[int, bytes]]:
    """What the block knows by itself, and for each hash range the pairs that need counts."""
    n = len(b.lengths)
    docs = np.zeros(n, _DOC)
    docs["held"] = held
    docs["n"] = b.lengths
    of = np.repeat(np.arange(n), b.lengths)
    bounds = np.cumsum(b.lengths)[:-1]
    sequences = np.split(b.classes[b.tokens], bounds)
    for which, t in trellises(sequences):
        docs["rest"][which[t.order]] = forward(s.model, t)[0] / np.log(10)
    docs["rest"] -= np.bincount(of, s.class_log[b.classes[b.tokens]], n)
    at = np.searchsorted(s.hot["h"], b.hashes)
    at[at == len(s.hot)] = 0
    count = np.where(s.hot["h"][at] == b.hashes, s.hot["n"][at], 0) if len(s.hot) else np.zeros(len(b.hashes), np.int64)
    docs["logs"] = np.bincount(of, np.log10(count + 1.0)[b.tokens], n)
    docs["known"] = np.bincount(of, (count > 0)[b.tokens], n)
    rare = np.flatnonzero(count == 0)
    rank = np.full(len(b.hashes), -1)
    rare = rare[np.argsort(b.hashes[rare])]
    rank[rare] = np.arange(len(rare))
    word = rank[b.tokens]
    pairs, tf = np.unique((word * n + of)[word >= 0], return_counts=True)
    word, doc = pairs // max(n, 1), pairs % max(n, 1)
    per_word = np.bincount(word, minlength=len(rare)).astype(np.uint32)
    packed = np.zeros(len(pairs), _PAIR)
    packed["doc"], packed["tf"] = doc, tf
    cuts = np.searchsorted(hash_range(b.hashes[rare], s.ranges), np.arange(s.ranges + 1))
    ends = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])
    out = {}
    for p in np.flatnonzero(np.diff(cuts)):
        low, high = cuts[p], cuts[p + 1]
        out[int(p)] = np.int64(high - low).tobytes() + b.hashes[rare[low:high]].tobytes() + per_word[low:high].tobytes() + packed[ends[low] : ends[high]].tobytes()
    return docs, out


def _met(data: bytes, counts: np.ndarray) -> bytes:
    """Partial sums by document of one block's pairs in one hash range."""
    m = int(np.frombuffer(data, np.int64, 1)[0])
    hashes = np.frombuffer(data, np.uint64, m, 8)
    per_word = np.frombuffer(data, np.uint32, m, 8 + 8 * m)
    pairs = np.frombuffer(data, _PAIR, offset=8 + 12 * m)
    at = np.searchsorted(counts["h"], hashes)
    at[at == len(counts)] = 0
    count = np.where(counts["h"][at] == hashes, counts["n"][at], 0) if len(counts) else np.zeros(m, np.int64)
    each = np.repeat(count, per_word)
    known = np.bincount(pairs["doc"], pairs["tf"] * (each > 0))
    logs = np.bincount(pairs["doc"], pairs["tf"] * np.log10(each + 1.0))
    some = np.flatnonzero(known)
    out = np.zeros(len(some), _PART)
    out["doc"], out["logs"], out["known"] = some, logs[some], known[some]
    return out.tobytes()


def packed_column(column: pa.Array) -> bytes:
    """A column of any type as bytes."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], ["x"])
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_column(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_next_batch().column(0)


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """The id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    width = ranges = shuffle_width(spark)
    rest = fold(F.col(id_col), folds)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(rest == held_out, F.lit(False)).alias("held"), F.coalesce(rest != held_out, F.lit(False)).alias("trained"))
    trained = rows.where("trained").select(F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part"), "text")
    counts = checkpointed(word_counts(trained.select("text"), ranges))
    class_n, class_v = class_totals(counts)
    tokens, words = int(class_n.sum()), int(class_v.sum())
    model = baum_welch(checkpointed(class_sequences(trained), by="part"))
    shared = spark.sparkContext.broadcast(Scorer(model, hot_words(counts, tokens), np.log10(class_n + class_v + 1.0), ranges))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (batch, texts) in enumerate(blocks(batches, 1)):
            number = task << 32 | k
            known, pairs = _scored_block(block_of(texts), batch.column(2).to_pylist(), shared.value)
            rows = [((task + k) % ranges, _DOCS, np.int64(known.nbytes).tobytes() + known.tobytes() + packed_column(batch.column(0))), *((p, _PAIRS, data) for p, data in pairs.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, entries = None, np.zeros(0, _ENTRY)
        for batch in batches:
            out = []
            for p, kind, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != at:
                    at, entries = p, np.zeros(0, _ENTRY)
                if kind == _COUNTS:
                    entries = np.frombuffer(data, _ENTRY)
                elif kind == _DOCS:
                    out.append((-1, kind, block, data))
                else:
                    out.append((p, kind, block, _met(data, entries)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary())], names)

    kind_of = docs.schema[id_col].dataType.simpleString()
    out_names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    total_log = float(np.log10(tokens + words + 1))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids = None, np.zeros(0, _DOC), None

        def rows(d: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(d["held"].astype(bool)), pa.array(d["n"]), pa.array(d["known"]), pa.array(np.full(len(d), tokens, np.int64)), pa.array(d["logs"] - d["n"] * total_log), pa.array(d["logs"] + d["rest"])], out_names)

        for batch in batches:
            for _, kind, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at and at is not None:
                    yield rows(held, ids)
                at = block
                if kind == _DOCS:
                    size = 8 + int(np.frombuffer(data, np.int64, 1)[0])
                    held, ids = np.frombuffer(data[8:size], _DOC).copy(), unpacked_column(data[size:])
                else:
                    part = np.frombuffer(data, _PART)
                    held["logs"][part["doc"]] += part["logs"]
                    held["known"][part["doc"]] += part["known"]
        if at is not None:
            yield rows(held, ids)

    names = ["p", "kind", "block", "data"]
    schema = "p int, kind int, block long, data binary"
    asked = rows.select("id", "text", "held").mapInArrow(scored, schema)
    told = counts.select("p", F.lit(_COUNTS).alias("kind"), F.lit(0).cast("long").alias("block"), "data")
    parts = told.union(asked).repartitionById(width, F.col("p")).sortWithinPartitions("p", "kind").mapInArrow(met, schema)
    whole = parts.repartition(width, "block").sortWithinPartitions("block", "kind", "p").mapInArrow(summed, f"id {kind_of}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return whole.withColumnRenamed("id", id_col)

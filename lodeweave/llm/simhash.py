"""SimHash near-duplicates by multi-index hashing.

Equal fingerprints are joined first, so copies cost one row.  Each distinct fingerprint is cut into segments.  By the
pigeonhole principle two fingerprints within the radius agree in some segment up to that segment's small radius, so
each fingerprint enters the table of a segment under its own value and probes it under every value of the small Hamming
ball around that.  Matches are verified by their complete distance.  Links within a bucket come out as a spanning
forest, never as all pairs; a bucket with more fingerprints than `hot` is dealt over several tasks, each with all its
table entries and a part of the probes.  Components then come from rounds of joins and minima (large star, small star).

A wide fingerprint has a second half of other hashes.  Two that differ in at most 25 bits of the two halves differ in at
most 12 of one of them, so each half is searched within 12, in segments of its own, and matches are verified by the
distance of both: every pair that agrees in 0.8 of 128 bits is found.

Defined cases: a null or wordless text has fingerprint zero, which links like any other; rows with equal ids are one
document; a row with a null id has a fingerprint and, if an id has the same fingerprint, that one's component, else a
null component; it never links others.  Ties don't matter, as links are an undirected graph.  An empty table gives no
rows.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.shared import as_bytes, checkpointed, shuffle_width

BITS = 64
SEED = 42
#: Table entries from which a bucket is dealt over several tasks.
HOT = 50_000
#: Links that a task gathers before it makes stars of them.
KEPT_LINKS = 500_000
#: Seconds that a probe takes through its shuffle, and a comparison.
PROBE_S, COMPARE_S = 2e-6, 3e-9
_LOWER = bytes(range(256)).lower()
_KEY_BITS = 40


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text; repeats count."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(tokens) - words + 1)


def second_hashes(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for the second half of a wide fingerprint."""
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes, words: int = 4) -> int:
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if over half of the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """id, fp and fp2: the fingerprint, and the second half of a wide one (else 0), as signed longs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in as_bytes(batch.column(1))]
            fps = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            more = np.array([fingerprint_of(second_hashes(h)) for h in hashes], np.uint64).view(np.int64) if wide else np.zeros(len(fps), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array(more)], ["id", "fp", "fp2"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(made, f"id {kind}, fp long, fp2 long")


def segment_plan(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """Shift, width and small radius of each segment that is probed."""
    small, more = divmod(radius, segments)
    plan, shift = [], 0
    for k in range(segments):
        width = BITS // segments + (k < BITS % segments)
        within = small if k <= more else small - 1
        if within >= 0:
            plan.append((shift, width, within))
        shift += width
    return plan


def ball(width: int, radius: int) -> list[int]:
    """What the values within a radius differ by, the nearest first."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def cheapest_segments(radius: int, n: int) -> int:
    """How many segments cost least for n fingerprints; any number finds every link.

    Few segments are wide and have large balls: many probes.  Many are narrow: many comparisons, which grow as n squared.
    """

    def cost(segments: int) -> float:
        balls = [(width, len(ball(width, within))) for _, width, within in segment_plan(radius, segments)]
        return n * sum(size * (PROBE_S + n / (1 << width) * COMPARE_S) for width, size in balls)

    return min((m for m in range(2, min(radius, 8) + 1) if radius // m <= 3), key=cost, default=1)


#: The half, shift, width and small radius of each segment that is probed.
Plan = list[tuple[str, int, int, int]]


def halves_plan(radius: int, both: int | None, segments: int) -> Plan:
    """The segments that find every pair within the reach.  What differs in over half of `both` in the first half doesn't in the second."""
    halves = [("fp", radius)] if both is None or radius <= both // 2 else [("fp", both // 2), ("fp2", both - both // 2 - 1)]
    return [(half, *segment) for half, within in halves for segment in segment_plan(within, segments)]


def _bucket_key(segment: int, half: str, shift: int, width: int) -> Column:
    value = F.shiftrightunsigned(half, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col(half)
    return value.bitwiseOR(F.lit(segment << _KEY_BITS))


def _bucket_keys(segment: int, half: str, shift: int, width: int, within: int) -> Column:
    """The keys of a fingerprint's ball in a segment, its own first."""
    return F.transform(F.array([F.lit(m).cast("long") for m in ball(width, within)]), lambda m: _bucket_key(segment, half, shift, width).bitwiseXOR(m))


def _entries(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Rows (key, probe, fp, fp2, node): probe is 0 for the table's own entry, 1 for what only probes."""
    xors = [_bucket_keys(k, *segment) for k, segment in enumerate(plan)]
    parts = [F.transform(x, lambda key, i: F.struct(key.alias("key"), F.when(i == 0, 0).otherwise(1).alias("probe"))) for x in xors]
    return nodes.select("fp", "fp2", "node", F.explode(F.concat(*parts)).alias("e")).select("e.key", "e.probe", "fp", "fp2", "node")


def _dealt(entries: DataFrame, nodes: DataFrame, plan: Plan, hot: int) -> DataFrame:
    """entries with a part: hot buckets' probes are spread, their table entries copied to each part."""
    own = nodes.select(F.explode(F.array(*[_bucket_key(k, half, s, w) for k, (half, s, w, _) in enumerate(plan)])).alias("key"))
    full = checkpointed(own.groupBy("key").count().where(F.col("count") > hot))
    found = full.count()
    if not found:
        return entries.withColumn("part", F.lit(0))
    around = [F.when(F.shiftrightunsigned("key", _KEY_BITS) == k, F.transform(F.array([F.lit(m).cast("long") for m in ball(w, r)]), lambda m: F.col("key").bitwiseXOR(m))) for k, (_, _, w, r) in enumerate(plan)]
    near = full.select(F.explode(F.coalesce(*around)).alias("key"), "count").groupBy("key").agg(F.ceil(F.sum("count") / F.lit(hot)).cast("int").alias("parts"))
    near = F.broadcast(near) if found <= 1000 else near  # at most 1000 balls of some hundred keys
    joined = entries.join(near, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = F.when(F.col("probe") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp", "fp2"), F.col("parts")).cast("int")))
    return joined.select("key", "probe", "fp", "fp2", "node", F.explode(spread).alias("part"))


@dataclass(frozen=True)
class Reach:
    """How far linked fingerprints are apart: in the first half, and in both."""

    radius: int
    both: int | None = None

    def near(self, fp: np.ndarray, other: np.ndarray, fp2: np.ndarray, other2: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(fp ^ other)
        return apart <= self.radius if self.both is None else (apart <= self.radius) & (apart + np.bitwise_count(fp2 ^ other2) <= self.both)


def _forest(fps: np.ndarray, fps2: np.ndarray, table: int, reach: Reach) -> list[tuple[int, np.ndarray]]:
    """Links within one bucket whose first `table` rows are table entries: (row, rows that it is linked to).

    All links if they are few, else of each component those to its first row.
    """
    out, few = [], 0
    step = max(1, 2_000_000 // len(fps))
    for at in range(0, table, step):
        rows, columns = np.nonzero(reach.near(fps[None, :], fps[at : at + step, None], fps2[None, :], fps2[at : at + step, None]))
        few += len(rows)
        if few > 4 * len(fps):
            break
        out += [(at + int(r), columns[rows == r]) for r in np.unique(rows)]
    else:
        return out
    out = []
    left = np.arange(len(fps))
    while len(left) and left[0] < table:
        pivot, left = int(left[0]), left[1:]
        frontier, members = np.array([pivot]), []
        while len(frontier) and len(left):
            some = frontier[: max(1, 4_000_000 // len(left))]
            near = reach.near(fps[left][None, :], fps[some][:, None], fps2[left][None, :], fps2[some][:, None]).any(axis=0)
            members.append(left[near])
            frontier, left = np.concatenate([frontier[len(some) :], left[near]]), left[~near]
        if members:
            out.append((pivot, np.concatenate(members)))
    return out


def bucket_links(keys: np.ndarray, probe: np.ndarray, fps: np.ndarray, fps2: np.ndarray, nodes: np.ndarray, reach: Reach, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole buckets, sorted by key, then probe."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    entries = np.add.reduceat((probe == 0).astype(np.int64), starts)
    a, b = [], []
    use = (entries > 0) & (entries <= few) & (sizes > 1)
    run = np.repeat(np.arange(len(starts)), sizes)
    at = np.flatnonzero(use[run])
    for k in range(int(entries[use].max(initial=0))):
        at = at[entries[run[at]] > k]
        first = starts[run[at]] + k
        fine = at > first
        other, first = at[fine], first[fine]
        near = reach.near(fps[other], fps[first], fps2[other], fps2[first])
        a.append(nodes[first[near]])
        b.append(nodes[other[near]])
    for r in np.flatnonzero((entries > few) & (sizes > 1)):
        own = slice(starts[r], starts[r] + sizes[r])
        for pivot, members in _forest(fps[own], fps2[own], int(entries[r]), reach):
            a.append(np.full(len(members), nodes[own][pivot]))
            b.append(nodes[own][members])
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    return np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components: each node but the smallest of its component, linked to that."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        for ends in (x, y, label[x], label[y]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = label != np.arange(len(nodes))
    return nodes[label[some]], nodes[some]


def _own_entries(nodes: DataFrame, plan: Plan, hot: int) -> DataFrame:
    """Each fingerprint under its own value in each segment, probing nothing.  Buckets over hot are parted by chance: this only finds what it can."""
    keys = F.array(*[_bucket_key(k, half, s, w) for k, (half, s, w, _) in enumerate(plan)])
    own = nodes.select(F.explode(keys).alias("key"), F.lit(0).alias("probe"), "fp", "fp2", "node")
    full = checkpointed(own.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / F.lit(hot)).cast("int").alias("parts")))
    found = full.count()
    if not found:
        return own.withColumn("part", F.lit(0))
    joined = own.join(F.broadcast(full) if found <= 1000 else full, "key", "left")
    return joined.withColumn("part", F.pmod(F.xxhash64("fp", "fp2"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def fingerprint_links(nodes: DataFrame, radius: int = 4, segments: int | None = None, hot: int = HOT, both: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints `nodes` (fp, fp2, node): their components are those of all links within reach.

    First, fingerprints that share a bucket are linked, and components made of these.  Then every ball is probed, with the
    components' roots in place of nodes, so that a large group isn't linked again from each of its balls.
    """
    plan = halves_plan(radius, both, segments or cheapest_segments(radius if both is None else min(radius, both // 2), nodes.count()))
    reach = Reach(radius, both)
    near = connected_components(_linked(_own_entries(nodes, plan, hot), reach))
    rooted = checkpointed(nodes.join(near, "node", "left").select("fp", "fp2", "node", F.coalesce("root", "node").alias("root")))
    named = rooted.select("fp", "fp2", F.col("root").alias("node"))
    far = _linked(_dealt(_entries(named, plan), named, plan, hot), reach)
    return far.union(rooted.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")))


def _linked(entries: DataFrame, reach: Reach) -> DataFrame:
    """Links (a, b) between the table entries and the probes of each bucket."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        # a task's links are kept as stars, so it gives each of its nodes once at most, and tasks that see one group mostly agree
        stars: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def links(rows: tuple[np.ndarray, ...]) -> None:
            nonlocal size
            key, part, probe, fp, fp2, node = rows
            # the part is told apart within the key by runs: rows are sorted by key, part
            run = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])) if len(key) else key
            x, y = bucket_links(run, probe, fp.view(np.uint64), fp2.view(np.uint64), node, reach)
            stars.append((x, y))
            size += len(x)
            if size > KEPT_LINKS and len(stars) > 1:
                stars[:] = [star_links(*map(np.concatenate, zip(*stars, strict=True)))]
                size = 0

        for batch in batches:
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(rows[0]):
                continue
            cut = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            last = int(cut[-1]) + 1 if len(cut) else 0  # where the last bucket begins
            if held and (last or held[-1][0][-1] != rows[0][0] or held[-1][1][-1] != rows[1][0]):
                done = [*held, tuple(c[:last] for c in rows)]
                held = []
                links(tuple(np.concatenate(c) for c in zip(*done, strict=True)))
            elif last:
                links(tuple(c[:last] for c in rows))
            held.append(tuple(c[last:] for c in rows))
        if held:
            links(tuple(np.concatenate(c) for c in zip(*held, strict=True)))
        if stars:
            x, y = star_links(*map(np.concatenate, zip(*stars, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    width = shuffle_width(entries.sparkSession)
    rows = entries.select("key", "part", "probe", "fp", "fp2", "node").repartition(width, "key", "part").sortWithinPartitions("key", "part", "probe")
    return rows.mapInArrow(linked, "a long, b long").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that reaches a smaller one; root is the smallest that it reaches.

    Rounds of large star and small star; each is a minimum by node, with partial sums before its shuffle, and a join of
    that with the links, which adaptive execution splits where a node has very many.
    """

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        down = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        seen = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else down
        low = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = seen.join(low, "u")
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if both else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    pairs = checkpointed(links.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s")).first()
        if now == before or not now.n:
            break
        before = now
        pairs = checkpointed(star(star(pairs, True), False))
    return pairs.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", segments: int | None = None, hot: int = HOT, both: int | None = None) -> DataFrame:
    """The id, fingerprint (hex) and component_id of every document.

    both: with a second fingerprint of other hashes, the most bits in which linked documents differ in the two together;
    radius then is a further limit on the first, and none if it isn't less.
    """
    fps = checkpointed(fingerprints(docs, words, id_col, text_col, both is not None))
    # numbers stand for fingerprints among links, as an id can be of any type; written, they don't change
    least = fps.groupBy("fp", "fp2").agg(F.min("id").alias("least")).where("least IS NOT NULL")
    nodes = checkpointed(least.withColumn("node", F.monotonically_increasing_id()))
    roots = connected_components(fingerprint_links(nodes, radius, segments, hot, both).union(_shared_ids(fps, nodes)))
    rooted = nodes.join(roots, "node", "left").select("fp", "fp2", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("smallest"))
    of_fp = rooted.join(smallest, "root").select("fp", "fp2", F.col("smallest").alias("component_id"))
    return fps.join(of_fp, ["fp", "fp2"], "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shared_ids(fps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of texts that have one id: all to the least of them."""
    texts = F.struct("fp", "fp2")
    several = fps.where("id IS NOT NULL").groupBy("id").agg(F.count_distinct(texts).alias("n")).where("n > 1").select("id")
    of = fps.join(several, "id").join(nodes.select("fp", "fp2", "node"), ["fp", "fp2"]).select("id", "node").distinct()
    first = of.groupBy("id").agg(F.min("node").alias("a"))
    return of.join(first, "id").where("a <> node").select("a", F.col("node").alias("b"))


#: Near-duplicate stages: five words, and fingerprints of 128 bits that agree in 0.8 of them, however the bits are spread.
STAGE = {"words": 5, "radius": 25, "both": 25}


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The ids (column `dropped`) of all documents but the smallest id of each component."""
    found = simhash_components(docs, id_col=id_col, text_col=text_col, **(how or STAGE))
    return found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("dropped")).distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """One row of each component: that with the smallest id, of repeated ids that whose row has the smallest hash.  Rows with a null id stay.

    Ids alone are shuffled.  Only where ids that stay repeat are rows brought together: by id and the hash of the row, so
    that copies of one row meet, after the rows of greater hashes went.
    """
    # the row is one column from here on, so none of its names can clash
    rows = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(*docs.columns).alias("own_key"), F.struct(*docs.columns).alias("row"))
    left = rows.join(duplicates(docs, id_col, text_col, **how), F.col("own_id") == F.col("dropped"), "left_anti")
    several = checkpointed(left.where("own_id IS NOT NULL").groupBy(F.col("own_id").alias("again")).agg(F.count("*").alias("rows"), F.min("own_key").alias("least")).where("rows > 1"))
    once = left.join(several, F.col("own_id") == F.col("again"), "left_anti").select("row")
    least = left.join(several, (F.col("own_id") == F.col("again")) & (F.col("own_key") == F.col("least")))
    return once.union(least.groupBy("own_id").agg(F.first("row").alias("row")).select("row")).select("row.*")

"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are those of the text with A-Z made small.  A test window is WINDOW consecutive words of an item, or all words of an
item that has fewer.  Each document keeps, of the GRAM-word strings of each WINDOW consecutive words, the one of least hash
(the leftmost of equal ones); so does each test window.  A document that has a test window at some place chooses the same
string there as the window does, so joining these fingerprints finds every occurrence.  Each joined pair is then extended
to the whole window and compared word by word, so nothing else is found.  The fingerprint of a window of fewer than WINDOW
words is its first 4, 2 or 1 words, and documents give all their strings of those lengths, if there are such windows.

Hashes of strings are made by doubling, and least ones too, on whole arrays.  Test windows with equal words are one row with
their items.  Windows are broadcast PASS at a time: what is broadcast has that bound, joins have no hot key on either side,
and a larger benchmark takes more passes over the documents' words, which are then written once to the shared folder.  Texts
are cut to blocks of BLOCK words that overlap, so that a very long one isn't hashed as one row.

Defined cases: a null or empty text has no words and isn't contaminated; rows with one id are judged one by one; a null
item_id is the item `null`; rows of the benchmark with one item_id are one item; an empty benchmark hits nothing; an empty
table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.shared import checkpointed

WINDOW = 10
GRAM = 4
BLOCK = 2_000
#: Pairs of a test window and an item that are broadcast at once.
PASS = 200_000
#: A hash's upper bits, and the place within a block in the lower.
PLACE_BITS = 12
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, whose letters A-Z are made small; none for null."""
    plain = F.octet_length(text) == F.char_length(text)
    small = F.when(plain, F.lower(text)).otherwise(F.translate(text, _CAPITALS, _SMALL))
    return F.coalesce(F.array_remove(F.split(small, _BETWEEN), ""), F.array().cast("array<string>"))


def _later(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _with_prints(blocks: DataFrame, window: int, short: list[int]) -> DataFrame:
    """Adds, for each place of `words`, g4, the hash of 4 words with the place in its lower bits; least, the least g4 of the window that begins there; g1 and g2 if short has them.

    Near the end of a block they are made of fewer words, which no comparison lets through.
    """
    placed = lambda h, i: h.bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR((i + 1).cast("long"))
    out = blocks.withColumn("twos", F.zip_with("words", _later(F.col("words"), 1), lambda x, y: F.xxhash64(x, y)))
    out = out.withColumn("g4", F.transform("twos", lambda x, i: placed(F.xxhash64(x, F.get("twos", i + 2)), i)))
    if 1 in short:
        out = out.withColumn("g1", F.transform("words", lambda w, i: placed(F.xxhash64(w), i)))
    if 2 in short:
        out = out.withColumn("g2", F.transform("twos", placed))
    span, width = window - GRAM + 1, 1
    out = out.withColumn("least", F.col("g4"))
    while width < span:
        step = min(width, span - width)
        out = out.withColumn("least", F.zip_with("least", _later(F.col("least"), step), lambda x, y: F.least(x, y)))
        width += step
    return out


def _key(print_: Column) -> Column:
    return F.shiftright(print_, PLACE_BITS)


def _place(print_: Column) -> Column:
    return print_.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _blocks(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Blocks of each text's words: row, id, n_words, base (the words before the block), words.  A text without words has one block."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("all"))
    bases = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(BLOCK))
    cut = rows.select("row", "id", F.size("all").alias("n_words"), "all", bases.alias("bases")).select("row", "id", "n_words", "all", F.explode_outer("bases").alias("base"))
    return cut.select("row", "id", "n_words", "base", F.slice("all", F.col("base") + 1, BLOCK + window - 1).alias("words"))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each item and different window of it: win (its words), key (its fingerprint), off (the words before that), item."""
    blocks = _with_prints(_blocks(items, id_col, text_col, window).where("n_words > 0"), window, [1, 2])
    n = F.size("words")
    starts = F.when(n > window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array(F.lit(1)))
    wins = blocks.withColumn("starts", starts).withColumn("start", F.explode_outer("starts"))
    first = F.when(n >= 4, F.get("g4", F.lit(0))).when(n >= 2, F.get("g2", F.lit(0))).otherwise(F.get("g1", F.lit(0)))
    chosen = F.when(n < window, first).otherwise(F.get("least", F.col("start") - 1))
    out = wins.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("item"), F.slice("words", F.col("start"), window).alias("win"), "start", chosen.alias("print"))
    return out.select("item", "win", _key(F.col("print")).alias("key"), (_place(F.col("print")) - F.col("start")).alias("off")).distinct()


def _hits(blocks: DataFrame, wins: DataFrame, short: list[int], window: int) -> DataFrame:
    """For each block a row without a window, and a row for each of its places that has one."""
    prints = F.concat(F.array(F.lit(None).cast("long")), F.array_distinct("least"), *(F.col(f"g{n}") for n in short))
    arrays = _with_prints(blocks, window, short).select("row", "id", "n_words", "base", "words", prints.alias("prints"))
    keyed = arrays.select("row", "id", "n_words", "base", "words", F.explode_outer("prints").alias("print"))
    placed = keyed.select("row", "id", "n_words", "base", "words", _key(F.col("print")).alias("at_key"), _place(F.col("print")).alias("place"))
    start = placed["place"] - wins["off"]
    same = (placed["at_key"] == wins["key"]) & (start >= 1) & (F.slice(placed["words"], F.greatest(start, F.lit(1)), F.size(wins["win"])) == wins["win"])
    met = placed.join(F.broadcast(wins), same, "left").where(F.col("at_key").isNull() | F.col("win").isNotNull())
    first = F.col("base") + F.col("place") - F.col("off") - 1
    return met.select("row", "id", "n_words", F.when(F.col("win").isNotNull(), F.struct(first.alias("start"), (first + F.size("win")).alias("stop"))).alias("hit"), "items")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """For each document: the id, n_words, n_hit, n_items, items (sorted), hits (stretches of words, from 0, end exclusive), contaminated."""
    found = checkpointed(item_windows(items, item_col, "text", window))
    sizes = found.groupBy(F.size("win").alias("n")).count().collect()
    short = sorted({4 if r.n >= 4 else 2 if r.n >= 2 else 1 for r in sizes if r.n < window})
    passes = max(1, math.ceil(sum(r["count"] for r in sizes) / PASS))
    blocks = _blocks(docs, id_col, text_col, window)
    if passes > 1:
        blocks = checkpointed(blocks)

    def of_pass(k: int) -> DataFrame:
        some = found.where(F.pmod(F.xxhash64("win", "item"), F.lit(passes)) == k) if passes > 1 else found
        sets = some.groupBy("win", "key", "off").agg(F.array_sort(F.collect_set("item")).alias("items"))
        return _hits(blocks, sets, short, window)

    hits = reduce(DataFrame.unionByName, map(of_pass, range(passes)))
    one = hits.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.flatten(F.collect_set("items"))).alias("items"))
    # stretches that meet or overlap become one
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    merged = F.aggregate("hits", empty, lambda out, h: F.when(
        (F.size(out) > 0) & (F.get(out, F.size(out) - 1)["stop"] >= h["start"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.get(out, F.size(out) - 1)["start"].alias("start"), F.greatest(F.get(out, F.size(out) - 1)["stop"], h["stop"]).alias("stop")))),
    ).otherwise(F.concat(out, F.array(h))))
    done = one.select("id", "n_words", merged.alias("hits"), F.array_distinct("items").alias("items"))
    n_hit = F.aggregate("hits", F.lit(0), lambda a, h: a + h["stop"] - h["start"])
    return done.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "items", "hits", (F.size("hits") > 0).alias("contaminated"),
    )


def decontamination_digests(found: DataFrame) -> DataFrame:
    """The columns of decontaminated() with a digest in place of lists."""
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.withColumn("items_sha256", digest).drop("items", "hits")

"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's mean repetition rate is its target share of the rows over its own count.  A document's count inverts a
Poisson distribution with that mean at a uniform number made from the hash of its id.  Rates over PART are the sum of
several Poisson numbers with their own hashes, so that no probability underflows.  Documents are exploded by their
counts and dealt out by the hash of id and copy, which orders them within partitions too.

Defined cases: a null source is a source of its own, told apart from an empty one; a null id hashes as 'null'; rows with
equal ids have equal counts; a weight of 0 or less drops a source, as do all weights; an empty table gives no rows.
Texts aren't read.  All columns stay, but for input columns named copy_no or mix_key, which the new ones replace.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.shared import shuffle_width

SEED = "mix-1"
#: The largest mean of a single Poisson number; P(X > TABLE) is below 1e-30 at that.
PART = 16.0
TABLE = 96
#: Up to so many sources their rates are broadcast; beyond, rows are joined to them by a shuffle, each source in SALTS parts.
BROADCAST_SOURCES, SALTS = 2_000, 64


def uniform(seed: str, *parts: Column) -> Column:
    """Between 0 and 1, from the first 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, weights: Mapping[str | None, float], default: float = 1.0, scale: float = 1.0, source_col: str = "source") -> tuple[DataFrame, int]:
    """For each source: parts, and the distribution function of one part as an array; the number of sources."""
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count("*").alias("n"))
    weight = F.lit(float(default))
    for name, value in weights.items():
        weight = F.when(F.col("mix_source").isNull() if name is None else F.col("mix_source") == name, float(value)).otherwise(weight)
    weighed = counts.withColumn("w", F.greatest(weight, F.lit(0.0)))
    total = weighed.agg(F.sum("n").alias("rows"), F.sum("w").alias("w"), F.count("*").alias("sources")).first()
    share = scale * (total.rows or 0) / (total.w or 1.0)
    rated = weighed.withColumn("rate", F.col("w") * F.lit(float(share)) / F.col("n")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    cdf = F.expr(f"""aggregate(sequence(1, {TABLE}), struct(exp(-mean) AS p, exp(-mean) AS c, array(exp(-mean)) AS a),
        (s, k) -> struct(s.p * mean / k AS p, s.c + s.p * mean / k AS c, array_append(s.a, s.c + s.p * mean / k) AS a), s -> s.a)""")
    return rated.select("mix_source", F.col("parts").alias("mix_parts"), cdf.alias("mix_cdf")), total.sources


def poisson_mix(docs: DataFrame, weights: Mapping[str | None, float], default: float = 1.0, scale: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns, each row as often as its count says, with copy_no (from 1) and mix_key, in a global order by chance."""
    rates, sources = source_rates(docs, weights, default, scale, source_col)
    docs = docs.drop("copy_no", "mix_key")
    columns = [docs[c] for c in docs.columns]
    same = docs[source_col].eqNullSafe(rates["mix_source"])
    if sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    else:
        rates = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = docs[source_col].eqNullSafe(rates["mix_source"]) & (F.pmod(F.xxhash64(docs[id_col]), F.lit(SALTS)).cast("int") == rates["mix_salt"])
    parts, cdf = rates["mix_parts"], rates["mix_cdf"]
    name = F.coalesce(docs[id_col].cast("string"), F.lit("null"))
    each = F.transform(F.sequence(F.lit(1), parts), lambda j: F.size(F.filter(cdf, lambda c: c < uniform(seed, name, j.cast("string")))))
    count = F.aggregate(each, F.lit(0), lambda a, b: a + b)
    counted = docs.join(rates, same).select(*columns, count.alias("copy_no")).where("copy_no > 0")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copy_no"))))
    key = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy_no").cast("string")).cast("binary"))
    keyed = copies.withColumn("mix_key", F.substring(key, 1, 16))
    return keyed.repartition(shuffle_width(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")

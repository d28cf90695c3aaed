"""Dense numbers over a total order without bringing all rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(rows: DataFrame, order: list[str], start: int = 0, column: str = "id", slot: Column | None = None) -> DataFrame:
    """rows with start + 1, start + 2, … in this order.  order must be unique.  slot: an int by whose order the numbers go first."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("part_no", F.pmod(F.xxhash64(*order), F.lit(1 << 20)))
    # ids follow the hash of the key, so the order is the hash's: deterministic, and even over partitions
    slot = F.floor(F.col("part_no") * width / (1 << 20)).cast("int") if slot is None else slot
    slotted = spread.withColumn("slot_no", slot)
    counts = slotted.groupBy("slot_no").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("slot_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = slotted.withColumn("within", F.row_number().over(Window.partitionBy("slot_no").orderBy("part_no", *order)))
    return inside.join(F.broadcast(before.select("slot_no", "before")), "slot_no").withColumn(column, (F.lit(start) + F.col("before") + F.col("within")).cast("long")).drop("part_no", "slot_no", "within", "before")


def number_in_place(rows: DataFrame, written: str, start: int = 0, column: str = "id") -> DataFrame:
    """rows with start + 1, start + 2, … in the order that they were written in, without a shuffle of them.

    written: a column of monotonically_increasing_id(), made when the rows were written and not filtered since.
    """
    numbered = rows.withColumns({"part_no": F.shiftright(written, 33), "within": F.col(written).bitwiseAND((1 << 33) - 1)})
    counts = numbered.groupBy("part_no").count()  # as many as tasks wrote them
    before = counts.select("part_no", F.coalesce(F.sum("count").over(Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(before), "part_no").withColumn(column, (F.lit(start + 1) + F.col("before") + F.col("within")).cast("long")).drop("part_no", "within", "before", written)


def marks(rows: DataFrame, written: str) -> DataFrame:
    """(mark_of, mark): which rows there are by a bit each, 64 in a row.  written: as number_in_place() has it."""
    bit = F.expr(f"shiftleft(1L, CAST({written} & 63 AS INT))")
    return rows.groupBy(F.shiftright(written, 6).alias("mark_of")).agg(F.bit_or(bit).alias("mark"))


def marked(rows: DataFrame, marks: DataFrame, written: str) -> DataFrame:
    """rows that marks() has, without a shuffle: a broadcast of a bit a row."""
    found = rows.join(F.broadcast(marks), F.shiftright(written, 6) == F.col("mark_of"))
    return found.where(F.getbit("mark", F.col(written).bitwiseAND(63).cast("int")) == 1).drop("mark_of", "mark")

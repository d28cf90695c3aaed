"""Python functions over columns that hold few values as Python objects at a time, however large an Arrow batch is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that are Python objects at a time.
ROWS = 250
KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def in_slices(values: pa.Array, function: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """function of each value; what is done goes into Arrow before the next values are read."""
    parts = [pa.array([function(v) for v in values.slice(at, ROWS).to_pylist()], kind) for at in range(0, len(values), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def mapped(kind: str, function: Callable[[Any], Any], column: Column) -> Column:
    """function of each value of a column, nulls included, as None.  kind: one of KINDS, or a struct of them, for which function gives a dict."""
    made = KINDS[kind] if kind in KINDS else pa.struct([(f.split()[0], KINDS[f.split()[1]]) for f in kind.split(", ")])

    @F.arrow_udf(kind)
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:  # results go back as they are made, so they are never whole either
            for at in range(0, len(values), ROWS):
                yield in_slices(values.slice(at, ROWS), function, made)

    return each(column)

"""Arrow functions that hold few rows of a batch as Python objects at a time."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that are Python objects at once: a batch may hold ten thousand whole documents.
ROWS = 128
_PLAIN = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return _PLAIN[kind]


def by_slices(column: pa.Array, make, rows: int = ROWS) -> pa.Array:
    """The Arrow columns that ``make`` gives for the values of each slice, joined."""
    return pa.concat_arrays([make(column.slice(k, rows).to_pylist()) for k in range(0, max(len(column), 1), rows)])


def _column(out: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    if isinstance(out, pd.DataFrame):
        return pa.StructArray.from_arrays([pa.array(out[f.name], f.type, from_pandas=True) for f in kind], fields=list(kind))
    return pa.array(out, kind, from_pandas=True)


def sliced(kind: T.DataType, rows: int = ROWS):
    """As a pandas UDF of series, but called for a slice of ``rows`` rows after the other; what it gives is kept as Arrow columns."""

    def wrap(f):
        made = arrow_type(kind)

        @F.arrow_udf(kind)
        def run(*columns: pa.Array) -> pa.Array:
            out = []
            for k in range(0, len(columns[0]), rows):
                out.append(_column(f(*(pd.Series(c.slice(k, rows).to_pylist(), dtype=object) for c in columns)), made))
            return pa.concat_arrays(out) if out else pa.array([], made)

        return run

    return wrap

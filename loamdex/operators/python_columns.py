"""Columns computed in Python: one Arrow crossing, no row objects, no second evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def with_python_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[tuple[str, T.DataType]], compute: Callable[..., Iterable[tuple]]) -> DataFrame:
    """``df`` with new columns. ``compute`` gets a list per input and yields a tuple of new values per row; a new column replaces one of its name."""
    names = [n for n, _ in fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(compute(*(b.column(n).to_pylist() for n in inputs)))
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *new], [*(f.name for f in kept), *names])

    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, t) for n, t in fields)]))

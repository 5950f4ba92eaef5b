"""What the operators share: appending columns batch by batch through Arrow, and what a worker process keeps."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text that one step of an operator holds as Python objects at once, in bytes of Arrow data.
SLICE_BYTES = 4 << 20

_RESIDENT: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], object]) -> object:
    """What a worker process keeps from one task to the next: one thing at a time, so the tables of one operator
    never lie beside those of the next."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about `limit` bytes; one row is never cut."""
    n = batch.num_rows
    step = max(1, min(n, int(n * limit / max(1, batch.nbytes))))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def append_columns(df: DataFrame, fields: T.StructType, fn: Callable[[pa.RecordBatch], list[pa.Array]], keeps: str = "") -> DataFrame:
    """Append what `fn` makes of each batch, one array for each field.

    Rows keep their order and all their other columns; an input column with an output's
    name is replaced. No shuffle; memory is bounded by one slice of one Arrow batch. What the process
    keeps of another operator (a key that doesn't begin with `keeps`) is let go first.
    """
    new = {f.name for f in fields}
    kept = [i for i, f in enumerate(df.schema) if f.name not in new]
    schema = T.StructType([df.schema[i] for i in kept] + list(fields))
    names, before = [f.name for f in schema], df.columns
    # Spark hands over columns by name, and can't those with dots or those that repeat.
    plain = df if all(c.isidentifier() for c in before) and len({c.lower() for c in before}) == len(before) else df.toDF(*[f"c{i}" for i in range(len(before))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not any(k[0] == keeps for k in _RESIDENT):
            _RESIDENT.clear()
        for whole in batches:
            for batch in slices(pa.RecordBatch.from_arrays(whole.columns, names=before)):
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + fn(batch), names=names)

    return plain.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def quoted(name: str) -> str:
    """A column's name as Spark reads it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out

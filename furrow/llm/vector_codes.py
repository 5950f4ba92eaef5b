"""Vector code compression: product codes over integer codebooks.

Vectors become whole numbers (components times a scale, rounded down) and are cut into equal parts.
Each part position has its own codebook, which starts as that part of the rows with the smallest ids. In each round
the codebooks are broadcast; Arrow batches compute the distances of all parts to all entries as
|x|^2 - 2 x.c + |c|^2, in 64-bit integer matrix products, and take the first of the least. A task returns its sums and counts by entry
(never more rows than the codebooks have components); a grouped shuffle merges them, and each used entry becomes the rounded-down mean.

Defined results: vectors that are null or hold a null or non-finite component have no code; shorter vectors count as padded with zeros, up to
the next multiple of the parts; rows with a null id come last among the first entries, rows of one id in the order of
their vectors; fewer rows than entries make shorter codebooks; no rows make empty ones. Vectors
so long that a distance, or the sum of all components, might not fit 64 bits are refused with an error, never wrapped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import append_columns, fresh, quoted
from furrow.session import ensure_checkpoint_dir

#: Rows whose distances are held at once; with 16 parts of 64 entries these are 8 MB.
STEP = 1_024
#: Codebooks are broadcast and held on the driver; larger ones are refused.
CODEBOOK_BYTES = 8 << 20
#: Groups that are joined to the rows by broadcast; more are joined by a shuffle.
SMALL_GROUPS = 100_000


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it is there, and so are all its components, as finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_rows(column: pa.ListArray, width: int, scale: float) -> np.ndarray:
    """The lists as rows of whole numbers of one width; absent lists and missing places are zeros."""
    column = column.fill_null([]) if column.null_count else column
    lengths = column.value_lengths().to_numpy()
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Codebooks:
    """Integer entries, one codebook a part position."""

    def __init__(self, entries: np.ndarray, scale: float):
        self.entries, self.scale = entries, scale  # (parts, entries, components of a part)
        self.parts, self.size, self.depth = entries.shape
        self.width = self.parts * self.depth
        self.square = (entries**2).sum(axis=2)

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, and the squared distance over all parts."""
        parts = rows.reshape(len(rows), self.parts, self.depth).transpose(1, 0, 2)
        distance = self.square[:, None, :] - 2 * (parts @ self.entries.transpose(0, 2, 1)) + (parts**2).sum(axis=2)[:, :, None]
        codes = distance.argmin(axis=2)  # the first of equal ones
        return codes.T, np.take_along_axis(distance, codes[:, :, None], axis=2)[:, :, 0].sum(axis=0)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The whole numbers that codes stand for."""
        return self.entries[np.arange(self.parts), codes].reshape(len(codes), self.width)

    def sha256(self) -> str:
        """Of all components by part, entry and place, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _steps(rows: int) -> Iterator[slice]:
    for at in range(0, rows, STEP):
        yield slice(at, at + STEP)


def fit_codebooks(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0
) -> Codebooks:
    """Learn the codebooks from every usable row.

    Each round is one pass over the rows and a shuffle of sums; the driver holds the codebooks only.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so 1 to 256 entries")
    id_, v = F.col(quoted(id_col)), F.col(quoted(vector_col))
    rows = df.filter(usable(v)).select(id_.alias("id"), v.cast("array<double>").alias("v"))
    longest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    n, width, top = rows.agg(F.count("*"), F.max(F.size("v")), longest).first()
    width, top = -(-(width or 0) // parts) * parts, (top or 0.0) * scale + 1
    if max(1, width) * (2 * top) ** 2 >= 2.0**62 or n * top >= 2.0**62:
        raise OverflowError(f"components of {top:.4g} whole units in {n} vectors of {width}: distances or sums may not fit 64 bits")
    if width * entries * 8 > CODEBOOK_BYTES:
        raise ValueError(f"codebooks of more than {CODEBOOK_BYTES} bytes")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column(0).combine_chunks()
    start = whole_rows(first, width, scale)
    books = Codebooks(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2).copy(), scale)
    for _ in range(rounds if books.size else 0):
        books = _moved(rows.select("v"), books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are the means of the parts nearest to them."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        totals, counts = np.zeros(held.entries.size, np.int64), np.zeros(held.parts * held.size, np.int64)
        place = np.arange(held.parts) * held.size
        for batch in batches:
            for step in _steps(batch.num_rows):
                x = whole_rows(batch.column(0)[step], held.width, held.scale)
                cell = held.assign(x)[0] + place
                counts += np.bincount(cell.ravel(), minlength=len(counts))
                at = cell[:, :, None] * held.depth + np.arange(held.depth)
                # Sums of one step are far below 2^53, so the weights are added exactly.
                totals += np.bincount(at.ravel(), weights=x.ravel(), minlength=len(totals)).astype(np.int64)
        used = np.flatnonzero(np.repeat(counts, held.depth))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used]), pa.array(counts[used // max(1, held.depth)])], names=["place", "total", "n"])

    sums = rows.mapInArrow(partial, "place long, total long, n long").groupBy("place").agg(F.sum("total"), F.sum("n")).toArrow()
    place, total, n = (sums.column(i).to_numpy() for i in range(3))
    entries = books.entries.copy().ravel()
    entries[place] = total // n
    shared.destroy()
    return Codebooks(entries.reshape(books.entries.shape), books.scale)


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", code_out: str = "code", error_out: str = "error", **fit: object
) -> tuple[DataFrame, Codebooks]:
    """All rows with a code (two hex digits a part) and its squared error in place of the vector, and the codebooks.

    Rows without a usable vector have null in both. The coded rows are checkpointed, so the broadcast is let go; nothing is shuffled for them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    books = fit_codebooks(df, id_col, vector_col, **fit)
    shared = df.sparkSession.sparkContext.broadcast(books)
    (ok,) = fresh(df, "usable")
    fields = T.StructType([T.StructField(code_out, T.StringType()), T.StructField(error_out, T.LongType())])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        held, good = shared.value, batch.column(ok).to_numpy(zero_copy_only=False)
        vectors = batch.column(vector_col)
        codes, errors = [], []
        for step in _steps(batch.num_rows):
            part, fine = vectors[step], good[step]
            x = np.zeros((len(fine), held.width), np.int64)
            x[fine] = whole_rows(part.filter(pa.array(fine)), held.width, held.scale)
            code, error = held.assign(x) if held.size else (np.zeros((len(fine), held.parts), np.int64), np.zeros(len(fine), np.int64))
            digits = code.astype(np.uint8).tobytes().hex()
            codes += [digits[i * 2 * held.parts : (i + 1) * 2 * held.parts] if f else None for i, f in enumerate(fine)]
            errors += [e if f else None for e, f in zip(error.tolist(), fine, strict=True)]
        return [pa.array(codes, pa.string()), pa.array(errors, pa.int64())]

    coded = append_columns(df.withColumn(ok, usable(F.col(quoted(vector_col)))), fields, run, "vector_codes")
    coded = coded.select(*[F.col(quoted(c)) for c in coded.columns if c not in (vector_col, ok)]).checkpoint()
    shared.destroy()
    return coded, books


def decompress(df: DataFrame, books: Codebooks, code_col: str = "code", out: str = "approximation") -> DataFrame:
    """Append the vector that each code stands for, in the units of the input; null for a null code."""
    fields = T.StructType([T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        codes = batch.column(code_col).to_pylist()
        there = [bytes.fromhex(c) for c in codes if c is not None]
        rows = iter((books.vectors(np.frombuffer(b"".join(there), np.uint8).reshape(len(there), books.parts)) / books.scale).tolist())
        return [pa.array([None if c is None else next(rows) for c in codes], pa.list_(pa.float64()))]

    return append_columns(df, fields, run, "vector_codes")


def with_group_total(df: DataFrame, group_col: str, value_col: str, out: str) -> DataFrame:
    """Append the sum of a value over the rows of equal group, nulls together.

    Sums are combined before the shuffle. Up to SMALL_GROUPS of them go to the rows by broadcast, so no group lies in one task; more are joined by a
    shuffle, where adaptive execution splits a hot group's rows.
    """
    group, total = fresh(df, "group_key", "group_total")
    sums = df.groupBy(F.col(quoted(group_col)).alias(group)).agg(F.sum(F.col(quoted(value_col)).cast("decimal(20,0)")).cast("long").alias(total)).checkpoint()
    side = F.broadcast(sums) if sums.count() <= SMALL_GROUPS else sums
    kept = [F.col(quoted(c)) for c in df.columns if c != out]
    return df.join(side, F.col(quoted(group_col)).eqNullSafe(F.col(group))).select(*kept, F.col(total).alias(out))

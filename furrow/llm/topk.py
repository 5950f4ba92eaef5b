"""Exact top-k inner products: candidates by descending length, pruned by partial sums.

Vectors are rotated by the right singular vectors of a bounded sample, so that the first
coordinates carry most of a product. Candidates are range-partitioned and sorted by descending norm. A task
holds one block of queries; of each batch of candidates it computes the product of the first
coordinates and adds the product of the residual norms (Cauchy-Schwarz): pairs whose bound stays
below the query's threshold are dropped, the others are scored exactly in integers. A
first threshold comes from the longest vectors, later ones from the best scores so far.

The bound is rounded up by a relative slack far above the error of float sums, so no true result is lost.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part;
vectors so long that a product might not fit a 64-bit integer are refused with an error, never wrapped; shorter vectors count as
padded with zeros; a query never meets rows of its own id; repeated candidate rows
each take a rank, repeated query rows count as one; fewer than k candidates give all; ties go to the
smaller id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import ensure_checkpoint_dir, shuffle_width

#: Bounds of what is broadcast or held on the driver at once.
QUERY_BLOCK, SEED_ROWS, SAMPLE_ROWS = 8_192, 2_048, 2_048
#: Rotated coordinates whose products are summed before a pair may be dropped.
LEADING = 16
SLACK = 1e-9
#: By Cauchy-Schwarz no product or partial sum of shorter vectors leaves 64 bits.
LONGEST = 3e9


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """(id, v, norm): components times `scale`, rounded down, of the rows that take part."""
    v = F.col(vector_col)
    fit = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = df.filter(fit).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of one width, shorter ones padded with zeros."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = flat
    return out


class Side:
    """Vectors with their rotated leading part and residual norms."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, rotation: np.ndarray):
        self.ids, self.whole = ids, whole
        self.real = whole.astype(np.float64)
        turned = self.real @ rotation
        self.lead = turned[:, :LEADING]
        self.norm = np.sqrt((self.real**2).sum(axis=1))
        self.rest = np.sqrt(np.maximum((turned[:, LEADING:] ** 2).sum(axis=1), 0))
        self.top = int(np.abs(whole).max(initial=0))

    def take(self, rows: np.ndarray) -> "Side":
        out = object.__new__(Side)
        for name in ("ids", "whole", "real", "lead", "norm", "rest"):
            setattr(out, name, getattr(self, name)[rows])
        out.top = self.top
        return out


def able(queries: Side, candidates: Side, limit: np.ndarray) -> np.ndarray:
    """The queries that the longest of the candidates could still serve."""
    return np.flatnonzero(queries.norm * candidates.norm.max(initial=0) * (1 + SLACK) + SLACK >= limit)


def survivors(queries: Side, candidates: Side, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row, score) whose exact score reaches the query's limit."""
    live = able(queries, candidates, limit)
    if not len(live) or not len(candidates.ids):
        none = np.zeros(0, np.int64)
        return none, none, none
    q = queries.take(live)
    bound = q.lead @ candidates.lead.T + np.outer(q.rest, candidates.rest)
    bound += SLACK * np.outer(q.norm, candidates.norm) + SLACK
    row, col = np.nonzero(bound >= limit[live][:, None])
    if float(queries.top) * candidates.top * candidates.whole.shape[1] < 2**52:
        if len(row) * 4 > bound.size:
            score = (q.real @ candidates.real.T)[row, col].astype(np.int64)
        else:
            score = np.zeros(len(row), np.int64)
            for at in range(0, len(row), 200_000):
                part = slice(at, at + 200_000)
                score[part] = np.einsum("ij,ij->i", q.real[row[part]], candidates.real[col[part]]).astype(np.int64)
    else:
        score = np.einsum("ij,ij->i", q.whole[row], candidates.whole[col])
    good = (score >= limit[live][row]) & (q.ids[row] != candidates.ids[col])
    return live[row[good]], col[good], score[good]


class Best:
    """The k best candidates of each query of a block so far, and the thresholds they set."""

    def __init__(self, n: int, k: int, limit: np.ndarray):
        self.k, self.limit = k, limit.copy()
        self.rows = np.zeros((3, 0), np.int64)  # query row, score, id

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        r, s, i = np.concatenate([self.rows, np.stack([row, score, ids])], axis=1)
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        rank = np.arange(len(r)) - np.repeat(begin, np.diff(np.append(begin, len(r))))
        full = rank == self.k - 1
        self.limit[r[full]] = np.maximum(self.limit[r[full]], s[full])
        self.rows = np.stack([r, s, i])[:, rank < self.k]


def _parts(batches: Iterator[pa.RecordBatch], step: int = 1_024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def top_inner_products(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, id, score) of each query's k highest integer inner products.

    `is_query` is a condition on the column `id`. Candidates are shuffled once, by norm. Each block of
    queries is broadcast and meets the candidates; a task returns at most k rows a query, and leaves its remaining candidates
    unread as vectors once they are too short for every query. A block's ranks are written under the checkpoint folder and its
    broadcast is let go before the next, so plan and driver hold one block however many queries there are.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = integer_vectors(df, id_col, vector_col)
    ranked = (
        rows.repartitionByRange(shuffle_width(spark, rows), F.col("norm").desc(), F.col("id"))
        .sortWithinPartitions(F.col("norm").desc(), "id")
        .checkpoint()
    )
    width, longest_norm = ranked.agg(F.max(F.size("v")), F.max("norm")).first()
    width = width or 1
    if longest_norm is not None and longest_norm >= LONGEST:
        raise OverflowError(f"a vector is {longest_norm:.4g} long in whole units; products of vectors of {LONGEST:.4g} and more may not fit 64 bits")
    sample = ranked.select("v").limit(SAMPLE_ROWS).toArrow().column(0).combine_chunks()
    _, _, turned = np.linalg.svd(_matrix(sample, width).astype(np.float64), full_matrices=True)
    rotation = turned.T
    seeds = ranked.select("id", "v").limit(SEED_ROWS).toArrow().combine_chunks()
    seed_ids, seed_rows = seeds.column(0).combine_chunks().to_numpy(), _matrix(seeds.column(1).combine_chunks(), width)
    first = spark.sparkContext.broadcast((seed_ids, seed_rows, rotation))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, whole, turn = first.value
        longest = Side(ids, whole, turn)
        for part in _parts(batches):
            q = Side(part.column(0).to_numpy(), _matrix(part.column(1), width), turn)
            best = Best(len(q.ids), k, np.full(len(q.ids), -np.inf))
            r, c, s = survivors(q, longest, best.limit)
            best.add(r, s, longest.ids[c])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best.limit)], names=["id", "v", "least"])

    queries = ranked.filter(is_query).select("id", "v").distinct().mapInArrow(thresholds, "id long, v array<long>, least double").checkpoint()
    first.destroy()
    folder = f"{spark.sparkContext.getCheckpointDir()}/top-products-{uuid.uuid4().hex}"
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    none = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    none.write.parquet(folder)
    for held in _blocks(queries, query_block):
        block = spark.sparkContext.broadcast((held.column(0).to_numpy(), _matrix(held.column(1), width), held.column(2).to_numpy(), rotation))

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, whole, least, turn = block.value
            q = Side(ids, whole, turn)
            best = Best(len(ids), k, least)
            spent = False  # the norms descend, so what follows is no longer
            for part in _parts(batches):
                if spent:
                    continue
                candidates = Side(part.column(0).to_numpy(), _matrix(part.column(1), width), turn)
                spent = not len(able(q, candidates, best.limit))
                r, c, s = survivors(q, candidates, best.limit)
                best.add(r, s, candidates.ids[c])
            r, s, i = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(i), pa.array(s)], names=["query_id", "id", "score"])

        found = ranked.select("id", "v").mapInArrow(search, "query_id long, id long, score long")
        ranks = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranks.select(*none.columns).write.mode("append").parquet(folder)
        block.destroy()
    return spark.read.schema(none.schema).parquet(folder)


def _blocks(queries: DataFrame, size: int) -> Iterator[pa.RecordBatch]:
    """The queries in blocks; the driver holds one block and one partition at a time."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int64())), ("least", pa.float64())])
    held: list[tuple] = []
    for r in queries.toLocalIterator():
        held.append((r.id, r.v, r.least))
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

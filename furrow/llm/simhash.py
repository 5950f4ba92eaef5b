"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position has a nonzero vector of radius + 1 bits; table v keeps the positions whose vector has
an odd product with v. For any set of at most `radius` differing positions the equations "product
with v is even" have a nonzero solution v, so two fingerprints within the radius agree on all that
some table keeps: every such pair meets, without exception.

Distinct fingerprints are what is hashed; copies never multiply. In one bucket a small run compares
all pairs, and a pair is reported by the first table it meets in only. A large run is searched breadth
first, where each found fingerprint leaves the run: a forest of at most run - 1 links comes out, and
time is near linear in a bucket of close relatives.

Defined results: null and blank texts have fingerprint zero and are linked like any other; a null id
takes part, but can't name a component; a group of null ids only has a null component; repeated
rows get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import append_columns, fresh, quoted, texts
from furrow.operators.graph import connected_components
from furrow.session import ensure_checkpoint_dir

BITS = 64
SEED = 42
#: Runs up to this size compare all pairs.
SMALL_RUN = 32
_HASH_BLOCK = 100_000


def fingerprint(text: str, words_each: int = 4) -> int:
    """Unsigned 64-bit SimHash of the lower-cased text's word shingles; 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - words_each + 1)
    first = starts[:n].tolist()
    last = ends[words_each - 1 :].tolist() if len(words) >= words_each else [len(line)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _HASH_BLOCK):
        some = [digest(line[a:b], SEED) for a, b in zip(first[at : at + _HASH_BLOCK], last[at : at + _HASH_BLOCK], strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint", words_each: int = 4) -> DataFrame:
    """Append the fingerprint of each whole text as a long (the same 64 bits)."""
    fields = T.StructType([T.StructField(out, T.LongType())])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = np.array([fingerprint(t, words_each) for t in texts(batch, text_col)], np.uint64)
        return [pa.array(found.view(np.int64))]

    return append_columns(df, fields, run)


def covering_masks(radius: int) -> list[int]:
    """The positions that each of the 2^(radius+1) - 1 tables keeps, as 64-bit masks."""
    vectors = 2 ** (radius + 1)
    of_bit = [1 + i % (vectors - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (of_bit[i] & v).bit_count() % 2) for v in range(1, vectors)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_in_runs(table: np.ndarray, key: np.ndarray, value: np.ndarray, masks: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within complete runs of equal (table, key); rows come sorted by both."""
    n = len(value)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (table[1:] != table[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    out = []
    small = np.repeat((size > 1) & (size <= SMALL_RUN), size)
    run = np.repeat(np.arange(len(begin)), size)
    at = np.flatnonzero(small)
    for d in range(1, min(SMALL_RUN, int(size.max(initial=1)))):
        i = at[at + d < n]
        i = i[run[i] == run[i + d]]
        if not len(i):
            break
        differ = value[i] ^ value[i + d]
        near = np.bitwise_count(differ) <= radius
        i, differ = i[near], differ[near]
        if len(i):
            first = np.argmax((differ[:, None] & masks[None, :]) == 0, axis=1)
            i = i[first == table[i]]
            out.append((value[i], value[i + d]))
    for r in np.flatnonzero(size > SMALL_RUN):
        out.extend(_forest(value[begin[r] : begin[r] + size[r]], radius))
    return out


def _forest(values: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct values, breadth first."""
    out, left = [], values
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for v in queue.pop():
                near = np.bitwise_count(left ^ v) <= radius
                if near.any():
                    found, left = left[near], left[~near]
                    out.append((np.full(len(found), v), found))
                    queue.append(found)
                    if not len(left):
                        break
    return out


def close_pairs(values: DataFrame, col: str = "fingerprint", radius: int = 4) -> DataFrame:
    """Links (src, dst) among distinct fingerprints, enough to connect all that lie within `radius` of
    each other. One shuffle of a narrow row for each fingerprint and table; each bucket is a run
    of a sorted partition."""
    masks = covering_masks(radius)
    all_masks = np.array(masks, np.uint64)
    kept = F.array(*[F.col(col).bitwiseAND(F.lit(_signed(m))) for m in masks])
    rows = values.select(F.col(col), F.posexplode(kept).alias("t", "k")).repartition("t", "k").sortWithinPartitions("t", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def links(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if parts:
                t, k, v = (np.concatenate(x) for x in zip(*parts, strict=True))
                for a, b in links_in_runs(t, k, v, all_masks, radius):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            v = batch.column(0).to_numpy().view(np.uint64)
            other = np.flatnonzero((t != t[-1]) | (k != k[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut == 0 and held and (held[-1][0][-1] != t[0] or held[-1][1][-1] != k[0]):
                yield from links(held)
                held = []
            elif cut:
                yield from links([*held, [t[:cut], k[:cut], v[:cut]]])
                held = []
            held.append([t[cut:], k[cut:], v[cut:]])
        yield from links(held)

    return rows.mapInArrow(run, "src long, dst long")


def _classes(distinct: DataFrame, radius: int) -> DataFrame:
    """The class of each distinct fingerprint: one of those that it is linked to, over any number of links."""
    labels = connected_components(close_pairs(distinct.select("fingerprint"), radius=radius))
    return distinct.join(labels, distinct["fingerprint"] == labels["node"], "left").select(
        "fingerprint", "rep", F.coalesce("component", "fingerprint").alias("class")
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words_each: int = 4) -> DataFrame:
    """(id, fingerprint, component): the component is the smallest id reachable over links.

    Groups of copies are joined as one fingerprint; the last join meets them again, where adaptive
    execution may split a hot one, since both sides are plain shuffles.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ids = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    marked = fingerprints(ids, words_each=words_each).drop("text").checkpoint()
    classes = _classes(marked.groupBy("fingerprint").agg(F.min("id").alias("rep")), radius)
    least = classes.groupBy("class").agg(F.min("rep").alias("component"))
    named = classes.join(least, "class").select("fingerprint", "component").checkpoint()
    return marked.join(named, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """Keep one row of each class of fingerprints, whatever its ids: that with the smallest id, null ids last.

    Rows are told apart by id and hashes of the text, so a class of null ids keeps a row, and a repeated id one in each class
    that it is least of. All columns stay; of rows with equal id and text, one does.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    i, a, b = fresh(docs, "row_id", "row_a", "row_b")
    own, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    # Two hashes of the text, so that rows of one id are told apart by 128 bits.
    key = {i: own, a: F.xxhash64(text), b: F.xxhash64(F.lit(SEED), text)}

    narrow = docs.select(*[c.alias(n) for n, c in key.items()], text.alias("text"))
    marked = fingerprints(narrow).drop("text")
    rows = marked.groupBy("fingerprint", i, a, b).agg(F.count(F.lit(1)).alias("rows")).checkpoint()
    first = F.struct(F.col(i).isNull().alias("none"), i, a, b, "rows")
    classes = _classes(rows.groupBy("fingerprint").agg(F.min(first).alias("rep")), radius)
    keep = classes.groupBy("class").agg(F.min("rep").alias("rep")).select("rep.*").checkpoint()
    named = docs.select("*", *[c.alias(n) for n, c in key.items()]).alias("d")

    def of(chosen: DataFrame) -> DataFrame:
        k = chosen.alias("k")
        same = F.col(f"d.{i}").eqNullSafe(F.col(f"k.{i}")) & (F.col(f"d.{a}") == F.col(f"k.{a}")) & (F.col(f"d.{b}") == F.col(f"k.{b}"))
        return named.join(k, same, "left_semi")

    # Of rows equal in id and text, which may differ in other columns, the same one stays in every run. Only such rows are grouped, and one of
    # each task and key goes on; both joins read the same shuffle of the documents.
    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    repeated = of(keep.filter(F.col("rows") > 1)).groupBy(i, a, b).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("row"))
    return of(keep.filter(F.col("rows") == 1)).select(*[F.col(quoted(c)) for c in docs.columns]).unionByName(repeated.select("row.*"))

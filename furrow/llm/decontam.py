"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Documents and test items are sequences of lower-cased words. Word and gap scores are +2, -1, -1. An item of m words is found where an
alignment is worth half of the item, and at least five words in a row or the whole item: a score of T = max(m, min(2m, 10)).

Seeds are few and rare, and yet no alignment of that score can be without one. If u of the item's words have no partner, at most
2(m - u) - T mismatches and gaps are left, so the matched words lie in at most one run more, and at least T - m + u - 1
pairs of neighbouring words stand together in the document too. For any U, then: either at most U words have no partner, and one of
any U + 1 words is there; or more have none, and one of any 2m - T - U neighbouring pairs is there. So the U + 1 rarest words and as many of the rarest pairs are
the seeds, with the U that makes them rarest over all documents. How often the items' words and pairs occur is counted
first, each task adding up its own. What a document holds doesn't depend on the choice of seeds, and so not on other documents.

The stretch around a seed reaches as far as an alignment of the asked score can; stretches of one item that overlap are
joined. Those with too few of the item's words for that score are left out, the others are aligned, and the
score over the best possible score decides.

Items come in blocks of bounded size, each broadcast and held against all documents; where there are several, each block's hits are written
before the next, by text, and its broadcasts are let go.

Defined results: null and empty texts match nothing, nor do items that are null or without a word; repeated documents get equal rows, items with equal text are all
reported; texts and items of any length are read whole, and the score of an item is over all its words. Besides the array of
hits, ordered by item, a document keeps its columns, and a column with the array's name is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import append_columns, fresh, quoted, slices, texts
from furrow.session import ensure_checkpoint_dir

MIN_SCORE = 0.5
#: A hit is worth so many words in a row at least, or the whole of a shorter item.
LEAST_WORDS = 5
#: A block is full at so many items or characters; an item is never cut, so a longer one is a block of its own.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4_000_000
#: Cells of one batch of alignments.
CELLS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

HIT = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("first_word", T.IntegerType()),
    T.StructField("last_word", T.IntegerType()),
])
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Items:
    """A block of test items as word numbers, and their seeds."""

    def __init__(self, rows: list[tuple[int, str]], min_score: float = MIN_SCORE):
        self.words: dict[str, int] = {}
        self.ids: list[int] = []
        self.sequences: list[np.ndarray] = []
        for item_id, text in rows:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                self.sequences.append(np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int64))
        self.base = len(self.words) + 1
        self.lengths = np.array([len(s) for s in self.sequences], np.int64)
        #: The score that an item needs, and the mismatches and gaps that such an alignment has at most.
        self.needed = np.maximum(np.ceil(MATCH * self.lengths * min_score), MATCH * np.minimum(self.lengths, LEAST_WORDS)).astype(np.int64)
        self.reach = MATCH * self.lengths - self.needed
        #: All grams that may be seeds: words by their number, then neighbouring pairs by their place here.
        self.pairs = np.unique(np.concatenate([*[s[:-1] * self.base + s[1:] for s in self.sequences], np.zeros(0, np.int64)]))
        self.seeds: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def numbers(self, text: str) -> np.ndarray:
        """The words as numbers, 0 for words of no item."""
        get = self.words.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def grams(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The grams of a text that items have: their numbers, and the place of each one's first word."""
        at = np.flatnonzero(numbers)
        codes = numbers[:-1] * self.base + numbers[1:]
        if not len(self.pairs) or not len(codes):
            return numbers[at], at
        near = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        both = np.flatnonzero((self.pairs[near] == codes) & (numbers[:-1] > 0))
        return np.concatenate([numbers[at], self.base + near[both]]), np.concatenate([at, both])

    def count(self, rows: list[str]) -> np.ndarray:
        """How often each gram stands in the texts."""
        times = np.zeros(self.base + len(self.pairs), np.int64)
        for text in rows:
            times += np.bincount(self.grams(self.numbers(text))[0], minlength=len(times))
        return times

    def choose(self, times: np.ndarray) -> "Items":
        """Take the rarest seeds that no alignment of the needed score can be without."""
        gram, owner, offset = [], [], []
        for item, (s, reach) in enumerate(zip(self.sequences, self.reach.tolist(), strict=True)):
            pairs = self.base + np.searchsorted(self.pairs, s[:-1] * self.base + s[1:])
            rare, rare_pairs = np.argsort(times[s], kind="stable"), np.argsort(times[pairs], kind="stable")
            words_cost = np.concatenate([[0], np.cumsum(times[s][rare] + 1)])
            pairs_cost = np.concatenate([[0], np.cumsum(times[pairs][rare_pairs] + 1)])
            # With U = reach // 2, the most words that can be without a partner, no pair is needed.
            most = reach // MATCH
            tried = np.arange(most + 1)
            n_pairs = np.where(tried == most, 0, reach - tried)
            fit = n_pairs < len(s)
            cost = words_cost[tried[fit] + 1] + pairs_cost[n_pairs[fit]]
            best = int(np.argmin(cost))
            places, pair_places = rare[: tried[fit][best] + 1], rare_pairs[: n_pairs[fit][best]]
            gram += [s[places], pairs[pair_places]]
            offset += [places, pair_places]
            owner.append(np.full(len(places) + len(pair_places), item))
        none = np.zeros(0, np.int64)
        gram, owner, offset = (np.concatenate([*x, none]) for x in (gram, owner, offset))
        order = np.argsort(gram, kind="stable")
        # The seeds of gram g are first[g] to first[g + 1] of owner and offset.
        first = np.searchsorted(gram[order], np.arange(self.base + len(self.pairs) + 1))
        self.seeds = first, owner[order], offset[order]
        return self

    def candidates(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, begin, end) of the stretches of a document that are worth aligning."""
        first, owner, offset = self.seeds
        gram, at = self.grams(numbers)
        times = first[gram + 1] - first[gram]
        gram, at, times = gram[times > 0], at[times > 0], times[times > 0]
        if not len(gram):
            return []
        seed = np.repeat(first[gram] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        item, place = owner[seed], np.repeat(at, times) - offset[seed]
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        begin, end = np.maximum(0, place - self.reach[item]), np.minimum(len(numbers), place + self.lengths[item] + self.reach[item])
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
        starts = np.flatnonzero(new)
        ends = end[np.append(starts[1:], len(item)) - 1]
        out = []
        seen = np.zeros(self.base, bool)
        for k, a, b in zip(item[starts].tolist(), begin[starts].tolist(), ends.tolist(), strict=True):
            words, stretch = self.sequences[k], numbers[a:b]
            least = self.needed[k] / MATCH
            seen[stretch] = True
            enough = np.count_nonzero(seen[words]) >= least
            seen[stretch] = False
            if enough:
                seen[words] = True
                if np.count_nonzero(seen[stretch]) >= least:
                    out.append((k, a, b))
                seen[words] = False
        return out


def align(queries: list[np.ndarray], stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair, and the place in the stretch where it ends (exclusive).

    Rows of the table run in step over all pairs; a gap along a row is a running maximum.
    """
    k, m, w = len(queries), max(map(len, queries)), max(map(len, stretches))
    q, s = np.zeros((k, m), np.int64), np.full((k, w), -1, np.int64)
    for i, (a, b) in enumerate(zip(queries, stretches, strict=True)):
        q[i, : len(a)] = a
        s[i, : len(b)] = np.where(b > 0, b, -1)
    step = np.arange(w) * -GAP
    above, best, end = np.zeros((k, w + 1), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
    rows = np.arange(k)
    for i in range(m):
        score = np.where(s == q[:, i : i + 1], MATCH, MISMATCH)
        cell = np.maximum(np.maximum(above[:, :-1] + score, above[:, 1:] + GAP), 0)
        cell = np.maximum.accumulate(cell + step, axis=1) - step
        above[:, 1:] = cell
        place = np.argmax(cell, axis=1)
        top = cell[rows, place]
        better = (top > best) & (q[:, i] > 0)
        best[better], end[better] = top[better], place[better] + 1
    return best, end


def matches(items: Items, rows: list[str]) -> list[list[tuple[int, float, int, int]]]:
    """For each text the items that it holds: (item_id, score, first word, last word + 1)."""
    if items.seeds is None:
        items.choose(items.count(rows))
    out: list[dict[int, tuple[int, float, int, int]]] = [{} for _ in rows]
    jobs: list[tuple[int, int, int, np.ndarray]] = []
    for r, text in enumerate(rows):
        numbers = items.numbers(text)
        jobs += [(r, item, a, numbers[a:b]) for item, a, b in items.candidates(numbers)]
    jobs.sort(key=lambda j: (len(j[3]), len(items.sequences[j[1]])))
    at = 0
    while at < len(jobs):
        # Stretches of one group are at most twice as long as its shortest, so little of the table is padding.
        most = 2 * len(jobs[at][3])
        end = at + 1
        while end < len(jobs) and len(jobs[end][3]) <= most and (end - at + 1) * len(jobs[end][3]) <= CELLS:
            end += 1
        group = jobs[at:end]
        at += len(group)
        queries = [items.sequences[j[1]] for j in group]
        best, end = align(queries, [j[3] for j in group])
        for (r, item, a, stretch), q, score, stop in zip(group, queries, best.tolist(), end.tolist(), strict=True):
            share = score / (MATCH * len(q))
            known = out[r].get(item)
            if score >= items.needed[item] and (known is None or share > known[1]):
                # The same alignment backwards tells where it begins.
                near = stretch[max(0, stop - len(q) - int(items.reach[item])) : stop]
                _, back = align([q[::-1]], [near[::-1]])
                out[r][item] = (items.ids[item], share, a + stop - int(back[0]), a + stop)
    return [sorted(found.values()) for found in out]


def item_blocks(
    benchmark: DataFrame, id_col: str, text_col: str, block: int, block_chars: int = BLOCK_CHARS
) -> Iterator[list[tuple[int, str]]]:
    """The whole items in blocks; the driver holds one block and one partition at a time."""
    item, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    rows = benchmark.filter(item.isNotNull() & text.isNotNull()).select(item, text)
    held: list[tuple[int, str]] = []
    chars = 0
    for r in rows.toLocalIterator():
        if held and chars + len(r[1]) > block_chars:
            yield held
            held, chars = [], 0
        held.append((r[0], r[1]))
        chars += len(r[1])
        if len(held) == block:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _counted(docs: DataFrame, items: Items, text: str) -> Items:
    """The items with their seeds, chosen by how often their grams stand in all documents.

    A task returns one row a gram at most, and the driver gets as many: they are bounded as the block is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(items_size, np.int64)
        for batch in batches:
            for part in slices(batch):
                times += shared.value.count(texts(part, "text"))
        some = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(times[some])], names=["gram", "times"])

    items_size = items.base + len(items.pairs)
    rows = docs.select(F.col(quoted(text)).alias("text")).mapInArrow(run, "gram long, times long")
    found = rows.groupBy("gram").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(items_size, np.int64)
    times[found.column(0).to_numpy()] = found.column(1).to_numpy()
    shared.destroy()
    return items.choose(times)


_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))


def _held(items: Items, rows: list[str]) -> pa.Array:
    return pa.array([[dict(zip(HIT.names, h, strict=True)) for h in hits] for hits in matches(items, rows)], _HITS)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    out: str = "contamination",
    min_score: float = MIN_SCORE,
    block: int = BLOCK_ITEMS,
) -> DataFrame:
    """Append an array of the test items that each whole text holds.

    One block of items takes a pass that counts and one that aligns, and texts aren't shuffled. Of several blocks each writes its hits, a row a
    distinct text that has any, under the checkpoint folder; the documents are joined to them at the end.
    """
    sc = docs.sparkSession.sparkContext
    fields = T.StructType([T.StructField(out, T.ArrayType(HIT))])
    blocks = item_blocks(benchmark, item_id_col, item_text_col, block)
    held, after = next(blocks, []), next(blocks, None)
    if after is None:
        shared = sc.broadcast(_counted(docs, Items(held, min_score), text_col))
        return append_columns(docs, fields, lambda batch: [_held(shared.value, texts(batch, text_col))], "decontam")
    ensure_checkpoint_dir(docs.sparkSession)
    folder = f"{sc.getCheckpointDir()}/contamination-{uuid.uuid4().hex}"
    keys = [F.xxhash64(F.col(quoted(text_col))), F.xxhash64(F.lit(1), F.col(quoted(text_col)))]
    k1, k2, hits = fresh(docs, "text_a", "text_b", "hits")
    rows = docs.select(F.col(quoted(text_col)).alias("text"), *[k.alias(n) for k, n in zip(keys, (k1, k2), strict=True)])
    while held:
        shared = sc.broadcast(_counted(docs, Items(held, min_score), text_col))
        kind = T.StructType([T.StructField(hits, T.ArrayType(HIT))])
        found = append_columns(rows, kind, lambda batch, shared=shared: [_held(shared.value, texts(batch, "text"))], "decontam")
        found.filter(F.size(hits) > 0).select(k1, k2, hits).dropDuplicates([k1, k2]).write.mode("append").parquet(folder)
        shared.destroy()
        held, after = after or [], next(blocks, None)
    schema = T.StructType([T.StructField(k1, T.LongType()), T.StructField(k2, T.LongType()), T.StructField(hits, T.ArrayType(HIT))])
    read = docs.sparkSession.read.schema(schema).parquet(folder)
    by_text = read.groupBy(k1, k2).agg(F.array_sort(F.flatten(F.collect_list(hits))).alias(hits))
    named = docs.withColumns(dict(zip((k1, k2), keys, strict=True))).join(by_text, [k1, k2], "left")
    kept = [F.col(quoted(c)) for c in docs.columns if c != out]
    return named.select(*kept, F.coalesce(F.col(hits), F.array().cast(T.ArrayType(HIT))).alias(out))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no test item; columns stay as they are."""
    (hits,) = fresh(docs, "contamination")
    marked = find_contamination(docs, benchmark, text_col, out=hits)
    return marked.filter(F.size(quoted(hits)) == 0).select(*[F.col(quoted(c)) for c in docs.columns])

"""Removal of repeated stretches: every byte within a stretch that starts in an earlier document too.

Which stretches (windows of `length` bytes) two documents share is decided by sorted suffixes; but only
suffixes that can have a partner are sorted:

1. A window's mark is the least hash of its k-byte substrings. Equal windows have equal marks, and neighbours
   mostly share one, so a document has a mark for every sixteen bytes or so. Runs of windows
   with one mark are segments.
2. Documents lie in groups of hashed ids. A group sends each of its marks once; marks seen in one
   document only are dropped, for no window under them is repeated.
3. For the other marks a group sends each distinct segment once, with its smallest document. The segments of a
   mark meet in one shard, where their windows are sorted as suffixes (see suffix_order), and
   equal ones get the smallest document of all.
4. A group learns which windows of its segments lie in an earlier document, and removes their bytes.

Messages are packed arrays, a row for each group and shard; segments travel compressed. Texts are shuffled once, by group; the exchange is
reused. A mark or segment of a third of all documents is sent once a group, not once a document.

Defined results: a null text is empty; texts shorter than `length` bytes lose nothing; repeated rows of one
id count as one document (none removes from the other); rows with a null id come after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.suffix_order import BASE, PrefixHashes, _mix, classes
from furrow.session import shuffle_width

LENGTH = 50
#: Bytes whose hash makes a mark; windows see LENGTH - MARK_BYTES + 1 of them.
MARK_BYTES = 20
#: Windows of one segment at most, so that a bit mask holds them.
SEGMENT_WINDOWS = 64
#: Bytes of documents whose windows are computed together.
CHUNK_BYTES = 2 << 20
NULL_ID = np.iinfo(np.int64).max


class Group:
    """The documents of one group as one buffer, in the order of id and text."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        rows = sorted((NULL_ID if i is None else i, (t or "").encode("utf-8", "surrogatepass"), i is None) for i, t in zip(ids, texts, strict=True))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.null = [r[2] for r in rows]
        self.texts = [r[1] for r in rows]
        self.raw = b"".join(self.texts)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def windows(self, length: int, mark_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments: mark, first window, number of windows. Works through the documents a few MB at a time."""
        found, at = [], 0
        while at < len(self.sizes):
            end = max(at + 1, int(np.searchsorted(self.begin, self.begin[at] + CHUNK_BYTES)))
            found.append(self._windows(at, end, length, mark_bytes))
            at = end
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none.astype(np.uint64), none, none)

    def _windows(self, at: int, end: int, length: int, mark_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offset, sizes = int(self.begin[at]), self.sizes[at:end]
        begin = self.begin[at:end] - offset
        data = np.frombuffer(self.raw, np.uint8, int(sizes.sum()), offset) if sizes.any() else np.zeros(0, np.uint8)
        if len(data) < length:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none
        sums = PrefixHashes(data).sums
        n = len(data) - mark_bytes + 1
        # Divided by the power of its place a stretch's hash doesn't depend on it: BASE is odd.
        least = _mix((sums[mark_bytes:] - sums[:n]) * _inverse_powers(n))
        span, have = length - mark_bytes + 1, 1
        while have * 2 <= span:
            least = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        # least[s] is the mark of window s; windows that run over a document's end don't count.
        long = sizes >= length
        edge = np.zeros(len(least) + 1, np.int8)
        np.add.at(edge, begin[long], 1)
        np.add.at(edge, begin[long] + sizes[long] - length + 1, -1)
        inside = np.cumsum(edge[: len(least)], dtype=np.int8) > 0
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        change[begin[long]] = True
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, len(least)))
        keep = inside[first]
        first, count = first[keep], count[keep]
        if len(count) and count.max() > SEGMENT_WINDOWS:
            parts = -(-count // SEGMENT_WINDOWS)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, whole = np.repeat(first, parts) + nth * SEGMENT_WINDOWS, np.repeat(count, parts)
            count = np.minimum(SEGMENT_WINDOWS, whole - nth * SEGMENT_WINDOWS)
        return least[first], first + offset, count

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The document of each place."""
        return np.searchsorted(self.begin + self.sizes, at, side="right")


_INVERSE = [np.ones(1, np.uint64)]


def _inverse_powers(n: int) -> np.ndarray:
    if len(_INVERSE[0]) < n:
        steps = np.full(1 << (n - 1).bit_length(), np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
        steps[0] = 1
        _INVERSE[0] = np.multiply.accumulate(steps)
    return _INVERSE[0][:n]


class Shared:
    """The distinct segments of a group under shared marks; equal calls give equal numbers."""

    def __init__(self, group: Group, marks: np.ndarray, length: int, mark_bytes: int):
        mark, first, count = group.windows(length, mark_bytes)
        hit = np.flatnonzero(_member(mark, marks))
        self.mark, self.first, self.count = mark[hit], first[hit], count[hit]
        self.doc = group.owner(self.first)
        raw, ends = group.raw, (self.first + self.count + length - 1).tolist()
        known: dict[tuple[int, bytes], int] = {}
        put = known.setdefault
        number = [put((m, raw[a:b]), len(known)) for m, a, b in zip(self.mark.tolist(), self.first.tolist(), ends, strict=True)]
        self.number = np.array(number, np.int64)
        #: The first segment of each number; documents come by id, so it has the smallest document.
        self.leader = np.unique(self.number, return_index=True)[1]


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, one after the other."""
    return len(arrays[0]).to_bytes(8, "little") + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in kinds:
        a = np.frombuffer(blob, kind, n, at)
        at += a.nbytes
        out.append(a)
    return out, blob[at:]


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(s)).tolist(), strict=True):
        yield int(s[a]), order[a:b]


def _first_of_windows(
    raw: bytes, begin: np.ndarray, size: np.ndarray, count: np.ndarray, group: np.ndarray, ids: np.ndarray, length: int
) -> Iterator[np.ndarray]:
    """For each window of the segments the smallest id among equal windows of its group, segment by segment.

    Whole groups are sorted a few MB at a time.
    """
    total = np.cumsum(size)
    new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    at = 0
    while at < len(new):
        a = int(new[at])
        fit = int(np.searchsorted(total[np.append(new[1:], len(group)) - 1], total[a] - size[a] + CHUNK_BYTES, side="right"))
        at = max(at + 1, fit)
        b = int(new[at]) if at < len(new) else len(group)
        data = np.frombuffer(b"".join([raw[x : x + n] for x, n in zip(begin[a:b].tolist(), size[a:b].tolist(), strict=True)]), np.uint8)
        here = np.cumsum(size[a:b]) - size[a:b]
        owner = np.repeat(np.arange(b - a), count[a:b])
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
        cls = classes(PrefixHashes(data), here[owner] + nth, group[a:b][owner], length)
        first = np.full(int(cls.max()) + 1, NULL_ID, np.int64)
        np.minimum.at(first, cls, ids[a:b][owner])
        yield first[cls]


def _messages(rows: list[tuple[int, int, bytes]], names: tuple[str, str] = ("to", "from")) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=[*names, "blob"])


_MESSAGE = "to long, from long, blob binary"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, mark_bytes: int = MARK_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): what is left of each document's bytes."""
    groups = shuffle_width(df.sparkSession, df, mb_each=24)
    # As many shards as groups: messages are few and large, and never more than there are marks.
    shards = groups
    docs = df.select(
        F.pmod(F.xxhash64(id_col), F.lit(groups)).alias("g"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )

    def read(table: pa.Table) -> Group:
        return Group(table.column("id").to_pylist(), table.column("text").to_pylist())

    def send_marks(key: tuple, table: pa.Table) -> pa.Table:
        group = read(table)
        mark, first, _ = group.windows(length, mark_bytes)
        ids = group.ids[group.owner(first)]
        order = np.lexsort((ids, mark))
        mark, ids = mark[order], ids[order]
        new = np.flatnonzero(np.append(True, mark[1:] != mark[:-1])) if len(mark) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(mark)) - 1
        many = (ids[new] != ids[last]).astype(np.uint8)
        mark = mark[new]
        g = key[0].as_py()
        return _messages([(s, g, _pack(mark[i], many[i])) for s, i in _by_shard((mark % np.uint64(shards)).astype(np.int64))])

    def share_marks(key: tuple, table: pa.Table) -> pa.Table:
        senders, blobs = table.column("from").to_pylist(), table.column("blob").to_pylist()
        parts = [_unpack(b, "<u8", "u1")[0] for b in blobs]
        mark, many = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        sender = np.repeat(np.array(senders, np.int64), [len(p[0]) for p in parts])
        order = np.argsort(mark, kind="stable")
        mark, many, sender = mark[order], many[order], sender[order]
        new = np.append(True, mark[1:] != mark[:-1])
        run = np.cumsum(new) - 1
        times = np.bincount(run)
        shared = (times > 1) | (np.bincount(run, many) > 0)
        hit = np.flatnonzero(shared[run])
        return _messages([(g, key[0].as_py(), _pack(mark[hit][i])) for g, i in _by_shard(sender[hit])])

    def marks_of(blobs: list[bytes]) -> np.ndarray:
        return np.sort(np.concatenate([np.zeros(0, np.uint64), *(_unpack(b, "<u8")[0][0] for b in blobs)]))

    def send_segments(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _messages([])
        group = read(left)
        shared = Shared(group, marks_of(right.column("blob").to_pylist()), length, mark_bytes)
        lead = shared.leader
        mark, first, count = shared.mark[lead], shared.first[lead], shared.count[lead].astype(np.uint8)
        ids = group.ids[shared.doc[lead]]
        out = []
        for s, i in _by_shard((mark % np.uint64(shards)).astype(np.int64)):
            texts = b"".join([group.raw[a : a + c + length - 1] for a, c in zip(first[i].tolist(), count[i].tolist(), strict=True)])
            out.append((s, key[0].as_py(), _pack(mark[i], ids[i], i.astype(np.int32), count[i]) + zstandard.compress(texts, 3)))
        return _messages(out)

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        senders, blobs = table.column("from").to_pylist(), table.column("blob").to_pylist()
        parts = [_unpack(b, "<u8", "<i8", "<i4", "u1") for b in blobs]
        mark, ids, number, count = (np.concatenate([p[0][k] for p in parts]) for k in range(4))
        sender = np.repeat(np.array(senders, np.int64), [len(p[0][0]) for p in parts])
        raw = b"".join(zstandard.decompress(p[1]) for p in parts)
        count = count.astype(np.int64)
        size = count + length - 1
        begin = np.cumsum(size) - size
        # Equal segments are one; a mark whose segments are all equal needs no sorting.
        known: dict[tuple[int, bytes], int] = {}
        put = known.setdefault
        same = np.array([put((m, raw[a : a + n]), len(known)) for m, a, n in zip(mark.tolist(), begin.tolist(), size.tolist(), strict=True)], np.int64)
        lead = np.unique(same, return_index=True)[1]
        least = np.full(len(lead), NULL_ID, np.int64)
        np.minimum.at(least, same, ids)
        order = np.argsort(mark[lead], kind="stable")
        by_mark = mark[lead][order]
        new = np.append(True, by_mark[1:] != by_mark[:-1])
        run = np.cumsum(new) - 1
        several = np.bincount(run)[run] > 1
        mask = np.zeros(len(mark), np.uint64)
        whole = np.where(count >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << count.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
        mask[least[same] < ids] = whole[least[same] < ids]
        chosen = order[several]
        if len(chosen):
            seg = lead[chosen]
            first = np.concatenate(list(_first_of_windows(raw, begin[seg], size[seg], count[seg], run[several], least[chosen], length)))
            window_first = np.zeros(len(lead), np.int64)
            # Each segment's windows lie together: where its row begins among them.
            window_first[chosen] = np.cumsum(count[seg]) - count[seg]
            sorted_too = np.zeros(len(lead), bool)
            sorted_too[chosen] = True
            rows = np.flatnonzero(sorted_too[same])
            r_owner = np.repeat(np.arange(len(rows)), count[rows])
            r_nth = np.arange(len(r_owner)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
            earlier = first[window_first[same[rows]][r_owner] + r_nth] < ids[rows][r_owner]
            bits = np.where(earlier, np.uint64(1) << r_nth.astype(np.uint64), np.uint64(0))
            got = np.zeros(len(rows), np.uint64)
            np.bitwise_or.at(got, r_owner, bits)
            mask[rows] |= got
        hit = np.flatnonzero(mask)
        return _messages([(g, key[0].as_py(), _pack(number[hit][i], mask[hit][i])) for g, i in _by_shard(sender[hit])])

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        group = read(left)
        covered = np.zeros(len(group.raw) + 1, np.int8)
        kinds = right.column("kind").to_pylist() if right.num_rows else []
        blobs = right.column("blob").to_pylist() if right.num_rows else []
        marks = marks_of([b for k, b in zip(kinds, blobs, strict=True) if k == 0])
        if len(marks):
            shared = Shared(group, marks, length, mark_bytes)
            masks = np.zeros(len(shared.leader), np.uint64)
            for k, b in zip(kinds, blobs, strict=True):
                if k == 1:
                    (number, mask), _ = _unpack(b, "<i4", "<u8")
                    masks[number] = mask
            # A later document of the group with the very segment: all its windows are repeated.
            ids = group.ids[shared.doc]
            later = ids > ids[shared.leader][shared.number]
            owner = np.repeat(np.arange(len(shared.first)), shared.count)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(shared.count) - shared.count, shared.count)
            hit = later[owner] | ((masks[shared.number][owner] >> nth.astype(np.uint64)) & np.uint64(1) == 1)
            at = np.sort((shared.first[owner] + nth)[hit])
            # Windows that overlap or touch are one run, so starts and ends are all different.
            head = np.append(True, at[1:] > at[:-1] + length) if len(at) else np.zeros(0, bool)
            covered[at[head]] += 1
            covered[at[np.append(head[1:], True)] + length if len(at) else at] -= 1
        gone = np.cumsum(covered[:-1], dtype=np.int8) > 0
        data = np.frombuffer(group.raw, np.uint8)
        out = []
        for k, (a, n) in enumerate(zip(group.begin.tolist(), group.sizes.tolist(), strict=True)):
            g = gone[a : a + n]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(n > 0 and g[0])
            out.append((None if group.null[k] else int(group.ids[k]), n, int(np.count_nonzero(g)), spans, data[a : a + n][~g].tobytes()))
        kinds_out = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_out, strict=True)] if out else [pa.array([], k) for k in kinds_out],
                        names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    marks = docs.groupBy("g").applyInArrow(send_marks, _MESSAGE).groupBy("to").applyInArrow(share_marks, _MESSAGE)
    segments = docs.groupBy("g").cogroup(marks.groupBy("to")).applyInArrow(send_segments, _MESSAGE)
    verdicts = segments.groupBy("to").applyInArrow(judge, _MESSAGE)
    replies = marks.withColumn("kind", F.lit(0)).unionByName(verdicts.withColumn("kind", F.lit(1)))
    return docs.groupBy("g").cogroup(replies.groupBy("to")).applyInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")

"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece exactly one valid encoding exists, and dropping its last token leaves
the valid encoding of a shorter prefix. So one number for each prefix, its last token, describes
the encodings of all prefixes. A token t ending at i is the last token of prefix i just when the
pair (last token before t, t) stays apart under the merges, which a pair test decides by undoing
the merges on both sides of the border. Appends extend the table; after an edit only entries near
it change until the table falls into step again.

Defined results: a null text encodes as an empty one (no ids, empty bytes); repeated rows give
equal rows; texts and pieces of any length are encoded whole, in time linear in their length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from furrow.llm.common import append_columns, resident, texts
from furrow.llm.pretokens import Memory, Pieces, chunks, single

#: A vocabulary file is broadcast; larger ones are refused.
VOCABULARY_BYTES = 64 << 20

#: Pairs of tokens whose test one process remembers before it starts anew, at about 110 bytes each.
PAIRS = 400_000

#: Bytes of one generation of an encoder's memory: corpora repeat their rare words late.
MEMORY_BYTES = 64 << 20


class Vocabulary:
    """Ranked byte strings, how each came about, and which pairs of them stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        for token, rank in ranks.items():
            self.halves[rank] = self._last_merge(token, rank)
        #: Tokens that the merges really produce from their own bytes.
        self.reached = {t: r for t, r in ranks.items() if len(t) == 1 or self.halves[r]}
        #: Yields the tokens that end at each byte of a piece, in one pass.
        self.ends = ahocorasick.Automaton()
        for token, rank in self.reached.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()
        self._apart: dict[int, bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        parts = [token[i : i + 1] for i in range(len(token))]
        ranks = self.ranks
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between two adjacent tokens alone."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > PAIRS:
                self._apart.clear()
            known = self._apart[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        # Walk back in time: undo the later of the two merges, and see whether a merge across the
        # border would have come before the merge that was undone last.
        name, ranks, halves = self.bytes_of, self.ranks, self.halves
        before, first_was_left = None, False
        while True:
            across = ranks.get(name[left] + name[right])
            # Equal ranks: the left one of two equal merges comes first.
            if across is not None and (before is None or across < before or (across == before and not first_was_left)):
                return False
            undo_left = halves[left] is not None and (halves[right] is None or left > right)
            if undo_left:
                before, first_was_left = left, True
                left = halves[left][1]
            elif halves[right] is not None:
                before, first_was_left = right, False
                right = halves[right][0]
            else:
                return True


class PrefixTable:
    """The last token of every prefix of one piece, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = piece
        self.last = last = [-1] * (len(piece) + 1)
        known, apart = vocabulary._apart, vocabulary.apart
        for at, (length, token) in vocabulary.ends.iter(piece.decode("latin-1")):
            end = at + 1
            if last[end] < 0:
                if length <= at:
                    before = last[end - length]
                    stays = known.get(before << 32 | token)
                    if stays is False or (stays is None and not apart(before, token)):
                        continue
                last[end] = token
        if min(last[1:], default=0) < 0:
            raise ValueError("the vocabulary lacks a single byte")

    def _token_at(self, piece: bytes, last: list[int], end: int) -> int:
        v = self.vocabulary
        reached, apart = v.reached, v.apart
        for start in range(max(0, end - v.longest), end):
            token = reached.get(piece[start:end])
            if token is not None and (start == 0 or apart(last[start], token)):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def append(self, more: bytes) -> None:
        """Exact: the entries so far stay as they are."""
        begin = len(self.piece) + 1
        self.piece += more
        for end in range(begin, len(self.piece) + 1):
            self.last.append(self._token_at(self.piece, self.last, end))

    def edit(self, at: int, drop: int, insert: bytes) -> int:
        """Replace `drop` bytes at `at`; returns how many entries were computed anew.

        An entry depends on the bytes and entries of the longest token's length before it; after
        so many entries in step with the old ones, all later ones are the old ones too.
        """
        old, shift = self.last, len(insert) - drop
        piece = self.piece[:at] + insert + self.piece[at + drop :]
        last = old[: at + 1]
        same, reach = 0, self.vocabulary.longest
        end = at + 1
        while end <= len(piece):
            last.append(self._token_at(piece, last, end))
            moved = end - shift
            same = same + 1 if end > at + len(insert) and last[end] == old[moved] else 0
            end += 1
            if same > reach:
                break
        done = end - at - 1
        last.extend(old[end - shift :])
        self.piece, self.last = piece, last
        return done

    def ids(self) -> list[int]:
        """The encoding of the whole piece."""
        out, end = [], len(self.piece)
        name = self.vocabulary.bytes_of
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(name[token])
        return out[::-1]


class Encoder:
    """Texts to ids, with a bounded memory of chunks, and ids to bytes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pieces = Pieces(pattern)
        #: Whether the pattern takes words as `single` does.
        self.words = r"| ?\p{L}+|" in pattern
        self.memory = Memory(MEMORY_BYTES)
        size = max(vocabulary.bytes_of) + 1
        self.lengths = np.zeros(size, np.int64)
        for rank, token in vocabulary.bytes_of.items():
            self.lengths[rank] = len(token)
        self.starts = np.zeros(size + 1, np.int64)
        np.cumsum(self.lengths, out=self.starts[1:])
        self.blob = np.frombuffer(b"".join(vocabulary.bytes_of.get(r, b"") for r in range(size)), np.uint8)

    def piece_ids(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.vocabulary.ranks.get(raw)
        return array("i", [whole] if whole is not None else PrefixTable(self.vocabulary, raw).ids()).tobytes()

    def chunk_ids(self, chunk: str) -> bytes:
        if self.words and single(chunk):
            return self.piece_ids(chunk)
        pieces = self.pieces(chunk)
        if len(pieces) == 1:
            return self.piece_ids(chunk)
        out = []
        for piece in pieces:
            ids = self.memory.get(piece)
            if ids is None:
                ids = self.piece_ids(piece)
                self.memory.put(piece, ids)
            out.append(ids)
        return b"".join(out)

    def encode_all(self, rows: list[str]) -> list[bytes]:
        """The ids of each text as native 32-bit integers; each distinct chunk is looked up once."""
        split = [chunks(text) for text in rows]
        memory, known = self.memory, {}
        for chunk in set().union(*split):
            ids = memory.get(chunk)
            if ids is None:
                ids = self.chunk_ids(chunk)
                memory.put(chunk, ids)
            known[chunk] = ids
        of = known.__getitem__
        return [b"".join(map(of, own)) for own in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a flat array of ids."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)]


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: on each line a token in base 64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def encoder(raw: bytes, pattern: str) -> Encoder:
    """One encoder for each worker process, until another vocabulary or operator takes its place."""
    key = ("bpe", hashlib.sha256(raw).hexdigest(), pattern)
    return resident(key, lambda: Encoder(Vocabulary(read_ranks(raw)), pattern))


def _shared(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary is larger than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


def _encoded(enc: Encoder, rows: list[str]) -> pa.ListArray:
    coded = enc.encode_all(rows)
    ends = np.zeros(len(coded) + 1, np.int32)
    np.cumsum([len(c) // 4 for c in coded], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def _decoded(enc: Encoder, column: pa.ListArray) -> pa.Array:
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    data = enc.decode(ids)
    at = np.concatenate([[0], np.cumsum(enc.lengths[ids])])
    ends = at[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "token_ids", decoded_out: str | None = None
) -> DataFrame:
    """Append the ids of each whole text as array<int>, and in the same pass, if asked, the bytes that those ids decode to."""
    raw = _shared(df.sparkSession, ranks_path)
    fields = [T.StructField(out, T.ArrayType(T.IntegerType()))]
    if decoded_out is not None:
        fields.append(T.StructField(decoded_out, T.BinaryType()))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        enc = encoder(raw.value, pattern)
        ids = _encoded(enc, texts(batch, text_col))
        return [ids] if decoded_out is None else [ids, _decoded(enc, ids)]

    return append_columns(df, T.StructType(fields), run, "bpe")


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Append the bytes that the ids stand for; a null list decodes as an empty one."""
    raw = _shared(df.sparkSession, ranks_path)
    fields = T.StructType([T.StructField(out, T.BinaryType())])
    return append_columns(df, fields, lambda batch: [_decoded(encoder(raw.value, pattern), batch.column(ids_col))], "bpe")

"""Token counts by rank-synchronous merging of many pieces at once.

The pieces of a batch that are not yet known lie in one ragged array of symbols. In each round every
piece finds its lowest-ranked pair, and all places that hold that pair merge at once (of overlapping
ones each second, from the left). A piece whose pairs have no rank is done; its surviving
symbols are its count.

Defined results: a null text counts as an empty one (0 tokens, 0 bytes); repeated rows give equal
rows; texts of any length are counted whole. Strings of special tokens inside a text count as one
token each, as the tokenizer file's library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.common import append_columns, resident, texts
from furrow.llm.pretokens import Memory, Pieces, chunks

VOCABULARY_BYTES = 64 << 20
NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Pair -> rank and product, as sorted arrays for vectorised lookup."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        made = set(self.byte_ids.tolist())
        keys, products = [], []
        for a, b in merges:
            left, right, product = vocab[a], vocab[b], vocab[a + b]
            # Merging all places of a pair at once is exact only if no pair with its product ranks lower.
            if left not in made or right not in made:
                raise ValueError("a merge uses a symbol that no earlier merge makes")
            made.add(product)
            keys.append(left * self.size + right)
            products.append(product)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = order.astype(np.int64)
        self.products = np.array(products, np.int64)[order]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK if there is none) and index of each pair."""
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NO_RANK), at

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each piece."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        out = lengths.copy()
        owner = np.repeat(np.arange(len(pieces)), lengths)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(symbols) > 1:
            inside = owner[1:] == owner[:-1]
            rank, at = self.lookup(symbols[:-1], symbols[1:])
            rank[~inside] = NO_RANK
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            # The pair at i belongs to the piece of symbol i; the last symbol has none.
            lowest = np.minimum.reduceat(np.append(rank, NO_RANK), first)
            spans = np.diff(np.append(first, len(symbols)))
            merging = np.append((rank == np.repeat(lowest, spans)[:-1]) & (rank != NO_RANK), False)
            # Overlapping places: of a run of hits take the first, third, ...
            hits = np.flatnonzero(merging)
            starts = np.append(True, np.diff(hits) > 1) if len(hits) else np.zeros(0, bool)
            run = np.flatnonzero(starts)
            place = np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))
            hits = hits[place % 2 == 0]
            symbols[hits] = self.products[at[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            # Pieces without a ranked pair are done.
            still = np.repeat(lowest != NO_RANK, spans)
            done = first[lowest == NO_RANK]
            out[owner[done]] = spans[lowest == NO_RANK]
            keep &= still
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols) == 1:
            out[owner[0]] = 1
        return out


class Counter:
    """Counts the tokens of texts under one tokenizer file."""

    #: Pieces that are merged together, so that the arrays stay small.
    BATCH = 50_000

    def __init__(self, raw: bytes, pattern: str):
        spec = json.loads(raw)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or spec["normalizer"] or model["ignore_merges"] or split["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pieces = Pieces(pattern)
        self.memory = Memory()

    def parts(self, text: str) -> tuple[list[str], int]:
        """The chunks between special tokens, and how many of those there are."""
        if self.special is None or not self.special.search(text):
            return chunks(text), 0
        between = self.special.split(text)
        return [c for part in between for c in chunks(part)], len(between) - 1

    def count(self, rows: list[str]) -> list[int]:
        """The number of tokens of each text."""
        split = [self.parts(text) for text in rows]
        known: dict[str, int] = {}
        missing: list[str] = []
        for chunk in {c for part, _ in split for c in part}:
            n = self.memory.get(chunk)
            if n is None:
                missing.append(chunk)
            else:
                known[chunk] = n
        for at in range(0, len(missing), self.BATCH):
            group = missing[at : at + self.BATCH]
            cut = [self.pieces(chunk) for chunk in group]
            new = list({p for pieces in cut for p in pieces})
            size = dict(zip(new, self.merges.counts([p.encode() for p in new]).tolist(), strict=True))
            for chunk, pieces in zip(group, cut, strict=True):
                known[chunk] = n = sum([size[p] for p in pieces])
                self.memory.put(chunk, n)
        return [sum(map(known.__getitem__, part)) + extra for part, extra in split]


def counter(raw: bytes, pattern: str) -> Counter:
    """One counter for each worker process, until another file or operator takes its place."""
    key = ("token_count", hashlib.sha256(raw).hexdigest(), pattern)
    return resident(key, lambda: Counter(raw, pattern))


def count_tokens(df: DataFrame, tokenizer_path: str, pattern: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Append the number of tokens of each whole text; one pass, no shuffle."""
    with open(tokenizer_path, "rb") as f:
        content = f.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"the tokenizer file is larger than {VOCABULARY_BYTES} bytes")
    raw = df.sparkSession.sparkContext.broadcast(content)
    fields = T.StructType([T.StructField(out, T.LongType())])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(counter(raw.value, pattern).count(texts(batch, text_col)), pa.int64())]

    return append_columns(df, fields, run, "token_count")

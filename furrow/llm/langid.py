"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton holds labelled text. A document is parsed into phrases, each the
longest match that the automaton allows; the fewer phrases, the more alike the text. Phrases times
log2 of the training length over the text's length estimate the cross entropy in bits a symbol; the
language with the lowest estimate wins, ties go to the smaller name.

The failure moves are folded into a table state x symbol -> (next state, phrases ended), so that
numpy can parse many blocks of text in step. All blocks start in the empty state at first; then those that another state
enters are parsed again from that state until they fall into step with the first pass, which soon happens. So the
phrases are those of one parse of the whole text.

Defined results: null text, empty text and text without a letter are `und` with score 0, as is all
text if nothing could be learned; repeated rows get equal rows; texts of any length are read whole.
Score is the second-best estimate over the sum of the two best: 0.5 is a tie, 1.0 a lone language.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import append_columns, quoted, resident, texts

UNKNOWN = "und"
#: Bounds of the sample that is learned from: labelled rows a language, and their characters together. Rows are learned whole, so
#: those go first that take a sixteenth of the characters at most; a language whose shortest row is over the bound is learned from this row alone.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 40_960
#: Letters with a symbol of their own; the rest share BUCKETS symbols.
LETTERS, BUCKETS = 160, 16
BLOCK = 2_048
_POINTS = 0x32400  # beyond it no letters are assigned


def _letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(_POINTS):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_LETTER: list[np.ndarray] = []


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters; each run of other characters is one 0."""
    if not _LETTER:
        _LETTER.append(_letter_table())
    return _read(text, _LETTER[0])


def _read(text: str, table: np.ndarray) -> np.ndarray:
    """The table's values for the text's characters, runs of 0 as one."""
    found = table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    return found[keep]


class SuffixAutomaton:
    """All substrings of one sequence; state 0 is the empty one."""

    def __init__(self, sequence: list[int]):
        self.moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        moves = self.moves
        for symbol in sequence:
            new = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and symbol not in moves[p]:
                moves[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = moves[p][symbol]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and moves[p].get(symbol) == q:
                        moves[p][symbol] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new


class Parser:
    """One language: the automaton with its failure moves folded in."""

    def __init__(self, sequence: np.ndarray, width: int):
        moves = SuffixAutomaton(sequence.tolist()).moves
        self.width, self.bits = width, float(np.log2(max(2, len(sequence))))
        # value = row offset of the next state * 4 + phrases that end here
        fail = np.full(width, 2, np.int64)
        for symbol, state in moves[0].items():
            fail[symbol] = state * width * 4 + 1
        table = np.tile(fail.astype(np.int32 if len(moves) * width * 4 < 2**31 else np.int64), (len(moves), 1))
        table[0] = np.where(fail == 2, 1, fail - 1)
        for state, row in enumerate(moves):
            for symbol, to in row.items():
                table[state, symbol] = to * width * 4
        self.table = table.reshape(-1)

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Phrases of each block; blocks come with the longest first. `before` names the block of the same text that a
        block goes on from, -1 at a beginning; what is open at a text's end counts there."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.int64)
        before = np.full(n, -1) if before is None else before
        # Step j is held by the blocks longer than j, one after another from at[j] on.
        active = n - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), side="right")
        at = np.concatenate([[0], np.cumsum(active)])
        trace, ended = np.zeros(at[-1], self.table.dtype), np.zeros(at[-1], np.int8)
        state = np.zeros(n, self.table.dtype)
        for j, k in enumerate(active.tolist()):
            found = self.table[state[:k] + symbols[starts[:k] + j]]
            ended[at[j] : at[j + 1]] = found & 3
            np.right_shift(found, 2, out=state[:k])
            trace[at[j] : at[j + 1]] = state[:k]
        last = at[lengths - 1] + np.arange(n)
        entered = np.zeros(n, self.table.dtype)
        while True:
            wanted = np.where(before >= 0, trace[last[before]], 0)
            block = np.flatnonzero(wanted != entered)
            if not len(block):
                break
            entered[block] = state = wanted[block]
            j = 0
            while len(block):
                found = self.table[state + symbols[starts[block] + j]]
                place = at[j] + block
                state = found >> 2
                ended[place] = found & 3
                other = trace[place] != state
                trace[place] = state
                j += 1
                other &= lengths[block] > j
                block, state = block[other], state[other]
        owner = np.arange(at[-1]) - np.repeat(at[:-1], active)
        count = np.bincount(owner, ended, minlength=n).astype(np.int64)
        goes_on = np.zeros(n, bool)
        goes_on[before[before >= 0]] = True
        return count + (~goes_on & (trace[last] > 0))


class Model:
    """What was learned: language names, the alphabet and the sequences; picklable and small."""

    def __init__(self, samples: dict[str, list[str]]):
        read = {}
        for lang, rows in sorted(samples.items()):
            whole = np.concatenate([np.append(letters_of(t), 0).astype(np.uint32) for t in rows] or [np.zeros(0, np.uint32)])
            if whole.any():
                read[lang] = whole
        self.langs = list(read)
        seen, times = np.unique(np.concatenate([*read.values(), np.zeros(0, np.uint32)]), return_counts=True)
        order = np.lexsort((seen, -times))
        self.alphabet = np.sort([c for c in seen[order].tolist() if c][:LETTERS]).astype(np.uint32)
        self.width = 1 + len(self.alphabet) + BUCKETS
        self.sequences = [self.symbols(s) for s in read.values()]

    def symbols(self, letters: np.ndarray) -> np.ndarray:
        """0 for a gap, 1.. for letters of the alphabet, the last BUCKETS for all others."""
        at = np.minimum(np.searchsorted(self.alphabet, letters), max(0, len(self.alphabet) - 1))
        known = self.alphabet[at] == letters if len(self.alphabet) else np.zeros(len(letters), bool)
        other = len(self.alphabet) + 1 + letters % BUCKETS
        return np.where(letters == 0, 0, np.where(known, at + 1, other)).astype(np.int32)

    def tables(self) -> tuple[list[Parser], np.ndarray]:
        """The parsers, and for each character its symbol; 0 is what is no letter."""
        return [Parser(s, self.width) for s in self.sequences], self.symbols(_letter_table()).astype(np.uint16)

    def predict(self, rows: list[str], tables: tuple[list[Parser], np.ndarray] | None = None) -> tuple[list[str], list[float]]:
        parsers, letters = tables or self.tables()
        read = [_read(t, letters) for t in rows]
        sizes = np.array([len(r) for r in read], np.int64)
        has = np.array([bool(r.any()) for r in read], bool)
        if not self.langs or not has.any():
            return [UNKNOWN] * len(rows), [0.0] * len(rows)
        flat = np.concatenate(read)
        # blocks of each document
        n_blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(rows)), n_blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        starts = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
        lengths = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        order = np.argsort(-lengths, kind="stable")
        # a text's blocks follow each other before they are ordered
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(nth > 0, np.append(0, place[:-1]), -1)[order]
        owner, starts, lengths = owner[order], starts[order], lengths[order]
        rates = np.stack([
            np.bincount(owner, p.phrases(flat, starts, lengths, before), minlength=len(rows)) * p.bits / np.maximum(sizes, 1) for p in parsers
        ])
        best = np.argmin(rates, axis=0)
        least = np.sort(rates, axis=0)
        second = least[1] if len(self.langs) > 1 else np.full(len(rows), np.inf)
        total = least[0] + second
        score = np.where(np.isinf(second), 1.0, second / np.where((total > 0) & ~np.isinf(total), total, 1.0))
        langs = [self.langs[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return langs, np.where(has, score, 0.0).tolist()


def learnable(id_col: str) -> Column:
    """Rows that may be learned from; the others are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
) -> Model:
    """Learn from a bounded sample of the learnable rows, each of them whole.

    Of each language the rows of up to a sixteenth of `sample_chars` come first, by a hash of the id, then longer ones by length; of these
    `sample_rows` those are taken that still fit into `sample_chars`, and the first one always. Ids, languages and lengths are ranked only, with
    the limit pushed before the shuffle; the texts of the few chosen rows go to the driver.
    """
    id_, lang, text = (F.col(quoted(c)) for c in (id_col, lang_col, text_col))
    rows = docs.select(id_.alias("id"), lang.cast("string").alias("lang"), text.alias("text"))
    rows = rows.filter(learnable("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ranked = rows.select("id", "lang", F.length("text").alias("chars"), F.xxhash64("text").alias("mark"))
    over = F.greatest(F.col("chars") - sample_chars // 16, F.lit(0))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(over, F.xxhash64("id"), "id", "mark"))
    near = ranked.withColumn("nth", nth).filter(F.col("nth") <= sample_rows)
    left: dict[str, int] = {}
    chosen = []
    for r in sorted(near.collect(), key=lambda r: (r.lang, r.nth)):
        if r.lang not in left or r.chars <= left[r.lang]:
            left[r.lang] = left.get(r.lang, sample_chars) - r.chars
            chosen.append((r.id, r.lang, r.mark))
    if not chosen:
        return Model({})
    wanted = docs.sparkSession.createDataFrame(chosen, T.StructType([ranked.schema[c] for c in ("id", "lang", "mark")]))
    sample = rows.withColumn("mark", F.xxhash64("text")).join(F.broadcast(wanted.distinct()), ["id", "lang", "mark"], "left_semi")
    samples: dict[str, list[str]] = {}
    for r in sorted(sample.select("lang", F.xxhash64("id").alias("h"), "id", "text").distinct().collect(), key=lambda r: (r.lang, r.h, r.id, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return Model(samples)


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """Append language and score of each whole text; one pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    key = ("langid", hashlib.sha256(pickle.dumps((model.langs, model.alphabet, model.sequences))).hexdigest())
    fields = T.StructType([T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        langs, scores = model.predict(texts(batch, text_col), resident(key, model.tables))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(df, fields, run, "langid")

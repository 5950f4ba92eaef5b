"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, and put in the order a model learns to fill in.

A text is decoded to an array of code points (UTF-32). A unit is a run of ASCII letters or any other single code point; units
begin where two neighbours aren't both letters, which one comparison of neighbouring classes and `flatnonzero` give.
The cuts are unit ranks drawn from a hash of the id, so they don't depend on partitions or retries.

Defined results: a null text counts as an empty one and stays plain, as do texts that hold a mark; a null id is hashed as an empty
string; repeated rows give equal rows; texts of any length are cut whole. Output columns replace input columns of their name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.common import append_columns, texts


@dataclass(frozen=True)
class Fill:
    """How often texts are cut, how often the suffix comes first, and the marks of the three parts."""

    rate: int = 90
    suffix_first: int = 20
    seed: int = 1
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def draws(self, doc_id: object) -> list[int]:
        """Four numbers of 32 bits from the id."""
        digits = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]

    def apply(self, doc_id: object, text: str) -> tuple[int, str, int | None, int | None, str]:
        """Units, form, code points of prefix and middle (none if plain), output."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        edges = unit_edges(points)
        n = len(edges) - 1
        h1, h2, h3, h4 = self.draws(doc_id)
        if not text or h3 % 100 >= self.rate or any(m in text for m in (self.prefix, self.suffix, self.middle)):
            return n, "plain", None, None, text
        first, last = (int(edges[rank]) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
        head, inner, tail = (points[a:b].tobytes().decode("utf-32-le") for a, b in ((0, first), (first, last), (last, len(points))))
        if h4 % 100 < self.suffix_first:
            return n, "spm", first, last - first, self.suffix + tail + self.prefix + head + self.middle + inner
        return n, "psm", first, last - first, self.prefix + head + self.suffix + tail + self.middle + inner

    def undo(self, form: str, output: str) -> str:
        """The text, from output and form alone. Texts that are cut hold no mark, and no mark overlaps another's end."""
        if form == "plain":
            return output
        leading, second = (self.prefix, self.suffix) if form == "psm" else (self.suffix, self.prefix)
        one, rest = output[len(leading) :].split(second, 1)
        two, inner = rest.split(self.middle, 1)
        return one + inner + two if form == "psm" else two + inner + one


def unit_edges(points: np.ndarray) -> np.ndarray:
    """Where units begin, and the end; no unit, no beginning."""
    letter = (points | 32) - np.uint32(97) < 26  # unsigned: what lies before "a" wraps to large numbers
    inner = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fill: Fill = Fill(), out: str = "output") -> DataFrame:
    """Append n (units), form, prefix_chars, middle_chars and the output text; one pass, no shuffle."""
    kinds = (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), (out, T.StringType()))
    fields = T.StructType([T.StructField(name, kind) for name, kind in kinds])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [fill.apply(i, t) for i, t in zip(batch.column(id_col).to_pylist(), texts(batch, text_col), strict=True)]
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return [pa.array([m[k] for m in made], kind) for k, kind in enumerate(types)]

    return append_columns(df, fields, run, "fill_middle")


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", fill: Fill = Fill(), out: str = "restored") -> DataFrame:
    """Append the text that an output was made of; null outputs or forms give null."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        pairs = zip(batch.column(form_col).to_pylist(), batch.column(output_col).to_pylist(), strict=True)
        return [pa.array([None if f is None or o is None else fill.undo(f, o) for f, o in pairs], pa.string())]

    return append_columns(df, T.StructType([T.StructField(out, T.StringType())]), run, "fill_middle")

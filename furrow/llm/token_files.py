"""Token ids as flat binary files, with 64-bit document offsets, for trainers that map them into memory.

A folder holds, in the order of the documents:

* `ids-*.bin`: token ids one after the other, little-endian and unsigned, 2 bytes each if every id fits, else 4;
* `docs-*.bin`: document ids, 8 bytes each, signed;
* `offsets-*.bin`: where each document's ids begin, counted over the whole folder, and the end; 8 bytes each, unsigned;
* `manifest.json`: the files in order, with the number of ids before each, of its documents and of those with a null id.

Documents are range-partitioned and sorted by id. Each task writes its files while it encodes; prefix sums over the tasks' counts give
the partitions' bases, and a second short pass turns each task's own offsets into offsets of the whole. File names are new for each attempt and the
manifest, written last, names the files of the attempts that count: a lost executor or a second attempt leaves unnamed files only, which
the driver deletes.

The tokenizer library encodes each distinct stretch between spaces and line ends once: no match of the file's pattern and no normalisation
crosses white space, so that is the encoding of the whole text. Files for which this doesn't hold are encoded whole.

Defined results: a null text counts as an empty one (the end id only); documents with a null id come last; documents of one
id are ordered by a hash of their text; repeated rows are written as often as they occur; an empty table makes a manifest without files.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import quoted, resident, slices, texts
from furrow.llm.token_count import byte_letters
from furrow.session import shuffle_width

VOCABULARY_BYTES = 64 << 20
#: Stretches that a worker process remembers, in bytes, before it keeps those of the texts at hand only.
MEMORY_BYTES = 96 << 20
#: Ids that a reader hands on at once.
READ_IDS = 1 << 20
#: A task's share of the texts.
PARTITION_MB = 128


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if folder.startswith("file:/"):
        folder = "/" + folder[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


class Flat:
    """A flat file of numbers: mapped into memory if the file system is local or mounted, else read by ranges."""

    def __init__(self, system: fs.FileSystem, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        if isinstance(system, fs.LocalFileSystem):
            self.items = os.path.getsize(path) // self.dtype.itemsize
            self.mapped = np.memmap(path, self.dtype, "r") if self.items else np.zeros(0, self.dtype)
        else:
            self.mapped, self.file = None, system.open_input_file(path)
            self.items = self.file.size() // self.dtype.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return np.asarray(self.mapped[part])
        begin, end, _ = part.indices(self.items)
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - begin) * width, begin * width), self.dtype)


class Encoder:
    """The library's ids of texts, as bytes of one unsigned width."""

    #: A control character between stretches that are encoded together; a text may hold it too.
    BORDER = "\x02"
    #: Marks that may close a stretch; no match of the pattern begins with one of them and goes on with a letter.
    MARKS = ".,;:!?*#$%&()[]{}+=/|-"

    def __init__(self, raw: bytes, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(raw)
        self.dtype = width(spec, end_id)
        self.end = np.array([end_id], self.dtype).tobytes()
        border = self.tokenizer.encode(self.BORDER, add_special_tokens=False).ids
        #: The id of the border, if stretches may be told apart by it. No other character's bytes give that id.
        self.border = border[0] if len(border) == 1 and drops_white_space(spec) and sys.byteorder == "little" else None
        #: Finds what may begin a special token.
        self.opening = re.compile("|".join(sorted({re.escape(t["content"][0]) for t in spec["added_tokens"]})) or "(?!)").search
        self.code = "H" if self.dtype == "<u2" else "I"
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}
        self.room = MEMORY_BYTES

    def encode(self, rows: list[str]) -> list[bytes]:
        """The ids of each text and the end id."""
        if self.border is None:
            return [self._ids(t) + self.end for t in rows]
        split = [t.replace("\n", " ").split(" ") for t in rows]
        parts = set().union(*split)
        if self.room < 0:  # what these texts need stays
            self.known = {p: self.known[p] for p in parts & self.known.keys()}
            self.room = MEMORY_BYTES - sum(map(self._size, self.known))
        missing = list(parts.difference(self.known))
        for at in range(0, len(missing), 10_000):
            self._learn(missing[at : at + 10_000])
        known = self.known.__getitem__
        return [b"".join(map(known, own)) + self.end for own in split]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Encode many stretches; those that differ in case or in closing marks only, once.

        A form of letters only is one match of the pattern, and the library's model takes it as it is, its bytes as letters. The others
        are encoded in one text, with borders between them.
        """
        known, tokenize, code = self.known, self.tokenizer.model.tokenize, self.code
        forms = [self._form(p) for p in parts]
        others = set()
        for form in forms:
            for p in form:
                if p in known:
                    continue
                if p.isalpha() and p.islower() and (p.isascii() or max(p) <= "\xff"):
                    piece = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
                    known[p] = array(code, [t.id for t in tokenize(piece)]).tobytes()
                    self.room -= self._size(p)
                else:
                    others.add(p)
        plain = [p for p in others if self.BORDER not in p]
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self.BORDER} ".join(plain)], add_special_tokens=False)[0].ids, self.dtype)
        borders = np.flatnonzero(ids == self.border)
        if len(plain) and len(borders) != len(plain) - 1:
            raise ValueError("the tokenizer lost a border")
        raw, step = ids.tobytes(), ids.itemsize
        begins, ends = [0, *((borders + 1) * step).tolist()], [*(borders * step).tolist(), len(raw)]
        known.update((p, raw[a:b]) for p, a, b in zip(plain, begins, ends, strict=False))
        known.update((p, self._ids(p)) for p in others if self.BORDER in p)
        self.room -= sum(map(self._size, others))
        for p, form in zip(parts, forms, strict=True):
            if p not in known:
                known[p] = known[form[0]] if len(form) == 1 else known[form[0]] + known[form[1]]
                self.room -= 200 + 2 * len(p)

    def _form(self, part: str) -> tuple[str, ...]:
        """Stretches whose ids, one after the other, are those of `part`.

        Up to U+00FF a character has one lower-case form and normalisation changes nothing. A run of marks that follows a letter or digit is a match of
        its own. What may hold a special token stays as it is.
        """
        if not (part.isascii() or max(part) <= "\xff") or self.opening(part):
            return (part,)
        core = part.rstrip(self.MARKS)
        if core and len(core) < len(part) and core[-1].isalnum():
            return core.lower(), part[len(core) :]
        return (part.lower(),)

    def _size(self, part: str) -> int:
        """About what an entry takes, its objects and place included."""
        return 200 + 2 * len(part) + len(self.known[part])


def width(spec: dict, end_id: int) -> str:
    """The narrowest type that holds all ids of a tokenizer file."""
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id]
    if min(ids) < 0 or max(ids) >= 1 << 32:
        raise ValueError("ids don't fit 32 unsigned bits")
    return "<u2" if max(ids) < 1 << 16 else "<u4"


def drops_white_space(spec: dict) -> bool:
    """Whether a file drops white space before its merges, so that what lies between spaces can be encoded on its own."""
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": "\\s+"}
        and steps[1]["content"] == " "
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["behavior"] == "Removed"
        and cuts[0]["invert"]
        and cuts[0]["pattern"] == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and not any(set(t["content"]) & set(" \n") or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )


def write_tokens(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every text, write the files to a new folder that all machines share, and return the manifest.

    Texts are shuffled once. The driver holds one row a file.
    """
    spark = df.sparkSession
    with open(tokenizer_path, "rb") as f:
        content = f.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"the tokenizer file is larger than {VOCABULARY_BYTES} bytes")
    dtype, key = width(json.loads(content), end_id), ("token_files", hashlib.sha256(content).hexdigest(), end_id)
    system, top = opened(folder)
    system.create_dir(top, recursive=True)
    raw = spark.sparkContext.broadcast(content)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        docs = nulls = ids = 0
        batch = next(batches, None)
        if batch is None:
            return
        system, top = opened(folder)
        with (
            system.open_output_stream(f"{top}/ids-{name}.bin") as id_file,
            system.open_output_stream(f"{top}/docs-{name}.bin") as doc_file,
            system.open_output_stream(f"{top}/lengths-{name}.bin") as length_file,
        ):
            encoder = resident(key, lambda: Encoder(raw.value, end_id))
            while batch is not None:
                for piece in slices(batch):
                    coded = encoder.encode(texts(piece, "text"))
                    lengths = np.array([len(c) for c in coded], "<u8") // np.dtype(dtype).itemsize
                    id_file.write(b"".join(coded))
                    doc_file.write(piece.column("id").fill_null(0).to_numpy().astype("<i8").tobytes())
                    length_file.write(lengths.tobytes())
                    docs, nulls, ids = docs + len(coded), nulls + piece.column("id").null_count, ids + int(lengths.sum())
                batch = next(batches, None)
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "docs": docs, "nulls": nulls, "ids": ids}])

    rows = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text")).withColumn("mark", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_last(), F.col("mark")]
    # The row's number only parts rows that are equal, so that many of one id don't fill one task.
    spread = rows.withColumn("row", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(shuffle_width(spark, df, PARTITION_MB), *order, F.col("row")).sortWithinPartitions(*order)
    found = sorted(ranged.select("id", "text").mapInArrow(write, "part long, name string, docs long, nulls long, ids long").collect())
    raw.destroy()
    bases = np.cumsum([0] + [r.ids for r in found])
    files = [{"name": r.name, "base": int(b), "docs": r.docs, "nulls": r.nulls, "ids": r.ids} for r, b in zip(found, bases, strict=False)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        for batch in batches:
            for r in batch.to_pylist():
                local = np.cumsum(Flat(system, f"{top}/lengths-{r['name']}.bin", "<u8")[:], dtype=np.uint64)
                name = uuid.uuid4().hex
                with system.open_output_stream(f"{top}/offsets-{name}.bin") as f:
                    f.write((np.concatenate([np.zeros(1, np.uint64), local]) + np.uint64(r["base"])).astype("<u8").tobytes())
                yield pa.RecordBatch.from_pylist([{"name": r["name"], "offsets": name}])

    if files:
        placed = _spread(spark, files).mapInArrow(place, "name string, offsets string").collect()
        offsets = {r.name: r.offsets for r in placed}
        files = [f | {"offsets": offsets[f["name"]]} for f in files]
    manifest = {"dtype": dtype, "end_id": end_id, "docs": sum(f["docs"] for f in files), "ids": int(bases[-1]), "files": files}
    with system.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    named = {"manifest.json"} | {f"{k}-{f['offsets' if k == 'offsets' else 'name']}.bin" for f in files for k in ("ids", "docs", "offsets")}
    for info in system.get_file_info(fs.FileSelector(top)):
        if info.base_name not in named:
            system.delete_file(info.path)
    return manifest


def _spread(spark: SparkSession, files: list[dict]) -> DataFrame:
    """The manifest's rows, one a task."""
    kinds = "name string, base long, docs long, nulls long, ids long" + (", offsets string" if "offsets" in files[0] else "")
    rows = spark.createDataFrame(list(enumerate([tuple(f.values()) for f in files])), f"at int, f struct<{kinds.replace(' ', ':').replace(',:', ',')}>")
    return rows.repartitionByRange(len(files), "at").select("f.*")


def manifest_of(folder: str) -> dict:
    """The manifest of a folder."""
    system, top = opened(folder)
    with system.open_input_stream(f"{top}/manifest.json") as f:
        return json.loads(f.read())


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, token_ids) of every document, from the files; ids as little-endian 32-bit numbers in one binary.

    `np.frombuffer(token_ids, "<u4")` gives the ids. Each file is one task, which hands on bounded stretches.
    """
    manifest = manifest_of(folder)
    schema = "doc_id long, start long, token_ids binary"
    if not manifest["files"]:
        return spark.createDataFrame([], schema)
    dtype = manifest["dtype"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        for batch in batches:
            for r in batch.to_pylist():
                ids = Flat(system, f"{top}/ids-{r['name']}.bin", dtype)
                docs = Flat(system, f"{top}/docs-{r['name']}.bin", "<i8")
                offsets = Flat(system, f"{top}/offsets-{r['offsets']}.bin", "<u8")[:].astype(np.int64)
                at = 0
                while at < r["docs"]:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_IDS, side="right")) - 1)
                    begin = int(offsets[at])
                    some = ids[begin - r["base"] : int(offsets[to]) - r["base"]].astype("<u4")
                    ends = (offsets[at : to + 1] - begin).tolist()
                    null = np.arange(at, to) >= r["docs"] - r["nulls"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[at:to], mask=null),
                            pa.array(offsets[at:to]),
                            pa.array([some[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                        ],
                        names=["doc_id", "start", "token_ids"],
                    )
                    at = to

    return _spread(spark, manifest["files"]).mapInArrow(read, schema)

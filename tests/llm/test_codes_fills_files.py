"""Vector codes, fill-in-middle and token files against slow versions, libraries and round trips."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import check
from tokenizers import Tokenizer

from furrow.llm import fill_middle, queries, token_files, vector_codes
from furrow.llm.fill_middle import Fill

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "\n\n", "a", "é日本 😀", "Don't  STOP\tnow Ǆ ΑΣ ß", "x" * 5000, "the of and " * 400, "<|endoftext|>a <|startoftext|>", "a<P>b", "\x1c\x85 \xa0x", "é ́ à"]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    assert check(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF)


def slow_codes(rows, parts, entries, rounds, scale):
    """(code, error) of each row of whole numbers, and the codebooks, one number at a time."""
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in rows), default=0) // parts) * parts
    whole = [[int(np.floor(x * scale)) for x in v] + [0] * (width - len(v)) for _, v in kept]
    d = width // parts
    cut = [[w[p * d : (p + 1) * d] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: far(c[p], books[p][e])) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == e]
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else books[p][e]
    out = [(k[0], "".join(f"{e:02x}" for e in code), sum(far(c[p], books[p][code[p]]) for p in range(parts))) for k, c, code in zip(kept, cut, codes, strict=True)]
    return out, books


@pytest.mark.parametrize("seed", range(3))
def test_vector_codes(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]), [round(rng.gauss(0, 1), 2) for _ in range(rng.choice([8, 8, 8, 5, 0]))]) for _ in range(80)] + [(7, [0.5] * 8)] * 30
    bad = [(1, None), (2, [1.0, None]), (3, [float("nan")] * 8), (4, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + bad], "vec_id long, embedding array<double>, code string, usable string").repartition(5)
    got, books = vector_codes.compress(df, parts=4, entries=6, rounds=3, scale=10.0)
    assert got.columns == ["vec_id", "usable", "code", "error"]
    want, slow = slow_codes(rows, 4, 6, 3, 10.0)
    key = lambda r: tuple(map(str, r))
    found = [(r.vec_id, r.code, r.error) for r in got.collect()]
    assert sorted(found, key=key) == sorted(want + [(i, None, None) for i, _ in bad], key=key)
    assert books.entries.tolist() == slow
    # what a code stands for is as far away as its error says
    back = vector_codes.decompress(got.filter("code is not null and vec_id = 7"), books).first()
    assert len(back.approximation) == books.width


def test_vector_codes_of_few_none_and_too_long_rows(spark):
    shape = "vec_id long, embedding array<float>, label int"
    one = spark.createDataFrame([(5, [1.0, -1.0], 1), (6, None, None)], shape)
    coded, books = vector_codes.compress(one, parts=2)
    assert {(r.vec_id, r.code, r.error) for r in coded.collect()} == {(5, "0000", 0), (6, None, None)} and books.size == 1
    for rows in ([], [(1, None, 2)]):
        coded, books = vector_codes.compress(spark.createDataFrame(rows, shape))
        assert coded.count() == len(rows) and books.size == 0
    with pytest.raises(OverflowError):
        vector_codes.compress(spark.createDataFrame([(1, [3e38] * 16, 1)], shape))
    with pytest.raises(ValueError):
        vector_codes.fit_codebooks(one, entries=257)


def test_group_totals_with_nulls_and_clashes(spark, monkeypatch):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 10)], "group_key int, error long")
    for bound in (100, 0):
        monkeypatch.setattr(vector_codes, "SMALL_GROUPS", bound)
        got = vector_codes.with_group_total(df, "group_key", "error", "total").collect()
        assert {tuple(r) for r in got} == {(None, 1, 3), (None, 2, 3), (3, 10, 10)} and len(got) == 3


def slow_fill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fills():
    rng = random.Random(1)
    fill = Fill()
    for i in range(4000):
        text = "".join(rng.choice("aZ@[`{ é😀<P>S\n\x00Ł") for _ in range(rng.randint(0, 30)))
        made = fill.apply(i, text)
        assert made == slow_fill(i, text) and fill.undo(made[1], made[4]) == text


def test_fill_tables(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "lost words here"), (5, TEXTS[5]), (99, "long word " * 300_000)]
    df = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], "doc_id long, text string, output string, form string, n int").repartition(3)
    got = fill_middle.restore(fill_middle.fill_in_middle(df)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=key) == sorted([(i, *slow_fill(i, t)) for i, t in rows], key=key)
    assert all(r.restored == (r.text or "") for r in got)
    empty = fill_middle.restore(fill_middle.fill_in_middle(df.limit(0)))
    assert empty.count() == 0 and empty.columns[-6:] == ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert fill_middle.restore(spark.createDataFrame([(None, "psm"), ("a", None)], "output string, form string")).select("restored").distinct().collect() == [(None,)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_stretches_encode_as_the_whole_text(library, monkeypatch):
    rng = random.Random(2)
    encoder = token_files.Encoder(open(WORDS, "rb").read(), 2)
    assert encoder.border is not None and encoder.dtype == "<u2"
    letters = "aB'sétΣß1日 \n\t́ͅ \x1c\x85\x02😀.<|>"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    marks = ["thing", "Thing,", "THING...", "don't.", "It's|", "É,", "ª.", "½!", "x\xa0,", "<|EndOfText|>", "<|endoftext|>,", "-|x|-", "a.b.", "...", "Ω.", "e\u0301,", "İ.", "'S,"]
    texts += marks + [" ".join(rng.choice(marks) for _ in range(6)) for _ in range(300)]
    texts += ["<|endoftext|>".join("a b\n ") + "".join(rng.choice(letters) for _ in range(9)) for _ in range(200)]
    want = [e.ids + [2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == want
    monkeypatch.setattr(token_files, "MEMORY_BYTES", 5_000)
    small = token_files.Encoder(open(WORDS, "rb").read(), 2)
    got = []
    for at in range(0, len(texts), 50):
        got += small.encode(texts[at : at + 50])
        assert sum(map(small._size, small.known)) < 5_000 + 120_000
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def test_a_file_that_keeps_white_space_is_encoded_whole():
    raw = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
    encoder = token_files.Encoder(raw, 50256)
    other = Tokenizer.from_str(raw.decode())
    assert encoder.border is None
    texts = ["a  b\n c", "", "the end"]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [other.encode(t, add_special_tokens=False).ids + [50256] for t in texts]


def expected(library, rows):
    """(doc_id, start, ids) in the order of the files."""
    out, start = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_token_files(spark, tmp_path, library, partitions):
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)] + [(None, "lost"), (None, "lost")] + [(4, "many")] * 40
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, token_ids string, id int").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        folder = f"file:{tmp_path}/tokens"
        manifest = token_files.write_tokens(df, folder, WORDS, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = expected(library, order)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    one_id = [r for r in got if r.doc_id == 4]  # ties of one id: by a hash of the text
    assert sorted((str(r.doc_id), bytes(r.token_ids)) for r in got if r.doc_id != 4) == sorted(
        (str(i), np.array(ids, "<u4").tobytes()) for i, _, ids in want if i != 4
    )
    assert len(one_id) == 41 and [r.doc_id for r in got] == [i for i, _, _ in want]
    starts = np.cumsum([0] + [len(r.token_ids) // 4 for r in got])
    assert [r.start for r in got] == starts[:-1].tolist() and manifest["ids"] == starts[-1]
    # the files themselves: one flat run of ids, offsets of the whole, nothing left over
    names = {p.name for p in (tmp_path / "tokens").iterdir()}
    files = manifest["files"]
    assert names == {"manifest.json"} | {f"{k}-{f[n]}.bin" for f in files for k, n in (("ids", "name"), ("docs", "name"), ("offsets", "offsets"))}
    flat = np.concatenate([np.fromfile(tmp_path / "tokens" / f"ids-{f['name']}.bin", "<u2") for f in files])
    assert flat.astype("<u4").tobytes() == b"".join(bytes(r.token_ids) for r in got)
    offsets = np.concatenate([np.fromfile(tmp_path / "tokens" / f"offsets-{f['offsets']}.bin", "<u8")[:-1] for f in files])
    assert offsets.tolist() == starts[:-1].tolist()
    assert json.loads((tmp_path / "tokens" / "manifest.json").read_text()) == manifest == token_files.manifest_of(folder)


def test_token_files_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    manifest = token_files.write_tokens(df, str(tmp_path / "none"), WORDS, 2)
    assert manifest["docs"] == manifest["ids"] == 0 and token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_wide_ids_take_four_bytes(spark, tmp_path, library):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    manifest = token_files.write_tokens(df, str(tmp_path / "wide"), WORDS, 70_000)
    got = {r.doc_id: np.frombuffer(r.token_ids, "<u4").tolist() for r in token_files.read_tokens(spark, str(tmp_path / "wide")).collect()}
    assert manifest["dtype"] == "<u4" and got == {1: library.encode("a b", add_special_tokens=False).ids + [70_000], 2: [70_000]}


def test_files_of_attempts_that_failed_do_not_count(spark, tmp_path, monkeypatch):
    folder = tmp_path / "tokens"
    folder.mkdir()
    (folder / "ids-0.bin").write_bytes(b"left by a task that was lost")
    token_files.write_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(folder), WORDS, 2)
    assert not (folder / "ids-0.bin").exists() and token_files.read_tokens(spark, str(folder)).count() == 1


def test_readers_hand_on_bounded_stretches(spark, tmp_path, monkeypatch, library):
    monkeypatch.setattr(token_files, "READ_IDS", 5)
    rows = [(i, "word " * (i % 9)) for i in range(60)]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), WORDS, 2)
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect())
    assert [(r.doc_id, r.start, np.frombuffer(r.token_ids, "<u4").tolist()) for r in got] == expected(library, rows)


def test_token_file_query(spark, library):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want = {(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in expected(library, docs)}
    assert {tuple(r) for r in queries.op13_token_files(spark, SF).collect()} == want


def test_ranges_are_read_where_files_cannot_be_mapped(tmp_path):
    from pyarrow import fs

    (tmp_path / "f.bin").write_bytes(np.arange(100, dtype="<u4").tobytes())
    system = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    flat = token_files.Flat(system, "f.bin", "<u4")
    assert flat.mapped is None and flat[10:20].tolist() == list(range(10, 20)) and len(flat[:]) == 100

"""The ten operators against brute force, libraries and round trips, on small awkward tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from oracle import check
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from furrow.llm import bpe, chat, decontam, html, langid, pii, queries, simhash, suffix_dedup, suffix_order, token_count, topk

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
AWKWARD = [None, "", " ", "\n\n", "a", "é日本 😀", "the of and " * 400, "x" * 5000, "the of and " * 400, "1 2 3", "<|endoftext|> a", "  a   b \n c  ", "\x1c\x85 \xa0x"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None) for i, t in enumerate(AWKWARD)] + [(None, "lost", "en", "s"), (3, "again", "de", "s"), (3, "again", "de", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def with_clashes(df):
    """Extra columns named as outputs are."""
    extra = ["pii_spans", "lang_pred", "lang_score", "fingerprint", "component", "token_ids", "decoded", "n_tokens", "contamination", "kept", "id", "g"]
    return df.withColumns({c: F.lit("x") for c in extra})


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for kind, p, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and (kind == "phone" or pii.luhn(d)):
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("letters", ["a.@-1", "1. -+(", "0123456789 -.+@a", "a@.é1"])
def test_pii_spans(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert [s[:3] for s in pii.spans_of(t) if s[0] in pii._ALWAYS] == base_spans(t)


def test_pii_checksums_context_and_redaction():
    assert [s[0] for s in pii.spans_of("IBAN GB33BUKB20201555555555 please")] == ["iban"]
    assert not pii.spans_of("GB34BUKB20201555555555") and not pii.spans_of("123-45-6789 is a part")
    assert [s[0] for s in pii.spans_of("social security 123-45-6789")] == ["ssn"]
    assert pii.score("call +1 999", "phone", 5, 11) > pii.score("test +1 999", "phone", 5, 11)
    assert pii.redact("write a.b@c.de or +1 (456) 555-2186.") == "write <EMAIL> or <PHONE>."
    assert pii.redact("x@1.2.3.4 y") == "<EMAIL> y"
    for t in ("1" * 50_000, "@" * 50_000, "a@" * 30_000, "1." * 30_000):
        pii.spans_of(t)


@pytest.mark.parametrize("code", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB33BUKB20201555555555", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
def test_pii_account_numbers_end_where_they_end(code):
    tails = ["", ".", " BIC COBADEFFXXX", " I", " A", " EUR", " EUR 100", " 2024-01-01", " 12", " Euro", " AND MANY MORE WORDS IN UPPER CASE", "\n", " " + code]
    for head in ("", "pay to ", "AB12 ", "AB13 3456 7890 1234 567 ", "FR76 X "):
        for tail in tails:
            t = head + code + tail
            got = [t[a:b] for k, a, b, _ in pii.spans_of(t) if k == "iban"]
            assert got == [code] * (2 if tail[1:] == code else 1), t
    assert pii.redact(f"to {code} EUR") == "to <IBAN> EUR"
    assert not [s for s in pii.spans_of(code + "x") + pii.spans_of("x" + code) if s[0] == "iban" and len(code) == s[2] - s[1]]
    pii.spans_of("DE89 " * 20_000 + "AA11" * 20_000)


def test_pii_query(spark):
    rows = {r.doc_id: r for r in queries.op1_pii(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = base_spans(d.text)
        r = rows[d.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone"))


def longest_match_phrases(seq, text):
    """Greedy parse by plain substring search."""
    n, i = 0, 0
    s = ",".join(map(str, seq)) + ","
    while i < len(text):
        k = 1
        while i + k <= len(text) and ("," + s).find("," + ",".join(map(str, text[i : i + k])) + ",") >= 0:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_language_parse_is_the_longest_match():
    rng = random.Random(4)
    for _ in range(60):
        seq, text = [rng.randint(0, 3) for _ in range(rng.randint(2, 40))], [rng.randint(0, 4) for _ in range(rng.randint(1, 30))]
        p = langid.Parser(np.array(seq), 5)
        got = p.phrases(np.array(text, np.int32), np.array([0]), np.array([len(text)]))
        assert got[0] == longest_match_phrases(seq, text)


def test_language_accuracy_and_edges(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.fit(docs)
    held = docs.filter(~langid.learnable("doc_id"))
    got = langid.predict(held, m).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("lang_score").alias("low"), F.max("lang_score").alias("high")).first()
    assert got.a > 0.98 and 0 <= got.low and got.high <= 1
    edge = langid.predict(with_clashes(odd), m).collect()
    assert len(edge) == odd.count() and all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in edge)
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_language_stage_keeps_text_if_nothing_was_learned(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "the and of", None), (2, "42 !", None), (3, None, None), (4, "\u65e5\u672c", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_language(spark, docs, SF).collect()) == [1, 4]


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def slow_components(ids, prints, radius):
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    out = {}
    for i, x in enumerate(ids):
        out.setdefault(find(i), []).append(x)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in out.items()}
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_covering_masks_miss_no_pair(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(radius)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius)))
        assert any(differ & m == 0 for m in masks)


def test_simhash_groups(spark, odd, none):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), with_clashes(odd)):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        prints = [slow_fingerprint(t) for _, t in rows]
        want = sorted(map(str, zip([i for i, _ in rows], prints, slow_components([i for i, _ in rows], prints, 4), strict=True)))
        got = sorted(str((r[0], r[1] % (1 << 64), r[2])) for r in simhash.near_duplicates(df).collect())
        assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_large_runs(spark):
    """A crowd of close fingerprints: forests keep what all pairs would link."""
    rng = random.Random(8)
    base = rng.getrandbits(64)
    prints = list({base ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fingerprint long")
    from furrow.operators.graph import connected_components

    labels = {r.node % (1 << 64): r.component for r in connected_components(simhash.close_pairs(df)).collect()}
    want = slow_components(list(range(len(prints))), prints, 4)
    groups, got = {}, {}
    for p, w in zip(prints, want, strict=True):
        groups.setdefault(w, set()).add(p)
        got.setdefault(labels.get(p, ("alone", p)), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_near_copies_keep_one(spark, odd):
    kept = simhash.drop_near_duplicates(with_clashes(odd))
    assert kept.columns == with_clashes(odd).columns
    groups = {r.component for r in simhash.near_duplicates(odd).collect()}
    assert kept.count() == len(groups)


def test_near_copies_keep_one_row_a_class_whatever_the_ids(spark):
    rng = random.Random(5)
    text = [" ".join(rng.choice("abcdefghijkl") * rng.randint(1, 5) for _ in range(60)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (7, text[2]), (1, text[3]), (2, text[3]), (2, text[4]), (3, text[5]), (3, text[5])]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(4)
    got = sorted((r.doc_id or 0, text.index(r.text)) for r in simhash.drop_near_duplicates(df).collect())
    assert got == [(0, 0), (0, 1), (1, 3), (2, 4), (3, 5), (7, 2)]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library(library):
    enc, rng = bpe.encoder(open(RANKS, "rb").read(), PATTERN), random.Random(5)
    for letters in ("ab \n", "a  \n\tb", "'s the an", "éèßñ日本 語", "aaaa", "!!?. ", "\x1c\x1d\x85\xa0  a\n", "thethandionereng "):
        for _ in range(800):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
            assert np.frombuffer(enc.encode(t), np.int32).tolist() == library.encode_ordinary(t)
    for t in ("a" * 30_000, " " * 30_000, "the" * 9_000):
        assert np.frombuffer(enc.encode(t), np.int32).tolist() == library.encode_ordinary(t)


def test_bpe_appends_and_edits():
    v, rng = bpe.encoder(open(RANKS, "rb").read(), PATTERN).vocabulary, random.Random(6)
    parts = [b"th", b"e", b"an", b"d", b"ion", b"er", b"aa", "é".encode()]
    for _ in range(150):
        p = b"".join(rng.choice(parts) for _ in range(80))
        t = bpe.PrefixTable(v, p[:30])
        t.append(p[30:])
        assert t.last == bpe.PrefixTable(v, p).last
        at, drop, new = rng.randint(0, len(p) - 5), rng.randint(0, 5), rng.choice(parts)
        done = t.edit(at, drop, new)
        assert t.last == bpe.PrefixTable(v, p[:at] + new + p[at + drop :]).last and done <= len(t.piece) - at


def test_bpe_tables(spark, odd, none, library):
    coded = bpe.decode(bpe.encode(with_clashes(odd), RANKS, PATTERN), RANKS, PATTERN)
    for r in coded.collect():
        assert list(r.token_ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(none, RANKS, PATTERN).count() == 0
    q = {r.doc_id: r for r in queries.op4_bpe(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(d.text)
        assert q[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and q[d.doc_id].n_tokens == len(ids)
        assert q[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_token_counts(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in token_count.count_tokens(with_clashes(odd), path, PATTERN).collect():
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids), r.text
    c, rng = token_count.counter(open(path, "rb").read(), PATTERN), random.Random(7)
    texts = ["".join(rng.choice(x) for _ in range(rng.randint(0, 40))) for x in ("aaab ", "the an\n", ["<|endoftext|>", " ", "a"], "é日 !") for _ in range(500)]
    assert c.count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert token_count.count_tokens(none, path, PATTERN).count() == 0
    assert queries.op10_token_count(spark, SF).count() == 200


def cheapest(roles):
    """Dijkstra over (turns read, state)."""
    import heapq

    heap, seen = [(0, 0, chat.START)], set()
    while heap:
        c, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(roles) and s == chat.FINAL:
            return c
        for r in range(4):
            other = 0 if i < len(roles) and roles[i] == r else 3 if i < len(roles) and roles[i] is not None else 2
            if s in chat.FOLLOWS[r]:
                heapq.heappush(heap, (c + 2, i, r))
                if i < len(roles):
                    heapq.heappush(heap, (c + other, i + 1, r))
            if i < len(roles) and s == r:
                heapq.heappush(heap, (c + 1 + other, i + 1, s))


def test_chat_repair_costs_least():
    rng = random.Random(9)
    for _ in range(800):
        roles = [rng.choice([None, 0, 1, 2, 3]) for _ in range(rng.randint(1, 9))]
        k = rng.randint(1, 3)
        parts = [roles[i : i + k] for i in range(0, len(roles), k)]
        behind = [chat.ENDING]
        for part in reversed(parts):
            behind.append(chat.before_block(chat.block_matrix(part), behind[-1]))
        behind.reverse()
        cost = behind[0][chat.START] // chat.UNIT
        assert cost == cheapest(roles)
        state, paid, whole = chat.START, 0, []
        for part, left in zip(parts, behind[1:], strict=True):
            steps = chat.repair(part, state, left)
            assert chat.passages(part, left)[2 * state : 2 * state + 2] == [steps[-1][1], sum(len(x[2]) for x in steps)]
            whole += steps
            for (op, role, inserted), was in zip(steps, part, strict=True):
                for x in (*inserted, *(() if op == "merge" else (role,))):
                    assert state in chat.FOLLOWS[x]
                    state = x
                paid += 2 * len(inserted) + (op == "merge") + (0 if role == was else 3 if was is not None else 2)
        assert paid + 2 * len(chat.closing(state)) == cost
        assert whole == chat.repair(roles, chat.START, chat.ENDING)  # wherever the blocks begin


def slow_chat(rows):
    """(piece, turn, role, op, cost, rendered) of one conversation: all ways through the automaton, the best by cost, insertions and roles."""
    roles = [chat.role_number(r[1]) for r in rows]
    best = {chat.START: ((0, 0, ()), ())}
    for role in roles:
        grown = {}
        for state, ((cost, extra, seen), steps) in best.items():
            for to in range(4):
                step = chat.STEP[role][state][to]
                if step is not None:
                    key = (cost + step[0], extra + len(step[3]), (*seen, to))
                    if to not in grown or key < grown[to][0]:
                        grown[to] = (key, (*steps, (step[1], to, step[3])))
        best = grown
    ends = {s: ((k[0] + 2 * len(chat.closing(s)), k[1] + len(chat.closing(s)), k[2]), steps) for s, (k, steps) in best.items() if chat.closing(s) is not None}
    (cost, _, seen), steps = min(ends.values())
    out = []
    opened = lambda role: ("<|im_end|>\n" if out else "") + f"<|im_start|>{chat.ROLES[role]}\n"
    for (op, role, inserted), (turn, _, text) in zip(steps, rows, strict=True):
        for extra in inserted:
            out.append([len(out), None, chat.ROLES[extra], "insert", cost, opened(extra)])
        out.append([len(out), turn, chat.ROLES[role], op, cost, ("\n\n" if op == "merge" else opened(role)) + chat.escaped(text or "")])
    for extra in chat.closing(seen[-1]):
        out.append([len(out), None, chat.ROLES[extra], "insert", cost, opened(extra)])
    out[-1][-1] += "<|im_end|>\n"
    return [tuple(x) for x in out]


def test_chat_query(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {}
    for r in queries.op5_chat(spark, SF).collect():
        got.setdefault(r.conv_id, []).append((r.piece, r.turn, r.role, r.op, r.cost, r.rendered))
    assert got.keys() == turns.keys()
    for conv, rows in turns.items():
        assert len({t for t, *_ in rows}) == len(rows)  # no ties in the table
        assert sorted(got[conv]) == slow_chat(sorted(rows))


def test_chat_does_not_depend_on_partitions(spark):
    rng = random.Random(11)
    rows = [(c, n, rng.choice([*chat.ROLES, "odd", None]), f"{c} {n}") for c in (None, 1, 2) for n in range(90)] + [(3, None, "user", "x")] * 5
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for width, block in ((1, 4096), (3, 7), (13, 16), (5, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            seen.append(sorted(map(str, chat.repair_chats(df, block_turns=block).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(x == seen[0] for x in seen) and len(seen[0]) >= len(rows)


def test_chat_tables(spark):
    cols = "conv_id long, turn long, role string, text string, cost string"
    rows = [(1, i, r, f"t{i}", "x") for i, r in enumerate(["user", "user", "assistant", "odd", "system"])]
    rows += [(None, None, None, None, None), (2, 1, "assistant", "b", "x"), (2, 1, "assistant", "b", "x"), (2, None, "user", None, "x")]
    df = spark.createDataFrame(rows, cols)
    out = chat.repair_chats(df).orderBy("conv_id", "piece").collect()
    assert sum(r.op != "insert" for r in out) == len(rows)
    for conv in (None, 1, 2):
        text = "".join(r.rendered for r in out if r.conv_id == conv)
        assert text.count("<|im_start|>") == text.count("<|im_end|>") and text.endswith("<|im_end|>\n")
    long = spark.createDataFrame([(1, i, random.Random(i).choice(chat.ROLES), "t", "x") for i in range(300)], cols)
    assert {r.cost for r in chat.repair_chats(long, block_turns=7).collect()} == {r.cost for r in chat.repair_chats(long).collect()}
    assert chat.repair_chats(df.limit(0)).count() == 0


def test_top_products(spark):
    check(spark, "op6", queries.op6_top_products, queries.ORACLES["op6_top_products"], SF)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5) * rng.choice([0.1, 1, 9])], 0) for i in range(150)] + [(i, [1.0, 2.0], 0) for i in range(200, 240)]
    rows += [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")], 0), (303, [float("inf")], 0), (None, [1.0], 0), (304, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    for block in (3, 8192):
        got = sorted(tuple(r) for r in topk.top_inner_products(df, F.col("id") % 20 == 0, query_block=block).collect())
        whole = {i: np.array([*np.floor(np.array(v) * 64), *[0] * (5 - len(v))], np.int64) for i, v, _ in rows if i is not None and i < 300}
        whole[304] = np.zeros(5, np.int64)
        want = []
        for q in sorted(i for i in whole if i % 20 == 0):
            best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert got == want
    assert topk.top_inner_products(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_products_leave_short_candidates(spark):
    """Tasks of more than one part of candidates, most of them too short to be among any query's best."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(12_000, 3)) * np.geomspace(300, 0.01, 12_000)[rng.permutation(12_000), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in topk.top_inner_products(df, F.col("id") % 400 == 0, query_block=20).collect()}
    whole = np.floor(vectors * 64).astype(np.int64)
    want = {}
    for q in range(0, 12_000, 400):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(len(score)), -score))[:21].tolist() if i != q][:20]
        want |= {(q, k + 1): (i, int(score[i])) for k, i in enumerate(order)}
    assert got == want


def slow_cut(rows, length):
    key = lambda i: 1 << 62 if i is None else i
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            first[b[a : a + length]] = min(first.get(b[a : a + length], 1 << 63), key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < key(i):
                gone[a : a + length] = [True] * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_suffix_order():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    h = suffix_order.PrefixHashes(data)
    starts = rng.permutation(350)[:300]
    group = np.sort(rng.integers(0, 7, 300))
    order = suffix_order.sort_groups(h, starts, group, 50)
    text = data.tobytes()
    want = sorted(range(300), key=lambda i: (group[i], text[starts[i] : starts[i] + 50]))
    assert order.tolist() == want
    cls = suffix_order.classes(h, starts, group, 3)
    keys = [(g, text[s : s + 3]) for g, s in zip(group, starts, strict=True)]
    assert len(set(zip(keys, cls.tolist(), strict=True))) == len(set(keys)) == len(set(cls.tolist()))


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, odd, none, seed):
    rng = random.Random(seed)
    words = ["the", "of", "é", "tion", "日本", "a"]
    passages = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(5)]
    rows = []
    for i in range(40):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        for _ in range(rng.randint(0, 3)):
            p, a = rng.choice(passages), rng.randint(0, 20)
            t += p[a : a + rng.randint(30, 90)]
        rows.append((i, t))
    rows += [(50, "a" * 200), (51, "a" * 90), (52, "ab" * 60), (53, "ab" * 70), (None, rows[3][1]), (5, rows[5][1]), (54, rows[5][1])]
    rows += [tuple(r) for r in odd.select((F.col("doc_id") + 100).alias("doc_id"), "text").collect()]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == slow_cut(rows, 50)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, SF).collect()}
    assert got == {i: (n, hashlib.sha256(k).hexdigest()) for i, _, n, _, k in slow_cut(rows, 50)}


def slow_align(q, s):
    h = [[0] * (len(s) + 1) for _ in range(len(q) + 1)]
    for i in range(len(q)):
        for j in range(len(s)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if q[i] == s[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment():
    rng = random.Random(2)
    pairs = [([rng.randint(1, 4) for _ in range(rng.randint(1, 12))], [rng.randint(0, 4) for _ in range(rng.randint(1, 20))]) for _ in range(60)]
    best, _ = decontam.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert best.tolist() == [slow_align(a, [x or -9 for x in b]) for a, b in pairs]


def test_decontamination(spark, odd, none):
    bench = [r for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SF).collect()}
    norm = lambda t: " ".join(decontam.words_of(t))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench if f" {norm(b.text)} " in f" {norm(d.text)} "}
    assert want and want <= got
    words = decontam.words_of(bench[0].text)
    rng = random.Random(3)
    edited = [w if rng.random() > 0.15 else "zzz" for w in words]
    planted = spark.createDataFrame([(1, "lead in " + " ".join(edited) + " and out"), (2, "nothing of the kind"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(r.item_id, r.text) for r in bench] + [(None, "x y z"), (900, None), (901, "two words")], "item_id long, text string")
    for block in (7, 20_000):
        hits = {r.doc_id: [h.item_id for h in r.contamination] for r in decontam.find_contamination(with_clashes(planted), b, block=block).collect()}
        assert hits == {1: [bench[0].item_id], 2: [], 3: []}
    assert decontam.find_contamination(none, b).count() == 0 and decontam.drop_contaminated(odd, b).count() == odd.count()
    assert decontam.drop_contaminated(odd, b.limit(0)).columns == odd.columns


def test_decontamination_of_edited_copies_in_a_hot_group(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
    edited = [f"zz{i}" if i in (3, 7, 11) else w for i, w in enumerate(words)]
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(i, "lead in " + " ".join(edited) if i < 30 else "nothing of the kind") for i in range(60)], "doc_id long, text string")
    hits = {r.doc_id: [(h.item_id, h.score, h.first_word, h.last_word) for h in r.contamination] for r in decontam.find_contamination(docs, b).collect()}
    assert hits == {i: [(1, 0.7, 2, 17)] if i < 30 else [] for i in range(60)}
    # words put in between don't move the end out of the stretch
    spread = "one two three four x five x six x seven x eight x nine x ten x eleven x twelve x thirteen x fourteen x fifteen"
    lone = "one two three zz five six zz eight nine zz eleven twelve zz fourteen fifteen"
    assert [[h[1:] for h in f] for f in decontam.matches(decontam.Items([(1, " ".join(words))]), [spread, lone])] == [[(19 / 30, 0, 26)], [(18 / 30, 0, 15)]]


def test_decontamination_by_the_later_part_of_a_long_item(spark):
    words = [f"{i:04d}" + "x" * 46 for i in range(3000)]
    b = spark.createDataFrame([(1, "a short item of words"), (2, " ".join(words)), (3, "another short item here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[1200:])), (2, " ".join(words[:1600])), (3, " ".join(words[:1400]))], "doc_id long, text string")
    hits = {r.doc_id: [(h.item_id, h.score) for h in r.contamination] for r in decontam.find_contamination(docs, b).collect()}
    assert hits == {1: [(2, 0.6)], 2: [(2, 1600 / 3000)], 3: []}
    assert [[i for i, _ in x] for x in decontam.item_blocks(b, "item_id", "text", 20_000, 1_000)] == [[1], [2], [3]]


PAGE = """<html><head><title>T</title><style>p{}</style><script>x="<p>no</p>"</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Menu</a></ul></nav>
<div class="ad">Buy</div><div id="cookie-notice">We use cookies on this long notice of ours</div><article><header><h1>Head &amp; more</h1></header><p>First   <b>bold</b> line<br>two.<p>And a
long paragraph with &eacute; and <a href="#">a link</a> in it, well over any threshold.<ul><li>one<li>two</ul><form>Name <input></form><p>End.</article>
<section class="comments"><p>I do not agree with this at all, and I say so at length.</p></section><aside>Side</aside><footer>&copy; Foot</footer></body></html>"""


def test_main_text(spark):
    blocks = ["Head & more", "First bold line two.", "And a long paragraph with é and a link in it, well over any threshold.", "one", "two", "End."]
    assert html.main_text(PAGE) == "\n\n".join(blocks)
    assert html.main_text(PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")).split("\n\n") == blocks[1:]  # a header outside an article is the page's
    assert [html.main_text(x) for x in ("", "plain  text &lt;", "<p>a<br>b</p>", "<!-- open <p>x", "<nav>only</nav>")] == ["", "plain text <", "a b", "", ""]
    for x in ("<div>" * 20_000, "<p>" * 20_000 + "x", "<!--" * 20_000, "<a " * 20_000, "&" * 50_000):
        html.main_text(x)
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, main_text string")
    assert [r.main_text for r in html.extract_main_text(df).collect()].count("") == 1
    assert html.extract_main_text(df.limit(0)).count() == 0
    q = queries.op9_main_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in q:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        import html as std

        want = [" ".join(std.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)


def _long(name, n=6):
    return f"{name} " + "is said here in a sentence of some length, and then once more. " * n


def _page(body):
    return html.main_text(f"<html><body><div><a href=/a>Home</a></div><div><a href=/b>News</a></div><div><a href=/c>More</a></div><div><a href=/d>Shop</a></div>{body}</body></html>")


def test_main_text_keeps_dense_lines_beside_named_elements():
    cards = "".join(f"<article class=teaser><h2>Card {i}</h2><p>A card with a few words about it.</p></article>" for i in range(3))
    text = [_long(f"Part {i}").strip() for i in range(4)]
    got = _page("<div class=story>" + "".join(f"<p>{t}</p>" for t in text) + "</div>" + cards).split("\n\n")
    assert [t for t in got if t.startswith("Part")] == text and "Home" not in got
    parts = "".join(f"<article><h2>Head {i}</h2><p>{t}</p><p>{i}.</p></article>" for i, t in enumerate(text))
    want = [x for i, t in enumerate(text) for x in (f"Head {i}", t, f"{i}.")]
    assert _page(parts).split("\n\n") == want
    assert _page(f"<div id=wrap>{parts}<div><p>{_long('Beside').strip()}</p></div></div>").split("\n\n") == [*want, _long("Beside").strip()]


def test_main_text_keeps_a_lead_beside_the_body():
    lead, body = _long("Lead", 5).strip(), [_long(f"Body {i}", 5).strip() for i in range(3)]
    parts = f"<h1>Title</h1><div class=lead><p>{lead}</p></div><div class=body>" + "".join(f"<p>{t}</p>" for t in body) + "</div><div><p>Short.</p></div><div><p>End.</p></div>"
    want = ["Title", lead, *body, "Short.", "End."]
    assert _page(f"<div class=content>{parts}</div>").split("\n\n") == want
    assert set(want[:-2]) <= set(_page(parts).split("\n\n"))  # straight in the page, whose branches of short lines are no article

def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark", "personal_data", "encode"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.columns == columns or name == "encode"
        if name == "near_copies":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert seen[-1] == set(slow_components([i for i, _ in rows], [slow_fingerprint(t) for _, t in rows], 4))
        if name == "benchmark":
            bad = decontam.find_contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter(F.size("contamination") > 0)
            assert seen[-1] == seen[-2] - {r.doc_id for r in bad.collect()} and len(seen[-1]) < len(seen[-2])
        if name == "personal_data":
            assert seen[-1] == seen[-2] and not any(base_spans(r.text) for r in docs.collect())
    assert docs.filter("NOT round_trip").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.collect()} == seen[-1]

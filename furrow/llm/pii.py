"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Kinds with a fixed definition (email, ip, card, phone) are always reported when their own test
holds; kinds that only context or a checksum makes credible (iban, ssn, secret) need `min_score`. A secret is a key in the form
of its issuer, a private key block (one without an end line goes as far as its lines do), or a value that a word such as token or password assigns, if it
looks random; what is assigned to a password needs no digit if it is long. Account numbers in small letters or with hyphens need their country's length.

Defined results: a null text has no spans and an empty text none; repeated rows get the same
spans each; spans of one kind never overlap, spans of different kinds may. Offsets are code
points, the end exclusive. Texts of any length are scanned in linear time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import append_columns, texts

#: Order of the kinds in a span list.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
SPAN = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ALNUM = re.compile(r"[A-Za-z0-9]")
#: As account numbers are written otherwise: small letters, hyphens; in one piece or in groups of four.
_IBAN_LOOSE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:(?P<gap>[ -])[A-Za-z0-9]{4}(?:(?P=gap)[A-Za-z0-9]{1,4}){2,7}|[A-Za-z0-9]{11,30})(?![A-Za-z0-9])")
_IBAN_WORD = re.compile(r"[A-Z0-9]+(?![A-Za-z0-9])")
#: Countries by the characters of an account number; in capitals other countries and lengths are tried too, after these. Fixed values.
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_LENGTH = {country: n for n, countries in _IBAN_COUNTRIES.items() for country in countries.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Forms in which issuers write their keys.
_KEY = re.compile(
    r"(?<![A-Za-z0-9_-])(?:A[KS]IA[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[A-Za-z0-9_-]{35}|[prs]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|glpat-[A-Za-z0-9_-]{20}|npm_[A-Za-z0-9]{36}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])"
)
_BLOCK_BEGIN, _BLOCK_END = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,30}PRIVATE KEY-----")
#: A word that names a secret, what assigns it, and the value, quoted or not.
_ASSIGNED = re.compile(
    r"(?P<name>(?i:token|secret|passwd|password|passphrase|pwd|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|credentials?|bearer))[\"'`]?"
    r"(?P<sign>[ \t]{0,4}(?:=>|:=|[=:])[ \t]{0,4}[\"'`]?|[ \t]{1,4}(?i:is|was)[ \t]{1,4}[\"'`]?|[ \t][\"'`]?)(?P<value>[A-Za-z0-9_/+.=~!@#$%^&*-]{8,})"
)
#: One of these stands in every text that a pattern for secrets can match; plain search is far faster than the patterns.
_KEY_PARTS = ("AKIA", "ASIA", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat_", "xox", "AIza", "k_live_", "k_test_", "sk-", "glpat-", "npm_", "eyJ")
_NAME_PARTS = ("token", "secret", "pass", "pwd", "key", "credential", "bearer")
#: Bits a character from which a value counts as random, and from which length on letters alone do.
RANDOM_BITS, RANDOM_CHARS = 2.5, 8
#: Names whose assigned value needs no digit if it has so many characters.
_PASSWORDS, PASSWORD_CHARS = frozenset(("password", "passwd", "passphrase", "pwd")), 12
#: Lines of a key block whose end line is missing.
_BLOCK_LINES = re.compile(r"(?:\s{1,4}[A-Za-z0-9+/=]{16,})+")

#: Start score of a kind once its own test holds, and the words nearby that raise or lower it.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.6}
RAISE = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("token", "secret", "password", "passwd", "key", "credential", "credentials", "authorization", "bearer", "login"),
}
LOWER = ("version", "example", "sample", "test", "isbn", "serial")
CONTEXT_CHARS = 48
_WORD = re.compile(r"[A-Za-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of an international account number, given without spaces."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A match starts at the run of local characters that ends before an "@" and can't start
    # elsewhere, so it is enough to look around each "@".
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    # The proposal may run on into what follows; each end of a word is tried, the country's length first, then from long to short.
    m = _IBAN.search(text)
    while m:
        start, done = m.start(), m.start() + 1
        ends = [w.end() for w in _IBAN_WORD.finditer(text, start, m.end())]
        if ends and ends[-1] == m.end() and _ALNUM.match(text, m.end()):
            ends.pop()  # the proposal was cut within a word
        codes = [(text[start:end].replace(" ", ""), end) for end in reversed(ends)]
        codes.sort(key=lambda c: len(c[0]) != _IBAN_LENGTH.get(c[0][:2]))
        for code, end in codes:
            if 15 <= len(code) <= 34 and mod97(code):
                yield start, end
                done = end
                break
        m = _IBAN.search(text, done)


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    found = list(_ibans(text))
    taken = set()
    for start, end in found:
        taken.update(range(start, end))
    at = 0
    while m := _IBAN_LOOSE.search(text, at):
        start, at = m.start(), m.start() + 1
        need = _IBAN_LENGTH.get(text[start : start + 2].upper(), 0)
        gap = m["gap"]
        ends = [m.end()] if gap is None else [k for k in range(start + 4, m.end() + 1) if k == m.end() or text[k] == gap]
        for end in ends:
            code = text[start:end].replace(gap, "") if gap else text[start:end]
            if len(code) == need and not taken.intersection((start, end - 1)) and mod97(code.upper()):
                found.append((start, end))
                at = end
                break
    return iter(sorted(found))


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield m.span()


def looks_random(value: str) -> bool:
    """Digits among letters, and many different characters: the entropy of the value's own characters decides."""
    n = len(value)
    if n < RANDOM_CHARS or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    return bits(value) >= RANDOM_BITS


def bits(value: str) -> float:
    """Bits a character of the value's own distribution."""
    n = len(value)
    return sum(-k / n * math.log2(k / n) for k in Counter(value).values())


def _is_secret(m: re.Match) -> bool:
    """Whether what a word assigns is a secret: not the word itself again, and random, or a long password after a sign."""
    name, value = m["name"].lower(), m["value"]
    if value.lower().startswith(name):
        return False
    if looks_random(value):
        return True
    signed = any(c in m["sign"] for c in "=:")
    return signed and name in _PASSWORDS and len(value) >= PASSWORD_CHARS and value.isalnum() and bits(value) >= RANDOM_BITS


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    found = [m.span() for m in _KEY.finditer(text)] if any(x in text for x in _KEY_PARTS) else []
    if "-----BEGIN " in text:
        at = 0
        while m := _BLOCK_BEGIN.search(text, at):
            end = _BLOCK_END.search(text, m.end())
            if end is None:
                if lines := _BLOCK_LINES.match(text, m.end()):
                    found.append((m.start(), lines.end()))
                at = m.end()
                continue
            found.append((m.start(), end.end()))
            at = end.end()
    low = text.lower()
    if any(x in low for x in _NAME_PARTS):
        found += [m.span("value") for m in _ASSIGNED.finditer(text) if _is_secret(m)]
    done = 0
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if start >= done:
            yield start, end
            done = end


_FINDERS = {"secret": _secrets, "email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _accounts, "ssn": _ssns}
_ALWAYS = ("email", "ip", "card", "phone")


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = {w.lower() for w in _WORD.findall(near)}
    value = BASE_SCORE[kind] + 0.3 * any(w in words for w in RAISE[kind]) - 0.2 * any(w in words for w in LOWER)
    return min(1.0, max(0.0, value))


def spans_of(text: str, min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans of one text, by kind as in KINDS and then by start."""
    out = []
    for kind in KINDS:
        for start, end in _FINDERS[kind](text):
            s = score(text, kind, start, end)
            if kind in _ALWAYS or s >= min_score:
                out.append((kind, start, end, s))
    return out


def detect_pii(df: DataFrame, text_col: str = "text", out: str = "pii_spans", min_score: float = 0.5) -> DataFrame:
    """Append the array of spans that each whole text holds; one pass, no shuffle."""
    fields = T.StructType([T.StructField(out, T.ArrayType(SPAN))])

    def spans(batch: pa.RecordBatch) -> list[pa.Array]:
        ends, kinds, starts, stops, scores = [0], [], [], [], []
        for text in texts(batch, text_col):
            for kind, a, b, s in spans_of(text, min_score):
                kinds.append(kind)
                starts.append(a)
                stops.append(b)
                scores.append(s)
            ends.append(len(kinds))
        rows = pa.StructArray.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(scores, pa.float64())],
            names=[f.name for f in SPAN],
        )
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)]

    return append_columns(df, fields, spans)


def redact(text: str, min_score: float = 0.5) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans count as
    the one that starts first (the longer, then the kind listed first)."""
    found = sorted(spans_of(text, min_score), key=lambda s: (s[1], -s[2], KINDS.index(s[0])))
    parts, at = [], 0
    for kind, start, end, _ in found:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
            at = end
        elif end > at:  # the rest of an overlapping span goes too
            at = end
    return "".join([*parts, text[at:]])


def redact_pii(df: DataFrame, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """Replace the spans in the text column; null stays null. Column order is kept."""
    names = df.columns
    fields = T.StructType([T.StructField(text_col, T.StringType())])

    def clean(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(text_col).to_pylist()
        return [pa.array([None if x is None else redact(x, min_score) for x in column], pa.string())]

    return append_columns(df, fields, clean).select(*[F.col(f"`{n}`") for n in names])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Secret scan: Aho-Corasick prefilter, anchored expressions near hits, checksums.

One automaton finds the keywords of all kinds in the lower-cased text (A-Z only,
so offsets stay). An anchored expression runs only where a keyword starts. Kinds
with an embedded checksum are reported only if it holds. Runs of hexadecimal
digits have no keyword: a second automaton looks for 24 digits in the text mapped
to character classes, and the anchored expression extends the run.

Spans are code points, end exclusive. Matches of one kind are leftmost and do not
overlap; a base match that is too short still takes up its text, as a scan with one
expression per kind would do. What follows a card or account number may look like
more of it (an expiry date, a bank's name): every admissible end is tried, the
longest first, and only a reported span takes up its text.

Edge cases: a null text is empty; repeated documents are scanned each; a text of
any length is scanned whole in one task, which needs a few times its size.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: kinds in their order, keywords and patterns
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "forge", "registry", "card", "iban")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "registry": ("npm_",),
    "card": ("card", "visa", "mastercard", "amex"),
    "iban": ("iban",),
}
HEX_MIN = 24
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "registry": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "card": re.compile(r"""(?:card|visa|mastercard|amex)[^0-9\n]{0,20}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])""",
                       re.IGNORECASE | re.ASCII),
    "iban": re.compile(r"(?i:iban)[^A-Za-z0-9\n]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Z0-9])", re.ASCII),
}
CARD_DIGITS = range(13, 20)
#: lengths of account numbers by country
IBAN_LENGTHS = {c: int(n) for n, codes in (
    ("15", "NO"), ("16", "BE"), ("18", "DK FI FO GL NL FK SD"), ("19", "MK SI"), ("20", "AT BA EE KZ LT LU XK MN"), ("21", "CH HR LI LV"),
    ("22", "BG BH CR DE GB GE IE ME RS VA"), ("23", "AE GI IL IQ OM SO TL"), ("24", "AD CZ ES MD PK RO SA SE SK TN VG"),
    ("25", "LY PT ST"), ("26", "IS TR"), ("27", "BI DJ FR GR IT MC MR SM"), ("28", "AL AZ BY CY DO GT HN HU LB NI PL SV"),
    ("29", "BR EG PS QA UA"), ("30", "JO KW MU YE"), ("31", "MT SC"), ("32", "LC"), ("33", "RU")) for c in codes.split()}
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase

_LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}
_CLASSES = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))


def crc_token_ok(token: str) -> bool:
    """The last six characters are the CRC-32 of the 30 before them, in base 62."""
    body, check = token[4:34], token[34:40]
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def luhn_ok(digits: str) -> bool:
    d = [int(c) for c in digits if c.isdigit()][::-1]
    return len(set(d)) > 1 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automata():
    words = ahocorasick.Automaton()
    for kind, keys in KEYWORDS.items():
        for k in keys:
            words.add_word(k, (words.get(k, ()) if k in words else ()) + ((kind, len(k)),))
    words.make_automaton()
    run = ahocorasick.Automaton()
    run.add_word("h" * HEX_MIN, HEX_MIN)
    run.make_automaton()
    return words, run


def _ends(m: re.Match, part: Callable[[str], bool]) -> list[tuple[int, int]]:
    """(signs, end) of the number's beginnings that no sign follows directly, the longest first."""
    number, signs, out = m[1], 0, []
    for i, c in enumerate(number):
        if part(c):
            signs += 1
            if i + 1 == len(number) or not part(number[i + 1]):
                out.append((signs, m.start(1) + i + 1))
    return out[::-1]


def _card(m: re.Match) -> tuple[int, int] | None:
    for digits, end in _ends(m, str.isdigit):
        if digits in CARD_DIGITS and luhn_ok(m.string[m.start(1):end]):
            return m.start(1), end
    return None


def _iban(m: re.Match) -> tuple[int, int] | None:
    """The country's length decides; a country not listed may have any. The whole run is tried last."""
    ends, length = _ends(m, str.isalnum), IBAN_LENGTHS.get(m[1][:2])
    tried = [e for n, e in ends if (n == length if length else n >= 15)]
    for end in [*tried, m.end(1)]:
        if iban_ok(m.string[m.start(1):end]):
            return m.start(1), end
    return None


def _accept(kind: str, m: re.Match) -> tuple[int, int] | None:
    """The span to report for an anchored match, or None if it fails."""
    if kind == "assign":
        return m.span() if m.end(2) - m.start(2) >= 6 else None
    if kind == "access":
        return m.span() if m.end() - m.start() >= 20 else None
    if kind in ("forge", "registry"):
        return m.span() if crc_token_ok(m[0]) else None
    return _card(m) if kind == "card" else _iban(m)


def scan_text(text: str, automata) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of every secret, sorted."""
    words, run = automata
    lower = text.lower() if text.isascii() else text.translate(_LOWER)
    hits: dict[str, list[int]] = {}
    for end, found in words.iter(lower):
        for kind, length in found:
            hits.setdefault(kind, []).append(end - length + 1)
    spans = []
    for kind, starts in hits.items():
        done, pattern = 0, PATTERNS[kind]
        for at in sorted(starts):
            if at >= done and (m := pattern.match(text, at)):
                span = _accept(kind, m)
                if span:
                    spans.append((span[0], KINDS.index(kind), span[1]))
                if kind not in ("card", "iban"):
                    done = m.end()
                elif span:
                    done = span[1]
    mapped = text.encode("ascii", "replace").translate(_CLASSES).decode("ascii")
    done, pattern = 0, PATTERNS["hex"]
    for end, length in run.iter(mapped):
        if end >= done:
            start = end - length + 1  # the first hit of a run starts where the run starts
            done = pattern.match(text, start).end()
            spans.append((start, KINDS.index("hex"), done))
    return sorted(spans)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def _digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replace each secret by ``[KIND]``; overlapping spans become one, named after the first."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, keep: list[Column], text_col: str = "text", clean: bool = False) -> DataFrame:
    """The columns ``keep`` and of each text ``spans`` (kind, start, end), the counts
    of the base kinds, and the span list as text (base kinds; all). With ``clean``
    also ``redacted``, the text with every secret replaced. Nothing is shuffled."""
    src = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kept = src.columns[:-1]
    schema = T.StructType([src.schema[c] for c in kept])
    for c in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(c, T.LongType())
    schema = schema.add("base_spans", T.StringType()).add("all_spans", T.StringType()).add("spans", SPANS)
    if clean:
        schema = schema.add("redacted", T.StringType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata()
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            found = [scan_text(t, automata) for t in texts]
            cols = [batch.column(c) for c in kept]
            cols += [pa.array([sum(k == i for _, k, _ in f) for f in found], pa.int64()) for i in range(3)]
            cols += [pa.array([_digest([x for x in f if x[1] < 3]) for f in found], pa.string()),
                     pa.array([_digest(f) for f in found], pa.string()),
                     pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in found],
                              pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
            if clean:
                cols.append(pa.array([redact(t, f) if f else t for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(scan, schema)


def remove_secrets(docs: DataFrame) -> DataFrame:
    """Documents with every secret replaced and ``n_chars``, where there is such a
    column, set to the new length. Texts without a secret, and null texts, stay."""
    # the other columns are one value, so that none of their names can meet those used here
    row = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]).alias("_row")
    out = find_secrets(docs, [row, F.col("text").isNull().alias("_null")], clean=True)
    changed = F.size("spans") > 0
    cols = []
    for i, c in enumerate(docs.columns):
        if c == "text":
            cols.append(F.when(~F.col("_null"), F.col("redacted")).alias("text"))
        elif c == "n_chars":
            cols.append(F.when(changed, F.length("redacted")).otherwise(F.col("_row")[f"c{i}"])
                        .cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            cols.append(F.col("_row")[f"c{i}"].alias(c))
    return out.select(*cols)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

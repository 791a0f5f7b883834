"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into units that no piece crosses (a run of spaces and
what follows it; characters that are in no piece stand alone). The distinct units
are concatenated and indexed by a suffix array, sorted as far as the longest piece.
Every piece of the vocabulary is found in it by binary search: its occurrences are
one range. The occurrences are edges of the units' lattices; sorted by position they
are relaxed in one pass over all units together:

* ``unigram`` models keep, for each position, the edge of the best total score
  (equal scores: the longer piece);
* ``bpe`` models keep the edge that ends the merge encoding of the text so far. It is
  the only one whose piece, after the piece that ends where it starts, is what merging
  makes of the two; that is found once for a pair of pieces and remembered.

Characters without a piece fall back to their bytes, or to the unknown piece.

Tasks work on their own batches; nothing is shuffled. Edge cases: a null text gives
null; an empty text gives no pieces; a text of any length is one row's work; U+2581
in a text is read as a space, as the library does; identifiers that are control
pieces decode to nothing, those out of range are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
CACHE_UNITS = 200_000
BATCH_CHARS = 1 << 21  # values of a batch that are worked on at a time; one long value may be more
_LOADED: dict = {}


@dataclass
class Pieces:
    """A vocabulary: the pieces that match text, their scores, and the rest by id."""
    text: dict[int, str]
    score: dict[str, float]
    byte_ids: list[int] | None
    unknown: int
    output: list[bytes]
    bpe: bool = True
    cache: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        self.id_of = {t: i for i, t in self.text.items()}
        alphabet = sorted({c for t in self.text.values() for c in t})
        self.size = len(self.output)
        alone = [c for c in alphabet if c not in self.id_of]  # in longer pieces only
        self.spelled = {self.size + i: self.fallback(c) for i, c in enumerate(alone)}
        matched = [(i, t) for i, t in self.text.items()] + [(self.size + i, c) for i, c in enumerate(alone)]
        self.start = self.size + len(alone)
        self.alphabet = np.array([ord(c) for c in alphabet], np.uint32)
        self.words = -(-max((len(t) for _, t in matched), default=1) // 4)
        self.ids = np.array([i for i, _ in matched], np.int64)
        self.lengths = np.array([len(t) for _, t in matched], np.int64)
        codes = np.zeros((len(matched), 4 * self.words), np.uint64)
        place = {c: i + 1 for i, c in enumerate(alphabet)}
        for row, (_, t) in enumerate(matched):
            codes[row, : len(t)] = [place[c] for c in t]
        used = np.arange(4 * self.words)[None, :] < self.lengths[:, None]
        self.low, self.high = _packed(codes), _packed(np.where(used, codes, np.uint64(0xFFFF)))
        self.value = np.array([self.score.get(t, -1e9) for _, t in matched])
        lone = "".join(c for c in "\n\r\t" if c not in place)
        self.units = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]" if lone else ""))
        self.known = frozenset(alphabet)
        self.pairs = (np.zeros(0, np.int64), np.zeros(0, bool))
        self.text_of = {**self.text, **{self.size + i: c for i, c in enumerate(alone)}, self.start: ""}

    def fallback(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]

    # merge encoding of a short string, from the definition
    def merge(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, keys: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two pieces of each key as they are."""
        known, good = self.pairs
        distinct = np.unique(keys)
        at = np.searchsorted(known, distinct)
        new = distinct[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != distinct)] if len(known) else distinct
        if len(new):
            answers = []
            for a, b in zip((new // (self.start + 1)).tolist(), (new % (self.start + 1)).tolist()):
                x, y = self.text_of[a], self.text_of[b]
                answers.append(self.merge(x + y) == ([x, y] if x else [y]))
            known, good = np.concatenate([known, new]), np.concatenate([good, np.array(answers, bool)])
            order = np.argsort(known)
            self.pairs = known, good = known[order], good[order]
        return good[np.searchsorted(known, keys)]


def _packed(codes: np.ndarray) -> np.ndarray:
    """Four codes of 16 bits in a word, most significant first."""
    c = codes.reshape(len(codes), -1, 4)
    return c[:, :, 0] << np.uint64(48) | c[:, :, 1] << np.uint64(32) | c[:, :, 2] << np.uint64(16) | c[:, :, 3]


def load(model_file: str) -> Pieces:
    """The vocabulary of a model file; kept for the tasks of this process."""
    if model_file not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in range(n)) else None
        output = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode()
                  if sp.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        _LOADED[model_file] = Pieces({i: names[i] for i in plain}, {names[i]: sp.get_score(i) for i in plain}, byte_ids, sp.unk_id(), output)
    return _LOADED[model_file]


def suffix_array(codes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``4 * words`` codes, and the packed words
    of four codes that start at each place."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(4 * words + 4, np.uint64)])
    first = padded[:-3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:]
    key, reach = first[:n], 4
    while True:
        order = np.argsort(key)
        if reach >= 4 * words:
            return order, first
        sorted_ = key[order]
        rank = np.empty(n + reach, np.uint64)
        rank[n:] = 0
        rank[order] = np.cumsum(np.concatenate([[1], sorted_[1:] != sorted_[:-1]])).astype(np.uint64)
        key, reach = rank[:n] << np.uint64(32) | rank[reach:], 2 * reach


def ranges(order: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the begin and end of its occurrences in the suffix array."""
    def bound(target: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(target), np.int64), np.full(len(target), len(order), np.int64)
        go = np.flatnonzero(lo < hi)
        while len(go):
            mid = (lo[go] + hi[go]) >> 1
            at, t = order[mid], target[go]
            less, same = np.zeros(len(go), bool), np.ones(len(go), bool)
            for j in range(target.shape[1]):
                w = first[at + 4 * j]
                less |= same & (w < t[:, j])
                same &= w == t[:, j]
            right = less | same if after else less
            lo[go] = np.where(right, mid + 1, lo[go])
            hi[go] = np.where(right, hi[go], mid)
            go = go[lo[go] < hi[go]]
        return lo
    return bound(low, False), bound(high, True)


def encode_units(p: Pieces, units: Sequence[str]) -> list[bytes]:
    """The piece ids (little-endian, 32 bits) of units made of the alphabet only."""
    if not units:
        return []
    points = np.frombuffer("\0".join(units).encode("utf-32-le") + b"\0\0\0\0", "<u4")
    codes = np.where(points > 0, np.searchsorted(p.alphabet, points) + 1, 0).astype(np.uint64)
    ends_of = np.flatnonzero(points == 0)
    starts_of = np.concatenate([[0], ends_of[:-1] + 1])
    order, first = suffix_array(codes, p.words)
    begin, end = ranges(order, first, p.low, p.high)
    count = end - begin
    which = np.repeat(np.arange(len(count), dtype=np.int32), count)
    start = np.concatenate([order[a:b] for a, b in zip(begin[count > 0], end[count > 0])] or [order[:0]]).astype(np.int32)
    del order, first
    stop = start + p.lengths[which].astype(np.int32)
    begins = np.repeat(starts_of, ends_of - starts_of + 1).astype(np.int32)  # of the unit that each place is in
    offset = stop - begins[start]
    by = np.lexsort((p.lengths[which], offset)) if not p.bpe else np.argsort(offset, kind="stable")
    start, stop, which, offset = start[by], stop[by], which[by], offset[by]
    piece, value = p.ids.astype(np.int32)[which], None if p.bpe else p.value[which]
    del by, which
    steps, cuts = np.unique(offset, return_index=True)
    last, origin = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, np.int64)
    total = None if p.bpe else np.zeros(len(codes) + 1)
    last[starts_of] = p.start
    for a, b in zip(cuts, [*cuts[1:], len(offset)]):
        s, e, q = start[a:b], stop[a:b], piece[a:b]
        if p.bpe:
            good = p.follows(last[s] * (p.start + 1) + q)
            s, e, q = s[good], e[good], q[good]
        else:
            score = total[s] + value[a:b]
            best = np.lexsort((np.arange(len(e)), score, e))
            best = best[np.append(e[best][1:] != e[best][:-1], True)]
            s, e, q = s[best], e[best], q[best]
            total[e] = score[best]
        last[e], origin[e] = q, s
    out_unit, out_id, at, live = [], [], ends_of.copy(), np.arange(len(units))
    while len(live):
        here = at[live]
        go = here > starts_of[live]
        live, here = live[go], here[go]
        out_unit.append(live)
        out_id.append(last[here])
        at[live] = origin[here]
    unit, ids = np.concatenate(out_unit), np.concatenate(out_id)
    back = np.lexsort((-np.arange(len(unit)), unit))
    unit, ids = unit[back], ids[back]
    cut = np.searchsorted(unit, np.arange(len(units) + 1)) * 4
    raw = ids.astype("<u4").tobytes()
    result = [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]
    for u in np.unique(unit[ids >= p.size]):
        spelled = [x for i in np.frombuffer(result[u], "<u4").tolist() for x in p.spelled.get(i, [i])]
        result[u] = np.array(spelled, "<u4").tobytes()
    return result


def encode_texts(p: Pieces, texts: Sequence[str]) -> list[bytes]:
    found = [p.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    cache = p.cache
    if len(cache) > CACHE_UNITS:
        cache.clear()
    missing = sorted(set().union(*found) - cache.keys())
    split = {u: re.findall(r"(?s).", u) if not p.known.issuperset(u) else None for u in missing}
    inner: dict[str, bytes] = {}
    runs: dict[str, list[str]] = {}
    for u, chars in split.items():
        if chars is None:
            inner[u] = b""
        else:
            parts, run = [], ""
            for c in chars:
                if c in p.known:
                    run += c
                else:
                    parts += [run, c] if run else [c]
                    run = ""
            runs[u] = [*parts, run] if run else parts
            inner.update((x, b"") for x in runs[u] if p.known.issuperset(x))
    names = list(inner)
    inner.update(zip(names, encode_units(p, names)))
    for u in missing:
        cache[u] = inner[u] if u not in runs else b"".join(
            inner[x] if x in inner else np.array(p.fallback(x), "<u4").tobytes() for x in runs[u])
    return [b"".join(map(cache.__getitem__, f)) for f in found]


def decode_ids(p: Pieces, ids: bytes) -> str:
    text = b"".join(map(p.output.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _map_column(df: DataFrame, keep: Sequence[Column], column: str, out: str, kind: T.DataType, function) -> DataFrame:
    src = df.select(*keep, F.col(column).alias("_in"))
    names = src.columns[:-1]
    schema = T.StructType([*[src.schema[c] for c in names], T.StructField(out, kind)])
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        begin, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column("_in")).to_pylist()):
            if i > begin and size + (n or 0) > BATCH_CHARS:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n or 0
        if begin < batch.num_rows:
            yield batch.slice(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            values = batch.column("_in").to_pylist()
            made = iter(function([v for v in values if v is not None]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array([None if v is None else next(made) for v in values], arrow)], names=schema.names)

    return src.mapInArrow(run, schema)


def encode(df: DataFrame, keep: Sequence[Column], model_file: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``ids``: the piece ids, little-endian, 32 bits each."""
    return _map_column(df, keep, text_col, "ids", T.BinaryType(), lambda texts: encode_texts(load(model_file), texts))


def decode(df: DataFrame, keep: Sequence[Column], model_file: str, ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``text``, from ids as ``encode`` gives them."""
    return _map_column(df, keep, ids_col, "text", T.StringType(), lambda ids: [decode_ids(load(model_file), i) for i in ids])

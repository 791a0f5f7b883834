"""N-gram language model in Elias-Fano tries, trained and queried by Spark tasks.

Probabilities are Dirichlet-smoothed, each order backed by the one below:

    P(w | ctx) = c(ctx w) / (c(ctx) + mu) + mu / (c(ctx) + mu) * P(w | shorter ctx)

with the unigram (c(w) + 0.1) / (N + 0.1 (V + 1)). The context of a text's first
word is the end of another text.

Documents are cut into blocks of about a million tokens; the words of a block are written
once as rows, its tokens as a file in the shared folder, which later steps read in place. A
block asks for its distinct n-grams by the identifiers of their words, with how often its
training documents hold them; a token is in the longest n-gram that it ends, and the shard
derives the shorter ones. Requests are dealt to shards by the nearest context word and the
predicted word, so that an n-gram is where its shorter ones are. The number of shards
follows the number of tokens; a block sends a shard one packet an order.

A shard builds its slice of the trie from what training documents hold: nearest context
word, predicted word, then the context words further away. A level has, per node above, the
words that follow it, made monotone by the ranges before and kept as Elias-Fano sequence,
with monotone pointers to the ranges; for each n-gram its count. A word is found by
successor search in the range of its node, relative to the value where that range begins.
Slices are written once, into the shared folder, and memory-mapped where they are asked: by
all blocks of the run, and later by texts that the model has not seen (``score_unseen``).
The counts go back to the blocks, which quantise the first terms and add up the texts. No
table, and no part of the model, is held in one task or sent to all of them.

Edge cases: a null text is empty and has the end token alone; identifiers are integers,
a null one counts as the empty string for the fold; repeated rows count as often as
they occur; without training documents every token is unknown; an empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import frozen
from wattframe.llm.elias_fano import EliasFano
from wattframe.session import scratch_path

ORDER = 3
MU = (0.0, 0.0, 8.0, 4.0, 2.0, 2.0)  # by order; the last one holds for higher orders
BLOCK_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 20
STEP = 2048  # codes are -log10 in steps of 1 / 2048
UNSEEN = 65535
END = b""  # words are never empty


def _zip(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unzip(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _pack(x: np.ndarray) -> bytes:
    """Integers >= 0 in the fewest bytes that hold them all, equal bytes of all values
    side by side, which compresses best."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + _zip(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").ravel()


def _deltas(x: np.ndarray) -> bytes:
    """Ascending integers by their differences."""
    return _pack(np.diff(x, prepend=0))


def _undelta(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw))


def _sorted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of integers >= 0, first column first, and where in it a new row
    begins. Columns go side by side into 64 bits; if they do not fit, those before are
    replaced by their ranks."""
    def ordered(key: np.ndarray):
        by = np.argsort(key)
        key = key[by]
        return by, np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]])

    key, bits = columns[0].astype(np.uint64), int(columns[0].max(initial=0)).bit_length()
    for column in columns[1:]:
        width = int(column.max(initial=0)).bit_length()
        if bits + width > 64:
            by, new = ordered(key)
            key[by] = (np.cumsum(new) - 1).astype(np.uint64)
            bits = len(key).bit_length()
        key = (key << np.uint64(width)) | column.astype(np.uint64)
        bits += width
    return ordered(key)


def _by_shard(to: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each shard that occurs, in ascending order."""
    order = np.argsort(to, kind="stable")
    present, starts = np.unique(to[order], return_index=True)
    return {int(s): part for s, part in zip(present, np.split(order, starts[1:]))} if len(to) else {}


def blocks_of(docs: DataFrame, ids: Column, train: Column, folder: str, text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block: its words, their training counts, and the name of its file in the
    folder: identifiers, flags (1: training, 2: no identifier) and lengths of its documents,
    their tokens as numbers in the block's dictionary. Later steps read the file in place."""
    root = _local(folder)
    src = docs.select(ids.cast("long").alias("id"), train.alias("train"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        state: list = []

        def clear():
            state[:] = [{}, [], [], [], 0]

        def block():
            nonlocal number
            words, keys, flags, tokens, n = state
            lens = np.array([len(t) for t in tokens], np.int64)
            flat = np.concatenate(tokens)
            counts = np.bincount(flat[np.repeat(np.array(flags, np.int64) & 1 > 0, lens)], minlength=len(words))
            name = f"{number:016x}-{uuid.uuid4().hex[:8]}"
            body = pa.record_batch({"ids": pa.array([keys], pa.list_(pa.int64())), "flags": [flags], "lens": [lens.tolist()], "tokens": [_pack(flat)]})
            os.makedirs(root, exist_ok=True)
            with pa.ipc.new_file(os.path.join(root, name), body.schema) as f:
                f.write_batch(body)
            row = {"block": [number], "n_tokens": [int(n)], "name": [name], "words": [_zip(b"\n".join(words))], "counts": [_pack(counts)]}
            number += 1
            clear()
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in out], schema=out)

        clear()
        for batch in batches:
            for key, flag, text in zip(*(batch.column(c).to_pylist() for c in ("id", "train", "text"))):
                words = state[0]
                found = text.lower().split()
                found.append(END)
                number_of = words.setdefault
                state[3].append(np.array([number_of(w, len(words)) for w in found], np.int64))
                state[1].append(key or 0)
                state[2].append(int(bool(flag)) + 2 * (key is None))
                state[4] += len(found)
                if state[4] >= block_tokens:
                    yield block()
        if state[1]:
            yield block()

    out = pa.schema([("block", pa.int64()), ("n_tokens", pa.int64()), ("name", pa.string()), ("words", pa.binary()), ("counts", pa.binary())])
    return src.mapInArrow(run, "block long, n_tokens long, name string, words binary, counts binary")


WORDS = "shard int, block long, at binary, nodes binary, counts binary, words binary, n long, v long"


def vocabulary(blocks: DataFrame, shards: int, known: DataFrame | None = None) -> DataFrame:
    """For each block and shard the numbers (in the block), places (in the shard) and counts of
    the words that occur in training; a word's identifier is place * shards + shard; rows with block -1 hold a shard's words and totals.
    With ``known``, such rows of a model, nothing is learned and the words are its."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts"))):
                words = _unzip(raw).split(b"\n")
                counts = _unpack(counts)
                to = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % shards
                rows = [(s, block, at) for s, at in _by_shard(to).items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, *_ in rows], pa.int32()), pa.array([b for _, b, _ in rows], pa.int64()),
                     pa.array([_zip(b"\n".join([words[i] for i in at])) for *_, at in rows], pa.binary()),
                     pa.array([_deltas(at) for *_, at in rows], pa.binary()),
                     pa.array([_pack(counts[at]) for *_, at in rows], pa.binary())], names=["shard", "block", "words", "at", "counts"])

    def reply(shard: int, pdf: pd.DataFrame, nodes: dict[bytes, tuple[int, int]]) -> list[tuple]:
        rows = []
        for block, raw, at in pdf[["block", "words", "at"]].itertuples(index=False):
            found = [nodes.get(w) for w in _unzip(raw).split(b"\n")]
            keep = np.array([f is not None for f in found], bool)
            pairs = np.array([f for f in found if f is not None], np.int64).reshape(-1, 2)
            rows.append((shard, int(block), _deltas(_undelta(at)[keep]), _pack(pairs[:, 0]), _pack(pairs[:, 1]), b"", 0, 0))
        return rows

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, total = int(pdf["shard"].iloc[0]), {}
        for raw, counts in zip(pdf["words"], pdf["counts"]):
            for w, c in zip(_unzip(raw).split(b"\n"), _unpack(counts).tolist()):
                if c:
                    total[w] = total.get(w, 0) + c
        # frequent words have small identifiers, which pack well
        names = sorted(total, key=lambda w: (-total[w], w))
        nodes = {w: (i, total[w]) for i, w in enumerate(names)}
        counts = np.array([total[w] for w in names], np.int64)
        rows = [(shard, -1, b"", b"", _pack(counts), _zip(b"\n".join(names)), int(counts.sum()), len(names))]
        return pd.DataFrame(rows + reply(shard, pdf, nodes), columns=names_of)

    def look_up(pdf: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if not pdf.empty:
            shard, nodes = int(pdf["shard"].iloc[0]), {}
            if not table.empty and table["v"].iloc[0]:
                words, counts = _unzip(table["k_words"].iloc[0]).split(b"\n"), _unpack(table["k_counts"].iloc[0]).tolist()
                nodes = {w: (i, c) for i, (w, c) in enumerate(zip(words, counts))}
            rows = reply(shard, pdf, nodes)
        return pd.DataFrame(rows, columns=names_of)

    names_of = [c.split(" ")[0] for c in WORDS.split(", ")]
    asked = blocks.select("block", "words", "counts").mapInArrow(ask, "shard int, block long, words binary, at binary, counts binary")
    if known is None:
        return asked.groupBy("shard").applyInPandas(learn, WORDS)
    table = known.where("block = -1").select(F.col("shard").alias("s"), F.col("words").alias("k_words"), F.col("counts").alias("k_counts"), "v")
    return asked.groupBy("shard").cogroup(table.groupBy("s")).applyInPandas(look_up, WORDS)


class Level:
    """A level of a shard's trie: per node above (its number) the words that follow it."""

    def __init__(self, nodes: EliasFano, pointers: EliasFano, words: EliasFano):
        self.contexts, self.pointers, self.words = nodes, pointers, words

    @classmethod
    def build(cls, folder: str, name: str, ctx: np.ndarray, word: np.ndarray) -> Level:
        """From sorted distinct (node, word) pairs; a pair's place is its node below."""
        first = np.flatnonzero(np.diff(ctx, prepend=-1)) if len(ctx) else np.zeros(0, np.int64)
        lasts = np.append(first[1:], len(ctx))[: len(first)] - 1
        spans = word[lasts] + 1  # a range takes the values from its base to base + last word
        base = np.concatenate([[0], np.cumsum(spans)])[:-1] if len(first) else np.zeros(0, np.int64)
        return cls(EliasFano(folder, f"{name}.contexts", ctx[first]), EliasFano(folder, f"{name}.pointers", np.append(first, len(ctx))),
                   EliasFano(folder, f"{name}.words", np.repeat(base, np.diff(np.append(first, len(ctx)))) + word))

    @classmethod
    def load(cls, folder: str, name: str) -> Level:
        return cls(*[EliasFano.load(folder, f"{name}.{part}") for part in ("contexts", "pointers", "words")])

    def find(self, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of sorted distinct pairs, -1 where the pair is not in the trie."""
        place = np.full(len(ctx), -1, np.int64)
        if not self.contexts.n or not len(ctx):
            return place
        first = np.flatnonzero(np.diff(ctx, prepend=-1))
        distinct = ctx[first]
        n = np.int64(self.contexts.n)
        node = self.contexts.successor(distinct, np.zeros(len(distinct)), np.full(len(distinct), n))
        here = node < n
        here[here] = self.contexts.get(node[here]).astype(np.int64) == distinct[here]
        node = np.where(here, node, 0)
        begin, end = self.pointers.get(node).astype(np.int64), self.pointers.get(node + 1).astype(np.int64)
        base = np.zeros(len(node), np.int64)
        later = begin > 0
        base[later] = self.words.get(begin[later] - 1).astype(np.int64) + 1  # where the range before ends
        size = np.diff(np.append(first, len(ctx)))
        rows = np.flatnonzero(np.repeat(here, size))
        of = np.repeat(np.arange(len(first)), size)[rows]
        x = base[of] + word[rows]
        at = self.words.successor(x, begin[of], end[of])
        inside = at < end[of]
        inside[inside] = self.words.get(at[inside]).astype(np.int64) == x[inside]
        place[rows[inside]] = at[inside]
        return place


class Slice:
    """A shard's trie, a level per word of its n-grams; their codes or their counts, and the
    counts of the shorter ones that it holds as nodes above (all compressed in their files:
    most are small and alike)."""

    def __init__(self, levels: list[Level], codes: np.ndarray, counts: np.ndarray, shorter: dict[int, np.ndarray] | None = None):
        self.levels, self.codes, self.counts, self.shorter = levels, codes, counts, shorter or {}

    @classmethod
    def build(cls, folder: str, grams: np.ndarray, total: np.ndarray, seen: np.ndarray | None, counted: bool, coded: bool = True,
              shorter: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> Slice:
        """``grams`` has a row per n-gram, in order; ``total`` their counts; ``seen`` the counts
        of all words but the last, or None if all that follows them is here; ``counted`` keeps
        the counts, ``coded`` the codes. ``shorter`` has, by length, all that n-grams begin with
        and perhaps more, in order, and their counts."""
        os.makedirs(folder)
        order, shorter, levels = grams.shape[1], shorter or {}, []
        tables = [grams]
        for k in range(order - 1, 0, -1):
            begin = tables[0][:, :k]
            new = np.ones(len(begin), bool)
            new[1:] = (begin[1:] != begin[:-1]).any(axis=1)
            tables.insert(0, shorter[k][0] if k in shorter else begin[new])
        above = np.zeros(len(tables[0]), np.int64)
        for k, table in enumerate(tables):
            if k:
                above = cls(levels, None, None).find(table[:, :k], True)
            levels.append(Level.build(folder, f"level{k}", above, table[:, k]))
        codes = np.zeros(0, "<u2")
        if coded:
            if seen is None:
                seen = np.bincount(above, weights=total).astype(np.int64)[above] if len(above) else total
            codes = _codes(total, seen, order).astype("<u2")
        with open(os.path.join(folder, "slice.json"), "w") as f:
            json.dump({"order": order, "shorter": sorted(shorter)}, f)
        out = cls(levels, codes, total if counted else total[:0], {k: counts for k, (_, counts) in shorter.items()})
        for name, values in (("codes", out.codes), ("counts", out.counts), *((f"counts{k}", x) for k, x in out.shorter.items())):
            with open(os.path.join(folder, name), "wb") as f:
                f.write(_pack(values))
        return out

    @classmethod
    def load(cls, folder: str) -> Slice:
        def unpacked(name: str) -> np.ndarray:
            with open(os.path.join(folder, name), "rb") as f:
                return _unpack(f.read())

        with open(os.path.join(folder, "slice.json")) as f:
            about = json.load(f)
        return cls([Level.load(folder, f"level{k}") for k in range(about["order"])], unpacked("codes"), unpacked("counts"),
                   {k: unpacked(f"counts{k}") for k in about["shorter"]})

    def seen(self, grams: np.ndarray) -> np.ndarray:
        """Counts of n-grams of one length (sorted, distinct), 0 where one is not in the trie."""
        out, place = np.zeros(len(grams), np.int64), self.find(grams)
        counts = self.counts if grams.shape[1] == len(self.levels) else self.shorter[grams.shape[1]]
        out[place >= 0] = counts[place[place >= 0]]
        return out

    def find(self, grams: np.ndarray, repeated: bool = False) -> np.ndarray:
        """Places of n-grams (sorted, distinct unless ``repeated``) among all of their length,
        -1 where one is not in the trie."""
        if repeated:
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]).any(axis=1)
            return self.find(grams[new])[np.cumsum(new) - 1]
        node = np.zeros(len(grams), np.int64)
        for k, level in enumerate(self.levels[: grams.shape[1]]):
            new = np.ones(len(grams), bool)
            new[1:] = (node[1:] != node[:-1]) | (grams[1:, k] != grams[:-1, k])
            if k:  # rows without a node share none, whatever the words
                new[1:] |= (grams[1:, :k] != grams[:-1, :k]).any(axis=1)
            ask = np.flatnonzero(new & (node >= 0))
            found = np.full(len(grams), -1, np.int64)
            found[ask] = level.find(node[ask], grams[ask, k])
            node = found[np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))] if len(grams) else node
        return node


def _codes(total: np.ndarray, seen: np.ndarray, order: int) -> np.ndarray:
    """Quantised first terms of n-grams that were seen ``total`` times (more than 0), their contexts ``seen`` times."""
    return np.minimum(np.rint(-np.log10(total / (seen + _mu(order))) * STEP), UNSEEN - 1)


def _shards_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the nearest context word and the predicted word: an n-gram is where its shorter ones are."""
    with np.errstate(over="ignore"):
        mix = (grams[:, 0].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
        mix = (mix ^ grams[:, 1].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mix ^= mix >> np.uint64(31)
        mix *= np.uint64(0xD6E8FEB86659FD93)
    return ((mix >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _pack_grams(grams: np.ndarray) -> bytes:
    """Sorted n-grams: of each word the difference to the one above, where those before it are equal."""
    parts, same = [], np.ones(len(grams), bool)
    same[:1] = False
    for k in range(grams.shape[1]):
        column = grams[:, k]
        before = np.zeros(len(grams), np.int64)
        before[1:] = np.where(same[1:], column[:-1], 0)
        parts.append(_pack(column - before))
        same[1:] &= column[1:] == column[:-1]
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _unpack_grams(raw: bytes) -> np.ndarray:
    columns, at, first = [], 0, None  # first: where a run of equal words before begins
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "little")
        column = np.cumsum(_unpack(raw[at + 4 : at + 4 + size]))
        if columns and len(column):
            starts = np.flatnonzero(first)
            before = np.concatenate([[0], column[starts[1:] - 1]])
            column -= np.repeat(before, np.diff(np.append(starts, len(column))))
        elif not columns:
            first = np.zeros(len(column), bool)
            first[:1] = True
        columns.append(column)
        first[1:] |= column[1:] != column[:-1]
        at += 4 + size
    return np.stack(columns, axis=1)


class _Block:
    """A block's tokens with the identifiers of their words."""

    @classmethod
    def load(cls, folder: str, name: str, words: pd.DataFrame, shards: int) -> _Block:
        with pa.ipc.open_file(os.path.join(folder, name)) as f:
            return cls(f.read_all().to_pylist()[0], words, shards)

    def __init__(self, row, words: pd.DataFrame, shards: int):
        self.ids, self.flags = row["ids"], np.asarray(row["flags"], np.int64)
        self.lens = np.asarray(row["lens"], np.int64)
        self.tokens = _unpack(row["tokens"])
        self.starts = np.cumsum(self.lens) - self.lens
        self.train = np.repeat(self.flags & 1 > 0, self.lens)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lens)
        size = int(self.tokens.max()) + 1
        node, count = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        for shard, at, nodes, counts in words[["shard", "at", "nodes", "counts"]].itertuples(index=False):
            at = _undelta(at)
            node[at], count[at] = _unpack(nodes) * shards + shard, _unpack(counts)
        self.word, self.count = node[self.tokens], count[self.tokens]
        # the first word follows an end: the last token of every text is one
        end = int(self.tokens[self.starts[0] + self.lens[0] - 1])
        self.end, self.end_count = node[end], count[end]

    def grams(self, order: int, among: np.ndarray | None = None):
        """Of all tokens or those ``among``: distinct known n-grams, sorted: the nearest context word, the predicted
        word, then the context words further away; times in training; how often the nearest word was seen; and for each token
        its n-gram or -1."""
        columns, ok = [], (self.word >= 0) & (self.place >= order - 2)
        if among is not None:
            ok &= among
        for back in range(1, order):
            before = np.full(len(self.word), -1, np.int64)
            before[back:] = self.word[:-back]
            at = self.starts + back - 1  # where the end of another text comes before
            at = at[at < self.starts + self.lens]
            before[at] = self.end
            columns.append(before)
            ok &= before >= 0
        often = np.zeros(len(self.word), np.int64)
        often[1:] = self.count[:-1]
        often[self.starts] = self.end_count
        columns.insert(1, self.word)
        rows = np.flatnonzero(ok)
        by, new = _sorted([c[rows] for c in columns])
        by = rows[by]
        number, first = np.cumsum(new) - 1, by[new]
        table = np.stack([c[first] for c in columns], axis=1)
        which = np.full(len(self.word), -1, np.int64)
        which[by] = number
        times = np.bincount(number[self.train[by]], minlength=len(first))
        return table, times, often[first], which, often


ANSWERS = "block long, order int, shard int, counts binary"


def _mu(level: int) -> float:
    return MU[min(level, len(MU) - 1)]


def _asked(body: DataFrame, words: DataFrame, folder: str, order: int, shards: int) -> DataFrame:
    """The packets of all blocks: a row per (block, order, shard). A token is in the longest
    n-gram that it ends; the shorter ones follow from that."""
    root = _local(folder)

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in left.to_dict("records"):
            block = _Block.load(root, row["name"], right, shards)
            rest = np.ones(len(block.word), bool)
            for k in range(order, 1, -1):
                grams, times, _, which, _ = block.grams(k, rest)
                rest &= which < 0
                for s, at in _by_shard(_shards_of(grams, shards)).items():
                    rows.append((s, k, int(row["block"]), _pack_grams(grams[at]), _pack(times[at])))
        return pd.DataFrame(rows, columns=["shard", "order", "block", "grams", "times"])

    return body.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(
        ask, "shard int, order int, block long, grams binary, times binary")


def _local(folder: str) -> str:
    path = folder.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"slices are memory-mapped: {folder} is not a path that tasks can map")
    return path


def _slice_name(order: int, shard: int) -> str:
    return f"order{order}-{shard:06d}"


def _distinct(grams: np.ndarray, times: np.ndarray):
    """The distinct n-grams, in order; their times in all; each row's number among them."""
    by, new = _sorted([grams[:, k] for k in range(grams.shape[1])])
    number = np.empty(len(grams), np.int64)
    number[by] = np.cumsum(new) - 1
    return grams[by[new]], np.bincount(number, weights=times, minlength=int(new.sum())).astype(np.int64), number


def _answers(asked: DataFrame, folder: str, last: int, learn: bool) -> DataFrame:
    """Answers to the packets: the counts of a block's distinct n-grams, in order. To
    ``learn``, a shard builds its slices first, under a name of its own for each attempt,
    and gives them the shard's name if no other attempt has; else the slices are those of a
    model. ``last`` is the longest order."""
    root = _local(folder)

    def slice_of(shard: int, orders: dict) -> Slice | None:
        path = os.path.join(root, f"shard-{shard:06d}")
        if not learn:  # without a slice nothing was learned there
            return Slice.load(path) if os.path.exists(path) else None
        attempt = f"{path}-{uuid.uuid4().hex[:8]}"
        tables = {k: (np.zeros((0, k), np.int64), np.zeros(0, np.int64)) for k in range(2, last + 1)}
        tables |= {k: (grams[total > 0], total[total > 0]) for k, (_, _, grams, total, _) in orders.items()}
        trie = Slice.build(attempt, *tables.pop(last), None, True, False, tables)
        if not os.path.exists(path):
            try:
                os.rename(attempt, path)
            except OSError:  # another attempt was faster: a folder with files is not replaced
                if not os.path.exists(path):
                    raise
        return trie

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, orders = int(pdf["shard"].iloc[0]), {}
        # by block, of the order above: its distinct n-grams and their times
        above: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for order in range(last, 1, -1):
            parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for block, raw, times in pdf.loc[pdf["order"] == order, ["block", "grams", "times"]].itertuples(index=False):
                parts[block] = (_unpack_grams(raw), _unpack(times))
            while above:  # let go of as they are used
                block, (grams, times) = above.popitem()
                grams = grams[:, :order]  # without the farthest context word
                if block in parts:
                    grams, times = np.concatenate([parts[block][0], grams]), np.concatenate([parts[block][1], times])
                parts[block] = _distinct(grams, times)[:2]
            above = parts
            if parts:
                here = sorted(parts)
                cuts = np.cumsum([0, *(len(parts[b][0]) for b in here)])
                orders[order] = (here, cuts, *_distinct(np.concatenate([parts[b][0] for b in here]), np.concatenate([parts[b][1] for b in here])))
        del parts, above
        trie, rows = slice_of(shard, orders), []
        for order, (here, cuts, grams, _, number) in orders.items():
            counts = np.zeros(len(grams), np.int64) if trie is None else trie.seen(grams)
            rows += [(int(b), order, shard, _pack(counts[number[i:j]])) for b, i, j in zip(here, cuts, cuts[1:])]
        return pd.DataFrame(rows, columns=["block", "order", "shard", "counts"])

    return asked.groupBy("shard").applyInPandas(answer, ANSWERS)


@dataclass
class Model:
    """What scoring needs: the words, the slices and where they are, the counts."""

    folder: str
    words: DataFrame
    order: int
    shards: int
    n: int
    v: int


def _scores(body: DataFrame, words: DataFrame, answers: DataFrame, folder: str, model: Model, id_col: str) -> DataFrame:
    """The scores, written once: answers are made for them alone, and go straight to the blocks."""
    root = _local(folder)
    order, shards, n, v = model.order, model.shards, model.n, model.v

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.to_dict("records"):
            block = _Block.load(root, row["name"], right[right["order"] == 1], shards)
            base = (block.count + 0.1) / (n + 0.1 * (v + 1))
            p, total = base, None
            for level in range(2, order + 1):
                grams, _, _, which, often = block.grams(level)
                if level > 2:  # a context's count is that of the n-gram that ends before
                    often = np.zeros(len(which), np.int64)
                    often[1:] = total[:-1]
                    often[block.place < level - 2] = 0
                places = _by_shard(_shards_of(grams, shards))
                counts = np.zeros(len(grams) + 1, np.int64)  # one more entry stands for tokens without an n-gram (-1)
                for shard, raw in right.loc[right["order"] == level, ["shard", "counts"]].itertuples(index=False):
                    counts[places[shard]] = _unpack(raw)
                total, mu = counts[which], _mu(level)
                hit = total > 0
                p = mu / (often + mu) * p
                p[hit] += 10.0 ** (-_codes(total[hit], often[hit], level) / STEP)
            out.append(pd.DataFrame({
                "id": pd.Series(block.ids, dtype="Int64").mask(block.flags > 1), "n_tokens": block.lens,
                "n_known": np.add.reduceat((block.count > 0).astype(np.int64), block.starts),
                "base_score": np.add.reduceat(np.log10(base), block.starts), "score": np.add.reduceat(np.log10(p), block.starts)}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})

    none = F.lit(None).cast("binary")
    rows = (words.select("block", F.lit(1).alias("order"), "shard", "counts", "at", "nodes")
            .unionByName(answers.select("block", "order", "shard", "counts", none.alias("at"), none.alias("nodes"))).where("block >= 0"))
    found = frozen(body.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(
        finish, "id long, n_tokens long, n_known long, base_score double, score double"))
    return found.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def _written_blocks(docs: DataFrame, id_col: str, train: Column, text_col: str, block_tokens: int) -> tuple[DataFrame, str]:
    """The rows of the blocks, and the folder of their files."""
    path, folder = (scratch_path(docs.sparkSession, name) for name in ("lm-blocks", "lm-tokens"))
    blocks_of(docs, F.col(id_col), train, folder, text_col, block_tokens).write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.parquet(path), folder


def learn_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                    block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, Model]:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every document, and the
    model. ``train`` says whether a document is learned from. Scores are log10 probabilities."""
    spark: SparkSession = docs.sparkSession
    blocks, bodies = _written_blocks(docs, id_col, train, text_col, block_tokens)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-tokens // shard_tokens))
    words = frozen(vocabulary(blocks, shards))
    n, v = words.where("block = -1").agg(F.sum("n"), F.sum("v")).first()
    folder = scratch_path(spark, "lm-slices")
    body = blocks.select("block", "name")
    if order > 1:
        asked = _asked(body, words.where("block >= 0"), bodies, order, shards)
        answers = _answers(asked, folder, order, True)
    else:
        answers = spark.createDataFrame([], ANSWERS)
    model = Model(folder, words, order, shards, n or 0, v or 0)
    return _scores(body, words, answers, bodies, model, id_col), model


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
          block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The scores of ``learn_and_score``."""
    return learn_and_score(docs, train, id_col, text_col, order, block_tokens, shard_tokens)[0]


def score_unseen(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Scores of other documents by a model's stored slices; nothing is learned."""
    blocks, bodies = _written_blocks(docs, id_col, F.lit(False), text_col, block_tokens)
    words = frozen(vocabulary(blocks, model.shards, model.words))
    body = blocks.select("block", "name")
    if model.order > 1:
        asked = _asked(body, words, bodies, model.order, model.shards)
        answers = _answers(asked, model.folder, model.order, False)
    else:
        answers = docs.sparkSession.createDataFrame([], ANSWERS)
    return _scores(body, words, answers, bodies, model, id_col)

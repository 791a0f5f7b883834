"""Sum-of-squares online packing of tokenized documents into fixed windows.

A document of more than a window fills whole windows of its own; what is left,
shorter than a window, is one item. The level array holds, for each fill level,
how many open windows have it. An item goes to the level (or a new window) that
makes the sum of the squared counts smallest, which keeps many different levels
in stock, so that a later item finds one that it closes. At the end of a task,
and whenever too many windows are open, the emptiest windows' pieces are cut to
fill the gaps of the others: one window per task at most stays partly filled.

Tasks pack the documents of their own partition, so texts and tokens are never
shuffled and only open windows (``max_open`` at most) are in memory. The
sequence identifier has the partition's number in its upper bits; a task that
is repeated after a lost executor reads the same rows and gives the same rows.
Input whose row order is not fixed (a shuffle's output) is to be written first.

Edge cases: a null text is empty and gives the end token alone; repeated
documents are packed each; a text of any length is tokenized whole.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 1024
MAX_OPEN = 4096
SEQUENCE_BITS = 36

PIECES = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"),
          ("sequence_id", "long"), ("offset", "long")]


def load_encoder(rank_file: str, pattern: str, end_of_text: int = 50256):
    """Byte-level BPE from a rank file; equal to the same vocabulary in a tokenizer
    file, whose special token is likewise recognised inside a text."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks,
                             special_tokens={"<|endoftext|>": end_of_text})


def tokenize(encoder, text: str) -> np.ndarray:
    """The ids of a text and the end token 0, as little-endian unsigned 32-bit."""
    ids = encoder.encode_to_numpy(text, allowed_special="all")
    out = np.zeros(len(ids) + 1, "<u4")
    out[:-1] = ids
    return out


class Packer:
    """Open windows by fill level. A piece is [document, start, ids]."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.n_open = window, max_open, 0
        self.counts = np.zeros(window + 1, np.int64)  # the level array; full windows are not counted
        self.levels: list[list[list]] = [[] for _ in range(window)]

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list]:
        """Place a document; windows that are full come out as lists of pieces."""
        whole = len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            yield [(doc, at, ids[at : at + self.window])]
        if whole < len(ids):
            done = self._place((doc, whole, ids[whole:].copy()))
            if done:
                yield done
            if self.n_open > self.max_open:
                yield from self.close(self.max_open // 2)

    def _place(self, piece) -> list | None:
        size, n = len(piece[2]), self.counts
        # change of the sum of squares if a window of level h gets the piece; h = 0 opens a window
        after = 2 * n[size:] + 1
        after[-1] = 0
        before = np.where(n[: len(after)] > 0, 2 * n[: len(after)] - 1, -(1 << 40))
        before[0] = 0
        change = np.where(before == -(1 << 40), np.iinfo(np.int64).max, after - before)
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # the fullest of equal ones
        if level:
            pieces = self.levels[level].pop()
            n[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.levels[level + size].append(pieces)
        n[level + size] += 1
        self.n_open += 1
        return None

    def close(self, keep: int = 0) -> Iterator[list]:
        """Cut the pieces of the emptiest windows to fill the others until ``keep``
        windows stay open; with 0 the last one comes out as it is."""
        opened = [w for level in self.levels for w in level]  # by fill level
        fills = [sum(len(p[2]) for p in w) for w in opened]
        lo, hi = 0, len(opened) - 1
        while lo < hi and hi - lo + 1 > keep:
            gap = self.window - fills[hi]
            while gap and lo < hi:
                doc, start, ids = opened[lo].pop()
                take = min(gap, len(ids))
                opened[hi].append((doc, start, ids[:take]))
                if take < len(ids):
                    opened[lo].append((doc, start + take, ids[take:]))
                fills[hi] += take
                fills[lo] -= take
                gap -= take
                if not fills[lo]:
                    lo += 1
            if not gap:
                yield opened[hi]
                hi -= 1
        rest = [(w, f) for w, f in zip(opened[lo : hi + 1], fills[lo : hi + 1]) if f]
        if not keep:
            yield from (w for w, _ in rest)
            rest = []
        self.counts[:] = 0
        self.levels = [[] for _ in range(self.window)]
        self.n_open = len(rest)
        for w, f in rest:
            self.levels[f].append(w)
            self.counts[f] += 1


def pack(docs: DataFrame, keep: Column, rank_file: str, pattern: str, text_col: str = "text",
         window: int = WINDOW, max_open: int = MAX_OPEN, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``keep`` of its document, start and length in the document's
    ids, CRC-32 of the ids, the document's number of ids, sequence and offset there.
    ``with_ids`` adds the ids themselves."""
    src = docs.select(keep.alias("_keep"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([src.schema["_keep"]])
    for name, kind in PIECES:
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = load_encoder(rank_file, pattern), Packer(window, max_open)
        sequence = TaskContext.get().partitionId() << SEQUENCE_BITS
        kind = None

        def rows(windows):
            nonlocal sequence
            out = []
            for pieces in windows:
                at = 0
                for (value, total), start, ids in pieces:
                    out.append((value, start, len(ids), zlib.crc32(ids), total, sequence, at, ids))
                    at += len(ids)
                sequence += 1
            return out

        def batch_of(out):
            cols = [pa.array([x[0] for x in out], kind)]
            cols += [pa.array([x[i] for x in out], pa.int64()) for i in range(1, 7)]
            if with_ids:
                cols.append(pa.array([x[7] for x in out], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for batch in batches:
            kind, out = batch.column("_keep").type, []
            for value, text in zip(batch.column("_keep").to_pylist(), batch.column("_text").to_pylist()):
                ids = tokenize(encoder, text)
                out += rows(packer.add((value, len(ids)), ids))
            if out:
                yield batch_of(out)
        out = rows(packer.close())
        if out:
            yield batch_of(out)

    return src.mapInArrow(run, schema).withColumnRenamed("_keep", "kept")

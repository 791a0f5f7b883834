"""Token-ID files: documents as ids in rANS blocks with one shared frequency table.

``tokenized`` turns texts into ids, ``write`` stores them in ascending order of the
key and ``read`` gives them back. A dataset is a folder:

- ``frequencies.bin``: the table all blocks are coded with, counted over all ids;
- ``part-*.ids``: one file per range partition of the key. Blocks of ``BLOCK`` ids
  (independent of each other, see ``range_coder``), then a footer: an Arrow table
  with the keys and lengths of the documents, the places of the blocks, checksums;
- ``manifest``: Parquet with one row per file, in order, with its number of ids and
  the ids before it.

Files are written by tasks, each attempt under a name of its own; the manifest
names those of the attempts that Spark committed, so a repeated or a lost attempt
does no harm. Reading is split by ranges of ids: a task that starts inside a file
decodes from the checkpoint before its first document.

A document's ids are never split between files, and documents are dealt out by
range of (key, digest of the ids, row), so no key, however frequent, makes a large
file. Counts of ids reach the driver as one row per id of the vocabulary (bounded
by it); nothing else does.

Edge cases: a null text is an empty one and gives the end id alone; null keys come
first; rows with equal keys are in order of the CRC-32 of their ids as staged, and their number;
repeated rows are all kept; a text of any length is one document, over as many
blocks as it needs; an empty table gives a dataset without files. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import codecs
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm import range_coder
from wattframe.session import scratch_path

BLOCK = 1 << 20
FILE_IDS = 1 << 23
SPLIT_IDS = 1 << 22
CACHED_WORDS = 600_000
SLICE_BYTES = 6_000_000
BATCH_BYTES = 8_000_000
FILES_A_GROUP = 1024
MOST_TASKS = 20_000

MAGIC = b"WIDF0001"
TRAILER = struct.Struct("<QQII8s")  # place of the footer, its length, its CRC-32, CRC-32 of the frequency table, magic


# ---- texts to ids

class Encoder:
    """The library's ids of whole texts.

    For byte-level vocabularies a text may be cut before a space that does not lie
    between white space: the library's own pattern cuts there too. So a text's words
    are looked up, and only words not seen before go through the library: one of
    letters, perhaps with marks behind it, through its model (the pattern leaves the
    letters whole, and the marks), others through all its steps. Texts with other spaces, and texts
    holding an added token, go through it whole. At most ``CACHED_WORDS`` words, and
    those of one slice, are kept."""

    #: letters of the blocks up to U+024F, which every version of the character tables agrees
    #: on, and ASCII marks other than the apostrophe, at which the pattern may cut
    SIMPLE = re.compile(r"([^\W\d_\u0250-\U0010ffff]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.tokenize = self.library.model.tokenize
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.line = self._ids("\n")
        self.by_words = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
                         and len(self.line) == 1 and all(t.split() == [t] and not t[0].isalpha() for t in self.added))
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.bytes_of = [i.to_bytes(int(self.width[2]), "little") for i in range(self.library.get_vocab_size())]
        self.line_bytes = self._bytes(self.line)
        # the library's names of bytes: printable ones stand for themselves, the others follow from U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in plain]
        self.byte_names = "".join(chr(b if b in plain else 256 + others.index(b)) for b in range(256))
        self.space = self.byte_names[32]
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def clear(self) -> None:
        #: number of a word (after a space), or of a 1-tuple of it (at the start of a text)
        self.numbers: dict[str | tuple[str], int] = {}
        #: ids of words by number, and of letters that were seen before marks only
        self.coded: list[bytes | None] = []
        self.cores: dict[str, bytes] = {}
        #: ids of marks; None if an added token is among them
        self.marks: dict[str, bytes | None] = {"": b""}
        self.flat, self.at, self.size = np.zeros(0, self.width), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.open, self.closed, self.apart = np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, bool)

    def _core(self, letters: str) -> bytes:
        """Ids of letters, with or without a space before, one token of the library's pattern."""
        ids = self.cores.get(letters)
        if ids is None:
            of, name = self.bytes_of, codecs.charmap_decode(letters.encode(), "strict", self.byte_names)[0]
            ids = self.cores[letters] = b"".join([of[t.id] for t in self.tokenize(name)])
        return ids

    def _marks(self, marks: str) -> bytes | None:
        if marks not in self.marks:
            self.marks[marks] = None if any(t in marks for t in self.added) else self._bytes(self._ids(marks))
        return self.marks[marks]

    def _simple(self, word: str) -> bytes | None:
        """Ids of a word of letters and marks after a space, or of several such, a line
        each, the first after a space; None if it is something else."""
        ids, before = b"", " "
        for part in word.split("\n"):
            m = self.SIMPLE.fullmatch(part)
            marks = self._marks(m[2]) if m else None
            if marks is None:
                return None
            if not before:
                ids += self.line_bytes
            ids += self._core(before + m[1]) + marks
            before = ""
        return ids

    def _learn(self, words: list) -> None:
        """Ids of new words, and whether they begin or end with white space (an empty one
        does both: what is beside it is a space) or hold an added token."""
        before, coded, lines, others = len(self.coded), [None] * len(words), [], []
        match, marks, number, core = self.SIMPLE.fullmatch, self.marks.get, self.numbers.get, self._core
        tokenize, of, space, name_of, names = self.tokenize, self.bytes_of, self.space, codecs.charmap_decode, self.byte_names
        for i, w in enumerate(words):
            if isinstance(w, tuple):
                others.append(i)
            elif w.isascii() and w.isalpha():
                coded[i] = b"".join([of[t.id] for t in tokenize(space + w)])  # ``_core`` in place, the word being new
            elif (m := match(w)) and (behind := marks(m[2]) or self._marks(m[2])) is not None:
                if not behind:
                    coded[i] = b"".join([of[t.id] for t in tokenize(space + name_of(w.encode(), "strict", names)[0])])
                    continue
                at = number(m[1], -1)  # the same letters as a word, before or among these
                ids = (self.coded[at] if at < before else coded[at - before]) if at >= 0 else None
                coded[i] = (core(" " + m[1]) if ids is None else ids) + behind
            elif w.split() == [w]:
                lines.append(i)
            else:
                coded[i] = self._simple(w)
                if coded[i] is None:
                    others.append(i)
        for a in range(0, len(lines), 4096):
            some = lines[a : a + 4096]
            ids = self._ids("\n".join(" " + words[i] for i in some))
            at = [-1, *[k for k, x in enumerate(ids) if x == self.line[0]], len(ids)]
            for i, first, stop in zip(some, at, at[1:]):
                coded[i] = self._bytes(ids[first + 1 : stop])
        for i, e in zip(others, self.library.encode_batch_fast(
                [" " + words[i] if isinstance(words[i], str) else words[i][0] for i in others], add_special_tokens=False)):
            coded[i] = self._bytes(e.ids)
        self.coded += coded
        size = np.fromiter(map(len, coded), np.int32, len(coded)) // int(self.width[2])
        self.at = np.concatenate([self.at, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(coded), self.width)])
        flags = np.zeros((3, len(words)), bool)
        for i in [*lines, *others]:
            w = words[i] if isinstance(words[i], str) else words[i][0]
            flags[:, i] = not w or w[0].isspace(), not w or w[-1].isspace(), any(t in w for t in self.added)
        self.open, self.closed, self.apart = (np.concatenate([a, b]) for a, b in zip((self.open, self.closed, self.apart), flags))

    def _number(self, words: list) -> np.ndarray:
        """Numbers of words, new ones in the order in which they come; a word may come twice."""
        number = np.fromiter(map(self.numbers.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(number < 0).tolist()
        if unknown:
            new = list(dict.fromkeys([words[i] for i in unknown]))
            self.numbers.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self._learn(new)
            number[unknown] = [self.numbers[words[i]] for i in unknown]
        return number

    def encode(self, texts: pa.Array | list[str], end: int) -> list[bytes]:
        """The ids of each text and then ``end``, as little-endian integers of ``width``."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]) if len(texts) else np.zeros(1)
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE_BYTES, "right")) - 1)
            out += self._encode_slice(texts.slice(at, stop - at), end)
            at = stop
        return out

    def _encode_slice(self, texts: pa.Array, end: int) -> list[bytes]:
        tail = np.array([end], self.width).tobytes()
        if not self.by_words:
            return [np.array(e.ids, self.width).tobytes() + tail for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        if len(self.numbers) > CACHED_WORDS:
            self.clear()
        lists = pc.split_pattern(texts, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts, stops = starts[:-1] - starts[0], starts[1:] - starts[0]
        words = lists.flatten().dictionary_encode()  # an empty text is one empty word
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = words.indices.to_numpy().astype(np.int32)  # of the slice's words, then of its texts' first words
        names += [(names[i],) for i in index[starts].tolist()]
        index[starts] = np.arange(len(names) - len(starts), len(names), dtype=np.int32)
        number = self._number(names)
        size = self.size[number][index]
        upto = np.cumsum(size, dtype=np.int32)  # of a slice of some megabytes
        shift = self.at[number][index]
        shift += size
        shift -= upto
        place = np.repeat(shift, size)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.flat[place]
        # a space between white space; what follows a text's last word is another text
        bad = self.apart[number][index]
        beside = self.closed[number][index[:-1]]
        beside &= self.open[number][index[1:]]
        beside[stops[:-1] - 1] = False
        bad[:-1] |= beside
        whole = np.flatnonzero(np.add.reduceat(bad, starts))
        data, ends = ids.tobytes(), upto[stops - 1].astype(np.int64) * int(self.width[2])
        parts = [data[a:b] + tail for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        if len(whole):
            for i, e in zip(whole, self.library.encode_batch_fast([texts[int(i)].as_py() for i in whole], add_special_tokens=False)):
                parts[i] = np.array(e.ids, self.width).tobytes() + tail
        return parts


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for the life of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _forget_encoders() -> None:
    """Called where a worker goes on to the files, so that its words are not kept beside them."""
    _ENCODERS.clear()


def tokenized(docs: DataFrame, key: Column, tokenizer_file: str, text_col: str = "text", end: int = 2) -> DataFrame:
    """(key, n_tokens, width, ids, counts): the end id included; ``ids`` are little-endian
    integers of ``width`` bytes. ``counts`` has, on one row of some, how often each id
    occurs in them, so that the ids need not be read again to count them."""
    src = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([src.schema["key"]]).add("n_tokens", "long").add("width", T.IntegerType()).add("ids", "binary").add("counts", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        width = int(encoder.width[2])
        for batch in batches:
            ids = encoder.encode(batch.column("text"), end)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([len(x) // width for x in ids], pa.int64()),
                 pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary()),
                 pa.array([_counts_of(ids, encoder.width)] + [None] * (len(ids) - 1) if ids else [], pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


# ---- ids to files

def _counts_of(ids: list[bytes], width: str) -> bytes:
    """The distinct ids, as 32-bit integers, then their counts, as 64-bit integers."""
    counts, at = np.zeros(0, np.int64), 0
    while at < len(ids):
        stop, size = at, 0  # some megabytes at a time
        while stop < len(ids) and (stop == at or size < BATCH_BYTES):
            size += len(ids[stop])
            stop += 1
        found = np.bincount(np.frombuffer(b"".join(ids[at:stop]), width))
        if len(found) > len(counts):
            counts = np.concatenate([counts, np.zeros(len(found) - len(counts), np.int64)])
        counts[: len(found)] += found
        at = stop
    seen = np.flatnonzero(counts)
    return seen.astype("<u4").tobytes() + counts[seen].astype("<i8").tobytes()


def _count_ids(tokens: DataFrame) -> DataFrame:
    """(id, n) over all rows, from the counts that ``tokenized`` has left, added up within a task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_encoders()
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                n = len(raw) // 12
                seen, found = np.frombuffer(raw, "<u4", n).astype(np.int64), np.frombuffer(raw, "<i8", n, 4 * n)
                if n and seen[-1] >= len(counts):
                    counts = np.concatenate([counts, np.zeros(seen[-1] + 1 - len(counts), np.int64)])
                counts[seen] += found
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])

    counted = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


class FileWriter:
    """One file: blocks as they fill, then the footer."""

    def __init__(self, out, table: range_coder.FrequencyTable, block: int = BLOCK):
        self.out, self.table, self.block = out, table, block
        self.waiting, self.n_waiting, self.blocks, self.at = [], 0, [], 0
        self.keys, self.lengths = [], []

    def add(self, keys: pa.Array, documents: list[np.ndarray]) -> None:
        self.keys.append(keys)
        self.lengths += [len(d) for d in documents]
        for ids in documents:
            self.waiting.append(ids)
            self.n_waiting += len(ids)
            if self.n_waiting >= self.block:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting)
        stop = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, stop, self.block):
            part = ids[a : min(a + self.block, stop)]
            data = range_coder.encode_block(part, self.table)
            self.out.write(data)
            self.blocks.append((self.at, len(data), len(part)))
            self.at += len(data)
        self.waiting, self.n_waiting = [ids[stop:]], len(ids) - stop

    def close(self) -> int:
        """The number of bytes of the file."""
        if self.n_waiting:
            self._flush(True)
        docs = pa.table({"key": pa.chunked_array(self.keys), "n": pa.array(self.lengths, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(docs)
        places = np.array(self.blocks, "<u8").reshape(-1, 3)
        footer = struct.pack("<I", len(places)) + places.tobytes() + sink.getvalue().to_pybytes()
        self.out.write(footer)
        self.out.write(TRAILER.pack(self.at, len(footer), zlib.crc32(footer), zlib.crc32(self.table.to_bytes()), MAGIC))
        return self.at + len(footer) + TRAILER.size


class FileReader:
    """Random access to the ids of one file."""

    def __init__(self, source, table: range_coder.FrequencyTable):
        self.source, self.table = source, table
        end = source.size()
        at, length, crc, table_crc, magic = TRAILER.unpack(source.read_at(TRAILER.size, end - TRAILER.size))
        footer = source.read_at(length, at)
        if magic != MAGIC or zlib.crc32(footer) != crc:
            raise range_coder.Corrupt("footer")
        if table_crc != zlib.crc32(table.to_bytes()):
            raise range_coder.Corrupt("coded with another frequency table")
        (n,) = struct.unpack_from("<I", footer)
        self.blocks = np.frombuffer(footer, "<u8", 3 * n, 4).reshape(-1, 3).astype(np.int64)
        docs = pa.ipc.open_file(pa.py_buffer(footer[4 + 24 * n :])).read_all()
        self.keys, self.lengths = docs.column("key").combine_chunks(), docs.column("n").to_numpy()
        self.ends = np.cumsum(self.lengths)
        self.block_ends = np.cumsum(self.blocks[:, 2])

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file."""
        parts = [np.zeros(0, np.uint32)]
        for k in range(int(np.searchsorted(self.block_ends, start, "right")), len(self.blocks)):
            at, size, n = self.blocks[k].tolist()
            first = int(self.block_ends[k]) - n
            if first >= end:
                break
            parts.append(range_coder.decode_block(self.source.read_at(size, at), self.table, max(start - first, 0), end - first))
        return np.concatenate(parts)


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write(tokens: DataFrame, folder: str, file_ids: int = FILE_IDS, block: int = BLOCK) -> None:
    """Write a dataset from rows of ``tokenized``. They are first written as they are,
    so that texts are tokenized once, however often a later step runs."""
    spark = tokens.sparkSession
    staged = scratch_path(spark, "token-ids")
    tokens.withColumn("crc", F.crc32("ids")).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(staged)
    rows = spark.read.parquet(staged)
    counts = _count_ids(rows).collect()  # a row per id of the vocabulary
    table = range_coder.FrequencyTable.fit(np.array([r["id"] for r in counts], np.uint32), np.array([r["n"] for r in counts], np.int64))
    blob = table.to_bytes()
    fs, base = _open(folder)
    fs.create_dir(f"{base}/files", recursive=True)
    with fs.open_output_stream(f"{base}/frequencies.bin") as f:
        f.write(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_encoders()
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids"
        fs, base = _open(folder)
        writer = out = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    out = fs.open_output_stream(f"{base}/files/{name}")
                    writer = FileWriter(out, range_coder.FrequencyTable.from_bytes(blob), block)
                writer.add(batch.column("key"), [np.frombuffer(ids, f"<u{w}").astype(np.uint32) for w, ids in zip(
                    batch.column("width").to_pylist(), batch.column("ids").to_pylist())])
            if writer is not None:
                size = writer.close()
        finally:
            if out is not None:
                out.close()
        if writer is not None:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([context.partitionId()], pa.int32()), "file": [name], "n_docs": pa.array([len(writer.lengths)], pa.int64()),
                "n_ids": pa.array([sum(writer.lengths)], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    n_files = max(1, -(-sum(r["n"] for r in counts) // file_ids))
    order = ["key", "crc", "n_tokens", "row"]
    placed = rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order).select("key", "width", "ids")
    files = scratch_path(spark, "token-files")
    placed.mapInArrow(run, "part int, file string, n_docs long, n_ids long, n_bytes long").write.parquet(files)
    _with_starts(spark.read.parquet(files)).write.parquet(f"{folder}/manifest")


def _with_starts(files: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all files before. Sums of groups of files first, so
    that no window holds more than a group of files, or one row a group."""
    grouped = files.withColumn("group", F.expr(f"part div {FILES_A_GROUP}"))
    sums = grouped.groupBy("group").agg(F.sum("n_ids").alias("_ids"))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("group").alias("_group"), F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).cast("long")
    return grouped.join(before, F.col("group") == F.col("_group")).select(*files.columns, start.alias("start"))


def read(spark: SparkSession, folder: str, key_type: T.DataType, split_ids: int = SPLIT_IDS) -> DataFrame:
    """(key, start, n_tokens, ids): all documents of a dataset; ``start`` counts the ids
    of all documents before, ``ids`` are little-endian unsigned 32-bit integers."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    last = F.greatest(F.expr(f"(n_ids - 1) div {split_ids}"), F.lit(0))
    splits = manifest.select("file", F.col("start").alias("file_start"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("split"))
    schema = T.StructType().add("key", key_type).add("start", "long").add("n_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_encoders()
        fs, base = _open(folder)
        table = None
        for batch in batches:
            for row in batch.to_pylist():
                if table is None:
                    with fs.open_input_file(f"{base}/frequencies.bin") as f:
                        table = range_coder.FrequencyTable.from_bytes(f.read())
                with fs.open_input_file(f"{base}/files/{row['file']}") as source:
                    yield from _read_split(FileReader(source, table), row["file_start"], row["split"] * split_ids, split_ids)

    def _read_split(reader: FileReader, file_start: int, first: int, length: int) -> Iterator[pa.RecordBatch]:
        starts = reader.ends - reader.lengths
        a, stop = int(np.searchsorted(starts, first)), int(np.searchsorted(starts, first + length))
        while a < stop:  # documents that begin in this split, a few megabytes at a time
            b = max(a + 1, int(np.searchsorted(reader.ends, starts[a] + BATCH_BYTES // 4, "right")))
            b = min(b, stop)
            ids = reader.ids(int(starts[a]), int(reader.ends[b - 1])).astype("<u4")
            cut = [ids[s:e].tobytes() for s, e in zip((starts[a:b] - starts[a]).tolist(), (reader.ends[a:b] - starts[a]).tolist())]
            yield pa.RecordBatch.from_arrays(
                [reader.keys.slice(a, b - a), pa.array(starts[a:b] + file_start, pa.int64()), pa.array(reader.lengths[a:b], pa.int64()),
                 pa.array(cut, pa.binary())], names=schema.names)
            a = b

    n_splits = splits.count()
    # a task a split: rows of a few bytes that stand for megabytes, which must not be joined by size
    return splits.repartition(max(1, min(n_splits, MOST_TASKS)), "file", "split").mapInArrow(run, schema)

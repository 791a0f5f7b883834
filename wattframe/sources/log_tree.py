"""Text files of a folder that holds very many of them, found and read by tasks.

Spark's file readers keep an entry for each file on the driver, for the listing and again
for each scan. Here one task lists the folder, others its subfolders, and the result is
a checkpointed table of byte ranges; the driver only learns how many there are.
Names, lines and header are taken as Spark's CSV reader takes them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.session import ensure_checkpoint_dir
from wattframe.sources.append_log import open_path
from wattframe.sources.power_source import BATCH_ROWS, OPEN_BYTES, RANGE_BYTES, lines_of

LIST_TASKS = 8  # tasks a core that list subfolders
_ENTRY = "root int, name string, folder boolean, size long, glob int"
_PIECE = "glob int, root int, name string, start long, stop long, cost long"
_BOM = b"\xef\xbb\xbf"
_BLANK = bytes(range(33))  # what Spark trims from a line to see if it is empty
# what Hadoop's paths quote in a URI
_QUOTED = re.compile(r"[\x00-\x20\"#%<>?\[\]\\^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _quote(name: str) -> str:
    return _QUOTED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), name)


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's readers leave out."""
    out = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return out and not (folder and name.startswith(("_metadata", "_common_metadata")))


def _children(fs: pyarrow.fs.FileSystem, path: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, size) of what lies in a folder."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with os.scandir(path) as entries:  # one by one; Arrow makes a list
            for e in entries:
                try:
                    yield e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size
                except FileNotFoundError:  # deleted since
                    continue
    else:
        for info in fs.get_file_info(pyarrow.fs.FileSelector(path)):
            yield info.base_name, info.type == pyarrow.fs.FileType.Directory, info.size or 0


def _batches(rows: Iterator[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    waiting = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), types)], list(names))

    for row in rows:
        waiting.append(row)
        if len(waiting) == BATCH_ROWS:
            yield batch()
            waiting = []
    if waiting:
        yield batch()


class LogTree:
    """The files under a folder (its name may be a glob) whose paths end as one of ``globs``
    has it, each glob ``folder/file`` with ``*`` for parts of a name; ``names`` are patterns that
    the paths of a glob have to match besides. ``found`` tells for each glob whether the folder
    holds anything that the glob's folder part fits."""

    def __init__(self, spark: SparkSession, directory: str, globs: Sequence[str], names: Sequence[str], range_bytes: int = RANGE_BYTES):
        self.spark = spark
        self.roots = self._roots(spark, directory)
        ensure_checkpoint_dir(spark)
        parts = [["[^/]*".join(map(re.escape, part.split("*"))) for part in g.split("/")] for g in globs]
        pieces = self._pieces([p[0] for p in parts], ["/" + "/".join(p) + "$" for p in parts], names, range_bytes)
        self.pieces = pieces.checkpoint(eager=True)
        sums = {r["glob"]: r for r in self.pieces.groupBy("glob").agg(F.count("name").alias("n"), F.sum("cost").alias("cost")).collect()}
        self.found = [i in sums for i in range(len(globs))]
        cores = spark.sparkContext.defaultParallelism
        # tasks of about range_bytes, and no fewer than the cores can take
        self.tasks = [max(-(-sums[i]["cost"] // range_bytes), min(cores, sums[i]["n"]), 1) if i in sums else 0 for i in range(len(globs))]

    @staticmethod
    def _roots(spark: SparkSession, directory: str) -> list[tuple[str, str]]:
        """(path for Arrow, URI as Spark gives it) of the folder or, of a glob, the folders."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(directory)
        out = []
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []:
            if status.isDirectory():
                plain = status.getPath().toString()
                uri = hadoop.Path(plain).toUri().toString()
                where = uri if "://" in uri else plain
                open_path(where)  # an error if Arrow doesn't know the store
                out.append((where.rstrip("/"), uri.rstrip("/")))
        return out

    def _pieces(self, folders: Sequence[str], files: Sequence[str], names: Sequence[str], range_bytes: int) -> DataFrame:
        """Ranges of the files of each glob, and for each glob that is found a row without a name."""
        roots, spark = self.roots, self.spark

        def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for k in (k for batch in batches for k in batch.column(0).to_pylist()):
                    fs, base = open_path(roots[k][0])
                    missing = dict(enumerate(folders))
                    for name, folder, size in _children(fs, base):
                        for i in [i for i, pattern in missing.items() if re.fullmatch(pattern, name)]:
                            del missing[i]
                            yield k, None, False, 0, i
                        if not _hidden(name, folder):
                            yield k, name, folder, size, None

            yield from _batches(rows(), ("root", "name", "folder", "size", "glob"), (pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int32()))

        def below(fs: pyarrow.fs.FileSystem, base: str, name: str) -> Iterator[tuple[str, int]]:
            waiting = [name]
            while waiting:
                at = waiting.pop()
                for child, folder, size in _children(fs, f"{base}/{at}"):
                    if _hidden(child, folder):
                        continue
                    if folder:
                        waiting.append(f"{at}/{child}")
                    else:
                        yield f"{at}/{child}", size

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened = [open_path(where) for where, _ in roots]
            patterns = [(re.compile(f, re.ASCII), re.compile(n, re.ASCII)) for f, n in zip(files, names)]

            def rows():
                for k, name, folder, size, glob in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))):
                    if name is None:
                        yield glob, k, None, 0, 0, 0
                        continue
                    for file, size in below(*opened[k], name) if folder else [(name, size)]:
                        uri = f"{roots[k][1]}/{_quote(file)}"
                        for i, (ends, named) in enumerate(patterns):
                            if ends.search(uri) and named.search(uri):
                                for a in range(0, size, range_bytes):
                                    b = min(a + range_bytes, size)
                                    yield i, k, file, a, b, b - a + min(OPEN_BYTES, range_bytes // 2)

            yield from _batches(rows(), ("glob", "root", "name", "start", "stop", "cost"),
                                (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))

        start = spark.createDataFrame([(k,) for k in range(len(roots))], "root int")
        listers = LIST_TASKS * spark.sparkContext.defaultParallelism
        return start.mapInArrow(top, _ENTRY).repartition(listers).mapInArrow(ranges, _PIECE)

    def csv(self, glob: int, names: Sequence[str]) -> DataFrame:
        """Text table of a glob's files, which have a header line: columns by place, and ``_file``."""
        roots = self.roots

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened = [open_path(where) for where, _ in roots]

            def batch():
                text = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lines, pa.binary()))
                return pa.RecordBatch.from_arrays([pa.array(of, pa.string()), text], ["_file", "lines"])

            of, ends, lines = [], [0], []
            for k, name, a, b in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))):
                fs, base = opened[k]
                uri = f"{roots[k][1]}/{_quote(name)}"
                for more in _lines(fs, f"{base}/{name}", a, b):
                    of.append(uri)
                    lines += more
                    ends.append(len(lines))
                    if len(lines) >= BATCH_ROWS:
                        yield batch()
                        of, ends, lines = [], [0], []
            if of:
                yield batch()

        own = (self.pieces.where((F.col("glob") == glob) & F.col("name").isNotNull()).select("root", "name", "start", "stop")
               .repartition(self.tasks[glob], "root", "name", "start"))
        schema = ", ".join(f"_c{i} string" for i in range(len(names)))
        # parsed before they become rows: an expression on rows may be copied into each column
        parsed = F.transform("lines", lambda line: F.from_csv(line.cast("string"), schema))
        table = own.mapInArrow(read, "_file string, lines array<binary>").select("_file", F.inline(parsed))
        return table.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "_file")


def _lines(fs: pyarrow.fs.FileSystem, path: str, start: int, stop: int) -> Iterator[list[bytes]]:
    """Lines that begin in a range of a file, without empty ones and the file's header."""
    with fs.open_input_file(path) as source:
        header = start == 0
        for at, block in enumerate(lines_of(source, start, stop)):
            if at == 0 and start == 0:
                block = block.removeprefix(_BOM)
            lines = [line for line in block.splitlines() if line.strip(_BLANK)]
            if header and lines:
                del lines[0]
                header = False
            for i in range(0, len(lines), BATCH_ROWS):
                yield lines[i : i + BATCH_ROWS]

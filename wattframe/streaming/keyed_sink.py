"""Current value per key of an update stream, in a folder that is compacted.

Each micro-batch is written to ``log/batch_id=<id>`` (overwritten if the batch is
retried). Every ``compact_every`` batches the latest row per key, of the last
snapshot and the batches since, becomes a new snapshot, sorted by key; then a small
manifest file naming it appears by a rename. Readers take the newest manifest, its
snapshot and the batches after it, so what they read does not grow with the number
of batches. Batches and snapshots that the manifest before the newest no longer
needs are removed; a reader that has just taken that one is not disturbed.

A crash between any two steps leaves the newest manifest and what it names in
place. A batch that is retried after a snapshot took it in is the same rows again,
at or below the snapshot's batch, and is not read twice.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"


class KeyedSink:
    def __init__(self, spark: SparkSession, folder: str, key_cols: Sequence[str], compact_every: int = 16):
        self.spark, self.folder, self.keys, self.compact_every = spark, folder, list(key_cols), compact_every

    # small files and listings go through Hadoop's file system, as the tables do
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, *parts))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, sub: str) -> list[str]:
        fs, path = self._fs(), self._path(sub)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def manifests(self) -> list[dict]:
        """Those there are, oldest first (two at most, unless a clean-up was cut short)."""
        fs, out = self._fs(), []
        for name in self._list("manifest"):
            if name.endswith(".json"):
                stream = fs.open(self._path("manifest", name))
                try:
                    out.append(json.loads(bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return out

    def _batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._list("log") if n.startswith(f"{BATCH}="))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        batch.write.mode("overwrite").parquet(os.path.join(self.folder, "log", f"{BATCH}={batch_id}"))
        known = self.manifests()
        upto = known[-1]["upto"] if known else -1
        if sum(b > upto for b in self._batches() if b <= batch_id) >= self.compact_every:
            self.compact(batch_id)

    def _latest(self, known: list[dict], upto: int | None = None) -> DataFrame | None:
        first = known[-1]["upto"] + 1 if known else 0
        parts = [self.spark.read.parquet(os.path.join(self.folder, "snapshots", known[-1]["snapshot"]))] if known else []
        tail = [os.path.join(self.folder, "log", f"{BATCH}={b}") for b in self._batches() if b >= first and (upto is None or b <= upto)]
        if tail:
            parts.append(self.spark.read.option("basePath", os.path.join(self.folder, "log")).parquet(*tail)
                         .withColumn(BATCH, F.col(BATCH).cast("long")))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        values = [c for c in rows.columns if c not in self.keys]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.col(BATCH)).alias("_row"))
        return latest.select(*self.keys, *[F.col("_row")[c].alias(c) for c in values])

    def compact(self, upto: int) -> None:
        """A new snapshot of all batches up to ``upto``; then what is no longer needed goes."""
        known = self.manifests()
        if known and known[-1]["upto"] >= upto:
            return
        rows = self._latest(known, upto)
        if rows is None:
            return
        name = f"upto={upto:012d}-{uuid.uuid4().hex[:8]}"
        # hashed by key already by the aggregate: sorted files, without another shuffle
        rows.sortWithinPartitions(*self.keys).write.parquet(os.path.join(self.folder, "snapshots", name))
        fs = self._fs()
        hidden, final = self._path("manifest", f".{upto:012d}.tmp"), self._path("manifest", f"{upto:012d}.json")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps({"upto": upto, "snapshot": name}).encode()))
        out.close()
        if not fs.rename(hidden, final):
            raise OSError(f"manifest {upto} was not committed")
        self._clean(fs)

    def _clean(self, fs) -> None:
        known = self.manifests()
        kept = known[-2:]
        for old in known[:-2]:
            fs.delete(self._path("manifest", f"{old['upto']:012d}.json"), False)
        if len(kept) < 2:
            return
        for b in self._batches():
            if b <= kept[0]["upto"]:
                fs.delete(self._path("log", f"{BATCH}={b}"), True)
        names = {m["snapshot"] for m in kept}
        for name in self._list("snapshots"):
            # a snapshot beyond the newest manifest may be one that is being written
            if name not in names and int(name[5:17]) <= kept[1]["upto"]:
                fs.delete(self._path("snapshots", name), True)

    def read(self) -> DataFrame:
        """The current row per key, without the batch number."""
        rows = self._latest(self.manifests())
        if rows is None:
            raise FileNotFoundError(f"no batch in {self.folder}")
        return rows.drop(BATCH)

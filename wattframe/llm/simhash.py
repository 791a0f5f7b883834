"""SimHash near-duplicates by a binary trie self-join.

Equal fingerprints are grouped first, so a group of exact copies is one node
however large it is. Two fingerprints that differ in at most ``errors`` bits
agree in at least one of ``errors + 1`` blocks of bits; for each block the
fingerprints are rotated so that the block leads, and all with the same leading
block form one subtree. A task walks its subtrees as tries: pairs of nodes are
followed together from the root, each differing bit adds to the pair's errors,
and a pair is dropped when its errors exceed the budget. Links of one task are
reduced to a spanning forest before they leave it, so a dense group gives as
many rows as it has members, not its pairs. A subtree with more than ``limit``
fingerprints is dealt out as pairs of random parts.

The links' connected components are found by alternating star contraction on
tables in the checkpoint folder. Nodes with very many links, of which there can
only be a bounded number, are joined by broadcast, the others by shuffle.

Edge cases: a null text is empty; a text without words has fingerprint zero and
links like any other; a row without an identifier takes no part in links and has
a null component; repeated rows are copies of each other; an empty table gives no
rows. ``near_duplicates`` reads the identifier, the text and the columns asked for;
``drop_near_duplicates`` carries columns of any name as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm.common import frozen

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SUBTREE_LIMIT = 100_000
FRONTIER = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[k:])), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes))))


def fingerprints(docs: DataFrame, keep: Sequence[Column], text_col: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long."""
    src = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    names = src.columns[:-1]
    schema = T.StructType([*[src.schema[c] for c in names], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in batch.column("_text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(fps.view(np.int64))], names=schema.names)

    return src.mapInArrow(run, schema)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_links(keys: np.ndarray, groups: np.ndarray, depth: int, errors: int, leaf: int = 16) -> np.ndarray:
    """Index pairs of equal group whose keys (``depth`` low bits, sorted within the
    sorted groups) differ in at most ``errors`` bits; enough pairs to connect all
    such pairs, not always each of them."""
    found = []
    edges = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1 if len(groups) else 0)) if len(groups) else np.zeros(0, int)
    ends = np.append(edges[1:], len(groups))
    many = ends - edges > 1
    a = edges[many]
    stack = [(depth, a, ends[many], a, ends[many], np.zeros(len(a), np.int8))]
    ones = {}

    def of(bit):
        if bit not in ones:
            ones[bit] = np.concatenate([np.zeros(1, np.int32), np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)])
        return ones[bit]

    while stack:
        level, a0, a1, b0, b1, d = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(level, a0[:half], a1[:half], b0[:half], b1[:half], d[:half]),
                      (level, a0[half:], a1[half:], b0[half:], b1[half:], d[half:])]
            continue
        if not len(a0):
            continue
        whole = level + d <= errors  # whatever follows, the budget holds: connect all of both nodes
        if whole.any():
            for lo, hi, lo2, hi2 in zip(a0[whole], a1[whole], b0[whole], b1[whole]):
                rest = np.concatenate([np.arange(lo, hi), np.arange(lo2, hi2)])
                found.append(np.stack([np.full(len(rest), lo), rest], 1))
        few = ~whole & ((a1 - a0) * (b1 - b0) <= leaf)
        if few.any():
            na, nb = (a1 - a0)[few], (b1 - b0)[few]
            n = na * nb
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(nb, n)
            x, y = np.repeat(a0[few], n) + at // wide, np.repeat(b0[few], n) + at % wide
            near = (x < y) & (_bits(keys[x] ^ keys[y]) <= errors)
            found.append(np.stack([x[near], y[near]], 1))
        go = ~whole & ~few
        if not go.any():
            continue
        a0, a1, b0, b1, d, bit = a0[go], a1[go], b0[go], b1[go], d[go], level - 1
        count = of(bit)
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        own = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1),
                 tuple(z[~own] for z in (am, a1, b0, bm, d + 1))]
        nxt = [np.concatenate(z) for z in zip(*parts)]
        live = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= errors)
        live &= ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1) & (nxt[3] - nxt[2] == 1))
        stack.append((bit, *[z[live] for z in nxt]))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def spanning(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs connect it with."""
    root = np.arange(n)
    while len(pairs):
        x, y = root[pairs[:, 0]], root[pairs[:, 1]]
        open_ = x != y
        if not open_.any():
            break
        pairs, x, y = pairs[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _rotate(fp: Column, by: int) -> Column:
    if not by:
        return fp
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def links(nodes: DataFrame, errors: int = MAX_BITS, limit: int = SUBTREE_LIMIT) -> DataFrame:
    """(u, v) pairs of node identifiers, u > v, that connect all nodes (id, fp; one
    row for each fingerprint) whose fingerprints differ in at most ``errors`` bits."""
    blocks = errors + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    rotated = nodes.select("id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.lit(cuts[i + 1] - cuts[i]).alias("width"), _rotate(F.col("fp"), cuts[i]).alias("key"))
        for i in range(blocks)])).alias("r")).select("id", "r.block", "r.width", "r.key")
    lead = F.call_function("shiftrightunsigned", F.col("key"), F.lit(64) - F.col("width"))
    rotated = rotated.withColumn("lead", lead)
    hot = frozen(rotated.groupBy("block", "lead").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit))
    none = F.lit(0).cast("long")
    if hot.isEmpty():
        dealt = rotated.withColumn("p", none).withColumn("q", none)
    else:
        # at most nodes * blocks / limit hot subtrees; parts by hash, every pair of parts once
        parts = hot.select("block", "lead", F.ceil(F.col("c") / limit).cast("long").alias("parts"))
        dealt = (rotated.join(F.broadcast(parts), ["block", "lead"], "left")
                 .withColumn("mine", F.when(F.col("parts").isNull(), none)
                             .otherwise(F.pmod(F.xxhash64("key"), F.col("parts"))))
                 .withColumn("other", F.explode(F.sequence(none, F.coalesce(F.col("parts") - 1, none))))
                 .withColumn("p", F.least("mine", "other")).withColumn("q", F.greatest("mine", "other")))
    group = ["block", "lead", "p", "q"]
    dealt = (dealt.select(*group, "width", "key", "id").repartition(*group)
             .sortWithinPartitions(*group, "key"))  # equal lead: signed and unsigned order agree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def join(table: pa.Table):
            g = [table.column(c).to_numpy() for c in group]
            new = np.zeros(table.num_rows, bool)
            for x in g:
                new[1:] |= x[1:] != x[:-1]
            ids, keys = table.column("id").to_numpy(), table.column("key").to_numpy().view(np.uint64)
            number = np.cumsum(new)
            depth = 64 - int(table.column("width").to_numpy().min()) if table.num_rows else 0
            root = spanning(len(ids), trie_links(keys, number, depth, errors))
            u, v = ids, ids[root]
            far = u != v
            u, v = u[far], v[far]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            last = [table.column(c)[-1].as_py() for c in group]
            same = np.ones(table.num_rows, bool)
            for c, x in zip(group, last):
                same &= table.column(c).to_numpy() == x
            cut = int(np.argmax(same))
            if cut:
                yield join(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield join(held.combine_chunks())

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def _with_least(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """(key, other) rows with ``least``, the smallest of a key's others and itself. Keys
    with over a thousandth of the rows are fewer than a thousand and are broadcast."""
    per = frozen(rows.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.least(F.col(key), F.min("other")).alias("least")))
    hot = per.where(F.col("c") > max(64, n_rows // 1000)).select(key, "least")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per.select(key, "least"), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) of every identifier in the pairs (u, v), u > v: the smallest
    identifier it is connected with."""
    edges = frozen(pairs)
    seen = None
    while True:
        n = edges.count()
        both = edges.select("u", F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("other")))
        big = _with_least(both, "u", 2 * n)
        edges = frozen(big.where("other > u and other > least").select(F.col("other").alias("u"), F.col("least").alias("v")).distinct())
        n = edges.count()
        small = _with_least(edges.select("u", F.col("v").alias("other")), "u", n)
        edges = frozen(small.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")),
                                                      F.struct(F.col("other").alias("u"), F.col("least").alias("v")))).alias("e"))
                       .select("e.*").where("u > v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    errors: int = MAX_BITS, seed: int = SEED, extra: Sequence[Column] = (),
                    limit: int = SUBTREE_LIMIT) -> DataFrame:
    """(id, extra columns, fp, component) for each row of ``docs``."""
    prints = frozen(fingerprints(docs, [F.col(id_col), *extra], text_col, shingle, seed))
    nodes = frozen(prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("id")))
    found = components(links(nodes, errors, limit))
    named = frozen(nodes.join(found, "id", "left").select(F.col("fp"), F.coalesce("component", "id").alias("component")))
    out = prints.join(named, "fp", "left")
    component = F.when(F.col(id_col).isNotNull(), F.col("component"))
    return out.select(*[c for c in prints.columns if c != "fp"], "fp", component.alias("component"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, errors: int = MAX_BITS) -> DataFrame:
    """One document of each group of near-duplicates, with all columns: the one with
    the smallest ``doc_id``; of several such rows the smallest by text hash, then by
    its columns. Rows without an identifier stay."""
    found = near_duplicates(docs, extra=[F.xxhash64(text_key()).alias("digest")], shingle=shingle, errors=errors).where("doc_id is not null")
    found = found.select(F.col("doc_id").alias("id"), "digest", "component")
    keep = frozen(found.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("k")).select("k.*"))
    times = frozen(found.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    # the row is one value, so that none of its names can meet those used here
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64(text_key()).alias("digest"))
    kept = rows.join(keep, ["id", "digest"], "left_semi")
    if not times.isEmpty():
        again = kept.join(times, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.min("row").alias("row"))
        kept = kept.join(times, ["id", "digest"], "left_anti").unionByName(again)
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def text_key() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))

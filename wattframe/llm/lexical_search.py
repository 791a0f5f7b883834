"""Ranked lexical search by MaxScore with bounds of term pairs.

``build`` writes an index: blocks of at most ``BLOCK_DOCS`` documents, each with the
postings of all its terms (term, documents, frequencies). Blocks are made where the
documents lie; nothing is shuffled. ``search`` takes queries in chunks of bounded
size. For a chunk

1. document frequencies of its terms are summed over the blocks (their weights);
2. intersection lists are built for the pairs of neighbouring terms of each query,
   terms in order of weight: per range of ``RANGE`` documents the largest joint
   impact, per block the best joint scores. They are written as a table;
3. the best joint scores of all blocks give each query a score that its k-th result
   must reach, before any posting of the search is read;
4. per block and query, terms are added from the heaviest down. What the terms still
   to come can add to a document of a range is bounded by the cheapest way to cover
   them with single terms and disjoint pairs, where a pair counts
   max(joint maximum, maximum of either alone), not the sum of two maxima. Ranges,
   and later single documents, whose bound is below the k-th best score are left.

Impacts are integers: ``weight * (10^9 tf div (1000 tf + 8 m))`` with
``m = 10 + 90 n N div L``, weight ``floor(1000 ln((2N + 2) / (2 df + 1)))``.

Edge cases: a null or empty text has no terms and is not counted; a query without
terms, or whose terms no document holds, gives no row; repeated query rows are
queries of their own; of equal scores the smaller key comes first (null before all),
of equal keys an arbitrary row; a text of any length is indexed whole; an empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm.common import frozen
from wattframe.session import scratch_path

BLOCK_DOCS = 8192
BLOCK_BYTES = 16_000_000
SLICE_BYTES = 4_000_000
RANGE = 512
CHUNK_BYTES = 2_000_000

_TERM_BYTES = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
_TABLE = bytes(b if b in _TERM_BYTES else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters; A-Z in lower case."""
    return text.translate(_TABLE).split()


# ---- index

def _postings(texts: list[bytes]) -> dict:
    """Postings of a block: documents are numbered as given."""
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    lengths, parts, at = [], [], 0
    while at < len(texts):
        tokens, first, size = [], at, 0
        while at < len(texts) and (size == 0 or size + len(texts[at]) <= SLICE_BYTES):
            found = terms_of(texts[at])
            lengths.append(len(found))
            tokens += found
            size += len(texts[at]) + 1
            at += 1
        terms = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
        docs = np.repeat(np.arange(first, at), lengths[first:at])
        pairs, tf = np.unique(terms << 16 | docs, return_counts=True)
        parts.append((pairs, tf))
    pairs, tf = (np.concatenate(x) for x in zip(*parts))
    names = list(vocabulary)
    order = np.argsort(np.array(names, object)) if names else np.zeros(0, np.int64)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    term, doc = place[pairs >> 16], pairs & 0xFFFF
    by_term = np.lexsort((doc, term))
    width = "<u2" if not len(tf) or tf.max() < 1 << 16 else "<u4"
    return {"n_docs": sum(n > 0 for n in lengths), "n_terms": sum(lengths), "lengths": np.array(lengths, "<i8").tobytes(),
            "terms": b" ".join(names[i] for i in order), "ends": np.cumsum(np.bincount(term, minlength=len(names))).astype("<u4").tobytes(),
            "docs": doc[by_term].astype("<u2").tobytes(), "tf_width": int(width[2]), "tf": tf[by_term].astype(width).tobytes()}


INDEX = ("n_docs long, n_terms long, lengths binary, terms binary, ends binary, docs binary, tf_width int, tf binary")


def build(docs: DataFrame, key: Column, text_col: str = "text") -> DataFrame:
    """The index, a row per block, written to the shared folder. ``keys`` holds the keys
    of a block's documents, in order."""
    spark = docs.sparkSession
    src = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("keys", T.ArrayType(src.schema["key"].dataType))] + T._parse_datatype_string(INDEX).fields)

    def block(keys: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        all_keys = pa.concat_arrays(keys)
        order = pc.sort_indices(all_keys, null_placement="at_start")
        row = _postings([texts[i] for i in order.to_pylist()])
        inside = all_keys.take(order)
        cols = [pa.ListArray.from_arrays(pa.array([0, len(inside)], pa.int32()), inside)]
        cols += [pa.array([row[f.name]], {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(f.dataType, pa.binary())) for f in schema.fields[1:]]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0
        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                texts.append(text)
                size += len(text)
                if size >= BLOCK_BYTES or len(texts) >= BLOCK_DOCS:
                    yield block([*keys, batch.column("key").slice(first, i + 1 - first)], texts)
                    keys, texts, size, first = [], [], 0, i + 1
            if first < batch.num_rows:
                keys.append(batch.column("key").slice(first))
        if texts:
            yield block(keys, texts)

    path = scratch_path(spark, "lexical-index")
    src.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


class Block:
    """A block's postings as impacts under the weights of a chunk of queries."""

    def __init__(self, row: dict, chunk: Chunk):
        self.chunk = chunk
        self.n = len(row["lengths"]) // 8
        names = row["terms"].split(b" ") if row["terms"] else []
        self.place = {t: i for i, t in enumerate(names) if t in chunk.number}
        self.ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        self.docs = np.frombuffer(row["docs"], "<u2")
        self.tf = np.frombuffer(row["tf"], f"<u{row['tf_width']}")
        self.m = 10 + 90 * np.frombuffer(row["lengths"], "<i8").astype(np.int64) * chunk.n_docs // max(chunk.n_terms, 1)
        self.n_ranges = -(-self.n // RANGE)
        self._lists: dict[int, tuple] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, impacts and, per range, the largest impact of a term of the chunk."""
        if term not in self._lists:
            i = self.place.get(self.chunk.terms[term])
            a, b = (0, 0) if i is None else (int(self.ends[i - 1]) if i else 0, int(self.ends[i]))
            docs = self.docs[a:b].astype(np.int64)
            tf = self.tf[a:b].astype(np.int64)
            impacts = self.chunk.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[docs]))
            self._lists[term] = (docs, impacts, self.range_maxima(docs, impacts))
        return self._lists[term]

    def range_maxima(self, docs: np.ndarray, scores: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_ranges, np.int64)
        np.maximum.at(out, docs // RANGE, scores)
        return out

    def intersection(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with both terms and their joint impacts."""
        (da, ia, _), (db, ib, _) = self.postings(a), self.postings(b)
        docs, pa_, pb = np.intersect1d(da, db, assume_unique=True, return_indices=True)
        return docs, ia[pa_] + ib[pb]

    def bounds(self, query: list[int], joint: dict[int, np.ndarray], pairs: dict) -> list[np.ndarray]:
        """Per position i of a query and per range, the most that its terms i, i + 1, ...
        can add: the cheapest cover by single terms and pairs of neighbours."""
        none = np.zeros(self.n_ranges, np.int64)
        out = [none, none]
        for i in range(len(query) - 1, -1, -1):
            alone = self.postings(query[i])[2]
            best = alone + out[0]
            if i + 1 < len(query):
                both = np.maximum(alone, self.postings(query[i + 1])[2])
                pair = np.maximum(both, joint.get(pairs[query[i], query[i + 1]], none))
                best = np.minimum(best, pair + out[1])
            out.insert(0, best)
        return out[:-1]

    def top(self, query: list[int], bound: list[np.ndarray], k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the k best that reach ``floor``; postings read."""
        need, read = max(floor, 1), 0
        scores = np.zeros(self.n, np.int64)
        if not self.n_ranges or bound[0].max() < need:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        ranges = np.arange(self.n) // RANGE
        alive, few = bound[0] >= need, None
        for i, term in enumerate(query):
            docs, impacts, maxima = self.postings(term)
            left = bound[i + 1]
            if few is None:
                if not alive.all():
                    keep = alive[docs // RANGE]
                    docs, impacts = docs[keep], impacts[keep]
                scores[docs] += impacts
                read += len(docs)
                if i % 3 == 2 or i == len(query) - 1 or left.max() < need:
                    if self.n > k:
                        need = max(need, int(np.partition(scores, self.n - k)[self.n - k]))
                    best = np.zeros(self.n_ranges, np.int64)
                    np.maximum.at(best, ranges, scores)
                    alive &= best + left >= need
                    if left.max() < need:  # documents without a score cannot come in any more
                        few = np.flatnonzero((scores > 0) & (scores + left[ranges] >= need))
            elif len(docs) and len(few):
                at = np.searchsorted(docs, few)
                hit = at < len(docs)
                hit[hit] = docs[at[hit]] == few[hit]
                scores[few[hit]] += impacts[at[hit]]
                read += int(hit.sum())
                if len(few) > k:
                    need = max(need, int(np.partition(scores[few], len(few) - k)[len(few) - k]))
                few = few[scores[few] + left[few // RANGE] >= need]
        few = np.flatnonzero(scores >= need) if few is None else few[scores[few] >= need]
        order = np.lexsort((few, -scores[few]))[:k]
        return few[order], scores[few[order]], read


class Chunk:
    """Queries of a chunk: (number, terms by falling weight), and the collection's counts."""

    def __init__(self, queries: list[tuple[int, list[bytes]]], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.terms = sorted({t for _, terms in queries for t in terms})
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms]
        self.queries = [(q, sorted((self.number[t] for t in set(terms)), key=lambda t: (-self.weights[t], t))) for q, terms in queries]
        neighbours = sorted({p for _, terms in self.queries for p in zip(terms, terms[1:])})
        self.pairs = {p: i for i, p in enumerate(neighbours)}


# ---- search

def _document_frequencies(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Of the terms of a chunk, over all blocks; a row per term reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            for names, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist()):
                df = np.diff(np.frombuffer(ends, "<u4").astype(np.int64), prepend=0)
                for i, t in enumerate(names.split(b" ") if names else []):
                    if t in terms:
                        found[t] = found.get(t, 0) + int(df[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    rows = index.select("terms", "ends").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {bytes(r["term"]): r["df"] for r in rows}


POSTINGS = ["block", "lengths", "terms", "ends", "docs", "tf_width", "tf"]


def pair_lists(index: DataFrame, chunk: Chunk, k: int) -> DataFrame:
    """A row per block: for each pair of the chunk that meets there, its number, the
    joint maximum of each range, and the k best joint scores (0 beyond their number)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row, chunk)
                numbers, maxima, best = [], [], []
                for (a, b), number in chunk.pairs.items():
                    docs, joint = block.intersection(a, b)
                    if len(docs):
                        numbers.append(number)
                        maxima.append(block.range_maxima(docs, joint))
                        top = np.sort(np.partition(joint, len(joint) - k)[len(joint) - k :] if len(joint) > k else joint)[::-1]
                        best.append(np.pad(top, (0, k - len(top))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64())] + [pa.array([x], pa.binary()) for x in (
                        np.array(numbers, "<i4").tobytes(), np.array(maxima, "<i8").tobytes(), np.array(best, "<i8").tobytes())],
                    names=["block", "pairs", "maxima", "best"])

    path = scratch_path(index.sparkSession, "lexical-pairs")
    lists = index.select(*POSTINGS).mapInArrow(run, "block long, pairs binary, maxima binary, best binary")
    lists.write.option("compression", "zstd").parquet(path)
    return index.sparkSession.read.parquet(path)


def _floors(lists: DataFrame, chunk: Chunk, k: int) -> dict[int, int]:
    """Per query, a score that its k-th result reaches at least: the k-th best joint
    score of one of its pairs over all blocks. A row per pair reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for pairs, best in zip(batch.column("pairs").to_pylist(), batch.column("best").to_pylist()):
                for p, b in zip(np.frombuffer(pairs, "<i4").tolist(), np.frombuffer(best, "<i8").reshape(-1, k)):
                    kept[p] = np.sort(np.concatenate([kept[p], b]))[::-1][:k] if p in kept else b
        flat = [(p, int(s)) for p, b in kept.items() for s in b if s]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int64())], names=["pair", "score"])

    scores = lists.select("pairs", "best").mapInArrow(run, "pair int, score long")
    rank = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("score")))
    kth = {r["pair"]: r["score"] for r in scores.withColumn("r", rank).where(F.col("r") <= k).where(F.col("r") == k).collect()}
    return {q: max((kth.get(chunk.pairs[p], 0) for p in zip(terms, terms[1:])), default=0) for q, terms in chunk.queries}


def _search_chunk(index: DataFrame, lists: DataFrame, chunk: Chunk, floors: dict[int, int], k: int) -> DataFrame:
    """(query, key, score): the k best of each block."""
    key_type = index.schema["keys"].dataType.elementType
    schema = T.StructType().add("query", "long").add("key", key_type).add("score", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.drop_columns(["keys"]).to_pylist()[0]
                block = Block(row, chunk)
                joint = dict(zip(np.frombuffer(row["pairs"], "<i4").tolist(), np.frombuffer(row["maxima"], "<i8").reshape(-1, max(block.n_ranges, 1))))
                queries, docs, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for q, terms in chunk.queries:
                    if any(block.chunk.terms[t] in block.place for t in terms):
                        d, s, _ = block.top(terms, block.bounds(terms, joint, chunk.pairs), k, floors[q])
                        queries += [q] * len(d)
                        docs.append(d)
                        scores.append(s)
                keys = one.column("keys").flatten()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries, pa.int64()), keys.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores), pa.int64())],
                    names=schema.names)

    pairs = lists.select(F.col("block").alias("of"), "pairs", "maxima")
    return index.join(pairs, F.col("block") == F.col("of")).select("keys", *POSTINGS, "pairs", "maxima").mapInArrow(run, schema)


def search(index: DataFrame, queries: DataFrame, query_key: Column, text_col: str = "text", k: int = 10,
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query, rank, key, score) of the k highest scores above 0 of each query row."""
    spark: SparkSession = index.sparkSession
    rows = frozen(queries.select(query_key.alias("query_key"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    found = None
    n_chunks = -(-size // chunk_bytes)
    for c in range(n_chunks):  # as many as the query set is large, whatever the documents
        part = rows.where(F.pmod(F.xxhash64("row"), F.lit(n_chunks)) == c).select("row", "text").collect()
        asked = [(r["row"], terms_of((r["text"] or "").encode())) for r in part]
        chunk = Chunk(asked, _document_frequencies(index, {t for _, terms in asked for t in terms}), n_docs, n_terms)
        lists = pair_lists(index, chunk, k)
        best = _search_chunk(index, lists, chunk, _floors(lists, chunk, k), k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        key_type = index.schema["keys"].dataType.elementType
        found = spark.createDataFrame([], T.StructType().add("query", "long").add("key", key_type).add("score", "long"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("key"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(rows.drop("text"), F.col("query") == F.col("row")).select(F.col("query_key").alias("query"), "rank", "key", "score")

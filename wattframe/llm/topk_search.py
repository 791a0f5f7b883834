"""Exact top-k by inner product, by no-random-access aggregation of sorted lists.

Each dimension of a block of candidates is a list sorted by value. A query reads the
lists that weigh most for it (|component| times the list's spread) to the end, one
group after another, and of the others the first ``HEAD`` of their length, from the end
that its component favours. What was not met of a candidate is bounded twice: by the
values at which the lists stand, and by Cauchy-Schwarz from the lengths of what is
left of query and candidate (a candidate's squared length is stored with it, so what is
left is known without looking it up). The smaller bound counts. Candidates whose upper
bound is below the k-th largest lower bound, or below the query's floor, cannot
qualify. Reading stops when no more than a small part is left, and the final scores of
those that remain are resolved. Only sorted reads count towards the bounds; no
candidate's vector is looked up before the end.

A floor is the k-th best score in the first candidate block (blocks are dealt by hash);
the other blocks are searched with it.

Bounds of all queries of a block are computed together: for a round they are sums of
products of the query's parts with what was read, so a few matrix products.

Queries are dealt in blocks against all candidates in blocks (a stated query set
against all rows); a task holds one query block and one candidate block at a time.
Each block keeps its k best for each query and a window over those few picks the
final ones, ties by the smaller identifier.

Edge cases: vectors that are null, empty, or hold null or non-finite components
take no part; vectors of other lengths than the query's are no candidates;
repeated identifiers are candidates and queries each, but a row with the query's
identifier is the query's own; identifiers may be numbers or texts; components beyond
+-2**20 after scaling are scored exactly in integers, more slowly, and a score outside
64 bits is set to the nearest bound. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm.common import frozen

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
ROUNDS = (0.25, 0.5, 0.625, 0.75, 0.875, 1.0)  # share of the lists read to the end
HEAD = 8  # of the others one entry in so many
RESOLVE = 0.1
EXACT = 1 << 20


def scaled(column: str, factor: float) -> Column:
    return F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long"))


def usable(column: str) -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) > 0) & finite, F.lit(False))


class SortedLists:
    """The sorted lists of one block: values, and places of the rows in each list."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.rank = np.empty_like(order)  # place from the bottom of the list
        np.put_along_axis(self.rank, order, np.arange(self.n)[:, None], axis=0)
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.squares = x * x
        self.depth = max(1, self.n // HEAD)
        self.met = (self.rank >= self.n - self.depth, self.rank < self.depth)  # in the head read from the top, from the bottom

    def bounds(self, queries: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Lower and upper bounds of all scores when each query has read its heaviest
        ``share`` of the lists to the end and the head of the others; entries read."""
        d = queries.shape[1]
        whole = min(d, max(1, round(d * share)))
        weight = np.abs(queries) * (self.sorted[-1] - self.sorted[0])
        done = np.zeros(queries.shape)
        np.put_along_axis(done, np.argsort(-weight, axis=1, kind="stable")[:, :whole], 1.0, axis=1)
        known = (queries * done) @ self.x.T
        left_x = self.squares.sum(1)[None, :] - done @ self.squares.T
        left_q = np.repeat(((1 - done) * queries * queries).sum(1)[:, None], self.n, axis=1)
        most, least = np.zeros_like(known), np.zeros_like(known)
        if whole < d:
            for part, met, at, far in ((np.maximum(queries, 0) * (1 - done), self.met[0], self.sorted[self.n - self.depth], self.sorted[0]),
                                       (np.minimum(queries, 0) * (1 - done), self.met[1], self.sorted[self.depth - 1], self.sorted[-1])):
                known += part @ (self.x * met).T
                left_x -= (part != 0) @ (self.squares * met).T.astype(float)
                left_q -= (part * part) @ met.T.astype(float)
                most += part @ (at * ~met).T
                least += part @ (far * ~met).T
            reach = np.sqrt(np.maximum(left_x, 0) * np.maximum(left_q, 0)) * (1 + 1e-9) + 1e-3
            most, least = np.minimum(most, reach), np.maximum(least, -reach)
        return known + least, known + most, whole * self.n + (d - whole) * self.depth


def block_best(queries: np.ndarray, lists: SortedLists, k: int, own: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query its row number, the candidates that may be among its k best in
    the block (a superset of those that reach its floor), their exact scores, and the
    entries that were read of the lists. ``own`` marks rows that are not candidates of
    the query."""
    n, m = lists.n, len(queries)
    alive, read = ~own, np.zeros(m, np.int64)
    waiting = np.arange(m)
    for share in ROUNDS:
        lower, upper, entries = lists.bounds(queries[waiting], share)
        read[waiting] = entries
        lower[~alive[waiting]] = -np.inf
        need = floors[waiting]
        if n > k:
            need = np.maximum(need, np.partition(lower, n - k, axis=1)[:, n - k])
        alive[waiting] &= upper >= need[:, None]
        waiting = waiting[alive[waiting].sum(axis=1) > max(2 * k, n * RESOLVE)]
        if not len(waiting):
            break
    for i in range(m):
        rows = np.flatnonzero(alive[i])
        yield i, rows, lists.x[rows] @ queries[i], int(read[i])


def _exact(queries: np.ndarray, x: np.ndarray, k: int, own: np.ndarray):
    """The same by Python integers, for components too large for exact doubles."""
    q, c = queries.astype(object), x.astype(object)
    lo, hi = -(1 << 63), (1 << 63) - 1
    for i in range(len(q)):
        rows = np.flatnonzero(~own[i])
        yield i, rows, np.array([min(max(int(s), lo), hi) for s in c[rows] @ q[i]], dtype=np.int64), 0


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy())


def top_k(vectors: DataFrame, queries: Column, k: int = 20, factor: float = 64.0, id_col: str = "vec_id",
          vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each query row."""
    rows = frozen(vectors.where(F.col(id_col).isNotNull() & usable(vector_col))
                  .select(F.col(id_col).alias("id"), scaled(vector_col, factor).alias("v"),
                          F.size(vector_col).alias("dim"), F.coalesce(queries, F.lit(False)).alias("is_query")))
    sizes = rows.agg(F.count(F.lit(1)), F.sum(F.col("is_query").cast("int"))).first()
    n_candidate = max(1, -(-sizes[0] // candidate_block))
    n_query = max(1, -(-(sizes[1] or 0) // query_block))
    number = F.xxhash64("id", F.monotonically_increasing_id())
    rows = frozen(rows.withColumn("cb", F.pmod(number, F.lit(n_candidate)).cast("int"))
                  .withColumn("row", F.monotonically_increasing_id()))
    asked = rows.where("is_query").withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(n_query)).cast("int")).select("dim", "qb", "id", "row", "v")
    offered = (rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
               .select(*[F.col(c).alias(f"c_{c}") for c in ("dim", "qb", "cb", "id", "v")]))
    lowest = F.lit(-(1 << 63)).cast("long")
    found = _searched(asked.withColumn("cb", F.lit(0)).withColumn("floor", lowest), offered.where("c_cb = 0"), k)
    if n_candidate > 1:
        found = frozen(found)
        floors = found.groupBy(F.col("row").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        rest = (asked.join(floors, F.col("row") == F.col("of"), "left").withColumn("floor", F.coalesce("least", lowest))
                .withColumn("cb", F.explode(F.sequence(F.lit(1), F.lit(n_candidate - 1)))))
        found = found.unionByName(_searched(rest, offered.where("c_cb > 0"), k))
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _searched(asked: DataFrame, offered: DataFrame, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): the k best of each candidate block for each query
    of (dim, qb, cb), of those that reach its ``floor``."""
    kind = asked.schema["id"].dataType
    schema = T.StructType().add("row", "long").add("query_id", kind).add("vec_id", kind).add("score", "long")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"row": np.zeros(0, np.int64), "query_id": left["id"].iloc[:0], "vec_id": right["c_id"].iloc[:0], "score": np.zeros(0, np.int64)})
        q, x = _matrix(left["v"]), _matrix(right["c_v"])
        q_ids, q_rows, ids, floors = left["id"].to_numpy(), left["row"].to_numpy(), right["c_id"].to_numpy(), left["floor"].to_numpy()
        by_id = np.empty(len(ids), np.int64)  # the order of the identifiers, which may be texts
        by_id[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        out = []
        small = max(np.abs(q).max(), np.abs(x).max()) <= EXACT and len(q[0]) < 1 << 12
        lists = SortedLists(x.astype(np.float64)) if small else None
        for at in range(0, len(q), 128):
            part = q[at : at + 128]
            own = q_ids[at : at + 128, None] == ids[None, :]
            found = block_best(part.astype(np.float64), lists, k, own, floors[at : at + 128].astype(np.float64)) if small else _exact(part, x, k, own)
            for i, rows_, scores, _ in found:
                best = np.lexsort((by_id[rows_], -scores.astype(np.float64) if small else -scores.astype(object)))[:k]
                out.append((at + i, rows_[best], scores[best]))
        which = np.concatenate([np.full(len(b), a, np.int64) for a, b, _ in out])
        picked = np.concatenate([b for _, b, _ in out])
        return pd.DataFrame({"row": q_rows[which], "query_id": q_ids[which], "vec_id": ids[picked],
                             "score": np.concatenate([c for *_, c in out]).astype(np.int64)})

    return (asked.groupBy("dim", "qb", "cb").cogroup(offered.groupBy("c_dim", "c_qb", "c_cb")).applyInPandas(search, schema))

"""Keyed permutations of [0, n) as column expressions.

A position is written as (l, r) on a grid of a x b >= n cells, a and b near the square
root of n. Rounds add a keyed function of one half to the other, in turn (a Feistel
network by addition), which is a bijection of the grid for any function. A cell beyond
n is sent through again until it is inside (cycle walking); less than one cell in b
lies beyond, and each walk visits different ones, so ``WALKS`` steps are enough but
for odds below n ** -8, where an error is raised. The result is a bijection of [0, n),
another one for each key, and a row's new position needs no other row.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
WALKS = 16
PRIME = 2**31 - 1


def round_keys(seed: int, number: int, rounds: int = ROUNDS) -> list[int]:
    """Keys of the permutation with this number."""
    return [int(hashlib.md5(f"{seed}:{number}:{i}".encode()).hexdigest()[:8], 16) % PRIME for i in range(rounds)]


def grid(n: int) -> tuple[int, int, int]:
    """(a, b, steps): sides of the grid, and how often a cell is sent through at most."""
    b = math.isqrt(max(n, 1) - 1) + 1
    a = -(-max(n, 1) // b)
    return a, b, min(a * b - n + 1, WALKS)


def _mixed(v: Column, key: Column) -> Column:
    t = (v * F.lit(48271) + key) % F.lit(PRIME)
    return t * t % F.lit(PRIME)


def permuted(position: Column, n: int, keys: Column) -> Column:
    """The place of ``position`` (in [0, n), n < 2 ** 60) under the permutation of ``keys``,
    an array of round keys."""
    a, b, steps = grid(n)
    # one number for key and side: even rounds change l, odd ones r
    rounds = F.transform(keys.cast("array<long>"), lambda k, i: k * 2 + i % 2)

    def through(x: Column) -> Column:
        def step(s: Column, code: Column) -> Column:
            r, key = s % F.lit(b), F.shiftright(code, 1)
            l = F.call_function("div", s, F.lit(b))
            return F.when(code % 2 == 0, (l + _mixed(r, key)) % F.lit(a) * F.lit(b) + r).otherwise(
                l * F.lit(b) + (r + _mixed(l, key)) % F.lit(b))
        return F.aggregate(rounds, x.cast("long"), step)

    out = through(position)
    if steps > 1:
        out = F.aggregate(F.sequence(F.lit(2), F.lit(steps)), out, lambda y, _: F.when(y >= F.lit(n), through(y)).otherwise(y))
    return F.when(out >= F.lit(n), F.raise_error(F.lit("a permutation's walk did not end")).cast("long")).otherwise(out)


def permuted_sql(position: str, n: str, a: str, b: str, steps: str, keys: str) -> str:
    """The same as DuckDB SQL; all arguments are expressions."""
    def through(x: str, s: str) -> str:
        key = f"(({keys})[i])"
        mixed = "((({v} * 48271 + {k}) % {p}) * (({v} * 48271 + {k}) % {p}) % {p})"
        left = mixed.format(v=f"({s} % {b})", k=key, p=PRIME)
        right = mixed.format(v=f"({s} // {b})", k=key, p=PRIME)
        return (f"list_reduce(range(1, {ROUNDS + 1}), lambda {s}, i: CASE WHEN i % 2 = 1 THEN ({s} // {b} + {left}) % {a} * {b} + {s} % {b} "
                f"ELSE {s} // {b} * {b} + ({s} % {b} + {right}) % {b} END, CAST({x} AS BIGINT))")
    return (f"list_reduce(range(2, {steps} + 1), lambda y, j: CASE WHEN y >= {n} THEN {through('y', 't')} ELSE y END, {through(position, 's')})")

"""Chat transcripts: roles by a hidden Markov model, then canonical turns.

A transcript is a sequence of chunks of text, each of one or more lines. The states
are a role and whether the line starts a turn. A line is seen as a speaker marker
(or none) and a few features; the model's tables are counted from transcripts whose
roles are known. Viterbi finds the best state sequence of a whole transcript, and
the lines are rendered as canonical turns without their markers.

Transcripts are sorted into partitions by range, and one that does not end with its
partition goes on in the next: no transcript, however long, is held by one task.
Each partition gives, for a transcript that crosses its borders, the best score from
each state before to each state after (a max-plus matrix); composing the few rows of
a transcript fixes the states at the borders, and each partition then decodes its
own lines between them. Equal scores go to the first state.

Edge cases: a null text is one empty line; null transcript identifiers form one
transcript; rows of equal position are ordered by their text; repeated rows are
lines of their own; an unknown or null role gives no counts; without any counts all
states are equally likely; an empty table gives an empty result. Rendered chunks,
joined in order, are the canonical form of the transcript.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm.common import frozen

ROLES = ("system", "user", "assistant")
STATES = [(r, start) for r in ROLES for start in (True, False)]
K = len(STATES)
# fixed values: speaker names
SPEAKERS = {
    "system": ("system", "system prompt", "instructions"),
    "user": ("user", "human", "q", "question", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model", "agent"),
}
_NAMES = {name: role for role, names in SPEAKERS.items() for name in names}
_MARKER = re.compile(r"[ \t]*(?:\[([A-Za-z][A-Za-z ]{0,19})\]|([A-Za-z][A-Za-z ]{0,19}?)[ \t]*:)[ \t]*")
MARKERS = ("none", *ROLES)
#: features after the marker and the number of their values: words in the line, last character, empty line
SIZES = (len(MARKERS), 5, 4)
START, END_MARK = "<|im_start|>", "<|im_end|>\n"


def features(line: str) -> tuple[tuple[int, ...], str]:
    """The line's features and its text without the speaker marker."""
    m = _MARKER.match(line)
    role = _NAMES.get((m[1] or m[2]).strip().lower()) if m else None
    content = line[m.end():] if role else line
    n = len(content.split())
    words = 0 if n == 0 else 1 if n <= 4 else 2 if n <= 12 else 3 if n <= 40 else 4
    last = content.rstrip()[-1:]
    end = 0 if not last else 1 if last == "?" else 2 if last in ".!" else 3
    return (MARKERS.index(role) if role else 0, words, end), content


@dataclass
class Model:
    first: np.ndarray  # log probabilities: of the first state,
    step: np.ndarray  # of the next state,
    seen: list[np.ndarray]  # and, for each feature, of its values, by state

    def emission(self, f: tuple[int, ...]) -> np.ndarray:
        return sum(table[:, v] for table, v in zip(self.seen, f))


def ordered(chunks: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, text, role, ...) sorted over range partitions, frozen, with
    the number of their partition as ``_part``. Rows that agree in all are told apart
    by their place in the input, so a partition need not hold all of them."""
    ranged = chunks.withColumn("_row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "text", "_row"]
    rows = frozen(ranged.repartitionByRange(*order).sortWithinPartitions(*order))
    return rows.withColumn("_part", F.spark_partition_id())


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def count_states(rows: DataFrame) -> DataFrame:
    """(kind, a, b, n): how often state b came first (kind -1) or after state a (kind -2),
    and how often value b of feature kind was seen in state a."""
    keys = [(-1, 0, b) for b in range(K)] + [(-2, a, b) for a in range(K) for b in range(K)]
    keys += [(k, a, b) for k, size in enumerate(SIZES) for a in range(K) for b in range(size)]
    at = {key: i for i, key in enumerate(keys)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(keys), np.int64)
        part, first, last = None, None, None
        for batch in batches:
            for part, conv, text, role in zip(*(batch.column(c).to_pylist() for c in ("_part", "conv_id", "text", "role"))):
                if role not in ROLES:
                    last = (conv, -1)
                    first = first or last
                    continue
                state = STATES.index((role, True))
                for line in lines_of(text):
                    f, _ = features(line)
                    for k, v in enumerate(f):
                        n[at[k, state, v]] += 1
                    if first is None:
                        first = (conv, state)
                    elif last[0] != conv:
                        n[at[-1, 0, state]] += 1
                    elif last[1] >= 0:
                        n[at[-2, last[1], state]] += 1
                    last, state = (conv, state), STATES.index((role, False))
        if part is not None:
            ends = [(conv is None, conv or 0, state) for conv, state in (first, last)]
            rows_ = [(-3, part, ends[0][2], int(ends[0][0]), ends[0][1]), (-4, part, ends[1][2], int(ends[1][0]), ends[1][1])]
            rows_ += [(k, a, b, 0, int(x)) for (k, a, b), x in zip(keys, n) if x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], pa.int64()) for i in range(5)], names=["kind", "a", "b", "c", "n"])

    counted = frozen(rows.select("_part", F.col("conv_id").cast("long").alias("conv_id"), "text", "role")
                     .mapInArrow(run, "kind long, a long, b long, c long, n long"))
    # what stands at the borders of partitions: two rows for each
    begin = counted.where("kind = -3").select(F.col("a").alias("part"), F.col("b").alias("state"), F.struct("c", "n").alias("conv"))
    end = counted.where("kind = -4").select((F.col("a") + 1).alias("part"), F.col("b").alias("before"), F.struct("c", "n").alias("conv_before"))
    border = begin.join(end, "part", "left").where("state >= 0").select(
        F.when(F.col("conv") == F.col("conv_before"), -2).otherwise(-1).cast("long").alias("kind"),
        F.when(F.col("conv") == F.col("conv_before"), F.col("before")).otherwise(0).alias("a"),
        F.col("state").alias("b"), F.lit(1).cast("long").alias("n")).where("a >= 0")
    return (counted.where("kind >= -2").select("kind", "a", "b", "n").unionByName(border)
            .groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))


def fit(rows: DataFrame, smoothing: float = 0.5) -> Model:
    """The model counted from ordered rows with roles. There are as many counts as
    the tables have cells, a few dozen."""
    first, step = np.full(K, smoothing), np.full((K, K), smoothing)
    seen = [np.full((K, size), smoothing) for size in SIZES]
    for kind, a, b, n in count_states(rows).collect():
        (first if kind == -1 else step[a] if kind == -2 else seen[kind][a])[b] += n
    return Model(np.log(first / first.sum()), np.log(step / step.sum(1, keepdims=True)), [np.log(t / t.sum(1, keepdims=True)) for t in seen])


def compose(model: Model, lines: list[tuple[int, ...]], entry: bool) -> np.ndarray:
    """Best score from each state before the lines (or from the start: one row) to
    each state of the last line."""
    e = model.emission(lines[0])
    m = (model.first[None, :] if entry else model.step) + e
    for f in lines[1:]:
        m = (m[:, :, None] + model.step[None]).max(axis=1) + model.emission(f)
    return m


def viterbi(model: Model, lines: list[tuple[int, ...]], before: int, after: int) -> list[int]:
    """The best states of the lines after state ``before`` (-1: start) that end in
    state ``after`` (-1: any)."""
    score = (model.first if before < 0 else model.step[before]) + model.emission(lines[0])
    back = []
    for f in lines[1:]:
        m = score[:, None] + model.step
        back.append(m.argmax(axis=0))
        score = m.max(axis=0) + model.emission(f)
    states = [int(score.argmax()) if after < 0 else after]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _transcripts(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple], bool]]:
    """(key, rows, is it the partition's last) of each transcript in a sorted partition."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held and row[0] != key:
                yield key, held, False
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held, True


def border_states(rows: DataFrame, model: Model) -> DataFrame:
    """(_part, head_before, head_after, tail_before, tail_after, tail_ends): the states at
    the borders of a partition's first and last transcript; -1 where it starts or ends
    there. One row for each partition."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first = [], True
        for conv, held, last in _transcripts(batches, ["conv_id", "_part", "text"]):
            if first or last:
                lines = [features(line)[0] for *_, text in held for line in lines_of(text)]
                out.append((conv, held[0][1], 0 if first else 1, last, compose(model, lines, False).ravel().tolist(),
                            compose(model, lines, True).ravel().tolist()))
            first = False
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                             names=["conv_id", "part", "which", "last", "inner", "entry"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "which"]).reset_index(drop=True)
        n = len(pdf)
        score, back = np.asarray(pdf["entry"][0]), []
        for i in range(1, n):
            m = score[:, None] + np.asarray(pdf["inner"][i]).reshape(K, K)
            back.append(m.argmax(axis=0))
            score = m.max(axis=0)
        after = [int(score.argmax())]
        for b in reversed(back):
            after.append(int(b[after[-1]]))
        after = after[::-1]
        return pd.DataFrame({"part": pdf["part"], "which": pdf["which"], "last": pdf["last"], "before": [-1, *after[:-1]],
                             "after": after, "ends": [i == n - 1 for i in range(n)]})

    pieces = (rows.select(F.col("conv_id").cast("long").alias("conv_id"), "_part", "text")
              .mapInArrow(ends, "conv_id long, part int, which int, last boolean, inner array<double>, entry array<double>"))
    settled = pieces.groupBy("conv_id").applyInPandas(settle, "part int, which int, last boolean, before int, after int, ends boolean")
    return settled.groupBy(F.col("part").alias("_part")).agg(
        F.sort_array(F.collect_list(F.struct("which", "before", "after", "ends"))).alias("_borders"))


def recover(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ordered rows, ``roles`` (one for each line), ``starts``
    (whether the line starts a turn) and ``rendered``, the chunk's canonical form."""
    borders = frozen(border_states(rows, model))  # one row for each partition
    src = rows.join(F.broadcast(borders), "_part").select(*keep, F.col("conv_id").cast("long").alias("_conv"), F.col("text").alias("_text"), "_borders")
    schema = (rows.select(*keep).schema.add("roles", T.ArrayType(T.StringType()))
              .add("starts", T.ArrayType(T.BooleanType())).add("rendered", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, kinds = True, None
        out: list = []

        def batch_of():
            made = pa.RecordBatch.from_arrays(
                [*[pa.array([r[0][i] for r in out], k) for i, k in enumerate(kinds)], pa.array([r[1] for r in out], pa.list_(pa.string())),
                 pa.array([r[2] for r in out], pa.list_(pa.bool_())), pa.array([r[3] for r in out], pa.string())], names=schema.names)
            out.clear()
            return made

        def watched():
            nonlocal kinds
            for b in batches:
                kinds = [b.column(c).type for c in keep]
                yield b

        for _, held, last in _transcripts(watched(), ["_conv", "_text", "_borders", *keep]):
            before, after, ends = -1, -1, True
            if first or last:
                border = next(x for x in held[0][2] if x["which"] == (0 if first else 1))
                before, after, ends = border["before"], border["after"], border["ends"]
            first = False
            parsed = [[features(line) for line in lines_of(row[1])] for row in held]
            states = iter(viterbi(model, [f for p in parsed for f, _ in p], before, after))
            opened = before >= 0
            for i, (row, p) in enumerate(zip(held, parsed)):
                roles, starts, text = [], [], []
                for j, (_, content) in enumerate(p):
                    role, start = STATES[next(states)]
                    start = start or not opened
                    text.append((END_MARK if opened else "") + f"{START}{role}\n" if start else "")
                    opened = True
                    roles.append(role)
                    starts.append(start)
                    text.append(content + "\n")
                if ends and i == len(held) - 1:
                    text.append(END_MARK)
                out.append((row[3:], roles, starts, "".join(text)))
            if len(out) >= 5000:
                yield batch_of()
        if out:
            yield batch_of()

    return src.mapInArrow(run, schema)

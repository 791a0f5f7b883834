import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from wattframe.llm import chat_format as C


def random_model(seed):
    r = np.random.default_rng(seed)

    def logs(*shape):
        x = r.random(shape) + 0.01
        return np.log(x / x.sum(-1, keepdims=True))
    return C.Model(logs(C.K), logs(C.K, C.K), [logs(C.K, n) for n in C.SIZES])


def best_path(model, lines):
    def score(path):
        s = model.first[path[0]] + model.emission(lines[0])[path[0]]
        for a, b, f in zip(path, path[1:], lines[1:]):
            s += model.step[a, b] + model.emission(f)[b]
        return s
    paths = list(itertools.product(range(C.K), repeat=len(lines)))
    return max(map(score, paths)), score


def test_viterbi_and_composition_are_optimal():
    r = random.Random(1)
    for seed in range(5):
        m = random_model(seed)
        lines = [tuple(r.randrange(n) for n in C.SIZES) for _ in range(4)]
        best, score = best_path(m, lines)
        path = C.viterbi(m, lines, -1, -1)
        assert abs(score(path) - best) < 1e-9
        whole = C.compose(m, lines, True)[0]
        assert abs(whole.max() - best) < 1e-9
        cut = C.compose(m, lines[:2], True)[0][:, None] + C.compose(m, lines[2:], False)
        assert np.allclose(cut.max(axis=0), whole)
        after = int(cut.max(axis=1).argmax())
        joined = C.viterbi(m, lines[:2], -1, after) + C.viterbi(m, lines[2:], after, -1)
        assert abs(score(joined) - best) < 1e-9


def transcripts(n, seed, hot=0):
    r = random.Random(seed)
    marks = {"user": ["User: ", "human:", "[user] "], "assistant": ["AI: ", "Assistant: ", "[assistant] "], "system": ["System: "]}
    rows = []
    for conv in range(n):
        turns = hot if conv == 3 and hot else r.randint(1, 6)
        for t in range(turns):
            role = "system" if t == 0 and r.random() < 0.3 else ("user", "assistant")[t % 2]
            lines = [" ".join(["word"] * (r.randint(3, 8) if role == "user" else r.randint(15, 60))) + ("?" if role == "user" else ".")
                     for _ in range(1 if role == "user" else r.randint(1, 4))]
            mark = r.choice(marks[role]) if r.random() < 0.9 else ""
            rows.append((conv, t, role, mark + "\n".join(lines)))
    return rows


def run(spark, rows, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        ordered = C.ordered(df)
        model = C.fit(ordered)
        got = C.recover(ordered, model, ["conv_id", "turn", "role"]).collect()
        return model, sorted(got, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.turn))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_partitions_do_not_change_the_result_even_for_one_long_transcript(spark):
    rows = transcripts(40, 2, hot=300)
    one, whole = run(spark, rows, 1)
    many, split = run(spark, rows, 9)
    assert np.allclose(one.first, many.first) and np.allclose(one.step, many.step)
    assert all(np.allclose(a, b) for a, b in zip(one.seen, many.seen))
    assert [tuple(r) for r in whole] == [tuple(r) for r in split]
    right = sum(r.role == r.roles[0] for r in whole) / len(whole)
    assert right > 0.95


def test_rendering_is_canonical(spark):
    rows = transcripts(30, 3)
    _, got = run(spark, rows, 4)
    for conv, parts in itertools.groupby(got, key=lambda r: r.conv_id):
        text = "".join(p.rendered for p in parts)
        assert text.startswith(C.START) and text.endswith(C.END_MARK)
        assert text.count(C.START) == text.count(C.END_MARK)
        assert "User:" not in text and "[assistant]" not in text


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 0, "user", "User: hi"), (None, 1, "assistant", None), (1, 0, "user", "User: a"), (1, 0, "user", "User: a"),
            (2, None, None, ""), (3, 0, "other", "Note: this is not a speaker")]
    _, got = run(spark, rows, 3)
    assert len(got) == len(rows) and all(len(r.roles) == 1 for r in got)
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    ordered = C.ordered(df)
    assert C.recover(ordered, C.fit(ordered), ["conv_id"]).count() == 0


def test_held_out_roles_are_recovered(spark):
    from wattframe.llm.queries import op9_chat_format

    rows = op9_chat_format(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(rows) > 20 and sum(r.role == r.recovered for r in rows) / len(rows) > 0.9

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wattframe.llm import quality_rules as Q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", t)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def texts(n, seed):
    r = random.Random(seed)
    parts = ["a", "b", "c", "The", "é日", "#*", "x|y", "\n", "\n", "\t", "\x0b", " ", " ", "line one\nline one\n", "  "]
    return ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 150))) for _ in range(n)]


def test_statistics_equal_brute_force(spark):
    rows = list(enumerate([None, "", " \n\t", "one", "one two", "a a a a", "a b c a b c", "The " * 30000, *texts(150, 1)]))
    df = spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], "doc_id int, text string, lang string, n_words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in Q.statistics(df, [F.col("doc_id")], "lang").collect()}
    for i, t in rows:
        assert got[i] == brute(t), repr(t)[:80]


def cdf(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail_is_exact(spark):
    cases = [(10, 0), (100, 1), (1000, 7), (3000, 20), (0, 0), (200000, 1500)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", Q.binomial_tail(F.col("n"), F.col("k"), 0.01))
    for r in df.collect():
        if r.k >= r.n * 0.01:
            assert r.p == 1.0
        elif r.n < 10000:
            assert abs(r.p - cdf(r.n, r.k, 0.01)) < 1e-9 * max(cdf(r.n, r.k, 0.01), 1e-30) + 1e-12
        else:
            assert 0 < r.p < 1e-20


def labelled(spark, n, seed, symbol_share=0.0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = r.random() < 0.8
        text = " ".join("w%d" % r.randint(0, 9999) for _ in range(80))
        if not good or r.random() < symbol_share:
            text = text.replace(" ", " ### ")
        rows.append((i, text, "en" if i % 4 else None, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_levels_are_the_strictest_that_pass_in_order(spark):
    df = labelled(spark, 6000, 3, symbol_share=0.001)
    levels = Q.frozen(Q.with_levels(Q.statistics(df, [F.col("doc_id")], "lang").drop("_place")))
    got = {r.stratum: r.selected for r in Q.select_levels(levels, df.select("doc_id", "quality"), "doc_id", alpha=0.06).collect()}
    rows = levels.join(df.select("doc_id", "quality"), "doc_id").where("quality = 1").collect()
    strata = {r.stratum for r in rows}
    risk = 0.06 / len(Q.RULES)
    for s in strata:
        own = [r.levels for r in rows if r.stratum == s]
        for i, rule in enumerate(Q.RULES):
            want = None
            for j in range(len(rule.cutoffs), 0, -1):
                k = sum(x[i] >= j for x in own)
                if k >= len(own) * risk or cdf(len(own), k, risk) > 0.05 / (len(strata) * len(Q.RULES)):
                    break
                want = j
            assert got[s][i] == want, (s, rule.name)
    assert got["=en"][0] is not None


def test_false_rejections_stay_below_the_risk_on_new_documents(spark):
    train, fresh = labelled(spark, 6000, 4, 0.002), labelled(spark, 4000, 5, 0.002)
    kept = Q.keep_good(fresh.withColumn("levels", F.lit("clash")), train.select("doc_id", "quality"), alpha=0.06)
    assert Q.keep_good(train.withColumn("_row", F.lit(1)), train.select("doc_id", "quality"), alpha=0.06).columns == [*train.columns, "_row"]
    both = Q.keep_good(train, train.select("doc_id", "quality"), alpha=0.06)
    n = train.where("quality = 1").count()
    assert both.where("quality = 1").count() >= 0.94 * n and both.where("quality = 0").count() < 0.5 * train.where("quality = 0").count()
    assert kept.columns == [*fresh.columns, "levels"]


def test_small_strata_get_cutoffs_from_the_joint_path(spark):
    df = labelled(spark, 900, 6, symbol_share=0.005).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en").otherwise("de"))
    labels = df.select("doc_id", "quality")
    levels = Q.frozen(Q.with_levels(Q.statistics(df, [F.col("doc_id")], "lang").drop("_place")))
    got = {r.stratum: r.selected for r in Q.select_joint(levels, labels, "doc_id").collect()}
    rows = levels.join(labels, "doc_id").where("quality = 1").collect()
    sizes = [len(r.cutoffs) for r in Q.RULES]
    for s in ("=en", "=de"):
        own, want = [r.levels for r in rows if r.stratum == s], None
        for t in range(1, max(sizes) + 1):
            least = [n + 1 - math.ceil(t * n / max(sizes)) for n in sizes]
            k = sum(any(x >= j for x, j in zip(doc, least)) for doc in own)
            if k >= 0.03 * len(own) or cdf(len(own), k, 0.03) > 0.05 / 2:
                break
            want = least
        assert want is not None and got[s] == want
    kept = Q.keep_good(df, labels)
    assert kept.where("quality = 1").count() >= 0.97 * df.where("quality = 1").count()
    assert kept.where("quality = 0").count() < 0.5 * df.where("quality = 0").count()


def test_nulls_repeats_and_no_labels(spark):
    good = " ".join("word%d" % i for i in range(60))
    df = spark.createDataFrame([(1, good, "en"), (1, good, "en"), (None, good, None), (2, None, "en"), (3, "", None), (4, "a b c " * 40, "en")],
                               "doc_id long, text string, lang string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = Q.quality_rules(df, none)
    assert sorted((r.doc_id or 0, r.base_failed, r.kept, r.rejected_by) for r in out.collect()) == [
        (0, False, True, ""), (1, False, True, ""), (1, False, True, ""), (2, True, False, ""), (3, True, False, ""), (4, True, False, "")]
    assert sorted(r.doc_id or 0 for r in Q.keep_good(df, none).collect()) == [0, 1, 1]
    assert Q.quality_rules(df.limit(0), none).count() == 0
    assert Q.quality_rules(df, none.limit(0)).count() == 6


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    plan = Q.with_levels(Q.statistics(df, [F.col("doc_id")], "lang"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan

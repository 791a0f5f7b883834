"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares an integer signal of a document with a cutoff from a fixed
grid, ordered from lenient to strict. Labelled good documents are the holdout.
For a stratum, a rule and a cutoff, let k of the n good holdout documents be
rejected; the exact binomial test P(Bin(n, risk) <= k) <= level says that the
true false-rejection rate is below ``risk`` (the Clopper-Pearson upper bound at
that level). Cutoffs of one rule are tested in their fixed order and testing
stops at the first failure, which needs no further correction; over the
(stratum, rule) pairs the level is ``delta / pairs`` (Bonferroni). So with
probability 1 - delta, in every stratum all rules together reject at most
``alpha`` of the good documents (``risk = alpha / rules`` and a union bound). A
stratum without enough labels gets no cutoff: its documents pass. ``select_joint``
tests one path of settings of all rules together instead (risk ``alpha``, level
``delta / strata``), which needs far fewer labels; the queries use it.

Signals come from windows and counts inside the row, so nothing is shuffled but
a histogram of rule levels; no document or stratum is ever held together.

Edge cases: a null text has no words and fails the base rule; a null stratum is
a stratum of its own; labels that are null are no labels; a document labelled
both good and bad counts as bad; repeated documents count as often as they
occur; empty tables give empty results, and without labels nothing but the base
rule rejects. Columns of the input that clash with names used here are not
read: rows are reduced to the identifier, the stratum and the signals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.common import SPACE, frozen, join_table, text_of
from wattframe.session import scratch_path

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Reject a document whose ``signal`` (an integer SQL expression over the
    statistics) is at least (``above``) or at most the cutoff; cutoffs from
    lenient to strict."""
    name: str
    signal: str
    cutoffs: tuple[int, ...]
    above: bool = True

    def level(self) -> Column:
        """How many cutoffs of the grid reject the document."""
        op = ">=" if self.above else "<="
        return F.expr("+".join(f"int(coalesce({self.signal} {op} {c}, false))" for c in self.cutoffs))


RULES = (
    Rule("symbols", "1000 * n_symbols div greatest(word_chars, 1)", (400, 300, 200, 150, 100, 75, 50, 30, 20)),
    Rule("capitals", "1000 * n_capitals div greatest(word_chars, 1)", (900, 800, 700, 600, 500, 400, 300, 200)),
    Rule("duplicate_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", (900, 700, 500, 400, 300, 250, 200)),
    Rule("repeats", "1000 * n_repeat_words div greatest(n_words, 1)", (480, 450, 400, 350, 300, 250, 200)),
    Rule("long_words", "10 * word_chars div greatest(n_words, 1)", (250, 200, 160, 130, 110, 100, 90)),
    Rule("short_words", "10 * word_chars div greatest(n_words, 1)", (15, 20, 25, 30, 35), above=False),
)


def statistics(df: DataFrame, keep: Sequence[Column], stratum_col: str | None = None,
               text_col: str = "text") -> DataFrame:
    """The columns ``keep``, the stratum and the statistics of each row. Nothing is shuffled.

    Words in repeated 3-word windows: windows are first compared by hash. A
    window's hash and its position share one long, so a primitive sort brings
    equal hashes together; only windows whose hash occurs twice are compared as
    strings, which makes the count exact whatever the hash does."""
    stratum = F.concat(F.lit("="), F.col(stratum_col).cast("string")) if stratum_col else F.lit("=")
    d = df.select(*keep, F.coalesce(stratum, F.lit("")).alias("stratum"), text_of(text_col).alias("_text"))
    names = [c for c in d.columns if c not in ("_text",)]
    d = d.select("*", F.array_remove(F.split("_text", SPACE), "").alias("_words"),
                 F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_lines"))
    w = F.col("_words")
    d = d.withColumn("_n", F.size(w).cast("long"))
    d = d.withColumn("_bits", F.length(F.bin("_n")))

    def hashed(i):
        p = i.cast("int")
        h = F.xxhash64(F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))
        return F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i)

    d = d.withColumn("_keys", F.when(
        F.col("_n") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 3), hashed))
    ).otherwise(F.array().cast("array<bigint>")))

    def same(a, b):
        bits = F.col("_bits")
        return F.coalesce(F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits), F.lit(False))

    d = d.withColumn("_twice", F.filter(
        "_keys", lambda k, j: same(k, F.get("_keys", j - 1)) | same(k, F.get("_keys", j + 1))))

    def window(k):
        p = (k - F.call_function("shiftleft", F.call_function("shiftright", k, F.col("_bits")), F.col("_bits"))).cast("int")
        return F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("g"), p.alias("p"))

    d = d.withColumn("_sorted", F.sort_array(F.transform("_twice", window)))

    def equal(a, b):
        return F.coalesce(a["g"] == b["g"], F.lit(False))

    found = F.filter("_sorted", lambda x, j: equal(x, F.get("_sorted", j - 1)) | equal(x, F.get("_sorted", j + 1)))
    covered = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    return d.select(
        *names, F.col("_n").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        # no filter is pushed through a column like this one: it would bring copies of the expressions above
        F.monotonically_increasing_id().alias("_place"))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def with_levels(stats: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    return stats.withColumn("levels", F.array(*[r.level() for r in rules]))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms from the exact terms. Beyond the
    mean the value is not needed and 1 is returned."""
    zero = n * F.log1p(F.lit(-p))
    odds = F.lit(p / (1 - p))

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, F.struct(zero.alias("term"), zero.alias("total")), add, lambda acc: acc["total"])
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.exp(total))


def select_levels(levels: DataFrame, labels: DataFrame, id_col: str, rules: Sequence[Rule] = RULES,
                  alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """(stratum, selected): for each stratum and rule the level from which on a
    document is rejected, by the strictest cutoff that the holdout allows (null:
    the rule is not used there).

    ``labels`` has (id, quality); quality 1 is good. The level histogram is
    pre-aggregated, so a hot stratum is a handful of rows."""
    good = (labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id"))
            .agg(F.min("quality").alias("_q")).where("_q = 1").select("_id"))
    held = levels.select(F.col(id_col).alias("_id"), "stratum", "levels").join(good, "_id", "left_semi")
    hist = frozen(held.select("stratum", F.posexplode("levels").alias("rule", "level"))
                  .groupBy("stratum", "rule", "level").agg(F.count(F.lit(1)).alias("c")))
    pairs = max(1, hist.select("stratum", "rule").distinct().count())
    sizes = F.array(*[F.lit(len(r.cutoffs)) for r in rules])
    down = Window.partitionBy("stratum", "rule").orderBy(F.col("j").desc())
    grid = (hist.select("stratum", "rule").distinct()
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.get(sizes, F.col("rule"))))))
    counted = (grid.join(hist.withColumnRenamed("level", "j"), ["stratum", "rule", "j"], "left")
               .withColumn("k", F.sum(F.coalesce("c", F.lit(0))).over(down))
               .withColumn("n", F.max("k").over(Window.partitionBy("stratum", "rule"))))
    tested = counted.where("j > 0").withColumn(
        "passed", binomial_tail(F.col("n"), F.col("k"), alpha / len(rules)) <= F.lit(delta / pairs))
    # level j is reached by the cutoffs up to the j-th strictest: the most lenient has the highest j
    order = Window.partitionBy("stratum", "rule").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    chosen = (tested.withColumn("all_passed", F.min("passed").over(order))
              .groupBy("stratum", "rule").agg(F.min(F.when(F.col("all_passed"), F.col("j"))).alias("j")))
    return frozen(chosen.groupBy("stratum").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rule", "j"))), lambda x: x["j"]).alias("selected")))


def select_joint(levels: DataFrame, labels: DataFrame, id_col: str, rules: Sequence[Rule] = RULES,
                 alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """(stratum, selected) as ``select_levels``, from one path of settings of all rules
    together. Step t of T uses the first ceil(t / T) part of each rule's cutoffs. Steps are
    tested in their order, up to the first failure, at risk ``alpha`` for what any rule
    rejects and at level ``delta / strata``: with probability 1 - delta all rules together
    reject at most ``alpha`` of the good documents in every stratum, and a stratum needs
    few labels (144 without a false rejection at the defaults with four strata)."""
    good = (labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id"))
            .agg(F.min("quality").alias("_q")).where("_q = 1").select("_id"))
    held = levels.select(F.col(id_col).alias("_id"), "stratum", "levels").join(good, "_id", "left_semi")
    sizes = [len(r.cutoffs) for r in rules]
    steps = max(sizes)
    # the first step that rejects a document; a level of 0 gives steps + 1: none does
    first = [F.expr(f"{steps} * ({n} - levels[{i}]) div {n} + 1") for i, n in enumerate(sizes)]
    hist = frozen(held.select("stratum", F.array_min(F.array(*first)).cast("int").alias("t"))
                  .groupBy("stratum", "t").agg(F.count(F.lit(1)).alias("c")))
    strata = max(1, hist.select("stratum").distinct().count())
    grid = hist.select("stratum").distinct().withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(steps + 1))))
    up = Window.partitionBy("stratum").orderBy("t")
    counted = (grid.join(hist, ["stratum", "t"], "left").withColumn("k", F.sum(F.coalesce("c", F.lit(0))).over(up))
               .withColumn("n", F.max("k").over(Window.partitionBy("stratum"))))
    tested = counted.where(F.col("t") <= steps).withColumn(
        "passed", binomial_tail(F.col("n"), F.col("k"), alpha) <= F.lit(delta / strata))
    chosen = (tested.withColumn("all_passed", F.min("passed").over(up))
              .groupBy("stratum").agg(F.max(F.when(F.col("all_passed"), F.col("t"))).alias("t")))
    used = [F.expr(f"cast({n} + 1 - ((t * {n} + {steps - 1}) div {steps}) as int)") for n in sizes]
    return frozen(chosen.select("stratum", F.array(*used).alias("selected")))


def _hits(rules: Sequence[Rule]) -> Column:
    """Names of the rules whose selected level a row reaches."""
    return F.array_compact(F.array(*[
        F.when(F.get("levels", F.lit(i)) >= F.get("selected", F.lit(i)), F.lit(r.name)) for i, r in enumerate(rules)]))


def verdicts(levels: DataFrame, selected: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``rejected_by`` (rule names, comma-joined)."""
    out = join_table(levels, selected, ["stratum"])
    out = out.withColumn("base_failed", base_failed()).withColumn("_hit", _hits(rules))
    return (out.withColumn("kept", ~F.col("base_failed") & (F.size("_hit") == 0))
            .withColumn("rejected_by", F.array_join("_hit", ",")).drop("_hit", "selected", "levels"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str | None = "lang",
                  rules: Sequence[Rule] = RULES, alpha: float = 0.03, delta: float = 0.05, select=select_joint) -> DataFrame:
    """(id, stratum, statistics, base_failed, kept, rejected_by), one row per document.
    The statistics are computed once and kept in the checkpoint folder. ``select`` is
    ``select_joint`` or ``select_levels``."""
    levels = frozen(with_levels(statistics(docs, [F.col(id_col)], stratum_col).drop("_place"), rules))
    return verdicts(levels, select(levels, labels, id_col, rules, alpha, delta), rules)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str | None = "lang",
              rules: Sequence[Rule] = RULES, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with all their columns. Each text is read
    once: rows are written to the shared folder beside their levels, and the cutoffs
    (``select_joint``) and the verdict read them there."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row")
    stats = statistics(docs, [row, F.col(f"`{id_col}`").alias("id")], stratum_col)
    path = scratch_path(spark, "quality-levels")
    with_levels(stats, rules).withColumn("base_failed", base_failed()).select("row", "id", "stratum", "levels", "base_failed").write.parquet(path)
    levels = spark.read.parquet(path)
    selected = select_joint(levels.select("id", "stratum", "levels"), labels.withColumnRenamed(id_col, "id"), "id", rules, alpha, delta)
    marked = join_table(levels.where("not base_failed"), selected, ["stratum"])
    return marked.where(F.size(_hits(rules)) == 0).select("row.*")

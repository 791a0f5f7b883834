"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm import (
    chat_format, fixity, lexical_search, merkle_manifest, ngram_lm, packing, piece_codec, secret_scan, sharding,
    simhash, token_files, topk_search,
)
from wattframe.llm import quality_rules as quality
from wattframe.llm.common import documents, frozen, text_of
from wattframe.session import scratch_path

#: where the public vocabulary files are; a parameter of the operators that tokenize
TOKENIZERS = "public_tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def _levels_sql() -> str:
    rows = []
    for i, r in enumerate(quality.RULES):
        op = ">=" if r.above else "<="
        # DuckDB's // on these non-negative integers is Spark's div
        signal = r.signal.replace(" div ", " // ")
        level = " + ".join(f"CAST(({signal}) {op} {c} AS INTEGER)" for c in r.cutoffs)
        rows.append(f"SELECT doc_id, stratum, {i} AS rule, {level} AS level FROM stats")
    return " UNION ALL ".join(rows)


STEPS = max(len(r.cutoffs) for r in quality.RULES)
SIZES = "(VALUES " + ", ".join(f"({i}, {len(r.cutoffs)}, '{r.name}')" for i, r in enumerate(quality.RULES)) + ") AS sizes(rule, size, name)"


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w),
win AS (SELECT doc_id, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g
        FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
rep AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p + k AS p FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
stats AS (SELECT w.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
levels AS ({_levels_sql()}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
steps AS (SELECT doc_id, stratum, min({STEPS} * (size - level) // size + 1) AS t FROM levels JOIN {SIZES} ON sizes.rule = levels.rule
          WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY doc_id, stratum),
held AS (SELECT stratum, t, count(*) AS c FROM steps GROUP BY ALL),
grid AS (SELECT DISTINCT stratum, unnest(range(1, {STEPS + 1})) AS t FROM held),
counted AS (SELECT grid.stratum, grid.t, CAST(coalesce(sum(c) FILTER (held.t <= grid.t), 0) AS BIGINT) AS k, CAST(sum(c) AS BIGINT) AS n
            FROM grid JOIN held ON held.stratum = grid.stratum GROUP BY ALL),
tested AS (SELECT *, k < n * 0.03 AND list_sum(list_transform(range(0, k + 1), lambda i:
      exp(CASE WHEN i IN (0, n) THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) END
          + i * ln(0.03) + (n - i) * ln(1 - 0.03))))
    <= 0.05 / (SELECT count(DISTINCT stratum) FROM held) AS passed FROM counted),
chosen AS (SELECT stratum, max(t) FILTER (ok) AS t FROM (
    SELECT *, min(CAST(passed AS INTEGER)) OVER (PARTITION BY stratum ORDER BY t) = 1 AS ok FROM tested) GROUP BY ALL),
hit AS (SELECT levels.doc_id, string_agg(name, ',' ORDER BY levels.rule) AS rejected_by
    FROM levels JOIN {SIZES} ON sizes.rule = levels.rule JOIN chosen ON chosen.stratum = levels.stratum
    WHERE level >= size + 1 - (chosen.t * size + {STEPS - 1}) // {STEPS} GROUP BY levels.doc_id)
SELECT stats.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND hit.doc_id IS NULL AS kept,
    coalesce(rejected_by, '') AS rejected_by
FROM stats LEFT JOIN hit ON hit.doc_id = stats.doc_id
"""


@_query("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.quality_rules(documents(spark, sf_dir), labels)
    return out.select("doc_id", *quality.STATS, "base_failed", "kept", "rejected_by")


@_query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir), [F.col("doc_id")])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"),
                        F.col("all_spans").alias("spans"))


def bpe_files() -> dict[str, str]:
    """Rank file and pattern of the byte-level vocabulary byte_bpe_50k."""
    vocabularies = importlib.import_module(TOKENIZERS)
    return {"rank_file": vocabularies.path("byte_bpe_50k.tiktoken"), "pattern": vocabularies.PATTERN}


@_query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), F.col("doc_id"), **bpe_files()).withColumnRenamed("kept", "doc_id")


@_query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@_query("op4_topk_search")
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.top_k(vectors, F.col("vec_id") % 20 == 0)


@_query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.shard_rows(docs, "doc_id", 24)


@_query("op2_ngram_lm")
def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held_out = F.crc32(key.cast("binary")) % 10 == 0
    scored = ngram_lm.score(documents(spark, sf_dir), ~held_out)
    return scored.withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _raw_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw transcripts: a speaker marker of some style before each
    turn, and none before one in ten."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    style = F.crc32(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    marks = {"user": ("User: ", "Human: ", "[user] ", "Q: "), "assistant": ("Assistant: ", "AI: ", "[assistant] ", "A: "),
             "system": ("System: ", "[system] ", "Instructions: ", "SYSTEM PROMPT: ")}
    mark = F.lit("")
    for role, names in marks.items():
        mark = F.when(F.col("role") == role, F.get(F.array(*map(F.lit, names)), (style % 4).cast("int"))).otherwise(mark)
    return turns.select("conv_id", "turn", "role", F.concat(F.when(style % 10 == 0, "").otherwise(mark), text_of()).alias("text"))


@_query("op9_chat_format")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on nine of ten conversations, applied to all."""
    held_out = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = chat_format.ordered(_raw_transcripts(spark, sf_dir).withColumn("held_out", held_out))
    model = chat_format.fit(rows.withColumn("role", F.when(~F.col("held_out"), F.col("role"))))
    found = chat_format.recover(rows, model, ["conv_id", "turn", "role", "held_out"])
    return found.select("conv_id", "turn", "role", "held_out", F.get("roles", F.lit(0)).alias("recovered"),
                        F.get("starts", F.lit(0)).alias("starts_turn"), F.size("roles").alias("n_lines"), "rendered")


OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS b, md5(coalesce(url, '')) AS m FROM pages),
r AS (SELECT page_id, u, 'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4)
    || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>' || e || 'WARC-Target-URI: ' || u || e
    || 'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: ' || strlen(b) || e || e || b || e || e AS rec
  FROM p, (SELECT chr(13) || chr(10) AS e)),
f AS (SELECT page_id, u, coalesce(CAST(page_id // {fixity.FILE_IDS} AS VARCHAR), 'none') || '-0' AS file, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest FROM r),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest, length
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM f)
SELECT page_id, file, "offset", length, digest,
    CASE substr(md5(digest), 1, 2) WHEN '00' THEN 'corrupt' WHEN '01' THEN 'missing' ELSE 'ok' END AS status FROM o
"""


@_query("op10_warc_fixity", OP10_SQL)
def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of WARC files, audited against a replica of other bytes: in
    one record in 256 a byte is another, one in 256 is lost (by a hash of its digest),
    and what is left is laid out and hashed anew."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    file, ident = F.expr(f"page_id div {fixity.FILE_IDS}"), [F.col("page_id"), F.col("url")]
    content = fixity.record_bytes(F.col("url"), F.col("html"))
    parts = fixity.layout(pages, file, ident)
    ours = frozen(fixity.index(pages, "page_id", file, content, ident, parts))
    fate = F.substring(F.md5(F.sha2(content.cast("binary"), 256).cast("binary")), 1, 2)
    # the first byte, W, turns into X
    rotten = F.when(fate == "00", F.overlay(content, F.lit("X"), F.lit(1), F.lit(1))).otherwise(content)
    theirs = frozen(fixity.index(pages.where(fate != "01"), "page_id", file, rotten, ident, parts))
    return fixity.audited(ours, theirs).select("page_id", "file", "offset", "length", "digest", "status")


@_query("op3_piece_codec")
def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as pieces and back: their number, a digest of the ids, and whether
    the text came back (it does but for U+2581, which reads as a space)."""
    model = importlib.import_module(TOKENIZERS).path("piece_bpe_32k.model")
    digest = F.xxhash64("text").alias("_digest")
    coded = piece_codec.encode(documents(spark, sf_dir), [F.col("doc_id"), digest], model)
    facts = [F.col("doc_id"), F.col("_digest"), (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32")]
    back = piece_codec.decode(coded, facts, model)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.length("text").cast("long").alias("n_chars"),
                       (F.xxhash64("text") == F.col("_digest")).alias("round_trip"))


@_query("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-ID files in the shared folder, read back."""
    docs = documents(spark, sf_dir)
    tokens = token_files.tokenized(docs, F.col("doc_id"), importlib.import_module(TOKENIZERS).path("byte_bpe_50k.json"))
    folder = scratch_path(spark, "token-dataset")
    token_files.write(tokens, folder)
    back = token_files.read(spark, folder, docs.schema["doc_id"].dataType)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM len),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
m AS (SELECT doc_id, 10 + (90 * n * nd) // l AS m FROM len, total),
s AS (SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@_query("op12_lexical_search", OP12_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(documents(spark, sf_dir), F.col("doc_id"))
    found = lexical_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), F.col("item_id"))
    return found.select(F.col("query").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: levels of the tree that the SQL spells out: 8 ** 7 leaves in a group, 8 ** 3 groups
OP13_LEVELS = (7, 3)


def _op13_sql() -> str:
    def part(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    crc = ("xor(list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])), lambda c, b: "
           "xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)")
    ctes = [
        "t AS (SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)",
        "d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents)",
        f"l AS (SELECT doc_id, lang, {leaf('text')} AS leaf, doc_id IS NOT NULL AND {crc} % 3 = 0 AS hit, "
        + leaf(f"translate(text, '{UPPER}', '{LOWER}')") + " AS other FROM d, t)",
        "g0 AS (SELECT *, CAST(0 AS BIGINT) + dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS gid FROM l)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY gid) AS n, "
        "row_number() OVER () AS rid FROM g0)",
        "n0 AS (SELECT gid, pos, leaf AS h, n FROM a0)",
        "f0 AS (SELECT rid, gid, pos, CASE WHEN hit THEN other ELSE leaf END AS h, '' AS beside FROM a0)",
    ]

    def climb(nodes: str, fold: str, name: str, levels: int, group: str) -> tuple[str, str]:
        for i in range(levels):
            new, newf = f"{name}n{i}", f"{name}f{i}"
            # a group of one node stays as it is
            ctes.append(f"{name}k{i} AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS m FROM {nodes})")
            ctes.append(f"{new} AS (SELECT {group}, pos // 8 AS pos, CASE WHEN m = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h "
                        f"FROM {name}k{i} GROUP BY {group}, pos // 8, m)")
            ctes.append(f"{name}s{i} AS (SELECT a.{group} AS grp, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, "
                        f"coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after FROM {name}k{i} a JOIN {name}k{i} b "
                        f"ON a.{group} = b.{group} AND a.pos // 8 = b.pos // 8 WHERE a.m > 1 GROUP BY a.{group}, a.pos)")
            ctes.append(f"{newf} AS (SELECT f.* EXCLUDE (pos, h, beside), f.pos // 8 AS pos, CASE WHEN s.grp IS NULL THEN f.h ELSE sha256(s.before || f.h || s.after) END AS h, "
                        f"CASE WHEN s.grp IS NULL THEN f.beside ELSE f.beside || s.before || s.after END AS beside "
                        f"FROM {fold} f LEFT JOIN {name}s{i} s ON s.grp = f.{group} AND s.pos = f.pos)")
            nodes, fold = new, newf
        return nodes, fold

    nodes, fold = climb("n0", "f0", "a", OP13_LEVELS[0], "gid")
    ctes.append(f"subroots AS (SELECT gid, h AS subroot FROM {nodes})")
    ctes.append("u0 AS (SELECT 0 AS one, gid AS pos, subroot AS h FROM subroots)")
    ctes.append(f"v0 AS (SELECT rid, gid, 0 AS one, gid AS pos, h, beside FROM {fold})")
    top, done = climb("u0", "v0", "b", OP13_LEVELS[1], "one")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT a0.doc_id, a0.leaf, subroot, r.h AS root, sha256(z.beside) AS proof_sha256, z.h AS folded_root, z.h = r.h AS verified
FROM a0 JOIN subroots ON subroots.gid = a0.gid JOIN {done} z ON z.rid = a0.rid, {top} r"""


@_query("op13_merkle_manifest", _op13_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by language; where 3 divides the CRC-32 of the identifier, the text
    is tampered with (A-Z in lower case)."""
    docs = documents(spark, sf_dir)
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [*plain[:-1], F.translate("text", UPPER, LOWER)]
    when = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    out = merkle_manifest.manifest(docs, "doc_id", "lang", plain, tampered, when)
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))

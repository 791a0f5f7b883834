"""Merkle fixity audit of replicated WARC files.

Records are hashed, and the hashes of a file's records go up a tree over ordered
ranges of its records. Where a range ends is not a byte offset, which moves with
every record before it, but a property of records: one in ``FANOUT`` begins a range of
level 1, one in ``FANOUT ** 2`` a range of level 2, by leading zeros of a hash of
what identifies it. So two replicas cut their ranges alike, and a record that is lost,
added or of another length changes the nodes above itself only. A node is named by
the record that begins its range, and its hash is taken of its name and its children
in order. Two replicas are compared at the roots; from there only the children of
nodes that differ are looked at, down to the records. What is compared shrinks with
each level to the damaged part.

All steps are joins, aggregates and windows inside a file. Files are bounded: a file
identifier with more than ``file_records`` records is dealt to several parts by a hash
of what identifies a record, and where one identity alone fills a file, of its content and
of the number of the copy too. How many parts is a ``layout``, which replicas of one collection share.

Edge cases: a null page has an empty body, a null address an empty one; null page
identifiers share a file; repeated pages are records of their own, told apart by the
order of their digests; a record that only one replica has is ``missing`` or
``extra``; empty tables give an empty result. Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.common import frozen

FILE_IDS = 512
FILE_RECORDS = 4096
FANOUT = 16  # a hexadecimal digit of the hash a level
HEIGHT = 4
COPIES = 4096
FIRST = ""  # the range before the first record that begins one


def record_bytes(url: Column, html: Column) -> Column:
    """A WARC/1.0 resource record with a name-based record identifier."""
    body = F.coalesce(html, F.lit(""))
    uri = F.coalesce(url, F.lit(""))
    name = F.md5(uri.cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(">\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def layout(records: DataFrame, file_id: Column, ident: Sequence[Column], file_records: int = FILE_RECORDS) -> DataFrame:
    """(file_id, parts, whole): file identifiers with more than ``file_records`` records,
    and whether an identity alone has so many there."""
    each = records.select(file_id.alias("file_id"), _identity(ident).alias("ident")).groupBy("file_id", "ident").agg(F.count(F.lit(1)).alias("n"))
    files = each.groupBy("file_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return frozen(files.where(F.col("n") > file_records).select(
        "file_id", F.ceil(F.col("n") / file_records).cast("int").alias("parts"), (F.col("most") > file_records).alias("whole")))


def _identity(ident: Sequence[Column]) -> Column:
    return F.md5(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(ident)]), {"ignoreNullFields": "false"}).cast("binary"))


def index(records: DataFrame, key: str, file_id: Column, content: Column, ident: Sequence[Column] | None = None,
          parts: DataFrame | None = None, file_records: int = FILE_RECORDS) -> DataFrame:
    """(key, file, record, offset, length, digest) of records laid out one after the
    other in their file, in the order of the key. ``record`` names a record by ``ident``
    (by default the key) and, among equal ones, its place. ``parts`` is the collection's
    ``layout``, by default that of these records. The content itself is not kept."""
    ident = [F.col(key)] if ident is None else ident
    parts = layout(records, file_id, ident, file_records) if parts is None else parts
    rows = records.select(F.col(key).alias("key"), file_id.alias("file_id"), _identity(ident).alias("ident"),
                          F.octet_length(content).cast("long").alias("length"), F.sha2(content.cast("binary"), 256).alias("digest"))
    # equal records are counted, not kept together: the i-th copy is dealt by its number
    rows = (rows.groupBy("key", "file_id", "ident", "length", "digest").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("b", F.explode(F.expr(f"sequence(0l, (n - 1) div {COPIES})")))
            .withColumn("i", F.explode(F.expr(f"sequence(b * {COPIES}, least(n, (b + 1) * {COPIES}) - 1)"))).drop("n", "b"))
    over = parts.select(F.col("file_id").alias("of"), "parts", "whole")
    dealt = F.when(F.col("whole"), F.concat("ident", "digest", F.col("i").cast("string"))).otherwise(F.col("ident"))
    part = F.coalesce(F.pmod(F.crc32(dealt.cast("binary")), F.col("parts")).cast("int"), F.lit(0))
    file = F.concat(F.coalesce(F.col("file_id").cast("string"), F.lit("none")), F.lit("-"), part.cast("string"))
    # a row per large file: as many as the table has file_records records, compared by bytes by Spark
    placed = rows.join(over, F.col("file_id").eqNullSafe(F.col("of")), "left").withColumn("file", file)
    again = F.row_number().over(Window.partitionBy("file", "ident").orderBy("digest", "length", "i"))
    order = Window.partitionBy("file").orderBy("key", "ident", "again").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("again", again).select(
        F.col("key").alias(key), "file", F.md5(F.concat("ident", F.lit("/"), F.col("again").cast("string")).cast("binary")).alias("record"),
        F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"), "length", "digest")


def tree(records: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(file, level, node, parent, hash) for all levels. Level 0 are the records; level
    ``height`` is the root, whatever the number of records."""
    zeros = F.length("record") - F.length(F.ltrim(F.col("record"), F.lit("0")))
    upto = Window.partitionBy("file").orderBy("offset", "record").rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy("file").orderBy("offset", "record"))
    starts = [F.coalesce(F.last(F.when(zeros >= k, F.col("record")), ignorenulls=True).over(upto), F.lit(FIRST)).alias(f"n{k}") for k in range(1, height)]

    def hashed(level: int, node: Column, what: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(str(level)), node, what).cast("binary"), 256)

    rows = records.select("file", F.col("record").alias("n0"), *starts, F.lit(FIRST).alias(f"n{height}"), place.alias("place"),
                          hashed(0, F.col("record"), F.concat_ws("|", F.col("length").cast("string"), "digest")).alias("hash"))
    names = [f"n{k}" for k in range(1, height + 1)]
    nodes = rows.select("file", F.col("n0").alias("node"), *names, "place", "hash")
    out = nodes.select("file", F.lit(0).alias("level"), "node", F.col("n1").alias("parent"), "hash")
    for k in range(1, height + 1):
        above = names[k:]
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]), "")
        # the node's first record decides what is above it: ranges are nested
        nodes = (nodes.groupBy("file", F.col(f"n{k}").alias("node"))
                 .agg(*[F.min_by(c, "place").alias(c) for c in above], F.min("place").alias("first"), children.alias("children"))
                 .select("file", "node", *above, F.col("first").alias("place"), hashed(k, F.col("node"), F.col("children")).alias("hash")))
        out = out.unionByName(nodes.select("file", F.lit(k).alias("level"), "node", (F.col(above[0]) if above else F.lit(FIRST)).alias("parent"), "hash"))
    return out


def audit(ours: DataFrame, theirs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(file, record, status) of every record that differs between two indexes:
    ``corrupt``, ``missing`` (not in theirs) or ``extra`` (not in ours)."""
    a, b = frozen(tree(ours, height)), frozen(tree(theirs, height))

    def different(level: int, under: DataFrame | None) -> DataFrame:
        sides = []
        for nodes, name in ((a, "a"), (b, "b")):
            n = nodes.where(F.col("level") == level).select(F.col("file").alias(f"f{name}"), F.col("node").alias(f"n{name}"),
                                                            F.col("parent").alias(f"p{name}"), F.col("hash").alias(f"h{name}"))
            if under is not None:
                n = n.join(under, (F.col(f"f{name}") == F.col("f")) & (F.col(f"p{name}") == F.col("p")), "left_semi")
            sides.append(n)
        both = sides[0].join(sides[1], (F.col("fa") == F.col("fb")) & (F.col("na") == F.col("nb")), "full")
        return both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select(
            F.coalesce("fa", "fb").alias("file"), F.coalesce("na", "nb").alias("node"), "ha", "hb")

    found = None
    for level in range(height, -1, -1):
        under = None if found is None else found.select(F.col("file").alias("f"), F.col("node").alias("p"))
        found = frozen(different(level, under))
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("corrupt")
    return found.select("file", F.col("node").alias("record"), status.alias("status"))


def audited(ours: DataFrame, theirs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Our records, each with its ``status``; ``ok`` where nothing differs."""
    bad = audit(ours, theirs, height).select(F.col("file").alias("f"), F.col("record").alias("r"), "status")
    return ours.join(bad, (F.col("file") == F.col("f")) & (F.col("record") == F.col("r")), "left").select(
        *ours.columns, F.coalesce("status", F.lit("ok")).alias("status"))

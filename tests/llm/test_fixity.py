import hashlib

import pytest
from pyspark.sql import functions as F

from wattframe.llm import fixity


def records(spark, n=400):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"),
                                 F.repeat(F.lit("é<p>"), (F.col("id") % 97).cast("int") * 50).alias("html"))


def layout(df, **k):
    return fixity.index(df, "page_id", F.expr("page_id div 64"), fixity.record_bytes(F.col("url"), F.col("html")), **k)


def test_records_and_offsets(spark):
    got = {r.page_id: r for r in layout(records(spark)).collect()}
    body = "é<p>" * 50
    name = hashlib.md5(b"http://h/1").hexdigest()
    uuid = f"{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}"
    raw = (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid}>\r\nWARC-Target-URI: http://h/1\r\n"
           f"Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n").encode()
    assert got[1].digest == hashlib.sha256(raw).hexdigest() and got[1].length == len(raw)
    assert got[0].offset == 0 and got[2].offset == got[0].length + got[1].length and got[64].offset == 0


@pytest.mark.parametrize("height", [2, 4])
def test_audit_finds_exactly_the_damage(spark, height):
    """Bytes changed (some to another length), records lost and added; laid out anew."""
    src = records(spark)
    ours = fixity.frozen(layout(src))
    longer = F.when(F.col("page_id").isin(0, 63, 64, 200), F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    added = spark.createDataFrame([(65, "http://new", "x")], src.schema)
    theirs = fixity.frozen(layout(src.where("page_id not in (7, 399)").withColumn("html", longer)
                                  .unionByName(added.withColumn("page_id", F.lit(64_000).cast("long")))))
    bad = {(r.file, r.record): r.status for r in fixity.audit(ours, theirs, height).collect()}
    at = {r.page_id: (r.file, r.record) for r in ours.collect()}
    new = [(r.file, r.record) for r in theirs.where("page_id = 64000").collect()]
    assert bad == {at[i]: "corrupt" for i in (0, 63, 64, 200)} | {at[i]: "missing" for i in (7, 399)} | {new[0]: "extra"}
    status = {r.page_id: r.status for r in fixity.audited(ours, theirs, height).collect()}
    assert {i for i, s in status.items() if s != "ok"} == {0, 63, 64, 200, 7, 399}


def test_every_single_lost_record_is_one_missing(spark):
    """Also records that begin ranges of any level."""
    src = records(spark, 300)
    ours = fixity.frozen(fixity.index(src, "page_id", F.lit(1), fixity.record_bytes(F.col("url"), F.col("html"))))
    begins = [r.page_id for r in ours.where(F.col("record").startswith("0")).collect()]
    assert begins
    for lost in (begins[0], begins[-1], 150):
        theirs = fixity.frozen(fixity.index(src.where(F.col("page_id") != lost), "page_id", F.lit(1), fixity.record_bytes(F.col("url"), F.col("html"))))
        assert [(r.record, r.status) for r in fixity.audit(ours, theirs).collect()] == [
            (next(x.record for x in ours.collect() if x.page_id == lost), "missing")]


def test_a_lost_record_changes_only_nodes_above_it(spark):
    src = records(spark)
    a = {(r.file, r.level, r.node): r.hash for r in fixity.tree(layout(src)).collect()}
    b = {(r.file, r.level, r.node): r.hash for r in fixity.tree(layout(src.where("page_id <> 3"))).collect()}
    changed = [k for k in a.keys() | b.keys() if a.get(k) != b.get(k)]
    assert 1 < len(changed) <= 2 * fixity.HEIGHT + 1 and {k[0] for k in changed} == {"0-0"}


def test_equal_replicas_and_roots_only(spark):
    ours = fixity.frozen(layout(records(spark)))
    assert fixity.audit(ours, ours).count() == 0
    roots = fixity.tree(ours).where(F.col("level") == fixity.HEIGHT)
    assert roots.count() == ours.select("file").distinct().count()


def test_a_large_file_is_dealt_alike_in_replicas_indexed_apart(spark):
    src = records(spark)
    content, ident = fixity.record_bytes(F.col("url"), F.col("html")), [F.col("page_id"), F.col("url")]
    parts = fixity.layout(src, F.lit(1), ident, 50)
    ours = fixity.frozen(fixity.index(src, "page_id", F.lit(1), content, ident, parts))
    theirs = fixity.frozen(fixity.index(src.where("page_id <> 5").repartition(7), "page_id", F.lit(1), content, ident, parts))
    assert ours.select("file").distinct().count() > 4
    assert [r.status for r in fixity.audit(ours, theirs).collect()] == ["missing"]


def test_nulls_repeats_hot_file_and_empty(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "x"), (None, None, ""), *[(3, "same", "page")] * 50]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, offset string")
    out = layout(df, file_records=10).collect()
    assert len(out) == len(rows) and len({r.file for r in out}) > 3
    files = {}
    for r in out:
        files.setdefault(r.file, []).append((r.offset, r.length))
    for parts in files.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    ours = fixity.frozen(layout(df, file_records=10))
    assert fixity.audited(ours, ours).where("status = 'ok'").count() == len(rows)
    empty = fixity.frozen(layout(df.limit(0)))
    assert fixity.audited(empty, empty).count() == 0

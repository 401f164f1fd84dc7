"""Fixity audit of web archive replicas by Merkle trees.

A replica holds files of records; each record has an id, a byte range and a digest.  A record's number, the same in
every replica, gives its leaf: a leaf hashes lengths and digests of its records in offset order, and a node hashes
its `FAN` children in order and, where these lie end to end, the ranges of bytes they span, measured from its own begin.
Roots of two replicas are compared first, only children of nodes that differ are looked at, level by level, and under
leaves that differ records are compared by id.  As numbers and not places align the trees, and a range counts only where no
other record can lie within it, a lost or inserted record changes the nodes above it alone, and not all that follows.
Records of a derived table are numbered in order; those of stored files by a hash of their id, as replicas that differ have
no other numbers in common, so there a tree is over the hashes' order.

Records are hashed where they are read; only ranges and digests are shuffled.  A file's records are put in order in
one task, files being of bounded length, as archive files are; pages without page_id form files of their own, by
digest.  Records of equal files and ids count as one record with several digests.  Rows without file or offset take
no part.  A file or record that only one replica has is reported as missing or extra.  Empty tables give empty
results; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.tables import scratch, stored

FAN = 16
PER_FILE = 1024
HEIGHT = 3  # levels above the leaves: FAN ** HEIGHT numbers a file
INDEX = "id string, file string, number long, start long, length long, digest string"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record; null url or html count as empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """page_id, file, record: pages as records of files that hold `per_file` page numbers each; those without page_id lie in files below 0, by digest."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    alone = -1 - F.conv(F.substring(F.sha2(record, 256), 1, 8), 16, 10).cast("long")
    return pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / per_file).cast("long"), alone).alias("file"), record.alias("record"))


def record_index(records: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """page_id, id, file, number, place (from 0), start, length, digest of records in order of page_id within their file."""
    hashed = records.select("page_id", F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("id"), "file", F.coalesce(F.pmod("page_id", F.lit(per_file)), F.lit(0)).cast("long").alias("number"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    by = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    return hashed.withColumns({"place": (F.row_number().over(by) - 1).cast("long"), "start": F.sum("length").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")})


def _member(raw: bytes, at: int) -> tuple[bytes, int]:
    """The record in the gzip member at a place, and the member's length; a damaged or cut member is a record up to the end, as it stands.

    The member is fed in growing steps, so its own bytes are read, not all that follow.
    """
    member, view, parts, place, step = zlib.decompressobj(31), memoryview(raw), [], at, 4096
    try:
        while not member.eof and place < len(raw):
            parts.append(member.decompress(view[place : place + step]))
            place, step = min(place + step, len(raw)), min(2 * step, 1 << 20)
    except zlib.error:
        return raw[at:], len(raw) - at
    if not member.eof:
        return raw[at:], len(raw) - at
    return b"".join(parts), place - at - len(member.unused_data)


def _records(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of a WARC file, plain or with a gzip member a record; what cannot be read is one record up to the end."""
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\x1f\x8b":
            record, length = _member(raw, at)
        else:
            end = raw.find(b"\r\n\r\n", at)
            size = next((int(v) for k, _, v in (h.partition(b":") for h in raw[at : max(end, at)].split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
            length = len(raw) - at if end < 0 or size is None else min(end + 4 + size + 4, len(raw)) - at
            record = raw[at : at + length]
        yield at, length, record
        at += length


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The index of all WARC files of a replica's folder; file is a file's name, id the WARC-Record-ID (without one: the digest)."""

    def run(batches):
        for batch in batches:
            out = []
            for where, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for start, length, record in _records(raw):
                    digest = hashlib.sha256(record).hexdigest()
                    heads = record.partition(b"\r\n\r\n")[0].split(b"\r\n")
                    own = next((v.strip().decode("latin-1") for k, _, v in (h.partition(b":") for h in heads) if k.strip().lower() == b"warc-record-id"), digest)
                    number = int.from_bytes(hashlib.sha256(own.encode()).digest()[:4], "big") % FAN**HEIGHT
                    out.append((own, where.rpartition("/")[2], number, start, length, digest))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["id", "file", "number", "start", "length", "digest"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("id", pa.string()), ("file", pa.string()), ("number", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("digest", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, INDEX)


def leaves(index: DataFrame) -> DataFrame:
    """Level 0 of the trees: file, place (the records' number), low and high (byte range), whole (no gap within), node (hash)."""
    known = index.where("file is not null and start is not null")
    order = F.array_sort(F.collect_list(F.struct("start", "length", "digest")))
    return known.groupBy("file", F.col("number").alias("place")).agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("length")).alias("high"), F.sum("length").alias("size"), order.alias("r")).select("file", "place", "low", "high", (F.col("high") - F.col("low") == F.col("size")).alias("whole"), F.sha2(F.concat_ws(",", F.transform("r", lambda r: F.concat_ws(":", r["length"], r["digest"]))), 256).alias("node"))


def parents(level: DataFrame) -> DataFrame:
    """The next level: every FAN nodes become one, with their ranges where these tile its own."""
    children = F.array_sort(F.collect_list(F.struct("place", "low", "high", "node")))
    up = level.groupBy("file", F.floor(F.col("place") / FAN).alias("up")).agg(F.min("low").alias("low"), F.max("high").alias("high"), children.alias("children"), F.every("whole").alias("all"), F.sum(F.col("high") - F.col("low")).alias("size"))
    up = up.withColumn("whole", F.col("all") & (F.col("high") - F.col("low") == F.col("size")))
    ranges = lambda c: F.when(F.col("whole"), F.concat_ws(":", c["low"] - F.col("low"), c["high"] - F.col("low"))).otherwise("")
    parts = F.transform("children", lambda c: F.concat_ws(":", c["place"], ranges(c), c["node"]))
    return up.select("file", F.col("up").alias("place"), "low", "high", "whole", F.sha2(F.concat_ws(",", parts), 256).alias("node"))


def tree(level: DataFrame, height: int) -> list[DataFrame]:
    levels = [stored(level, "leaves")]
    for _ in range(height):
        levels.append(stored(parents(levels[-1]), "nodes"))
    return levels


def differing(one: DataFrame, two: DataFrame, under: DataFrame | None) -> DataFrame:
    """file and place of the nodes of a level that differ or that one replica lacks, among children of `under`."""
    if under is not None:
        above = under.select(F.col("file"), F.col("place").alias("up"))
        one, two = (x.withColumn("up", F.floor(F.col("place") / FAN)).join(above, ["file", "up"], "left_semi").drop("up") for x in (one, two))
    both = one.select("file", "place", "node").join(two.select("file", "place", F.col("node").alias("other")), ["file", "place"], "full_outer")
    return both.where(~F.col("node").eqNullSafe(F.col("other"))).select("file", "place")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged records of a replica: file, id, low, high (range in the primary, or in the replica where only that has it), fault (altered, missing or extra).  Both are index tables."""
    spark = primary.sparkSession
    with scratch(spark):
        one, two = leaves(primary), leaves(replica)
        last = one.select("place").union(two.select("place")).agg(F.max("place")).first()[0] or 0
        height = 0
        while FAN**height <= last:
            height += 1
        trees = tree(one, height), tree(two, height)
        under = None
        for level in range(height, -1, -1):
            under = stored(differing(trees[0][level], trees[1][level], under), "differing")
        under = under.withColumnRenamed("place", "number")

        def records(index: DataFrame, k: int) -> DataFrame:
            near = index.join(under, ["file", "number"], "left_semi").groupBy("file", "id")
            return near.agg(F.min("start").alias(f"low_{k}"), F.max(F.col("start") + F.col("length")).alias(f"high_{k}"), F.array_sort(F.collect_list("digest")).alias(f"d_{k}"))

        both = records(primary, 1).join(records(replica, 2), ["file", "id"], "full_outer")
        fault = F.when(F.col("d_2").isNull(), "missing").when(F.col("d_1").isNull(), "extra").when(F.col("d_1") != F.col("d_2"), "altered")
        both = both.withColumn("fault", fault).where("fault is not null")
        return stored(both.select("file", "id", F.coalesce("low_1", "low_2").alias("low"), F.coalesce("high_1", "high_2").alias("high"), "fault"), "faults", outer=True)


def damaged(records: DataFrame) -> DataFrame:
    """A replica with planted damage, by the MD5 of page_id: one letter changed, a record zeroed, lost or preceded by a foreign one, and the last records of some files lost."""
    draw = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    record = F.when(draw == "00", F.concat(F.substring("record", 1, 20), F.lit("#"), F.expr("substring(record, 22)"))).when(draw == "01", F.repeat(F.lit("0"), F.octet_length("record"))).otherwise(F.col("record"))
    lost = (draw == "02") | ((F.pmod("file", F.lit(7)) == 3) & (F.pmod("page_id", F.lit(PER_FILE)) >= 1000))
    return records.where(~F.coalesce(lost, F.lit(False))).withColumn("record", record)


def audit_pages(pages: DataFrame) -> DataFrame:
    """Every page's record and what the audit of the damaged replica says of it."""
    records = archive(pages)
    index = stored(record_index(records), "index")
    replica = record_index(damaged(records))
    foreign = replica.where("page_id % 97 = 5").withColumn("id", F.concat("id", F.lit("-foreign"))).withColumn("start", F.col("start") - F.col("length") / 2)
    found = audit(index, stored(replica.unionByName(foreign.withColumn("start", F.col("start").cast("long"))), "replica"))
    return index.join(found.select("file", "id", "fault"), ["file", "id"], "left").select("page_id", "file", "place", "start", "length", "digest", F.coalesce("fault", F.lit("intact")).alias("status"))


SQL = """
WITH r AS (
  SELECT page_id, coalesce(html, '') AS body,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
h AS (SELECT page_id, coalesce(floor(page_id / 1024)::BIGINT, -1 - ('0x' || substr(sha256(record), 1, 8))::BIGINT) AS file, strlen(record)::BIGINT AS length, sha256(record) AS digest, substr(md5(page_id::VARCHAR), 1, 2) AS draw FROM r)
SELECT page_id, file, (row_number() OVER w - 1)::BIGINT AS place, (sum(length) OVER w - length)::BIGINT AS start, length, digest,
  CASE WHEN draw = '02' OR (file % 7 = 3 AND page_id % 1024 >= 1000) THEN 'missing' WHEN draw IN ('00', '01') THEN 'altered' ELSE 'intact' END AS status
FROM h WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
